from fractions import Fraction

import pytest

from varspark.llm import mixing
from varspark.llm.mixing import WEIGHTS, mix, op9_mixing, period, shared


@pytest.mark.parametrize("weights", [shared(WEIGHTS, 50, ["x", "y", None]), {"a": 1}, {"a": 3, "b": 3, None: 1}, {"a": 7, "b": 5, "c": 2, "d": 1, None: 8}, {"a": 997, "b": 2, None: 1}])
def test_less_than_one_block_off(weights):
    q = sum(weights.values())
    seen = dict.fromkeys(weights, 0)
    for t, s in enumerate(period(weights), 1):
        seen[s] += 1
        assert all(abs(seen[x] - Fraction(weights[x] * t, q)) < 1 for x in weights)
    assert seen == weights


def test_bad_weights():
    for w in ({}, {"a": 0}, {"a": -1, "b": 2}, {"a": 100_001}):
        with pytest.raises(ValueError):
            period(w)


def test_mixture(spark):
    rows = [(i, f"t{i}", "src0" if i % 3 else "src1") for i in range(900)] + [(None, "n", None), (None, "n", None), (None, None, "other"), (5, "t5", "src0")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mix_pos int")
    weights = {"src0": 3, "src1": 1}
    out = mix(df, weights, 1, 10)
    assert out.columns == ["doc_id", "text", "source", "mix_block", "mix_slot", "mix_pos"]
    got = out.orderBy("mix_slot", "mix_pos").collect()
    assert sorted(str(tuple(r)[:3]) for r in got) == sorted(map(str, rows))  # every row once
    assert len({(r.mix_slot, r.mix_pos) for r in got}) == len(got)
    share = shared(weights, 1, ["other", None])  # each source without a weight is a class of its own
    assert share == {"src0": 6, "src1": 2, "other": 1, None: 1}
    slots = {r.mix_slot: r.source for r in got}
    end = min(max(s for s, x in slots.items() if x == "src0"), max(s for s, x in slots.items() if x == "src1"))
    for x in ("src0", "src1"):
        seen = 0
        for s in range(end + 1):
            seen += slots.get(s, "") == x
            assert abs(seen - Fraction(share[x] * (s + 1), 10)) < 1
    assert mix(df.where("false"), weights).count() == 0
    only = mix(df, {"src0": 1}, 0, 10).orderBy("mix_slot", "mix_pos").collect()
    assert len(only) == len(rows) and only[0].source == "src0" and only[-1].source != "src0"


def test_query_is_whole(spark):
    sf = "/root/testdata/sf0.001"
    rows = op9_mixing(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() == len({(r.mix_slot, r.mix_pos) for r in rows})


def test_column_names_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_OTHERS", 4)
    df = spark.createDataFrame([(i if i % 5 else None, f"t{i}", f"s{i % 9}", 7, i) for i in range(300)], "doc_id long, text string, source string, class int, `a b.c` int")
    out = mix(df, {"s1": 2}, 3, 4)
    assert out.columns == [*df.columns, "mix_block", "mix_slot", "mix_pos"]
    got = out.collect()
    assert sorted(r[4] for r in got) == list(range(300)) and {r[3] for r in got} == {7}
    assert len({(r.mix_slot, r.mix_pos) for r in got}) == 300
