import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varspark.llm import common as c
from varspark.llm.lm_score import lm_score
from varspark.llm.near_dedup import near_dedup
from varspark.llm.substring_dedup import substring_dedup
from varspark.llm.suffix_dedup import suffix_dedup

SIZE = "spark.sql.files.maxPartitionBytes"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**62 - 1) | st.integers(0, 300), max_size=60))
def test_gaps(values):
    values = np.sort(np.array(values, np.int64))
    assert (c.ungaps(c.gaps(values)) == values).all()
    keys, (a, b) = c.unpack(c.pack(values, [values.astype(np.uint32), values > 5]), ["<u4", "?"])
    assert (keys == values).all() and (a == values.astype(np.uint32)).all() and (b == (values > 5)).all()


def test_shards_are_ranges():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**62, 10_000))
    for n in (1, 3, 5000, 1 << 24):
        shard = c.shard_of(keys, n)
        assert (np.diff(shard) >= 0).all() and shard.min() >= 0 and shard.max() < n
    assert (np.bincount(c.shard_of(keys, 10)) > 800).all()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Files of many row groups; texts repeat far apart, nulls among them."""
    path = str(tmp_path_factory.mktemp("routing") / "docs.parquet")
    text = lambda i: None if i % 37 == 0 else " ".join(f"w{i % 150}_{j}" for j in range(80)) + f" {i // 150} " + " ".join(f"r{(i * 7 + j) % 90}" for j in range(60))
    pq.write_table(pa.table({"doc_id": [i if i % 41 else None for i in range(450)], "text": [text(i) for i in range(450)]}), path, row_group_size=20)
    return spark.read.parquet(path)


def scores(docs):
    return lm_score(docs, F.col("doc_id") % 7 == 2).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), F.round("score", 6))


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup, scores, near_dedup])
def test_many_units_shards_and_relays(spark, monkeypatch, docs, operator):
    """Many small units and shards, messages through relays, passes planned with other splits: the same result."""
    want = sorted(map(str, operator(docs).collect()))
    monkeypatch.setattr(c, "UNIT_BYTES", 8000)
    monkeypatch.setattr(c, "SHARD_BYTES", 16_000)
    monkeypatch.setattr(c, "FAN", 4)
    before, deliver, units = spark.conf.get(SIZE), c.deliver, []

    def planned_anew(answers, name, known, by="_split"):
        out = deliver(answers, name, known, by)
        spark.conf.set(SIZE, "16k" if spark.conf.get(SIZE) == before else before)
        units.append(known.count())
        return out

    monkeypatch.setattr(c, "deliver", planned_anew)
    try:
        got = sorted(map(str, operator(docs).collect()))
    finally:
        spark.conf.set(SIZE, before)
    assert units[0] > 20 and c.shard_count(docs) > 16 and got == want


def test_an_unknown_unit_is_an_error(spark, docs):
    packed = c.units(docs, "t")
    told = c.deliver(spark.createDataFrame([], "body binary, unit long"), "t", packed, "unit")
    assert c.delivered(told, packed.first().unit, ["body"], "unit") is None
    with pytest.raises(ValueError, match="doesn't know"):
        c.delivered(told, 12345, ["body"], "unit")


def test_units_give_rows_back(spark, docs):
    def back(unit):
        yield c.table(doc_id=unit.doc_id, text=pa.array([unit.text(i).decode() for i in range(unit.n)]), more=unit.longs[0])

    more = docs.withColumn("more", F.xxhash64("text"))
    got = c.units(more, "t", "more").mapInArrow(c.each_unit(back), "doc_id long, text string, more long")
    assert sorted(map(str, got.collect())) == sorted(map(str, more.fillna("").collect()))
