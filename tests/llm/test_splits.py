import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from varspark.llm import common as c
from varspark.llm.decontaminate import decontaminate
from varspark.llm.quality_rules import quality_rules
from varspark.llm.toxicity import toxicity

SIZE = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    """One file of many row groups; each text stands twice but for its last word, far apart."""
    path = str(tmp_path_factory.mktemp("splits") / "docs.parquet")
    text = lambda i: " ".join(f"w{i % 150}_{j}" for j in range(80)) + " damn" * (i % 150 % 3) + f" {i // 150}"
    pq.write_table(pa.table({"doc_id": range(300), "text": [text(i) for i in range(300)]}), path, row_group_size=20)
    return path


def labelled(docs):
    return toxicity(docs, docs.selectExpr("doc_id", "cast(doc_id % 150 % 3 > 0 as int) AS toxic"))


def cleaned(docs):
    items = docs.where("doc_id % 9 = 0").selectExpr("doc_id AS item_id", "substring_index(text, ' ', 40) AS text")
    return decontaminate(docs, items, slice_bytes=2000)


def ruled(docs):
    return quality_rules(docs.selectExpr("doc_id", "replace(text, '_7', '_7\n') AS text", "concat('s', doc_id % 3) AS source"), min_docs=1, share=0.0)


@pytest.mark.parametrize("operator", [labelled, cleaned, ruled])
def test_passes_may_be_planned_with_other_splits(spark, monkeypatch, path, operator):
    before, deliver = spark.conf.get(SIZE), c.deliver
    docs = spark.read.parquet(path)
    want = sorted(map(str, operator(docs).collect()))
    splits = set()

    def planned_anew(*args):
        out = deliver(*args)
        spark.conf.set(SIZE, "8k" if spark.conf.get(SIZE) == before else before)
        splits.add(spark.read.parquet(path).rdd.getNumPartitions())
        return out

    monkeypatch.setattr(c, "deliver", planned_anew)
    try:
        got = sorted(map(str, operator(docs).collect()))
    finally:
        spark.conf.set(SIZE, before)
    assert max(splits) > 1 and got == want


def test_an_unknown_split_is_an_error(spark, path):
    docs = c.with_split(spark.read.parquet(path))
    split = docs.first()._split
    told = c.deliver(spark.createDataFrame([], "key long, _split long"), "t", docs)
    assert c.delivered(told, split, ["key"]) is None
    with pytest.raises(ValueError, match="doesn't know"):
        c.delivered(told, 12345, ["key"])
