import hashlib
import re

import pytest
from pyspark.sql import types as T

from varspark.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n):
    first = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, 1 << 63), 1 << 63 if doc is None else doc)
    out = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (1 << 63 if doc is None else doc):
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, n):
    return sorted(map(tuple, substring_dedup(df, n, with_text=False).collect()), key=str)


def test_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert run(df, 50) == brute(rows, 50)


@pytest.mark.parametrize("n", [1, 3])
def test_edge_rows(spark, n):
    rows = [(3, "a b c dé e a b c"), (1, "x a b\tc\n"), (1, "x a b c"), (None, "a b c"), (None, None), (7, ""), (8, "  \n"), (2, "q " * 5000 + "a b c"), (9, "a b c dé"), (9, "a b c dé")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())])
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    assert run(df, n) == brute(rows, n)
    assert run(df.where("false"), n) == []
