import hashlib

import pytest
from pyspark.sql import functions as F

from varspark.llm.line_dedup import LineRuns, line_dedup, op7_line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    order = lambda d: (d is None, d or 0)
    key = lambda x: x.strip(SPACE).translate(LOWER)
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                first[key(x)] = min(order(d), first.get(key(x), order(d)))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if first.get(key(x), order(d)) == order(d)]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op7_line_dedup(spark, sf).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_edge_rows(spark, batches):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "short\nA longer line here"), (5, " a LONGER line here\t\nshort"), (5, "a longer line here\nother"), (6, "éééééééééé\nÉéééééééééé"), (7, "éééééééééé"), (None, "a longer line here\nonly with nobody"), (None, "only with nobody"), (8, "twice in one doc\ntwice in one doc"), (9, "x" * 200000 + "\nA longer line here"), (9, "x" * 200000 + "\nA longer line here"), (-4, "other\r\nnot ten ch")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_lines string")
    out = line_dedup(df, batches=batches, fanout=2)
    assert sorted(map(tuple, out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()), key=str) == brute(rows)
    assert line_dedup(df.where("false"), batches=batches).count() == 0


def test_levels(spark):
    runs = LineRuns(spark, 4, fanout=2)
    for i in range(5):
        keys = spark.range(i * 10, i * 10 + 15).select(F.col("id").alias("h1"), (F.col("id") * 7).alias("h2"))
        new = runs.new(keys)
        assert new.count() == (15 if i == 0 else 10)
        runs.add(new)
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # 5 runs: one of 4, one of 1
    assert sum(spark.table(n).count() for level in runs.levels for n in level) == 55
    plan = runs.new(keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1  # runs are read in place
    runs.drop()


def test_column_names(spark):
    df = spark.createDataFrame([(1, "a line of text", 1, "x"), (2, "a line of text\nmore", 2, "y")], "doc_id long, text string, _ord int, `body of.it` string")
    out = line_dedup(df, batches=1)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(1, "a line of text", 1, "x", 1, 0), (2, "more", 2, "y", 2, 1)]
    assert spark.sql("SHOW TABLES LIKE 'line_run_*'").count() == 0
