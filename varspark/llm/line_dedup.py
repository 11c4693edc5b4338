"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

The store is a log-structured set: every batch of documents (batches come in doc_id order) takes the
keys it holds, merge-anti-joins them against the runs, and adds the keys that are new as one more
run. Runs are tables bucketed and sorted by hash, so the join reads them in place, without a
shuffle of the runs. When ``fanout`` runs share a level, they are merged into one run of the next.

Keys are combined (smallest and largest doc_id) before any shuffle, so a line that a third of all
documents hold costs one row per task. Texts are shuffled once, to meet their dropped positions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

HASH = ["h1", "h2"]
LAST = 0x7FFFFFFFFFFFFFFF
SALTS = 8  # places where a repeated line meets its key
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs of the 128-bit line hashes seen so far; keys of different runs are disjoint.

    A run is an external table, its files are in the shared folder.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, keys: DataFrame) -> str:
        path = c.scratch(self.spark, "op7-run")
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = path
        keys.select(*HASH).repartition(self.buckets, *HASH).write.option("path", path).bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").saveAsTable(name)
        return name

    def new(self, keys: DataFrame) -> DataFrame:
        """Those rows of keys that no run holds."""
        for run in sum(self.levels, []):
            keys = keys.join(self.spark.table(run).hint("merge"), HASH, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add keys that new() returned as a run; compact levels that are full."""
        run, level = self._write(keys), 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.union(self.spark.table(other))
            run, level = self._write(merged), level + 1
            self.drop(full)

    def drop(self, names: list[str] | None = None) -> None:
        for name in list(self.paths) if names is None else names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            c.drop_path(self.spark, self.paths.pop(name))


def _dropped(docs: DataFrame, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """Positions (array gone) of the lines to drop, for the documents that have any. docs: ord, text."""
    spark = docs.sparkSession
    cuts = docs.agg(F.expr(f"approx_percentile(ord, array({', '.join(str(i / batches) for i in range(1, batches))}), 1000)")).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    keyed = docs.select("ord", F.xxhash64("text").alias("body"), F.posexplode(F.transform(text_lines(F.col("text")), line_key)).alias("pos", "key"))
    keyed = keyed.where(F.length("key") >= min_chars).select("ord", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    lines = c.keep(keyed, "op7-lines")
    # lines meet their keys in SALTS places, so that a line that a third of all documents hold isn't one task's
    salt = F.pmod(F.xxhash64("ord", "pos"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    parts, done = [], [lines]
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            batch = lines
            if low is not None:
                batch = batch.where(F.col("ord") > low)
            if high is not None:
                batch = batch.where(F.col("ord") <= high)
            keys = c.keep(batch.groupBy(*HASH).agg(F.min("ord").alias("first"), F.max("ord").alias("last")), "op7-keys")
            new = c.keep(runs.new(keys), "op7-new")
            done += [keys, new]
            # of a new key, lines of later documents go; of a key seen before, all
            within = new.where("first < last").select(*HASH, "first")
            seen = keys.join(new.select(*HASH), HASH, "left_anti").select(*HASH, F.lit(None).cast("long").alias("first"))
            gone = batch.select("*", salt).join(within.union(seen).select("*", salts), [*HASH, "salt"]).where("first IS NULL OR ord > first")
            parts.append(gone.groupBy("ord", "body").agg(F.collect_set("pos").alias("gone")))
            if high is not None:
                runs.add(new)
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return c.keep(out, "op7-gone")
    finally:
        runs.drop()
        c.drop(*done)


def line_dedup(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with its text deduplicated, and n_lines, n_dropped.

    A key of at least ``min_chars`` code points that several doc_ids hold stays only in the smallest.
    A null text is one empty line and comes back as an empty text. A null doc_id sorts last. Rows with
    the same doc_id count as one document. All columns of docs are returned, whatever their names; columns named n_lines or
    n_dropped are replaced. An empty table gives an empty one.
    """
    docs = docs.drop("n_lines", "n_dropped")
    rows, names = c.plain(docs)
    text = names["text"]
    rows = rows.withColumn("ord", F.coalesce(F.col(names["doc_id"]).cast("long"), F.lit(LAST))).withColumn("body", F.xxhash64(text))
    gone = _dropped(rows.select("ord", F.col(text).alias("text")), min_chars, batches, fanout)
    lines = text_lines(F.col(text))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = rows.join(gone, ["ord", "body"], "left")
    columns = [kept.alias(x) if x == text else F.col(x) for x in names.values()]
    return out.select(*columns, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")).toDF(*docs.columns, "n_lines", "n_dropped")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id > f.first, false) AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
