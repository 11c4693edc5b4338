"""Mixing sources to target weights by Pfair scheduling.

Block k (from 0) of a source with weight w is released at slot floor(k / w) and due by
ceil((k + 1) / w). Earliest deadline first then gives every slot to one block, and after any number
of slots a source is less than one block away from its share. With integer weights the
schedule repeats after sum(weights) slots, so only one period is scheduled (on the driver, its size
is the sum of the weights, which is checked), and a block finds its slot by arithmetic.

Sources without a weight of their own share the weight ``rest`` evenly, each with blocks, releases and deadlines of its own.

The rank of a document in its source is made of a bucket's offset and a rank inside the bucket, so
that no source is ever sorted in one task; the number of buckets follows the number of documents.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

BUCKETS = 4096  # of a source, at least
BUCKET_ROWS = 100_000  # documents for each bucket, all sources together
MAX_PERIOD = 100_000
MAX_OTHERS = 1000  # sources without a weight that are classes of their own; if there are more, they are dealt to so many classes by hash
WEIGHTS = {"src0": 10, "src1": 20, "src2": 15, "src3": 5}
REST = 50
BLOCK = 16


def period(weights: dict[str | None, int]) -> list[str | None]:
    """The source class of each slot of one period."""
    q = sum(weights.values())
    if not 0 < q <= MAX_PERIOD or min(weights.values()) <= 0:
        raise ValueError(f"weights must be positive integers with a sum of at most {MAX_PERIOD}")
    classes = sorted(weights, key=lambda s: (s is None, s or ""))
    by_release: dict[int, list[tuple[int, int]]] = {}
    for i, s in enumerate(classes):
        p = weights[s]
        for k in range(p):
            by_release.setdefault(k * q // p, []).append((-(-(k + 1) * q // p), i))
    ready: list[tuple[int, int]] = []
    out = []
    for slot in range(q):
        for item in by_release.get(slot, ()):
            heapq.heappush(ready, item)
        out.append(classes[heapq.heappop(ready)[1]])
    return out


def places(weights: dict[str | None, int]) -> list[tuple[int, int, int, int]]:
    """(class number, blocks a period, number of the block, its slot); classes are numbered in order of weights."""
    order, seen, out = {s: i for i, s in enumerate(weights)}, dict.fromkeys(weights, 0), []
    for slot, s in enumerate(period(weights)):
        out.append((order[s], weights[s], seen[s], slot))
        seen[s] += 1
    return out


def shared(weights: dict[str, int], rest: int, others: list[str | None]) -> dict[str | None, int]:
    """Whole weights of all classes: the given ones, and ``rest`` split evenly over others."""
    out = {s: w * max(1, len(others)) for s, w in weights.items()} | (dict.fromkeys(others, rest) if rest else {})
    shrink = math.gcd(*out.values()) if out else 1
    return {s: w // max(1, shrink) for s, w in out.items()}


def mix(docs: DataFrame, weights: dict[str, int] = WEIGHTS, rest: int = REST, block: int = BLOCK) -> DataFrame:
    """docs with mix_block (number of the block in its source), mix_slot and mix_pos (place in the block).

    Reading by (mix_slot, mix_pos) gives the mixture. Every row comes out once. While each source has
    blocks left, its share of any prefix is less than a block off; afterwards the others go on by
    their own slots. Sources without a weight share ``rest``, null among them (with
    rest 0 they come last, in slots of their own). Null doc_ids are spread by their text and sort last in a bucket; equal rows are told
    apart by their text. Columns named mix_* are replaced, all others are returned, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_block", "mix_slot", "mix_pos")
    plain, names = c.plain(docs)
    doc_id, text, source = (names[x] for x in ("doc_id", "text", "source"))
    found = docs.select("source").where(F.col("source").isNull() | ~F.col("source").isin(list(weights))).distinct().limit(MAX_OTHERS + 1)
    others = sorted((r.source for r in found.collect()), key=lambda s: (s is None, s or ""))
    hashed = len(others) > MAX_OTHERS
    if hashed:
        others = [f"\0{i}" for i in range(MAX_OTHERS)]
    classes = shared(weights, rest, others)
    if not classes:
        raise ValueError("weights and rest give no class")
    total = docs.count()
    buckets = max(BUCKETS, -(-total // BUCKET_ROWS))
    # at most the weights and MAX_OTHERS rows
    known = F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(classes)], "name string, class int"))
    name = F.when(F.col(source).isin(list(weights)), F.col(source)).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64(source), F.lit(MAX_OTHERS)))) if hashed else F.col(source)
    key = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))
    rows = plain.join(known, name.eqNullSafe(F.col("name")), "left").drop("name").withColumn("class", F.coalesce("class", F.lit(-1)))
    rows = rows.withColumn("bucket", F.pmod(F.pmod(key, F.lit(1000003)) * 7919, F.lit(buckets)))
    counts = rows.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("class", "bucket").orderBy(F.col(doc_id).asc_nulls_last(), F.xxhash64(text)))
    ranked = rows.withColumn("rank", rank).join(offsets, ["class", "bucket"]).withColumn("rank", F.col("rank") + F.col("before") - 1)
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block)).withColumn("pos", F.col("rank") % block)
    # at most MAX_PERIOD rows
    table = F.broadcast(spark.createDataFrame([*places(classes), (-1, 1, 0, 0)], "class int, each long, k long, slot long"))
    sizes = F.broadcast(spark.createDataFrame([*((i, w) for i, w in enumerate(classes.values())), (-1, 1)], "class int, size long"))
    placed = ranked.join(sizes, "class").withColumn("k", F.col("block") % F.col("size")).join(table, ["class", "k"])
    slot = F.floor(F.col("block") / F.col("each")) * sum(classes.values()) + F.col("slot")
    # sources outside all classes follow after every slot in use
    slot = F.when(F.col("class") < 0, F.col("block") + (1 << 60)).otherwise(slot)
    return placed.select(*names.values(), "block", slot.alias("slot"), "pos").toDF(*docs.columns, "mix_block", "mix_slot", "mix_pos")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs.withColumn("text", F.xxhash64("text").cast("string"))).drop("text")


# earliest deadline first, slot by slot: ks are the blocks that each class has placed, pick is the class of the slot
OP9_SQL = f"""
WITH RECURSIVE named(source, w) AS (VALUES {", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())}),
others AS (SELECT DISTINCT source FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM named)),
raw AS (SELECT source, w * greatest(1, (SELECT count(*) FROM others)) AS p FROM named UNION ALL SELECT source, {REST} FROM others),
cls AS (SELECT source, CAST(p // (SELECT list_reduce(list(p), lambda a, b: gcd(a, b)) FROM raw) AS BIGINT) AS p, row_number() OVER (ORDER BY source NULLS LAST) AS c FROM raw),
par AS (SELECT list(p ORDER BY c) AS ps, CAST(sum(p) AS BIGINT) AS q, count(*) AS n FROM cls),
s(t, ks, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ps, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM par
  UNION ALL
  SELECT t + 1, list_transform(range(1, n + 1), lambda i: ks[i] + CASE WHEN i = d.pick THEN 1 ELSE 0 END), d.pick
  FROM (SELECT t, ks, q, n, CAST(list_position(due, list_min(due)) AS BIGINT) AS pick
        FROM (SELECT t, ks, q, n, list_transform(range(1, n + 1), lambda i: CASE WHEN ks[i] * q // ps[i] <= t + 1 THEN ((ks[i] + 1) * q + ps[i] - 1) // ps[i] ELSE 1000000000 END) AS due FROM s, par WHERE t + 1 < q)) d
),
p AS (SELECT cls.source, cls.p AS each, s.t AS slot, row_number() OVER (PARTITION BY s.pick ORDER BY s.t) - 1 AS k FROM s JOIN cls ON cls.c = s.pick),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ((doc_id % 1000003) * 7919) % {BUCKETS}, doc_id) - 1 AS rnk FROM documents),
b AS (SELECT *, CAST(rnk // {BLOCK} AS BIGINT) AS mix_block, CAST(rnk % {BLOCK} AS BIGINT) AS mix_pos FROM r)
SELECT b.doc_id, b.source, b.mix_block, CAST((b.mix_block // p.each) * (SELECT q FROM par) + p.slot AS BIGINT) AS mix_slot, b.mix_pos
FROM b JOIN p ON p.source IS NOT DISTINCT FROM b.source AND p.k = b.mix_block % p.each
"""
