"""Near-duplicate detection with SetSketch registers.

1. Every document's set of word shingles gets a SetSketch: exponentially spaced, truncated minima
   of m independent Poisson processes. Registers merge by maximum and collide about as often as
   the Jaccard similarity. Equal sets (by 128 bits) become one class.
2. Registers are banded. In each bucket, every class is paired with the bucket's smallest class, so a
   bucket of g classes gives g - 1 pairs. A pair passes if the joint likelihood of its registers doesn't rule
   out the threshold; then the full sets are compared.
3. Components are formed. Only buckets whose classes still lie in several components are gone through
   again: small ones by all pairs of classes from different components; the components of large ones are
   joined to clusters, whose classes are compared in blocks of similar set sizes, by counts of common shingles over an inverted index, of
   which only links that join components come out as rows.
4. Components are formed again, and named by their smallest doc_id.

With the production bands, a pair at the threshold misses all buckets with a probability below 1e-9.
Only texts of classes in candidate pairs are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

M, BANDS, BAND = 252, 42, 6  # registers, bands, registers of a band
BASE, SHIFT = 1.08, 30  # spacing of register values; value SHIFT + 1 is a minimum of 1
DOUBT = 15.0  # log likelihood ratio that rules a pair out
SMALL = 32  # classes of a bucket that are paired in the JVM when it is gone through again
BLOCK = 1 << 17  # shingles of a block of a cluster's classes, which is compared with other blocks
SALTS = 8  # places where a node's label meets its neighbours
LAST = 0x7FFFFFFFFFFFFFFF


# ---------------------------------------------------------------- sets and sketches


def shingles(data: np.ndarray, at: np.ndarray, k: int):
    """Distinct shingles of all rows: two hashes and the row of each (rows ascending), and the number per row."""
    start, end, first = c.words(data, at)
    hashes = [c.word_hashes(data, start, end, i, lower=True) for i in (0, 1)]
    where, row = c.windows(first, k)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    out = []
    for i, x in enumerate(hashes):
        prefix = c.prefix_hash(x, i + 2)
        whole = c.mix(c.range_hash(prefix, first[short], first[short + 1], i + 2))
        out.append(np.concatenate([c.mix(c.range_hash(prefix, where, where + k, i + 2)), whole]))
    row = np.concatenate([row, short])
    order = np.lexsort((out[0], row))
    h, g, row = out[0][order], out[1][order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, g, row = h[new], g[new], row[new]
    return h, g, row, np.bincount(row, minlength=len(at) - 1)


def sketch(h: np.ndarray, row: np.ndarray, rows: int, m: int = M) -> np.ndarray:
    """SetSketch registers (rows x m bytes) of the sets {h | row}."""
    least = np.full(rows * m, np.inf)
    x = np.zeros(len(h))
    alive = np.arange(len(h))
    drawn, step = 0, 1
    while len(alive):
        limit = least.reshape(rows, m).max(axis=1)
        alive = alive[x[alive] < limit[row[alive]]]
        if not len(alive):
            break
        for _ in range(step):
            u = c.mix(h[alive] + np.uint64((drawn + 1) * int(c.ODD[6]) % (1 << 64)))
            x[alive] -= np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / m
            register = c.mix(u + c.ODD[7]) >> np.uint64(32)
            np.minimum.at(least, row[alive] * m + (register * np.uint64(m) >> np.uint64(32)).astype(np.int64), x[alive])
            drawn += 1
        step = min(2 * step, 64)
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(least) / np.log(BASE)) + SHIFT
    return np.clip(value, 0, 255).astype(np.uint8).reshape(rows, m)


def not_below(similarity: float, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Pairs whose registers don't rule out that similarity or more, by their joint likelihood given the set sizes."""
    more, fewer = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - fewer
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-4
        return more * np.log(np.maximum(up, tiny)) + fewer * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))

    grid = [likelihood(np.minimum(top, x)) for x in np.linspace(0, 1, 41)]
    best, above = np.max(grid, axis=0), np.max([likelihood(np.minimum(top, x)) for x in np.linspace(similarity, 1, 8)], axis=0)
    return (top >= similarity - 1e-12) & (np.maximum(best, above) - above <= DOUBT)


def _sign(k: int, longs: list[str]):
    def work(unit: c.Unit) -> Iterator[pa.RecordBatch]:
        for rows, data, at in unit.slices():
            h, g, row, n = shingles(data, at, k)
            a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            np.add.at(a, row, c.mix(h ^ c.ODD[4]))
            np.add.at(b, row, c.mix(g ^ c.ODD[5]))
            node = np.stack([c.mix(a), c.mix(b + n.astype(np.uint64))], axis=1)
            registers = sketch(h, row, len(n))
            body = c.mix(c.range_hash(c.prefix_hash(c.BYTE[0][data], 2), at[:-1], at[1:], 2) + np.diff(at).astype(np.uint64))
            yield c.table(
                doc_id=unit.doc_id[rows], unit=np.full(len(n), unit.unit), row=np.arange(rows.start, rows.stop), key=body.astype(np.int64), n=n.astype(np.int64),
                node=pa.array([x.tobytes() for x in node], pa.binary()), registers=pa.array([x.tobytes() for x in registers], pa.binary()), **{x: v[rows] for x, v in zip(longs, unit.longs, strict=True)},
            )

    return c.each_unit(work)


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if hasattr(column, "to_pylist") else column), np.uint8).reshape(-1, M)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r = _registers(batch.column(1)).astype(np.uint64)
        keys = np.empty((len(r), BANDS), np.uint64)
        for i in range(BANDS):
            h = np.full(len(r), i + 1, np.uint64)
            for j in range(BAND):
                h = c.mix(h * c.ODD[3] + r[:, i * BAND + j])
            keys[:, i] = h
        node = pc.take(batch.column(0), pa.array(np.repeat(np.arange(len(r)), BANDS)))
        yield c.table(bucket=keys.reshape(-1).astype(np.int64), node=node)


# ---------------------------------------------------------------- links


def _likely(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            keep = not_below(similarity, _registers(x["registers_a"]), _registers(x["registers_b"]), x["n_a"].to_numpy(), x["n_b"].to_numpy())
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(keep))

    return run


def _fetch(path: str):
    """node and text of the documents that path lists for a unit."""

    def work(unit: c.Unit) -> Iterator[pa.RecordBatch]:
        listed = c.delivered(path, unit.unit, ["row", "node"], "unit")
        for i in range(0, 0 if listed is None else listed.num_rows, 256):
            part = listed.slice(i, 256)
            texts = [unit.text(x) for x in part.column("row").to_pylist()]
            yield c.table(node=pa.array(part.column("node").to_pylist(), pa.binary()), text=pa.array(texts, pa.binary()).cast(pa.string()))

    return c.each_unit(work)


def common_shingles(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Per row, how many shingles the sets of text_a and text_b share."""
    keys = []
    for name in ("text_a", "text_b"):
        h, g, row, _ = shingles(*c.text_buffer(batch, name), k)
        keys.append((h, g, row))
    h, g, row = (np.concatenate(x) for x in zip(*keys, strict=True))
    order = np.lexsort((g, h, row))
    h, g, row = h[order], g[order], row[order]
    twice = (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][twice], minlength=batch.num_rows)


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 64
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                x = {k2: part.column(j) for j, k2 in enumerate(part.schema.names)}
                shared = common_shingles(part, k)
                union = x["n_a"].to_numpy() + x["n_b"].to_numpy() - shared
                yield part.select(["a", "b"]).filter(pa.array(100 * shared >= percent * union))

    return run


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """A text of each of the classes wanted, read from the unit that has it."""
    told = c.deliver(nodes.join(wanted, "node").select("row", "node", "unit"), "op6-wanted", docs, "unit")
    return c.keep(docs.mapInArrow(_fetch(told), "node binary, text string"), "op6-texts")


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "registers_a", "registers_b")
    likely = c.keep(likely.mapInArrow(_likely(percent / 100), "a binary, b binary, n_a long, n_b long"), "op6-likely")
    texts = _texts(likely.select("a").union(likely.select("b")).distinct().withColumnRenamed("a", "node"), nodes, docs)
    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    both = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "n_a", "n_b", "text_a", "text_b")
    out = c.keep(both.mapInArrow(_confirm(k, percent), "a binary, b binary"), "op6-links")
    return out


def components(links: DataFrame) -> DataFrame:
    """node, label of every linked node: the smallest node that it reaches. Labels spread to neighbours and jump along pointers.

    A node's label meets its neighbours in SALTS places, so that a node that a third of all others are linked with isn't one task's.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = c.keep(both.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")), "op6-both")
    labels = c.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "op6-labels")
    salts, kept = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label", salts), ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        out = c.keep(step.join(jump, "new").select("node", F.least("new", "far").alias("label"), (F.least("new", "far") != F.col("label")).alias("changed")), "op6-labels")
        c.drop(kept)
        if not out.where("changed").head(1):
            c.drop(both)
            return out.select("node", "label")
        labels, kept = out.select("node", "label"), out


# ---------------------------------------------------------------- buckets gone through again


def _block_links(k: int, percent: int, path: str):
    """Links between the two blocks that each row names (or inside its only one) that join components, a spanning set of them."""

    def block(number: int):
        got = c.delivered(path, number, ["node", "label", "text"], "block").sort_by("node")
        batch = pa.record_batch({"text": got.column("text").combine_chunks()})
        return got.column("node").to_pylist(), got.column("label").to_pylist(), *shingles(*c.text_buffer(batch), k)

    def links(i: int, j: int, top: dict):
        node_a, label_a, h, g, row, n_a = block(i)
        node_b, label_b, h_b, g_b, row_b, n_b = block(j) if i != j else (node_a, label_a, h, g, row, n_a)

        def root(x):
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        order = np.lexsort((g_b, h_b))  # the inverted index: sorted shingles of the second block
        key, other, owner = h_b[order], g_b[order], row_b[order]
        edge = np.searchsorted(row, np.arange(len(node_a) + 1))
        for x in range(len(node_a)):
            own, own_g = h[edge[x] : edge[x + 1]], g[edge[x] : edge[x + 1]]
            low, high = np.searchsorted(key, own), np.searchsorted(key, own, "right")
            m = high - low
            pick = np.repeat(low - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            shared = np.bincount(owner[pick[other[pick] == np.repeat(own_g, m)]], minlength=len(node_b))
            for y in np.flatnonzero((shared > 0) & (100 * shared >= percent * (n_b + n_a[x] - shared))):
                a, b = root(label_a[x]), root(label_b[y])
                if a != b:
                    top[max(a, b)] = min(a, b)
                    yield node_a[x], node_b[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                out = list(links(i, j, {}))
                if out:
                    a, b = zip(*out, strict=True)
                    yield c.table(a=pa.array(a, pa.binary()), b=pa.array(b, pa.binary()))

    return run


def _links_again(bands: DataFrame, nodes: DataFrame, labels: DataFrame, tested: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between classes that share a bucket and lie in different components so far."""
    named = bands.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "node").alias("hub")).where("low <> high")
    rows = c.keep(named.join(mixed.select("bucket", "size", "hub"), "bucket"), "op6-mixed")
    few = rows.where(F.col("size") <= SMALL)
    left, right = few.select("bucket", F.col("node").alias("a"), F.col("label").alias("la")), few.select("bucket", F.col("node").alias("b"), F.col("label").alias("lb"))
    pairs = left.join(right, "bucket").where("a < b AND la <> lb").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
    links = _links(c.keep(pairs, "op6-pairs"), nodes, docs, k, percent)
    # components that meet in a large bucket make a cluster; its members are the classes in such buckets
    many = rows.where(F.col("size") > SMALL).select("node", "label", "hub").distinct()
    meet = components(many.where("hub <> label").select(F.col("hub").alias("a"), F.col("label").alias("b")).distinct())
    members = many.select("node", "label").distinct().join(meet.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label")
    members = c.keep(members, "op6-members")
    return links.union(_cluster_links(members, nodes, docs, k, percent))


def _cluster_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members (node, label, cluster) of the same cluster. Classes whose numbers of shingles differ too much aren't compared."""
    spark = members.sparkSession
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("long").alias("band")
    sized = members.join(nodes.select("node", "n"), "node").select("node", "label", "cluster", "n", band)
    sizes = sized.groupBy("cluster", "band").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    placed = sized.join(sizes, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = c.keep(placed.withColumn("block", F.xxhash64("cluster", "band", "part")), "op6-blocks")
    # texts go to a block once; tasks read the two blocks that they compare
    blocks = placed.select("cluster", "band", "block").distinct()
    texts = placed.select("node", "label", "block").join(_texts(placed.select("node"), nodes, docs), "node")
    path = c.deliver(texts.select("node", "label", "text", "block"), "op6-texts", blocks, "block")
    one, two = blocks.toDF("cluster", "band", "i"), blocks.toDF("cluster", "other", "j")
    pairs = one.join(two, "cluster").where("other = band + 1 OR other = band AND i <= j").select("i", "j").distinct()
    pairs = c.keep(pairs, "op6-block-pairs")
    tasks = max(1, min(100_000, pairs.count() // 4, 64 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return pairs.repartition(tasks).mapInArrow(_block_links(k, percent, path), "a binary, b binary")


# ---------------------------------------------------------------- operator


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document (near_rows has one kept row of each component).

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of k-word
    shingles (A-Z lower-cased). Documents without words are linked with nothing. component_id is the
    smallest doc_id of the component, null if it has none; kept is doc_id <=> component_id, so of
    rows with null doc_ids only those go that are linked with a named document. Equal rows stay together.
    Only doc_id and text are read; rows may repeat.
    """
    return near_rows(docs, k, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_rows(docs: DataFrame, k: int = 5, percent: int = 85, longs: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, first and the columns longs of each row of docs (doc_id, text and longs).

    first holds for one row of each component, that with the smallest doc_id; null doc_ids come last, and of
    rows with one doc_id that with the smallest hash of its text. It holds for all rows without words.
    """
    docs = c.units(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *longs), "op6-units", *longs)
    schema = "doc_id long, unit long, row long, key long, n long, node binary, registers binary" + "".join(f", `{x}` long" for x in longs)
    signs = c.keep(docs.mapInArrow(_sign(k, list(longs)), schema), "op6-signs")
    full = signs.where("n > 0")
    order = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "key", "unit", "row")
    one = F.min_by(F.struct("unit", "row", "n", "registers"), order)
    nodes = c.keep(full.groupBy("node").agg(one.alias("one"), F.min("doc_id").alias("first"), F.min(order).alias("head")).select("node", "one.*", "first", "head"), "op6-nodes")
    bands = nodes.select("node", "registers").mapInArrow(_bands, "bucket long, node binary")
    hubs = bands.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", "a")
    pairs = c.keep(bands.join(hubs, "bucket").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "op6-pairs")
    links = _links(pairs, nodes, docs, k, percent)
    labels = components(links)
    labels = components(links.union(_links_again(bands, nodes, labels, pairs, docs, k, percent)))
    named = nodes.select("node", "first", "head").join(labels, "node", "left").select("node", "first", "head", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"), F.min("head").alias("head"))
    of = c.keep(named.select("node", "label").join(smallest, "label").select("node", "component_id", F.col("head.unit").alias("at"), F.col("head.row").alias("at_row")), "op6-components")
    out = signs.select("doc_id", "n", "node", "unit", "row", *longs).join(of, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    first = (F.col("n") == 0) | ((F.col("unit") == F.col("at")) & (F.col("row") == F.col("at_row")))
    return out.select(*longs, "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), first.alias("first"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
