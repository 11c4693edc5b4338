"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. Seeds of
``match`` tokens that a document shares with an item are joined by fingerprint. A pair whose seeds
could cover enough of the item is tiled: the longest common run of unmarked tokens is marked, again
and again, down to ``match`` tokens (Running Karp-Rabin fingerprints find the runs, the tokens themselves confirm
them). Tiles don't overlap and may stand in any order, so reordered passages are caught.

The benchmark is gone through in slices of a checked size, a job each: the slice is sent to the executors, and what is found goes to the
shared folder. Documents are never shuffled, and their texts never kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

SLICE_BYTES = 8 << 20  # benchmark text that is sent to the executors at once
MADE = T.StructType().add("n_items", "long").add("items", T.ArrayType(T.LongType())).add("item_id", "long").add("coverage", "double").add("contaminated", "boolean")
_part = np.ones(256, bool)
_part[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Tokens:
    """Tokens of all rows: where they start and end, two hashes each, and the index of each row's first token."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = data
        self.start, self.end, self.first = c.words(np.where(_part[data], np.uint8(32), data), at)
        self.hashes = c.word_hashes(data, self.start, self.end, 0, lower=True) if len(self.start) else np.empty(0, np.uint64)

    def text(self, a: int, b: int) -> list[bytes]:
        return [self.data[i:j].tobytes().lower() for i, j in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def fingerprints(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin fingerprints of all runs of n tokens inside rows, and where they start."""
    where, _ = c.windows(first, n)
    return c.window_hashes(hashes, where, n, 0), where


def runs(places: list[int], lists: list[np.ndarray], n: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (start in a, start in b, length): a[i : i + n] stands in b at the ascending positions lists[k], where i = places[k].

    Goes along a with the runs that are open, so it holds positions of one place at a time, however often a token is repeated.
    """
    out: list[tuple[int, int, int]] = []

    def close(begin, at, last):
        out.extend((i, j - (last - i), last - i + n) for i, j in zip(begin.tolist(), at.tolist(), strict=True))

    last, begin, at = -2, np.empty(0, np.int64), np.empty(0, np.int64)
    for place, here in zip(places, lists, strict=True):
        if place != last + 1:
            close(begin, at, last)
            begin, at = begin[:0], at[:0]
        follows = c.member(at + 1, here)
        goes_on = np.zeros(len(at), bool)
        goes_on[follows[follows >= 0]] = True
        close(begin[~goes_on], at[~goes_on], last)
        begin = np.where(follows >= 0, begin[follows], place) if len(begin) else np.full(len(here), place)
        last, at = place, here
    close(begin, at, last)
    return out


def tile_runs(len_a: int, len_b: int, found: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of maximal common runs: (start in a, start in b, length), longest first.

    Of runs of equal length, that with the smallest start in a, then in b, is marked first.
    """
    heap = [(-size, i, j) for i, j, size in found]
    heapq.heapify(heap)
    in_a, in_b, tiles, left = np.zeros(len_a, bool), np.zeros(len_b, bool), [], len_a
    while heap and left >= n:
        size, i, j = heapq.heappop(heap)
        size = -size
        taken = in_a[i : i + size] | in_b[j : j + size]
        if not taken.any():
            in_a[i : i + size] = in_b[j : j + size] = True
            tiles.append((i, j, size))
            left -= size
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= n:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


def tile(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of token arrays. seeds are all (i, j) with a[i : i + n] == b[j : j + n]."""
    at: dict[int, list[int]] = {}
    for i, j in sorted(seeds):
        at.setdefault(i, []).append(j)
    return tile_runs(len(a), len(b), runs(list(at), [np.array(x) for x in at.values()], n), n)


def tile_texts(a: list[bytes], b: list[bytes], n: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of tokens, without fingerprints."""
    at: dict[tuple, list[int]] = {}
    for j in range(len(b) - n + 1):
        at.setdefault(tuple(b[j : j + n]), []).append(j)
    places = [i for i in range(len(a) - n + 1) if tuple(a[i : i + n]) in at]
    return tile_runs(len(a), len(b), runs(places, [np.array(at[tuple(a[i : i + n])]) for i in places], n), n)


class Items:
    """Benchmark items of a slice, with their seeds."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.ids, self.n = [i for i, _ in rows], n
        self.tokens = Tokens(*c.text_buffer(pa.record_batch({"text": pa.array([t for _, t in rows], pa.string())})))
        self.first = self.tokens.first
        f, where = fingerprints(self.tokens.hashes, self.first, n)
        order = np.argsort(f, kind="stable")
        self.seed, self.where = f[order], where[order]
        self.item = np.searchsorted(self.first, self.where, "right") - 1


def _cover(items: Items, own: Tokens, low: int, high: int, at: np.ndarray, f: np.ndarray, share: float) -> list[tuple[int, int]]:
    """(item, tokens tiled) of the items tiled to that share by a document, tokens low..high; at, f: its seeds and their fingerprints."""
    order = np.argsort(f, kind="stable")
    f, at = f[order], at[order]
    seed, begin = np.unique(f, return_index=True)
    stop = np.append(begin[1:], len(f))
    a, b = np.searchsorted(items.seed, seed), np.searchsorted(items.seed, seed, "right")
    n = b - a
    pick = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    which, place, item = np.repeat(np.arange(len(seed)), n), items.where[pick], items.item[pick]  # a row for each seed of the items, however often the document has it
    order = np.lexsort((place, item))
    which, place, item = which[order], place[order], item[order]
    cut = np.flatnonzero(np.diff(item, prepend=-1))
    step = np.minimum(np.diff(place, append=place[-1:] + items.n), items.n)
    step[np.append(cut[1:], len(item)) - 1] = items.n
    size = items.first[item[cut] + 1] - items.first[item[cut]]
    out = []
    for x in np.flatnonzero(np.add.reduceat(step, cut) >= share * size):  # seeds can't cover more
        s, e = cut[x], cut[x + 1] if x + 1 < len(cut) else len(item)
        k, base = int(item[s]), int(items.first[item[s]])
        tiles = tile_runs(int(size[x]), high - low, runs((place[s:e] - base).tolist(), [at[begin[w] : stop[w]] for w in which[s:e]], items.n), items.n)
        if sum(t[2] for t in tiles) < share * size[x]:
            continue
        if any(items.tokens.text(base + i, base + i + m) != own.text(low + j, low + j + m) for i, j, m in tiles):  # fingerprints collided
            tiles = tile_texts(items.tokens.text(base, base + int(size[x])), own.text(low, high), items.n)
        done = sum(t[2] for t in tiles)
        if done >= share * size[x]:
            out.append((k, done))
    return out


def _search(items, text: str, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = items.value
        for _, batch in c.by_split(batches, text):
            own = Tokens(*c.text_buffer(batch, text))
            f, where = fingerprints(own.hashes, own.first, known.n)
            hit = np.flatnonzero(c.member(known.seed, f) >= 0)
            f, where = f[hit], where[hit]
            row = np.searchsorted(own.first, where, "right") - 1
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            found = []
            for i in np.unique(row).tolist():
                a, b, low = edge[i], edge[i + 1], int(own.first[i])
                found += [(i, known.ids[k], n / int(known.first[k + 1] - known.first[k])) for k, n in _cover(known, own, low, int(own.first[i + 1]), where[a:b] - low, f[a:b], share)]
            if found:
                at, item, coverage = zip(*found, strict=True)
                rows = batch.select(["_split", "_file", "_row"]).take(pa.array(at))
                yield c.table(item_id=pa.array(item, pa.int64()), coverage=pa.array(coverage), **{k: rows.column(i) for i, k in enumerate(rows.schema.names)})

    return run


def _append(path: str):
    """The batch with what was found in its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, {}
        for split, batch in c.by_split(batches, None):
            if split != last:
                last, known, got = split, {}, c.delivered(path, split, ["item_id", "coverage", "_file", "_row"])
                for x in () if got is None else got.to_pylist():
                    own = known.setdefault((x["_file"], x["_row"]), {})
                    own[x["item_id"]] = max(own.get(x["item_id"], 0.0), x["coverage"])
            key = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("_file", "_row"))
            hits = [known.get(k, {}) for k in zip(*key, strict=True)]
            best = [min(((-v, k) for k, v in x.items()), default=(-0.0, None)) for x in hits]
            made = {"n_items": pa.array([len(x) for x in hits], pa.int64()), "items": pa.array([sorted(x) for x in hits], pa.list_(pa.int64())), "item_id": pa.array([k for _, k in best], pa.int64()), "coverage": pa.array([round(-v, 6) + 0.0 for v, _ in best], pa.float64()), "contaminated": pa.array([bool(x) for x in hits])}
            batch = batch.drop_columns(["_split", "_file", "_row"])
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, match: int = 4, share: float = 0.5, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs with n_items (items tiled to at least ``share``), items (their ids, ascending), item_id and coverage of the best, and contaminated.

    The best item has the highest coverage, then the smallest id. Items of fewer than ``match`` tokens (null texts too) are
    never found, they say too little. Repeated items count once each id. Null texts of documents are empty. Columns of docs
    with the names made here are replaced, all others are returned, whatever their names.
    """
    if match < 1 or not 0 < share <= 1:
        raise ValueError("match must be positive and share in (0, 1]")
    spark = docs.sparkSession
    docs = docs.drop(*MADE.names)
    rows, names = c.plain(docs)
    rows = c.with_split(rows)
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-size // slice_bytes)
    schema = "item_id long, coverage double, _split long, _file long, _row long"
    hits, parts = spark.createDataFrame([], schema), []
    for i in range(slices):
        part = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i).orderBy("item_id", "text").collect()  # slice_bytes on average
        items = spark.sparkContext.broadcast(Items([tuple(r) for r in part], match))
        found = rows.select(names["text"], "_split", "_file", "_row").mapInArrow(_search(items, names["text"], share), schema)
        parts.append(c.keep(found, "op10-hits"))
        hits = hits.union(parts[-1])
        items.destroy()
    told = c.deliver(hits, "op10-told", rows)
    c.drop(*parts)
    plain = [f for f in rows.schema.fields if f.name in names.values()]
    out = rows.mapInArrow(_append(told), T.StructType([*plain, *MADE.fields]))
    return out.toDF(*docs.columns, *MADE.names)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
