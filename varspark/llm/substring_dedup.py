"""Substring dedup: a count-min prefilter, then exact grouping of the windows estimated repeated.

A window is ``window`` consecutive words of one document. Each word covered by a window whose word
sequence also starts in a document with a smaller doc_id is removed.

1. Every unit hashes its windows into its own count-min sketch (two rows, one after the other) and sends the cells it
   touched to the sketch's shards. A shard adds the sketches of all units up and answers each unit with those of
   its cells that were touched at least twice. The second row is asked for only those windows that the first
   row lets pass. The sketch overestimates, so no repeated window is lost.
2. Only windows with repeated cells in both rows are grouped exactly, by 94 bits of hash: each unit
   sends a key once with its smallest doc_id, a shard takes the minimum over units and answers the
   units that have later documents.
3. Every unit marks the words under windows whose key has an earlier document.

No text is shuffled and nothing passes through the driver. A window that a third of all documents hold is one key per unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

CELLS_PER_BYTE = 1  # sketch width for each byte of text, four to eight for each word
ROWS = 2
KEY = ["<u4", "<i8", "?"]  # of a window: further bits of hash, the smallest doc_id, whether there is a larger one


def _hashes(data: np.ndarray, at: np.ndarray, window: int):
    start, end, first = c.words(data, at)
    where, row = c.windows(first, window)
    both = [c.window_hashes(c.word_hashes(data, start, end, k), where, window, k) for k in (0, 1)]
    return first, where, row, both


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class _Repeated:
    """The cells of one unit that are estimated repeated, in each row of the sketch so far."""

    def __init__(self, told: list[str], unit: int, bits: int):
        self.bits, self.cells = bits, [c.told(path, unit, [])[0] for path in told]

    def mask(self, both: list[np.ndarray]) -> np.ndarray:
        held = np.ones(len(both[0]), bool)
        for have, h in zip(self.cells, both, strict=False):
            some = np.flatnonzero(held)
            held[some] = c.member(have, _cells(h[some], self.bits)) >= 0
        return held


def _ask_cells(window: int, bits: int, told: list[str]):
    """The unit's sketch: cells of the next row, for the windows that the rows before let pass, and whether they were touched again."""
    row = len(told)

    def leaf(unit: c.Unit):
        repeated, held = _Repeated(told, unit.unit, bits), [np.empty(0, np.int64)]
        for _, data, at in unit.slices():
            both = _hashes(data, at, window)[3]
            held.append(_cells(both[row][repeated.mask(both)], bits))
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        return cell, [np.minimum(n, 2).astype(np.uint8)]

    return leaf


def _merge_cells(shard, keys, values, of):
    """The sum of the units' sketches; of a cell, 2 and more are the same."""
    low = int(keys.min())
    sketch = np.bincount(keys - low, values[0])
    return sketch[keys - low] > 1, []


def first_ids(h: np.ndarray, g: np.ndarray, doc: np.ndarray):
    """Distinct keys with their smallest document, and whether they have a later one too."""
    _, at = c.groups(g, h)
    order = np.lexsort((doc, g, h))
    h, g, doc = h[order], g[order], doc[order]
    last = np.append(at, len(h))[1:] - 1
    return h[at], g[at], doc[at], doc[last] > doc[at]


def _key(both: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (both[0] >> np.uint64(64 - c.BITS)).astype(np.int64), (both[1] >> np.uint64(32)).astype(np.uint32)


def _ask_keys(window: int, bits: int, told: list[str]):
    def leaf(unit: c.Unit):
        repeated, held = _Repeated(told, unit.unit, bits), []
        for rows, data, at in unit.slices():
            _, _, row, both = _hashes(data, at, window)
            some = np.flatnonzero(repeated.mask(both))
            h, g = _key([x[some] for x in both])
            held.append((h, g, unit.ids[rows][row[some]]))
        h, g, doc, more = first_ids(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return h, [g, doc, more]

    return leaf


def _merge_keys(shard, keys, values, of):
    """Each unit is told the first document of those of its keys that have a later document in it."""
    g, doc, more = values
    order = np.lexsort((doc, g, keys))
    _, start = c.groups(g, keys)
    least = np.empty_like(doc)
    least[order] = np.repeat(doc[order][start], np.diff(np.append(start, len(keys))))
    return more | (least < doc), [g, least]


class _Earlier:
    """First documents of the keys of one unit."""

    def __init__(self, path: str, unit: int):
        self.h, (self.g, self.doc) = c.told(path, unit, ["<u4", "<i8"])

    def mask(self, both: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
        h, g = _key(both)
        out = np.zeros(len(doc), bool)
        at = c.member(self.h, h)
        some = np.flatnonzero(at >= 0)
        at, g, own = at[some], g[some], doc[some]
        hit = (self.g[at] == g) & (self.doc[at] < own)
        # keys that share their first bits with another key stand next to it
        for i in np.flatnonzero(self.g[at] != g):
            j = at[i]
            while j < len(self.h) and self.h[j] == h[some[i]]:
                hit[i] |= self.g[j] == g[i] and self.doc[j] < own[i]
                j += 1
        out[some] = hit
        return out


def _apply(window: int, path: str, with_text: bool):
    def work(unit: c.Unit) -> Iterator[pa.RecordBatch]:
        earlier = _Earlier(path, unit.unit)
        for rows, data, at in unit.slices():
            first, where, row, both = _hashes(data, at, window)
            gone = c.covered(where[earlier.mask(both, unit.ids[rows][row])], window, int(first[-1]))
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[first[1:]] - total[first[:-1]]
            kept = []
            for i in range(len(at) - 1):
                own = data[at[i] : at[i + 1]].tobytes().split()
                kept.append(b" ".join(compress(own, ~gone[first[i] : first[i + 1]]) if removed[i] else own))
            out = {"doc_id": unit.doc_id[rows], "n_words": np.diff(first).astype(np.int64), "n_removed": removed.astype(np.int64)}
            out |= {"kept": pa.array(kept, pa.binary()).cast(pa.string())} if with_text else {"kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
            yield c.table(**out)

    return c.each_unit(work)


def substring_dedup(docs: DataFrame, window: int = 50, with_text: bool = True, fan: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of each document: as text, or only their SHA-256.

    A null or empty text has no words. A null doc_id sorts after all others, so such documents lose
    what any other holds and take nothing away. Documents with the same doc_id don't dedupe each other.
    Rows may repeat and docs may have further columns (also of the names made here): only doc_id and text
    are read. An empty table gives an empty result. ``fan``: shards that a unit sends to directly.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = c.shard_count(docs)
    bits = min(48, max(12, (shards * c.SHARD_BYTES * CELLS_PER_BYTE).bit_length()))
    packed, told = c.units(docs, "op1-units"), []
    for _ in range(ROWS):
        told.append(c.ask(packed, _ask_cells(window, bits, list(told)), ["<u1"], _merge_cells, shards, "op1-cells", bits, fan))
    found = c.ask(packed, _ask_keys(window, bits, told), KEY, _merge_keys, shards, "op1-keys", fan=fan)
    c.drop_told(docs.sparkSession, *told)
    kept = "kept string" if with_text else "kept_sha256 string"
    return packed.mapInArrow(_apply(window, found, with_text), f"doc_id long, n_words long, n_removed long, {kept}")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
