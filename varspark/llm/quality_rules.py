"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, runs of digits to 0, white space collapsed) and hashed; per host, the
distinct documents of each line are counted. Lines in more documents than the host's limit are
removed, and a document whose remaining words are too few, or too small a part, is depleted and
rejected. The text statistics of the base rules are taken in the same single scan, which leaves a row of numbers for
each document; lines are counted per split first, and frequent ones go back only to the splits that hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_fold = c.LOWER.copy()
_fold[DIGIT] = 48
NORMAL = [c.BYTE[k][_fold] for k in (0, 1)]
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LINES = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))
ROW = f"host string, doc_id long, {', '.join(f'{k} long' for k in STATS)}, lines array<struct<h:long,w:long>>"


def _per_row(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeated_words(first: np.ndarray, hashes: list[np.ndarray], n: int) -> np.ndarray:
    """Per row, the words covered by n-word windows found twice or more in that row."""
    where, row = c.windows(first, n)
    h, g = (c.window_hashes(x, where, n, k) for k, x in enumerate(hashes))
    order, start = c.groups(g, h, row)
    size = np.diff(np.append(start, len(order)))
    return _per_row(c.covered(where[order[np.repeat(size > 1, size)]], n, int(first[-1])), first)


def text_lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all lines."""
    cut = np.flatnonzero(data == 10)
    start, end = np.sort(np.concatenate([at[:-1], cut + 1])), np.sort(np.concatenate([at[1:], cut]))
    return start, end, np.repeat(np.arange(len(at) - 1), 1 + _per_row(data == 10, at))


def normal_hashes(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words with A-Z lower-cased and runs of digits as one 0."""
    digit = DIGIT[data]
    drop = np.zeros(len(data), bool)
    drop[1:] = digit[1:] & digit[:-1]
    drop[at[:-1][at[:-1] < len(data)]] = False
    moved = np.concatenate([[0], np.cumsum(~drop)])
    return c.mix(c.range_hash(c.prefix_hash(NORMAL[0][data[~drop]], 0), moved[start], moved[end], 0))


def _line_stats(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, host: np.ndarray):
    """Repeated lines per row; and for each row its distinct normalised lines, mixed with its host, and their words: offsets, hashes, words."""
    n = len(at) - 1
    low, high, row = text_lines(data, at)
    first, last = np.searchsorted(start, low), np.searchsorted(start, high)
    some = last > first
    low, high, row, first, last = (x[some] for x in (low, high, row, first, last))
    raw = [c.mix(c.range_hash(c.prefix_hash(c.BYTE[k][data], k), low, high, k)) for k in (0, 1)]
    _, distinct = c.groups(*raw, row)
    order = np.lexsort((*raw, row))
    dups = np.bincount(row, minlength=n) - np.bincount(row[order[distinct]], minlength=n)
    h = c.mix(c.mix(c.range_hash(c.prefix_hash(normal_hashes(data, at, start, end), 2), first, last, 2)) + host[row])
    order, at_ = c.groups(h, row)
    words = np.add.reduceat((last - first)[order], at_) if len(at_) else np.empty(0, np.int64)
    one = order[at_]
    return dups, np.concatenate([[0], np.cumsum(np.bincount(row[one], minlength=n))]), h[one].astype(np.int64), words


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, batch in c.by_split(batches):
        data, at = c.text_buffer(batch)
        start, end, first = c.words(data, at)
        column = lambda k: batch.column(batch.schema.get_field_index(k))  # noqa: E731, B023
        host = np.array([int.from_bytes(hashlib.blake2b((x or "\0").encode(), digest_size=8).digest(), "little") for x in column("host").to_pylist()], np.uint64)
        dups, offsets, h, w = _line_stats(data, at, start, end, host)
        yield c.table(
            host=column("host"), doc_id=column("doc_id"), n_words=np.diff(first).astype(np.int64),
            word_chars=_per_row(~c.SPACE[data] & ((data & 0xC0) != 0x80), at), n_symbols=_per_row(SYMBOLS[data], at), n_dup_lines=dups.astype(np.int64),
            n_repeat_words=repeated_words(first, [c.word_hashes(data, start, end, k) for k in (0, 1)], 5).astype(np.int64),
            lines=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(h), pa.array(w.astype(np.int64))], ["h", "w"])).cast(LINES),
        )


def _remove(path: str):
    """n_removed of each row: its words in frequent lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, often = None, None
        for split, batch in c.by_split(batches, None):
            if split != last:
                last, got = split, c.delivered(path, split, ["h"])
                often = np.empty(0, np.int64) if got is None else np.sort(got.column("h").to_numpy())
            lines = batch.column(batch.schema.get_field_index("lines"))
            at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lines).to_numpy(zero_copy_only=False))])
            h, w = (x.to_numpy(zero_copy_only=False) for x in lines.flatten().flatten())
            total = np.concatenate([[0], np.cumsum(np.where(c.member(often, h) >= 0, w, 0))])
            yield batch.select(["doc_id", *STATS]).append_column("n_removed", pa.array(total[at[1:]] - total[at[:-1]], pa.int64()))

    return run


def quality_rules(docs: DataFrame, host: str = "source", min_docs: int = 20, share: float = 0.01, max_docs: int = 1000, min_words: int = 10, min_left: float = 0.5) -> DataFrame:
    """Statistics and verdict for each document.

    A line is frequent if more documents of its host have it than the host's limit: ``share`` of the host's documents, but at least
    ``min_docs`` and at most ``max_docs``, so that a huge host isn't exempt. A document that passes the base rules is kept if at least ``min_words``
    words and the part ``min_left`` of its words stand in other lines. Null and empty texts have no words and
    fail. A null host is a host of its own; rows may repeat and count as documents each. Only doc_id, text and the host are read.
    """
    c.columnwise(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(host).cast("string").alias("host"))
    rows = c.with_split(c.keep(rows.mapInArrow(_scan, ROW), "op4-rows"))
    own = F.coalesce("host", F.lit("\0")).alias("host")
    held = rows.select("_split", own, F.explode("lines.h").alias("h")).groupBy("_split", "host", "h").agg(F.count(F.lit(1)).alias("n"))  # rows hold a line once
    limit = F.least(F.greatest(F.lit(float(min_docs)), F.count(F.lit(1)) * share), F.lit(float(max_docs)))
    hosts = rows.groupBy(own).agg(limit.alias("limit"))
    # a line that a third of all documents hold is a row for each split here
    counted = held.withColumn("docs", F.sum("n").over(Window.partitionBy("host", "h"))).where(F.col("docs") > min(min_docs, max_docs))
    often = counted.join(hosts, "host").where("docs > limit").select("h", "_split")
    told = c.deliver(often, "op4-often", rows)
    out = rows.select("doc_id", *STATS, "lines", "_split").mapInArrow(_remove(told), f"doc_id long, {', '.join(f'{k} long' for k in STATS)}, n_removed long")
    left = F.col("n_words") - F.col("n_removed")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("*", failed.alias("base_failed"), (~failed & (left >= min_words) & (left >= F.col("n_words") * min_left)).alias("kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
