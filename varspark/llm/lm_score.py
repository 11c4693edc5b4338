"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored from memory-mapped hash arrays.

1. Every unit asks hash shards about its distinct bigrams and says how often its training texts hold them. A shard adds the
   counts up, writes its part of the model (hashes in ascending order and their counts: plain arrays in the
   shared folder), maps the arrays into memory and looks the asked bigrams up.
2. Every unit asks word shards about its distinct words in the same way, and says what they gain from its texts, as a
   word (count, distinct contexts) and as a context (total, types with count 1, 2, 3+). A bigram's gain is
   told by one unit, which the bigram's shard names. Frequent contexts and words are one entry per unit.
3. Units score their texts from the answers. So a task maps one shard of the model, never all, and only the sums that
   give the discounts go to the driver.

Words are known by 56 bits of hash, bigrams by 62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BEGIN, END = np.int64(0x0123456789ABCD), np.int64(0x0FEDCBA9876543)  # 56-bit codes of the borders of a text
WORD_BITS = 56
BIGRAM = {"h": "<i8", "n": "<u1"}  # counts of MANY and more stand in a table of their own
MANY = 255
FREQUENT = {"h": "<i8", "n": "<u8"}
SUMS = ["<u8", "<u8", "<u8", "<u4", "<u4", "<u4"]  # of a word: count; total as a context; distinct contexts; types that follow once, twice, more often
NAMES = ["n", "total", "before", "one", "two", "more"]
WORD = {"h": "<i8", **dict(zip(NAMES, SUMS, strict=True))}


def bigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and words of all tokens, rows in order, and the number of tokens per row."""
    start, end, first = c.words(data, at)
    n = np.diff(first)
    stream = np.full(int((n + 2).sum()), END, np.int64)
    row = np.cumsum(n + 2) - (n + 2)
    stream[row] = BEGIN
    inside = np.arange(len(start)) - np.repeat(first[:-1], n)
    stream[np.repeat(row + 1, n) + inside] = c.word_hashes(data, start, end, 0, lower=True) >> np.uint64(64 - WORD_BITS)
    token = np.ones(len(stream), bool)
    token[row] = False
    at = np.flatnonzero(token)
    return stream[at - 1], stream[at], n + 1


def bigram_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (c.mix(c.mix(v.astype(np.uint64) * c.ODD[6]) + w.astype(np.uint64) * c.ODD[7]) >> np.uint64(64 - c.BITS)).astype(np.int64)


class _Tokens:
    """All tokens of a unit: contexts v, words w, the distinct bigrams and which of them each token is, and which tokens train."""

    def __init__(self, unit: c.Unit):
        got = [bigrams(data, at) for _, data, at in unit.slices()]
        self.v, self.w, self.n = (np.concatenate(x) for x in zip(*got, strict=True))
        self.train = np.repeat(unit.longs[0] == 0, self.n)
        self.h, self.one, self.which = np.unique(bigram_hash(self.v, self.w), return_index=True, return_inverse=True)
        self.count = np.bincount(self.which[self.train], minlength=len(self.h))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words and contexts, and which of them the word and the context of each token are."""
        word, which = np.unique(np.concatenate([self.w, self.v]), return_inverse=True)
        return word, which[: len(self.w)], which[len(self.w) :]


def _histogram(n: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(n == i)) for i in range(1, 5)]


def _ask_bigrams(unit: c.Unit):
    t = _Tokens(unit)
    return t.h, [t.count.astype(np.uint32)]


def _merge_bigrams(path: str):
    def merge(shard, keys, values, of):
        n = values[0].astype(np.uint64)
        order = np.lexsort((of, n == 0, keys))  # of a bigram's units, the first that trains on it tells its gain
        start = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
        h, total = keys[order][start], np.add.reduceat(n[order], start)
        seen = total > 0
        c.write_arrays(path, "bigram", shard, {"h": h[seen], "n": np.minimum(total[seen], MANY).astype(np.uint8)})
        c.write_arrays(path, "frequent", shard, {"h": h[total >= MANY], "n": total[total >= MANY]})
        model, frequent = c.mapped(path, "bigram", shard, BIGRAM), c.mapped(path, "frequent", shard, FREQUENT)
        at = c.member(model["h"], keys)
        count = np.zeros(len(keys), np.uint64)
        count[at >= 0] = model["n"][at[at >= 0]]
        many = np.flatnonzero(count == MANY)
        count[many] = frequent["n"][c.member(frequent["h"], keys[many])] if len(many) else 0
        tells = np.zeros(len(keys), bool)
        tells[order[start[seen]]] = True
        return None, [count, tells], [*_histogram(total), int(seen.sum())]

    return merge


def _ask_words(path: str):
    def leaf(unit: c.Unit):
        t = _Tokens(unit)
        _, (total, tells) = c.told(path, unit.unit, ["<u8", "?"], keyed=False)
        word, as_word, as_context = t.words()
        own = t.one[tells]  # a token of each bigram whose gain this unit tells
        often = total[tells]
        count = lambda at: np.bincount(at, minlength=len(word))
        sums = [count(as_word[t.train]), count(as_context[t.train]), count(as_word[own]), *(count(as_context[own[x]]) for x in (often == 1, often == 2, often > 2))]
        return word, [x.astype(kind) for x, kind in zip(sums, SUMS, strict=True)]

    return leaf


def _merge_words(path: str):
    def merge(shard, keys, values, of):
        order, start = c.groups(keys)
        sums = [np.add.reduceat(x[order], start) for x in values]
        c.write_arrays(path, "word", shard, {"h": keys[order][start], **{k: x.astype(WORD[k]) for k, x in zip(NAMES, sums, strict=True)}})
        model = c.mapped(path, "word", shard, WORD)
        at = c.member(model["h"], keys)
        return None, [model[k][at] for k in NAMES], [int(sums[0].sum()), int(np.count_nonzero(sums[0])), *_histogram(sums[2])]

    return merge


def discounts(histogram: list[int]) -> np.ndarray:
    """Of modified Kneser-Ney, for counts 0, 1, 2 and 3 or more; where counts of counts are missing, 1/2, 1 and 3/2."""
    n = histogram
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
        if all(0 < x <= i for i, x in enumerate(d, 1)):
            return np.array([0, *d])
    return np.array([0, 0.5, 1, 1.5])


def _score(grams: str, words: str, told: dict):
    d1, d2 = np.array(told["word_discounts"]), np.array(told["bigram_discounts"])
    tokens, types, pairs = told["tokens"], told["types"], max(1, told["pairs"])
    ones, twos, mores = told["words"]
    rest = (d1[1] * ones + d1[2] * twos + d1[3] * mores) / pairs if told["pairs"] else 1.0

    def work(unit: c.Unit) -> Iterator[pa.RecordBatch]:
        t = _Tokens(unit)
        _, (count, _) = c.told(grams, unit.unit, ["<u8", "?"], keyed=False)
        _, sums = c.told(words, unit.unit, SUMS, keyed=False)
        _, as_word, as_context = t.words()
        known = {k: x.astype(np.float64) for k, x in zip(NAMES, sums, strict=True)}
        word, context = ({k: x[at] for k, x in known.items()} for at in (as_word, as_context))
        at, count = np.cumsum(t.n) - t.n, count.astype(np.float64)[t.which]
        before, total = word["before"], context["total"]
        p1 = (before - d1[np.minimum(before, 3).astype(int)]) / pairs + rest / (types + 1)
        weight = np.where(total > 0, (d2[1] * context["one"] + d2[2] * context["two"] + d2[3] * context["more"]) / np.maximum(total, 1), 1.0)
        p2 = (count - d2[np.minimum(count, 3).astype(int)]) / np.maximum(total, 1) + weight * p1
        base = np.log10((word["n"] + 1) / (tokens + types + 1))
        score = np.add.reduceat(np.log10(p2), at)
        yield c.table(
            doc_id=unit.doc_id, held_out=unit.longs[0] > 0, n_tokens=t.n.astype(np.int64),
            n_known=np.add.reduceat((word["n"] > 0).astype(np.int64), at), train_tokens=np.full(unit.n, tokens, np.int64),
            base_score=np.add.reduceat(base, at), score=score, perplexity=np.power(10.0, np.minimum(300.0, -score / t.n)),
        )

    return c.each_unit(work)


def lm_score(docs: DataFrame, held_out, fan: int | None = None) -> DataFrame:
    """Scores of every document under a model of those where the column ``held_out`` is false or null.

    base_score is add-one smoothed: the sum of log10((c + 1) / (N + V + 1)). A null text is empty and has
    one token, its end. Unseen words share what the word level leaves over, 1 / (V + 1) of it each. Where
    nothing is held in, every token gets 1. Rows may repeat; only doc_id, text and what held_out reads are used.
    ``fan``: shards that a unit sends to directly.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).cast("long").alias("held"))
    spark, shards = docs.sparkSession, c.shard_count(docs)
    packed, path = c.units(docs, "op2-units", "held"), c.scratch(docs.sparkSession, "op2-model")
    grams = c.ask(packed, _ask_bigrams, ["<u4"], _merge_bigrams(path), shards, "op2-bigrams", fan=fan)
    words = c.ask(packed, _ask_words(grams), SUMS, _merge_words(path), shards, "op2-words", WORD_BITS, fan)
    *often, pairs = c.facts(spark, grams, 5)
    tokens, types, *before = c.facts(spark, words, 6)
    told = {"tokens": tokens, "types": types, "pairs": pairs, "words": [before[0], before[1], types - before[0] - before[1]], "word_discounts": discounts(before).tolist(), "bigram_discounts": discounts(often).tolist()}
    return packed.mapInArrow(_score(grams, words, told), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)
