import re

import numpy as np
import pytest

from varspark.llm.decontaminate import decontaminate, op10_decontaminate, tile, tile_texts

TOKEN = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tok(t):
    return TOKEN.findall((t or "").translate(LOWER))


def brute_tiles(a, b, n):
    """Greedy string tiling as published: longest unmarked match first."""
    in_a, in_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (n - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not in_a[i + k] and not in_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < n:
            return out
        out.append((i, j, k))
        in_a[i : i + k] = in_b[j : j + k] = [True] * k


@pytest.mark.parametrize("seed", range(6))
def test_tiles(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, 40), rng.integers(0, 3, 70)
    for n in (1, 2, 4):
        seeds = [(i, j) for i in range(41 - n) for j in range(71 - n) if (a[i : i + n] == b[j : j + n]).all()]
        assert tile(a, b, seeds, n) == brute_tiles(a.tolist(), b.tolist(), n)


def brute(docs, items, n, share):
    out = []
    for doc, text in docs:
        b = tok(text)
        hits = {}
        for item, t in set(items):
            a = tok(t)
            if item is None or len(a) < n or not set(a) & set(b):
                continue
            done = sum(k for _, _, k in brute_tiles(a, b, n))
            if done >= share * len(a):
                hits[item] = max(hits.get(item, 0), done / len(a))
        best = min(((-v, k) for k, v in hits.items()), default=(0, None))
        out.append((doc, len(hits), sorted(hits), best[1], pytest.approx(-best[0], abs=1e-6), bool(hits)))
    return sorted(out, key=lambda r: str(r[:4]))


def got(df):
    return sorted(((r.doc_id, r.n_items, r["items"], r.item_id, r.coverage, r.contaminated) for r in df.collect()), key=lambda r: str(r[:4]))


@pytest.mark.parametrize("slice_bytes", [1 << 20, 60])
def test_edge_rows(spark, slice_bytes):
    items = [(1, "Alpha beta, gamma delta. Epsilon zeta eta theta iota kappa"), (2, "uno dos tres quatro cinco seis"), (3, "x y"), (4, None), (None, "alpha beta gamma delta"), (2, "uno dos tres quatro cinco seis"), (5, "rep rep rep rep rep rep rep rep"), (6, "é è ê ë ñ ü")]
    docs = [(1, "epsilon ZETA eta theta iota kappa - alpha beta gamma delta"), (2, "alpha beta gamma delta only"), (3, None), (4, ""), (None, "say uno dos tres QUATRO cinco seis!"), (None, "say uno dos tres QUATRO cinco seis!"), (5, "rep " * 2000), (6, "x y x y"), (7, "alpha beta gamma x delta epsilon zeta eta y theta iota kappa"), (8, "é è ê ë ñ É")]
    d = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, coverage double")
    b = spark.createDataFrame(items, "item_id long, text string")
    small = [r for r in docs if r[0] != 5]
    assert got(decontaminate(d.where("doc_id IS NULL OR doc_id <> 5"), b, 4, 0.5, slice_bytes)) == brute(small, items, 4, 0.5)
    (long,) = got(decontaminate(d.where("doc_id = 5"), b, 4, 0.5, slice_bytes))
    assert long[1:4] == (1, [5], 5) and long[4] == 1.0
    assert all(not r[5] for r in got(decontaminate(d, b.where("false"))))
    assert got(decontaminate(d.where("false"), b)) == []


def test_a_token_repeated_without_end(spark):
    """All places match all places: runs are found place by place, in bounded memory and time."""
    docs = spark.createDataFrame([(1, "rep " * 20_000), (2, "rep " * 390), (3, "rep " * 150 + "x " * 99 + "rep " * 60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "rep " * 400)], "item_id long, text string")
    assert [r[3:5] for r in got(decontaminate(docs, items))] == [(1, 1.0), (1, 0.975), (1, 0.525)]


def test_column_names(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta", 5, "a b", 7)], "doc_id long, text string, _split int, `n-chars of.it` string, _row int")
    out = decontaminate(docs, spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string"))
    assert out.columns == [*docs.columns, "n_items", "items", "item_id", "coverage", "contaminated"]
    assert [tuple(r) for r in out.collect()] == [(1, "alpha beta gamma delta", 5, "a b", 7, 1, [1], 1, 1.0, True)]


def test_tiles_of_texts():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = ([bytes([x]) for x in rng.integers(97, 100, n)] for n in (30, 60))
        assert tile_texts(a, b, 3) == brute_tiles(a, b, 3)


def test_query_against_brute_force(spark):
    """All documents against all items, coverage and verdict, with tiles from plain token lists."""
    sf = "/root/testdata/sf0.001"
    items = {r.item_id: [x.encode() for x in tok(r.text)] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        b = [x.encode() for x in tok(r.text)]
        seen = set(zip(b, b[1:], b[2:], b[3:]))
        hits = {}
        for i, a in items.items():
            if len(a) >= 4 and any(g in seen for g in zip(a, a[1:], a[2:], a[3:])):
                done = sum(k for _, _, k in tile_texts(a, b, 4))
                if done >= 0.5 * len(a):
                    hits[i] = done / len(a)
        best = min(((-v, k) for k, v in hits.items()), default=(0, None))
        want.append((r.doc_id, len(hits), sorted(hits), best[1], pytest.approx(-best[0], abs=1e-6), bool(hits)))
    assert got(op10_decontaminate(spark, sf)) == sorted(want, key=lambda r: str(r[:4]))
    assert any(r[1] for r in want)


def test_query_finds_contained_items(spark):
    sf = "/root/testdata/sf0.001"
    items = {r.item_id: " ".join(tok(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: f" {' '.join(tok(r.text))} " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r.doc_id: r for r in op10_decontaminate(spark, sf).collect()}
    assert out.keys() == docs.keys()
    for doc, text in docs.items():
        held = [i for i, t in items.items() if f" {t} " in text]
        assert set(held) <= set(out[doc]["items"])
        if held:
            assert out[doc].coverage == 1.0
