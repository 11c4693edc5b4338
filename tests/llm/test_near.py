import re

import numpy as np
import pytest

from varspark.llm import near_dedup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k=5, percent=85):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        mates = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        first = min(mates, default=None) if sets[i] else doc
        out.append((doc, len(sets[i]), first, doc == first))
    return sorted(out, key=str)


def run(df):
    return sorted(map(tuple, nd.near_dedup(df).collect()), key=str)


def test_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 4)
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (None, "one"), (6, "a b c d"), (7, "a b c d e"), (None, "q r s t u v"), (None, "q r s t u v"), (8, "A B c d e"), (8, "A B c d e")]
    for i in range(60):  # near copies: some linked, some not, some by way of others
        w = list(base)
        for at in rng.choice(300, rng.integers(0, 9), replace=False):
            w[at] = f"x{i}_{at}"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, node string")
    assert run(df) == brute(rows)
    assert run(df.where("false")) == []


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    one, two = h[:1850], h[150:]
    a, b, both = (nd.sketch(x, np.zeros(len(x), np.int64), 1) for x in (one, two, h))
    assert (np.maximum(a, b) == both).all()  # mergeable
    assert abs((a == b).mean() - 1700 / 2000) < 0.1
    n = np.array([1850.0])
    assert nd.not_below(0.85, a, b, n, n)[0]
    far = nd.sketch(h[1000:], np.zeros(1000, np.int64), 1)
    near = nd.sketch(h[:1000], np.zeros(1000, np.int64), 1)
    assert not nd.not_below(0.85, far, near, np.array([1000.0]), np.array([1000.0]))[0]


@pytest.mark.parametrize("n", [1, 5, 400])
def test_register_levels(n):
    rng = np.random.default_rng(n)
    r = nd.sketch(rng.integers(0, 1 << 63, n, dtype=np.uint64), np.zeros(n, np.int64), 1)[0].astype(float)
    # E[min of n exponentials] = 1 / n
    assert abs(np.mean(np.power(nd.BASE, -(r - nd.SHIFT - 0.5))) * n - 1) < 0.35
