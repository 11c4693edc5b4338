import hashlib

import numpy as np
import pytest

from varspark.llm.suffix_dedup import Suffixes, suffix_dedup


def brute(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            k = t[i : i + n]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, *args):
    return sorted(map(tuple, suffix_dedup(df, *args, with_bytes=False).collect()), key=str)


@pytest.mark.parametrize("hot", [4096, 1])
def test_against_brute_force(spark, hot):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert run(df, 400, 64, hot) == brute(rows, 400)


@pytest.mark.parametrize("n,gram,hot", [(12, 4, 4096), (12, 12, 3), (1, 1, 4096), (30, 5, 2)])
def test_edge_rows(spark, n, gram, hot):
    rng = np.random.default_rng(n)
    part = ["".join(rng.choice(list("abé "), 40)) for _ in range(4)]
    rows = [(1, None), (2, ""), (None, part[0]), (3, part[0]), (3, part[0]), (4, "x" * 500), (5, part[1][:20] + part[2]), (6, part[2][:30] + part[1]), (7, part[3] + "y" + part[3]), (8, "ab"), (None, part[1] + part[0][5:])]
    rows += [(10 + i, "".join(rng.choice(list("ab"), 60)) + part[2][i : i + 25] + "".join(rng.choice(list("ab"), 60))) for i in range(12)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int")
    assert run(df, n, gram, hot) == brute(rows, n)
    assert run(df.where("false"), n, gram, hot) == []


def test_mergesort():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    pos = rng.integers(0, 2990, 400)
    group = np.sort(rng.integers(0, 9, 400))
    end = np.minimum(pos + 60, 3000)
    order = Suffixes(data).sort(group, pos, end)
    raw = data.tobytes()
    keys = [(group[i], raw[pos[i] : end[i]]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(400))


def brute_earlier(rows, n):
    texts = [((d is None, d), (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in texts:
        for i in range(len(t) - n + 1):
            least[t[i : i + n]] = min(least.get(t[i : i + n], d), d)
    out = []
    for d, t in texts:
        held = [False] * len(t)
        for i in range(len(t) - n + 1):
            if least[t[i : i + n]] < d:
                held[i : i + n] = [True] * n
        out.append((d[1], hashlib.sha256(t).hexdigest()[:8], sum(held)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,gram,hot", [(12, 4, 4096), (12, 12, 1), (1, 1, 4096), (30, 5, 2)])
def test_bytes_of_earlier_documents(spark, n, gram, hot):
    rng = np.random.default_rng(n)
    part = ["".join(rng.choice(list("abé "), 40)) for _ in range(3)]
    rows = [(9, part[0] + "z" + part[1]), (4, part[0]), (4, part[0]), (None, part[0] + part[2]), (7, part[1] + "x" + part[1]), (-1, "y" * 90), (30, part[2] + part[1][:35] + "y" * 40), (8, None), (6, "")]
    rows += [(10 + i * 7 % 11, "".join(rng.choice(list("ab"), 60)) + part[2][i : i + 25] + "".join(rng.choice(list("ab"), 60))) for i in range(11)]
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    got = suffix_dedup(df, n, gram, hot, with_bytes=False, earlier=True)
    assert sorted(r.n_earlier for r in got.collect()) == sorted(x[2] for x in brute_earlier(rows, n))
    one = {r.doc_id: r.n_earlier for r in got.collect() if r.doc_id != 4}
    assert one == {d: x for d, _, x in brute_earlier(rows, n) if d != 4}


def test_first_holders_have_nothing_earlier(spark):
    from varspark.llm.suffix_dedup import op8_suffix_dedup

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: r.n_earlier for r in op8_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: x for d, _, x in brute_earlier(rows, 400)} and any(got.values())


def test_collisions_of_hashes_leave_earlier_exact(monkeypatch):
    from varspark.llm import suffix_dedup as m

    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    s, pos, doc, group = Suffixes(data), np.arange(10, 590, 7), np.arange(83) * 5 % 83, np.zeros(83, np.int64)
    found = [(i, o, o) for i in range(83) for o in (0, 1, 3)]
    raw = data.tobytes()
    want = {(i, o) for i, o, _ in found if any(doc[j] < doc[i] and raw[pos[j] - o : pos[j] - o + 5] == raw[pos[i] - o : pos[i] - o + 5] for j in range(83))}
    flat = lambda x: {(i, v) for i, lo, hi in x for v in range(lo, hi + 1)}
    assert flat(m._earlier(s, doc, group, pos, found, 5)) == want
    monkeypatch.setattr(m.c, "mix", lambda x: x & np.uint64(1))
    assert flat(m._earlier(s, doc, group, pos, found, 5)) == want
