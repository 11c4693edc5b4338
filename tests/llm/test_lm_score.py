import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from varspark.llm.lm_score import discounts, lm_score, op2_lm_score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """Interpolated modified Kneser-Ney over dictionaries."""
    sent = [(d, held, ["<s>", *WORD.findall((t or "").translate(LOWER)), "</s>"]) for d, t, held in rows]
    bi = Counter(p for _, held, s in sent if not held for p in zip(s, s[1:]))
    uni, before, after = Counter(), Counter(), defaultdict(list)
    for (v, w), n in bi.items():
        uni[w] += n
        before[w] += 1
        after[v].append(n)
    hist = lambda values: [sum(x == i for x in values) for i in (1, 2, 3, 4)]
    d1, d2 = discounts(hist(before.values())), discounts(hist(bi.values()))
    n, types, pairs = sum(uni.values()), len(uni), len(bi)
    rest = sum(d1[min(x, 3)] for x in before.values()) / pairs if pairs else 1.0
    out = []
    for d, held, s in sent:
        score = base = 0
        for v, w in zip(s, s[1:]):
            p1 = ((before[w] - d1[min(before[w], 3)]) / pairs if pairs else 0) + rest / (types + 1)
            total = sum(after[v])
            weight = sum(d2[min(x, 3)] for x in after[v]) / total if total else 1
            p = ((bi[v, w] - d2[min(bi[v, w], 3)]) / total if total else 0) + weight * p1
            score += math.log10(p)
            base += math.log10((uni[w] + 1) / (n + types + 1))
        out.append((d, held, len(s) - 1, sum(w in uni for w in s[1:]), n, pytest.approx(base, abs=1e-6), pytest.approx(score, abs=1e-6)))
    return sorted(out, key=lambda r: str(r[:4]))


def got(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=lambda r: str(r[:4]))


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op2_lm_score(spark, sf)) == brute(rows)


def test_edge_rows(spark):
    rows = [(1, "A b a B c", False), (1, "A b a B c", False), (2, None, True), (3, "", False), (None, "a zz", True), (4, "  ", True), (5, "go " * 700 + "on", False)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, out boolean, n_tokens string")
    assert got(lm_score(df, F.col("out"))) == brute(rows)
    assert got(lm_score(df.where("out"), F.col("out"))) == brute([r for r in rows if r[2]])
    assert got(lm_score(df.where("false"), F.col("out"))) == []


def test_probabilities_sum_to_one(spark):
    rows = [(i, t, False) for i, t in enumerate(["a b c a b", "a c c b", "b a d"])]
    known = ["a", "b", "c", "d", "unseen"]
    asked = rows + [(100 + i, w, True) for i, w in enumerate(known)] + [(200, "", True)]
    scores = {r.doc_id: r for r in lm_score(spark.createDataFrame(asked, "doc_id long, text string, out boolean"), F.col("out")).collect() if r.doc_id >= 100}
    # P(w|<s>) = P(w </s>) / P(</s>|w); an unseen word's successor has the word-level probability
    assert scores[200].score < 0 and all(scores[100 + i].score < 0 for i in range(5))
    assert sum(10 ** r.score for r in scores.values()) < 1
