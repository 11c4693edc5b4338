import re
from collections import Counter

import numpy as np

from varspark.llm.quality_rules import op4_quality_rules, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_docs=20, share=0.01, max_docs=1000):
    """rows: (doc_id, text, host)."""
    norm = lambda line: re.sub("[0-9]+", "0", " ".join(WORD.findall(line)).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    docs, hosts = Counter(), Counter(h for *_, h in rows)
    for _, t, h in rows:
        docs.update({(h, norm(x)) for x in (t or "").split("\n") if WORD.search(x)})
    out = []
    for d, t, h in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        gone = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        seen, dup, removed = set(), 0, 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
                if docs[h, norm(line)] > min(max(min_docs, share * hosts[h]), max_docs):
                    removed += len(WORD.findall(line))
        failed = len(w) < 10 or 100 * len(gone) > 20 * len(w)
        left = len(w) - removed
        out.append((d, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(gone), removed, failed, not failed and left >= 10 and left >= 0.5 * len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op4_quality_rules(spark, sf)) == brute(rows)


def test_edge_rows(spark):
    own = "one two three four five six seven eight nine ten"
    rows = [(i, f"Same LINE  {i}\n{own} x{i} y{i % 7} é\n", "a") for i in range(8)]
    rows += [(20, None, "a"), (21, "", None), (22, " \n\t\n", "a"), (None, f"same line 7\n{own}", None), (23, "same line 1\nsame line 1\n" * 4, "a"), (24, "a b c d e f g h i j # <b> | 100%", "a"), (24, "a b c d e f g h i j # <b> | 100%", "a"), (25, "z " * 30000, "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_words int")
    out = got(quality_rules(df, min_docs=3, share=0.1))
    assert out == brute(rows, 3, 0.1)
    assert any(r[8] for r in out) and any(r[6] for r in out)
    assert got(quality_rules(df.where("false"))) == []
    low = got(quality_rules(df, min_docs=3, share=0.9, max_docs=5))
    assert low == brute(rows, 3, 0.9, 5) and low != got(quality_rules(df, min_docs=3, share=0.9))


def test_lines_of_random_bytes(spark):
    rng = np.random.default_rng(0)
    pieces = ["a", "B", "7", "88", " ", "\t", "\n", "\n\n", "é", "\r", "x1y22", "\x0b"]
    rows = [(i, "".join(rng.choice(pieces, rng.integers(0, 60))), f"h{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert got(quality_rules(df, min_docs=4, share=0.0, min_words=1)) == [(*r[:8], not r[7] and r[1] - r[6] >= 1 and r[1] - r[6] >= 0.5 * r[1]) for r in brute(rows, 4, 0.0)]
