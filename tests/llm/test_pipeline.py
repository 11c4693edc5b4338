import math

import corpus_pipeline
from tests.llm.test_decontaminate import tok
from tests.llm.test_near import brute as near_brute
from varspark.llm.decontaminate import tile
from varspark.llm.mixing import BLOCK, BUCKETS, REST, WEIGHTS, period
from varspark.llm.toxicity import op3_toxicity

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(docs):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    first = {}
    for d, t in docs:
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(d, first.get(key(line), d))
    return [(d, "\n".join(x for x in t.split("\n") if first.get(key(x), d) == d)) for d, t in docs]


def covered(item, text, n=4):
    import numpy as np

    words = {w: i for i, w in enumerate({*item, *text})}
    a, b = (np.array([words[w] for w in x]) for x in (item, text))
    at = {}
    for j in range(len(b) - n + 1):
        at.setdefault(tuple(b[j : j + n]), []).append(j)
    seeds = [(i, j) for i in range(len(a) - n + 1) for j in at.get(tuple(a[i : i + n]), ())]
    return sum(t[2] for t in tile(a, b, seeds, n)) if seeds else 0


def test_pipeline_against_brute_force(spark):
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {r.doc_id for r in op3_toxicity(spark, SF).collect() if r.predicted}
    docs = brute_lines([(d, r.text) for d, r in sorted(source.items()) if d not in toxic])
    kept = {r[0] for r in near_brute(docs) if r[3]}
    items = [tok(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in docs if d in kept and not any(2 * covered(x, tok(t)) >= len(x) for x in items if len(x) >= 4)]
    seen, order = {}, []
    others = {source[d].source for d, _ in docs} - set(WEIGHTS)
    weights = {s: w * len(others) for s, w in WEIGHTS.items()} | dict.fromkeys(others, REST)
    weights = {s: w // math.gcd(*weights.values()) for s, w in weights.items()}
    slots = {}
    for slot, s in enumerate(period(weights)):
        slots.setdefault(s, []).append(slot)
    for d, _ in sorted(docs, key=lambda r: (r[0] % 1000003 * 7919 % BUCKETS, r[0])):
        s = source[d].source
        rank = seen[s] = seen.get(s, -1) + 1
        block = rank // BLOCK
        order.append((block // weights[s] * sum(weights.values()) + slots[s][block % weights[s]], rank % BLOCK, d))
    text = dict(docs)
    want = [(d, text[d], source[d].lang, source[d].source, len(text[d]), slot, pos) for slot, pos, d in sorted(order)]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)
    assert 3 < len(want) < len(source)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "mixing"]


def test_stages_on_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, SF)
        assert out.columns[:5] == empty.columns and out.count() == 0, i
