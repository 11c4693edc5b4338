import itertools

import numpy as np
from pyspark.sql import functions as F

from varspark.llm.toxicity import LabelModel, learn, op3_toxicity, spanning_tree, toxicity, train


def auc(s, y):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = op3_toxicity(spark, sf).toPandas()
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    assert ((rows["score"] >= 0.5).astype(int) == rows["predicted"]).all()
    own = rows.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = own[own["held_out"]]
    assert auc(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.95
    assert (held["predicted"] == held["toxic"]).mean() > 0.97


def test_edge_rows(spark):
    text = {1: "you stupid scum", 0: "a fine day at sea"}
    rows = [(i, f"{text[i % 3 == 0]} word{i % 7}", "x") for i in range(1, 200)]
    rows += [(500, None, "x"), (501, "", "x"), (None, "you stupid scum", "x"), (None, "you stupid scum", "y"), (502, "stupid " * 20000, "x"), (7, rows[6][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 200)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    out = toxicity(docs, labels)
    assert out.columns == ["doc_id", "text", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.predicted == int("stupid" in (r.text or "")) and 0 <= r.score <= 1
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())  # a function of the text alone
    assert toxicity(docs.where("false"), labels).count() == 0
    assert all(r.score < 1e-6 for r in toxicity(docs, labels.where("false")).collect())
    assert {r.predicted for r in toxicity(docs, labels.where("toxic = 1")).collect()} == {1}


def test_held_out_labels_are_not_used(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def brute_posterior(model, votes):
    """P(class 1 | votes) of a row from the model's own factors, by plain enumeration."""
    out = []
    for row in votes.tolist():
        like = []
        for y, prior in ((0, 1 - model.prior), (1, model.prior)):
            p = prior
            for j, up in enumerate(model.parent):
                p *= model.tables[j][y][row[up] if up >= 0 else 0][row[j]]
            like.append(p)
        out.append(like[1] / sum(like))
    return np.array(out)


def test_label_model_finds_accuracies_and_correlations_without_labels():
    rng = np.random.default_rng(0)
    n = 6000
    y = rng.random(n) < 0.2
    vote = lambda yes, no: np.where(y, rng.random(n) < yes, rng.random(n) < no).astype(int)
    one, two, three, four = vote(0.8, 0.05), vote(0.7, 0.1), vote(0.6, 0.04), vote(0.75, 0.08)
    copy = np.where(rng.random(n) < 0.95, one, 1 - one)  # tells nothing that the first voter doesn't
    votes = np.column_stack([one, copy, two, three, four])
    model = LabelModel(votes)
    pair = next(i for i in (0, 1) if model.parent[i] == 1 - i)  # the copies are joined by a factor of the model
    assert pair in (0, 1)
    right = np.array([y[v == 1].mean() for v in votes.T])
    assert np.allclose(model.accuracies(), right, atol=0.12) and abs(model.prior - 0.2) < 0.05
    assert ((model.posterior > 0.5) == y).mean() > max((v == y).mean() for v in votes.T)
    assert np.allclose(model.posterior, brute_posterior(model, votes), atol=1e-9)
    # a copied vote counts about once: the row with both is hardly surer than the model of one of them
    alone = LabelModel(np.delete(votes, 1, axis=1))
    both, single = model.classify(np.array([[1, 1, 0, 0, 0]])), alone.classify(np.array([[1, 0, 0, 0]]))
    assert abs(np.log(both / (1 - both)) - np.log(single / (1 - single)))[0] < 1


def test_spanning_tree():
    rng = np.random.default_rng(2)
    gain = rng.random((6, 6))
    gain = gain + gain.T
    np.fill_diagonal(gain, -np.inf)
    parent = spanning_tree(gain)
    trees = []
    for p in itertools.product(range(6), repeat=5):  # all parents of nodes 1 to 5
        up, ok = (-1, *p), True
        for i in range(1, 6):
            seen, k = set(), i
            while k and k not in seen:
                seen.add(k)
                k = up[k]
            ok &= k == 0
        if ok:
            trees.append(sum(gain[i, up[i]] for i in range(1, 6)))
    assert np.isclose(sum(gain[i, parent[i]] for i in range(1, 6)), max(trees))


def test_posteriors_are_no_copy_of_the_labels(spark):
    """Voters never see the labels of the rows that they vote on, and the classifier's targets come from the votes."""
    sf = "/root/testdata/sf0.1"
    report = learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))[3]
    assert 0 < report["differ"] < 0.06 * report["rows"] and min(report["voters"]) > 50


def test_train():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    w, b = train(x, (x[:, 0] > 0).astype(float), penalty=1)
    assert w[0] > 5 * abs(w[1]) and (((x @ w + b) > 0) == (x[:, 0] > 0)).mean() > 0.97


def test_column_names(spark):
    docs = spark.createDataFrame([(1, "you scum", 5, "a b"), (2, "fine", 6, "c")], "doc_id long, text string, _split int, `n-chars of.it` string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    out = toxicity(docs, labels)
    assert out.columns == [*docs.columns, "held_out", "score", "predicted"]
    assert sorted((r[0], r[2], r[3]) for r in out.collect()) == [(1, 5, "a b"), (2, 6, "c")]
