"""Toxicity by weak supervision.

1. Voters. General voters don't know any label: each word of a small lexicon of insults, and patterns (bursts of ! and ?, shouting, symbols,
   repetition, a high share of rare beginnings of words). Since the corpus has languages without such a lexicon, further lexicon voters
   are mined: labelled training rows are dealt to two folds, features (words and word beginnings) that tell most are counted in Spark over all
   rows of a fold, and vote on the rows of the *other* fold only. A voter says toxic where a text holds its feature
   more often than the corpus lets expect, and else abstains.
2. A generative label model of each fold's votes: the class, and for each voter a table of its votes given the class and one other voter (the
   maximum spanning tree of the voters' mutual information given the class), so that correlations are factors of the model. EM fits it to the
   votes alone; labels only say which of its classes is the toxic one.
3. A linear classifier is trained on the posterior labels, and scores every document's whole text.

The label model and the classifier see a bounded sample of rows (``SAMPLE``); all counts cover all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

FEATURES = 300  # mined features of a fold, those that tell most
VOTERS = 120  # of them vote, those that tell most of toxic texts
LEAST_DOCS = 4  # labelled documents of a fold that a feature must stand in
LEAST_Z = 3.5  # standardised excess of toxic documents that a voter's feature must have
SAMPLE = 20_000  # labelled rows that the label model and the classifier are fitted on, at most
HEADS = (4, 5, 6, 7, 8)
# A small general lexicon of insults, a voter each.
INSULTS = [
    "asshole", "bastard", "bitch", "clown", "coward", "creep", "cretin", "crap", "damn", "degenerate", "disgusting", "dumb", "dumbass", "failure", "filth", "fool", "freak", "garbage", "hate", "hideous",
    "idiot", "idiots", "ignorant", "imbecile", "jerk", "kill", "liar", "loser", "losers", "lunatic", "maggot", "moron", "morons", "nasty", "parasite", "pathetic", "pig", "repulsive", "retard", "scum",
    "shit", "shut", "sick", "slime", "stupid", "swine", "trash", "ugly", "useless", "vermin", "vile", "weak", "worthless", "wretch",
    "arschloch", "dumm", "idioten", "dreck", "abschaum", "trottel", "versager", "connard", "salaud", "imbécile", "ordure", "crétin", "nul", "basura", "estúpido", "idiota", "imbécil", "inútil", "asqueroso",
]
PATTERNS = ["burst", "shouting", "symbols", "repetition"]


def document_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and row of every occurrence of a word or word beginning, and the words per row."""
    from .decontaminate import _part

    start, end, first = c.words(np.where(_part[data], np.uint8(32), data), at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    if not len(start):
        return np.empty(0, np.int64), row, np.diff(first)
    prefix = c.prefix_hash(c.BYTE_LOWER[0][data], 0)
    out, rows = [c.mix(c.range_hash(prefix, start, end, 0))], [row]
    for n in HEADS:
        long = np.flatnonzero(end - start > n)
        out.append(c.mix(c.range_hash(prefix, start[long], start[long] + n, 0) + c.ODD[n % 8]))
        rows.append(row[long])
    return (np.concatenate(out) >> np.uint64(64 - c.BITS)).astype(np.int64), np.concatenate(rows), np.diff(first)


def general() -> np.ndarray:
    """The features of INSULTS, ascending."""
    word = lambda x: document_features(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0][0]
    return np.array(sorted({int(word(x)) for x in INSULTS}))


def patterns(data: np.ndarray, at: np.ndarray, f: np.ndarray, row: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Row by pattern voter: a burst of ! or ?, much shouting, many symbols, one feature that makes up much of the text."""
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    bang = (data == 33) | (data == 63)
    burst = bang.copy()
    burst[1:] &= bang[:-1]
    burst[:1] = False
    size = np.maximum(np.diff(at), 1)
    order, start = c.groups(f, row)
    most = np.zeros(len(at) - 1, np.int64)
    np.maximum.at(most, row[order[start]], np.diff(np.append(start, len(order))))
    return np.stack([total(burst) > 0, total((data >= 65) & (data <= 90)) > 0.3 * size, total(np.isin(data, list(b"#*$%&|<>@"))) > 0.05 * size, (words > 20) & (most > 0.3 * words)], axis=1)


# ---------------------------------------------------------------- labelled rows


def _labelled(batches: Iterator[pa.RecordBatch], path: str):
    """Batches of the labelled rows, with whether each is toxic and its fold."""
    last, known = None, {}
    for split, batch in c.by_split(batches):
        if split != last:
            last, got = split, c.delivered(path, split, ["doc_id", "toxic", "fold"])
            known = {} if got is None else {d: (t, f) for d, t, f in zip(*(got.column(k).to_pylist() for k in ("doc_id", "toxic", "fold")), strict=True)}
        doc = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        own = [i for i, d in enumerate(doc) if d in known]
        if own:
            toxic, fold = zip(*(known[doc[i]] for i in own), strict=True)
            yield batch.take(pa.array(own)), np.array(toxic), np.array(fold)


def _count(path: str, shards: int):
    """In how many documents and in how many toxic ones of each fold the features stand: messages to shards by feature."""

    def send(held):
        h, *sums = (np.concatenate(x) for x in zip(*held, strict=True))
        order, start = c.groups(h)
        h, sums = h[order[start]], [np.add.reduceat(x[order], start).astype(np.uint32) for x in sums]
        shard = c.shard_of(h, shards)
        cut = c._cut(shard)
        return c.table(shard=pa.array([int(shard[a]) for a, _ in cut], pa.int64()), body=pa.array([c.pack(h[a:b], [x[a:b] for x in sums]) for a, b in cut], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, toxic, fold in _labelled(batches, path):
            f, row, _ = document_features(*c.text_buffer(batch))
            order, start = c.groups(f, row)
            f, row = f[order[start]], row[order[start]]
            held.append((f, *((fold[row] == x) & (toxic[row] >= y) for x in (0, 1) for y in (0, 1))))
            size += len(f)
            if size > 1 << 19:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    return run


def _telling(docs: list[int], toxic: list[int]):
    """The features of a shard that tell most in either fold, by their standardised excess of toxic documents."""

    def run(messages: pa.Table) -> pa.Table:
        got = [c.unpack(x, ["<u4"] * 4) for x in messages.column("body").to_pylist()]
        h = np.concatenate([k for k, _ in got])
        order, start = c.groups(h)
        sums = [np.add.reduceat(np.concatenate([v[i] for _, v in got])[order], start).astype(float) for i in range(4)]
        h = h[order[start]]
        out = []
        for fold in (0, 1):
            n, t = sums[2 * fold : 2 * fold + 2]
            share = toxic[fold] / max(1, docs[fold])
            z = np.where(n >= LEAST_DOCS, (t - n * share) / np.sqrt(n * share * (1 - share) + 0.5), 0)
            best = np.lexsort((h, -np.abs(z)))[:FEATURES]
            best = best[np.abs(z[best]) > 1]
            out.append(pa.table({"fold": np.full(len(best), fold), "h": h[best], "z": z[best]}))
        return pa.concat_tables(out)

    return run


def counts(f: np.ndarray, row: np.ndarray, rows: int, known: np.ndarray) -> np.ndarray:
    """Occurrences of the known features (ascending) in each row."""
    out = np.zeros((rows, len(known)), np.float32)
    at = c.member(known, f)
    hit = at >= 0
    out += np.bincount(row[hit] * len(known) + at[hit], minlength=out.size).reshape(out.shape) if len(known) else 0
    return out


def _sample(path: str, known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, toxic, fold in _labelled(batches, path):
            data, at = c.text_buffer(batch)
            f, row, words = document_features(data, at)
            x = np.minimum(counts(f, row, batch.num_rows, known), 255).astype(np.uint8)
            seen = patterns(data, at, f, row, words).astype(np.uint8)
            arrays = {"toxic": toxic.astype(np.uint8), "fold": fold.astype(np.uint8), "words": words.astype("<i8"), "x": x, "patterns": seen}
            yield c.table(**{k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()})

    return run


# ---------------------------------------------------------------- label model


def lexicon_votes(x: np.ndarray, words: np.ndarray, insult: np.ndarray) -> np.ndarray:
    """1 (toxic) where a row has an insult, or a mined feature clearly more often than its length and the feature's rate in all rows let expect, else 0 (abstains)."""
    expected = np.outer(words, x.sum(axis=0, dtype=float) / max(1, words.sum())).astype(np.float32)
    return ((x >= 1) & (insult | (x > expected + 2 * np.sqrt(expected)))).astype(np.int8)


def spanning_tree(gain: np.ndarray) -> list[int]:
    """Parent of each node (-1 for the root, node 0) in the maximum spanning tree of the symmetric matrix gain."""
    n = len(gain)
    parent, best, done = [-1] * n, gain[0].copy(), np.zeros(n, bool)
    near = np.zeros(n, int)
    done[0] = True
    for _ in range(n - 1):
        j = int(np.argmax(np.where(done, -np.inf, best)))
        parent[j], done[j] = int(near[j]), True
        better = ~done & (gain[j] > best)
        best[better], near[better] = gain[j][better], j
    return parent


class LabelModel:
    """P(class) and, for each voter, P(vote | class, vote of the voter's parent); votes are 0 (abstains), 1 (toxic), 2 (not toxic)."""

    def __init__(self, votes: np.ndarray, rounds: int = 40, smooth: float = 0.2):
        n, m = votes.shape
        self.votes, self.smooth = votes, smooth
        self.hot = np.stack([votes == k for k in range(3)], axis=2).reshape(n, 3 * m).astype(np.float32)
        # EM starts from a count of votes, in which voters that nearly copy each other share one
        said = (votes == 1).astype(float) - (votes == 2)
        alike = np.abs(np.corrcoef(said, rowvar=False).reshape(m, m)) if n > 1 else np.eye(m)
        yes = said @ (1 / np.maximum(1, (np.nan_to_num(alike) > 0.95).sum(axis=1)))
        self.posterior = np.where(yes > 1.25, 0.9, np.where(yes > 0.75, 0.6, 0.02))
        self.parent = [-1] * m
        for i in range(rounds):
            if i in (1, 4, 8, 20):  # the first round takes voters as independent, else the factors would take up what the class explains
                self.parent = spanning_tree(self._information())
            self._maximise()
            self.posterior = self.classify(votes)

    def _pairs(self, y: int) -> np.ndarray:
        """Weighted counts of the votes of all pairs of voters in a class."""
        weight = self.posterior if y else 1 - self.posterior
        m = self.votes.shape[1]
        return (self.hot.T @ (self.hot * weight[:, None].astype(np.float32))).astype(float).reshape(m, 3, m, 3)

    def _information(self) -> np.ndarray:
        """Mutual information of all pairs of voters given the class."""
        out = 0
        for y in (0, 1):
            joint = self._pairs(y) + 1e-9
            own = self.posterior.sum() if y else len(self.posterior) - self.posterior.sum()
            joint /= max(own, 1e-9)
            single = np.einsum("jkjk->jk", joint)
            out = out + own * (joint * np.log(joint / (single[:, :, None, None] * single[None, None]))).sum(axis=(1, 3))
        np.fill_diagonal(out, -np.inf)
        return out

    def _maximise(self) -> None:
        self.prior = float(np.clip(self.posterior.mean(), 1e-4, 1 - 1e-4))
        self.tables = []  # of each voter: class, parent's vote, vote
        for j, up in enumerate(self.parent):
            table = np.empty((2, 3, 3))
            above = self.votes[:, up].astype(int) if up >= 0 else np.zeros(len(self.votes), int)
            for y in (0, 1):
                weight = self.posterior if y else 1 - self.posterior
                count = np.bincount(above * 3 + self.votes[:, j], weight, minlength=9).reshape(3, 3)
                overall = (count.sum(axis=0) + self.smooth) / (count.sum() + 3 * self.smooth)
                table[y] = (count + 3 * self.smooth * overall) / (count.sum(axis=1, keepdims=True) + 3 * self.smooth)
            self.tables.append(table)

    def classify(self, votes: np.ndarray) -> np.ndarray:
        """Posterior probability of class 1 for each row of votes."""
        logit = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, up in enumerate(self.parent):
            above = votes[:, up] if up >= 0 else np.zeros(len(votes), int)
            logit += np.log(self.tables[j][1][above, votes[:, j]] / self.tables[j][0][above, votes[:, j]])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def accuracies(self) -> np.ndarray:
        """Of each voter, how often a vote of it agrees with the class, by the model's posterior."""
        p = self.posterior[:, None]
        right = (np.where(self.votes == 1, p, 0) + np.where(self.votes == 2, 1 - p, 0)).sum(axis=0)
        return right / np.maximum((self.votes > 0).sum(axis=0), 1)


# ---------------------------------------------------------------- classifier


PENALTY = 0.006  # L2, for each row


def train(x: np.ndarray, target: np.ndarray, penalty: float | None = None, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (standardised features, L2), by accelerated gradient steps. x is scaled in place."""
    penalty = max(0.5, PENALTY * len(x)) if penalty is None else penalty
    mean = x.mean(axis=0, dtype=np.float64)
    sd = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=np.float64) / max(1, len(x)) - mean**2, 0))
    sd[sd < 1e-4] = np.inf  # a constant feature has no weight
    x /= sd.astype(x.dtype)
    z, n = x, len(x)
    scale = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(z.shape[1]), float(np.log(scale / (1 - scale)))
    if z.shape[1]:
        probe = (np.ones(z.shape[1]) / np.sqrt(z.shape[1])).astype(z.dtype)
        for _ in range(20):
            probe = z.T @ (z @ probe)
            norm = np.linalg.norm(probe) + 1e-12
            probe /= norm
        step = float(1 / (norm / 4 + n / 4 + penalty))
        last_w, last_b = w, b
        for i in range(rounds):
            m = i / (i + 3)
            yw, yb = w + m * (w - last_w), b + m * (b - last_b)
            off = 1 / (1 + np.exp(-np.clip(z @ yw.astype(z.dtype) + yb, -30, 30))) - target
            last_w, last_b = w, b
            w, b = yw - step * (z.T @ off.astype(z.dtype) + penalty * yw), yb - step * off.sum()
    return w / sd, b


def posteriors(x: np.ndarray, words: np.ndarray, seen: np.ndarray, fold: np.ndarray, given: np.ndarray, voters: list[np.ndarray], insult: np.ndarray) -> tuple[np.ndarray, list[LabelModel]]:
    """Posterior of each row. voters: for each fold, the columns of x that vote there; insult: whether a column is a general voter's."""
    out, models = np.zeros(len(x)), []
    for f in (0, 1):
        own = fold == f
        if not own.any():
            continue
        votes = np.column_stack([lexicon_votes(x[own][:, voters[f]], words[own], insult[voters[f]]), seen[own].astype(np.int8)])
        votes = votes[:, votes.any(axis=0)]
        if not votes.shape[1]:
            continue
        model = LabelModel(votes)
        p = model.posterior
        # the labels only name the classes
        if 0 < given[own].sum() < own.sum() and p[given[own] == 1].mean() < p[given[own] == 0].mean():
            p = 1 - p
        out[own] = p
        models.append(model)
    return out, models


def _score(known: np.ndarray, weights: np.ndarray, bias: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in c.by_split(batches, text):
            f, row, _ = document_features(*c.text_buffer(batch, text))
            logit = (np.log1p(counts(f, row, batch.num_rows, known).astype(float)) * weights).sum(axis=1) + bias  # row by row, so the same for equal texts
            score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield batch.append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= 0.5).astype(np.int32)))

    return run


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, score (0 to 1, higher: toxic likelier) and predicted (1 if score >= 0.5).

    Learns from labels (doc_id, toxic) of rows that aren't held out; of several labels for a doc_id the
    largest counts, null ones don't. The label model and the classifier see ``sample`` rows at most, those with the
    smallest hashes of doc_id. Scores are a function of the text alone; null and empty texts have no
    features and get the classifier's constant. Without usable labels of both classes every score is the
    share of toxic labels (0 without labels). Columns of docs named held_out, score or predicted are replaced, all others
    are returned, whatever their names.
    """
    docs = docs.drop("held_out", "score", "predicted")
    rows, names = c.plain(docs)
    c.columnwise(docs.sparkSession)
    known, weights, bias = learn(docs, labels, sample)[:3]
    out = rows.withColumn("held_out", held_out(names["doc_id"]))
    schema = T.StructType([*out.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return out.mapInArrow(_score(known, weights, bias, names["text"]), schema).toDF(*docs.columns, "held_out", "score", "predicted")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The classifier: features, weights and constant; and a report of the label models."""
    own = c.with_split(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    given = given.where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int").alias("fold")
    there = c.keep(own.select("doc_id", "_split").distinct().join(given, "doc_id").select("doc_id", "toxic", fold, "_split"), "op3-labels")
    size = {r.fold: r for r in there.groupBy("fold").agg(F.count(F.lit(1)).alias("docs"), F.sum("toxic").alias("bad")).collect()}
    docs_of, toxic_of = ([size[f][k] if f in size else 0 for f in (0, 1)] for k in ("docs", "bad"))
    total, bad = sum(docs_of), sum(toxic_of)
    if not 0 < bad < total:
        share = min(max(bad / total, 1e-9), 1 - 1e-9) if total else 0
        return np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))) if total else -30.0, {}
    texts, shards = own.select("doc_id", "text", "_split"), c.shard_count(own)
    labelled = c.deliver(there, "op3-told", own)
    counted = texts.mapInArrow(_count(labelled, shards), "shard long, body binary")
    told = c.keep(counted.groupBy("shard").applyInArrow(_telling(docs_of, toxic_of), "fold long, h long, z double"), "op3-telling")
    mined = [[(r.h, r.z) for r in told.where(F.col("fold") == f).orderBy(F.abs("z").desc(), "h").limit(FEATURES).collect()] for f in (0, 1)]
    known = np.unique(np.concatenate([general(), *(np.array([h for h, _ in x], np.int64) for x in mined)]))
    few = there if total <= sample else there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # SAMPLE rows with a byte for each feature
    sampled = c.deliver(few, "op3-few", own)
    got = texts.mapInArrow(_sample(sampled, known), "toxic binary, fold binary, words binary, x binary, patterns binary").collect()
    x, seen, words, folds, toxic = (np.frombuffer(b"".join(r[k] for r in got), kind) for k, kind in (("x", "u1"), ("patterns", "u1"), ("words", "<i8"), ("fold", "u1"), ("toxic", "u1")))
    del got
    c.drop(there, told)
    c.drop_told(own.sparkSession, labelled, sampled)
    x, seen = x.reshape(-1, len(known)), seen.reshape(-1, len(PATTERNS))
    # an order that doesn't follow from how rows were dealt to tasks
    order = np.lexsort((toxic, folds, c.mix((x @ c.ODD_ROW[: len(known)]) + (seen @ c.ODD_ROW[: len(PATTERNS)])), words))
    x, seen, words, folds, toxic = (v[order] for v in (x, seen, words, folds, toxic))
    tells = [np.array([h for h, z in mined[1 - f] if z >= LEAST_Z][:VOTERS], np.int64) for f in (0, 1)]
    voters = [np.searchsorted(known, np.unique(np.concatenate([general(), t]))) for t in tells]
    p, models = posteriors(x, words, seen, folds, toxic, voters, np.isin(known, general()))
    x = x.astype(np.float32)
    weights, bias = train(np.log1p(x, out=x), p)
    return known, weights, bias, {"rows": len(x), "toxic": int(toxic.sum()), "differ": int(((p >= 0.5) != toxic).sum()), "voters": [m.votes.shape[1] for m in models], "models": models}


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
