"""Toxicity: a cumulative-link (proportional odds) regression on sparse text features.

P(grade >= k) = sigmoid(w.x - theta_k): one weight vector shared by ordered
thresholds theta_1 <= ... <= theta_K. Features are words and word beginnings
(lower case, letters only), 1 where a document has them, chosen by their
one-sided association with the labels and normalised by nothing: one strong
word is as strong in a long document as in a short one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import _NO_LETTER, Words, freed, keep, labelled, mix, text_batches

#: Labelled rows that the model is fitted on, about, at most.
FIT_ROWS = 10_000
#: Features that the model has, at most, and documents that a feature must be in.
FEATURES, MIN_DOCS = 4_096, 4
PREFIXES = (4, 5, 6, 7, 8)
#: Ordered grades above 0 of a 0/1 label: by the share of words that are evidence, parted at these quantiles.
GRADE_QUANTILES = (1 / 3, 2 / 3)
RIDGE, STEPS, RATE = 1e-6, 600, 0.1
#: Clean labelled documents that the cut on expected severity may reject, at most, as a share.
LOSE_CLEAN = 0.002


def doc_features(batch: pa.RecordBatch, column: str = "text"):
    """(first row, end row, feature, row) of each run of documents, a pair for each word and each of its beginnings."""
    for a, b, data, offs in text_batches(batch, column):
        w = Words(data, offs, lower=True, breaks=_NO_LETTER)
        long = w.ends - w.starts + 1
        keys, docs = [w.hashes()], [w.doc]
        for n in PREFIXES:
            at = np.flatnonzero(long > n)
            keys.append(mix(w.hashes(n)[at] + np.uint64(n)))
            docs.append(w.doc[at])
        yield a, b, np.concatenate(keys), np.concatenate(docs)


@dataclass
class Ordinal:
    """Sorted feature hashes, their shared weights, and the thresholds in order."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are features, as places in keys and feature numbers."""
        at = np.flatnonzero(self.maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(self.features):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.features, keys[at]), len(self.features) - 1)
        hit = self.features[i] == keys[at]
        return at[hit], i[hit]

    def severity(self, batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
        """Expected severity (the sum of P(grade >= k)) and P(grade >= 1) of every row."""
        score = np.zeros(batch.num_rows)
        for a, b, keys, docs in doc_features(batch, column):
            at, i = self.find(keys)
            once = np.unique(docs[at] * len(self.features) + i)
            score[a:b] = np.bincount(once // max(1, len(self.features)), self.weights[once % max(1, len(self.features))], b - a) if len(once) else 0
        return self.expected(score)

    def expected(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= 1) of sums of weights."""
        p = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        return p.sum(1), p[:, 0]


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps (Adam) on the ridge-penalised ordinal likelihood."""
    k = int(grades.max())
    n = len(grades)
    w = np.zeros(n_features)
    first, gaps = np.array([1.0]), np.full(k - 1, 0.0)  # theta_1, then logs of what is added
    above = grades[:, None] >= np.arange(1, k + 1)
    state = [np.zeros(n_features + k), np.zeros(n_features + k)]
    for t in range(1, steps + 1):
        theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        s = np.bincount(rows, w[columns], n)
        p = 1 / (1 + np.exp(np.clip(theta - s[:, None], -40, 40)))
        g = (p - above) / n
        gs = g.sum(1)
        gw = np.bincount(columns, gs[rows], n_features) + RIDGE * w
        gt = -g.sum(0)
        grad = np.concatenate([gw, [gt.sum()], (np.cumsum(gt[::-1])[::-1][1:] * np.exp(gaps)) if k > 1 else []])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = RATE * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w -= move[:n_features]
        np.maximum(w, 0, out=w)  # features are evidence for a grade, never against one
        first = first - move[n_features]
        gaps = np.clip(gaps - move[n_features + 1 :], -5, 3)
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def feature_counts(batch: pa.RecordBatch, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the rows, and how many rows with and without the label have each."""
    names, pos, neg = [], [], []
    for a, b, keys, docs in doc_features(batch):
        f, column = np.unique(keys, return_inverse=True)
        pair = np.unique(column * (b - a) + docs)
        toxic = label[a + pair % (b - a)] > 0
        names.append(f)
        pos.append(np.bincount(pair // (b - a), toxic, len(f)))
        neg.append(np.bincount(pair // (b - a), ~toxic, len(f)))
    f, column = np.unique(np.concatenate(names), return_inverse=True)
    return f, np.bincount(column, np.concatenate(pos), len(f)).astype(np.int64), np.bincount(column, np.concatenate(neg), len(f)).astype(np.int64)


def evidence(pos: F.Column, neg: F.Column, n_pos: int, n_neg: int) -> F.Column:
    """The lower end of the log odds ratio: high for what is seen often, and seldom without the label."""
    p, n = pos + 0.5, neg + 0.5
    q, m = F.lit(n_pos + 0.5) - pos, F.lit(n_neg + 0.5) - neg
    return F.log(p / q) - F.log(n / m) - 3.5 * F.sqrt(1 / p + 1 / n + 1 / q + 1 / m)


def finish(features: np.ndarray, row: np.ndarray, column: np.ndarray, words: np.ndarray, label: np.ndarray) -> Ordinal:
    """The model from the rows' features (sorted pairs of row and column), their counts of words and beginnings, and their labels.

    Label 0 is grade 0; a positive 0/1 label is graded by its share of
    evidence, larger labels are grades themselves.
    """
    n, positive = len(label), label > 0
    grades = label.astype(np.int64).copy()
    if label.max() <= 1:
        share = np.bincount(row, minlength=n) / np.maximum(words, 1)
        edges = np.quantile(share[positive], GRADE_QUANTILES)
        grades[positive] = 1 + np.searchsorted(edges, share[positive], "left")
    grades = np.unique(grades, return_inverse=True)[1]
    w, theta = fit_ordinal(row, column, grades, len(features))
    model = Ordinal(features, w, theta)
    model.cut = cut(model.expected(np.bincount(row, w[column], n))[0], positive)
    return model


def cut(severity: np.ndarray, positive: np.ndarray) -> float:
    """The expected severity that parts the labels best, midway to the next lower one, among those that reject at most LOSE_CLEAN of the clean rows."""
    at = np.unique(severity)
    caught = 1 - np.searchsorted(np.sort(severity[positive]), at, "left") / positive.sum()
    lost = 1 - np.searchsorted(np.sort(severity[~positive]), at, "left") / (~positive).sum()
    best = int(np.argmax(np.where(lost <= LOSE_CLEAN, caught - lost, -1.0)))
    return float(at[best] + at[max(best - 1, 0)]) / 2 if lost[best] <= LOSE_CLEAN else 0.5


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Ordinal:
    """The model of about `rows` labelled documents, whole texts.

    Features are counted and chosen by the executors; the driver gets at most
    FEATURES of them, and for each labelled row which of them it has.
    """
    nothing = Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.array([20.0]))
    sample = labelled(docs, labels, "toxic", rows)
    sample = keep(sample.select("doc_id", "text", "label"), "toxic-sample")
    n_pos, n_neg = sample.agg(F.count(F.when(F.col("label") > 0, 1)), F.count(F.when(F.col("label") <= 0, 1))).first()
    if n_pos < MIN_DOCS or n_neg < MIN_DOCS:
        return nothing

    def count(batches):
        for b in batches:
            names, pos, neg = feature_counts(b, b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(pos), pa.array(neg)], ["feature", "pos", "neg"])

    counts = sample.mapInArrow(freed(count), "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= MIN_DOCS)
    chosen = counts.withColumn("low", evidence(F.col("pos"), F.col("neg"), n_pos, n_neg)).where("low > 0.5").orderBy(F.desc("low"), "feature").limit(FEATURES)
    features = np.sort(chosen.select("feature").toArrow()["feature"].to_numpy().view(np.uint64))
    if not len(features):
        return nothing
    table = sample.sparkSession.sparkContext.broadcast(features)

    def find(batches):
        model = Ordinal(table.value, np.zeros(len(table.value)), np.zeros(1))
        for b in batches:
            words, hits = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            for first, last, keys, at in doc_features(b):
                words[first:last] = np.bincount(at, minlength=last - first)
                place, i = model.find(keys)
                for pair in np.unique(at[place] * len(features) + i).tolist():
                    hits[first + pair // len(features)].append(pair % len(features))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(words), pa.array(hits, pa.list_(pa.int32()))], ["doc_id", "label", "words", "hits"])

    id_type = sample.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(freed(find), f"doc_id {id_type}, label int, words long, hits array<int>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("words", "ascending")])
    size = np.array([len(h) for h in found["hits"].to_pylist()])
    column = np.array([i for h in found["hits"].to_pylist() for i in h], np.int64)
    return finish(features, np.repeat(np.arange(len(size)), size), column, found["words"].to_numpy(), found["label"].to_numpy())


def grade(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic and kept of every whole text.

    kept is severity under the model's cut. Null or empty text has no evidence and is kept;
    so is everything if there are too few labels of either kind. Long texts are
    graded whole; a severity equal to the cut is rejected. Repeated rows and
    doc_ids repeat; no rows, no rows; other columns don't matter.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels, rows))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            severity, p = model.value.severity(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(severity), pa.array(p), pa.array(severity >= model.value.cut), pa.array(severity < model.value.cut)], ["doc_id", "severity", "p_toxic", "toxic", "kept"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), f"doc_id {id_type}, severity double, p_toxic double, toxic boolean, kept boolean")


def accepted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The documents that grade() keeps, with all their columns whatever they are called.

    Null and empty texts are kept; repeated rows go or stay together; an empty
    table gives an empty one; without enough labels of both kinds all stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels, rows))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.value.severity(b)[0] < model.value.cut))

    return docs.mapInArrow(freed(run), docs.schema)
