"""Quality rules: rule statistics of whole texts, judged by an isolation forest calibrated on labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.common import clear, freed, keep, label_of, mix, segment_bounds, segment_sums, text_batches, words, written

#: Characters that count as symbols, fixed by the rule.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbols_per_word", "repeated", "upper", "exclaims", "bars", "marks_per_word"]
TREES, SUBSAMPLE, SEED = 128, 256, 20240229
#: Bins of the scores, each of which is cumulated in one task.
BINS = 4096
#: The share of good labelled documents that pass the base rule and that the threshold may reject, at most.
LOSE_GOOD = 0.004


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL, _UPPER, _EXCLAIM, _BAR = (_class(x) for x in (SYMBOLS, bytes(range(65, 91)), b"!", b"|"))
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)))
_MARK = _class(bytes(c for c in range(33, 127) if not chr(c).isalnum()))


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def statistics(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts (int64, a column for each of COUNTS) and ratios (float64, of RATIOS) of every row; null is no words."""
    counts, ratios = np.zeros((batch.num_rows, len(COUNTS)), np.int64), np.zeros((batch.num_rows, len(RATIOS)))
    for a, b, data, offs in text_batches(batch, column):
        n = b - a
        h, doc, points = words(data, offs, lower=False)
        bounds = segment_bounds(doc, n)
        n_words = np.diff(bounds)
        chars = segment_sums(points, bounds)
        repeat = np.zeros(len(h), np.int64)
        if len(h) >= 3:
            inner = np.flatnonzero(doc[2:] == doc[:-2])
            key = mix(mix(mix(h[inner]) + h[inner + 1]) + h[inner + 2]) + mix(doc[inner])
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            again = inner[times[back] > 1]
            for k in range(3):
                repeat[again + k] = 1
        n_repeat = segment_sums(repeat, bounds)
        per_byte = lambda lut: segment_sums(lut[data], offs)
        raw = data.tobytes()
        dup = np.array([_dup_lines(raw[offs[i] : offs[i + 1]]) for i in range(n)], np.int64)
        symbols = per_byte(_SYMBOL)
        counts[a:b] = np.column_stack([n_words, chars, symbols, dup, n_repeat])
        w, letters = np.maximum(n_words, 1), np.maximum(per_byte(_LETTER), 1)
        ratios[a:b] = np.column_stack([chars / w, symbols / w, n_repeat / w, per_byte(_UPPER) / letters, per_byte(_EXCLAIM) / w, per_byte(_BAR) / w, per_byte(_MARK) / w])
    return counts, ratios


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The rule: under 50 words, or over half of the words in repeated 3-word windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), split, children, and the path length that a leaf stands for."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    depth: int
    scale: float
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / c): near 1 is odd, under 0.5 is usual."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            f, s, lo, hi = self.feature[t], self.split[t], self.left[t], self.right[t]
            for _ in range(self.depth):
                at = f[node]
                inner = at >= 0
                node = np.where(inner, np.where(x[rows, np.maximum(at, 0)] < s[node], lo[node], hi[node]), node)
            total += self.length[t][node]
        return np.exp2(-total / len(self.feature) / self.scale)


def _c(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, deviation: np.ndarray, trees: int = TREES, size: int = SUBSAMPLE, seed: int = SEED) -> Forest:
    """Random splits over random features; a split may fall outside of the node's range by half of it, so that what lies beyond all that was seen is cut off early.

    x: rows in random order, of which each tree takes its own `size`, or draws
    them if there are too few for that. low, high and deviation are those of
    all rows, in x or not.
    """
    rng = np.random.default_rng(seed)
    apart = len(x) >= trees * size
    size = min(size, len(x))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    n = 2 ** (depth + 1)
    shape = (trees, n)
    feature, split = np.full(shape, -1), np.zeros(shape)
    left, right, length = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape)
    wide = np.maximum(deviation, 0.02 * np.maximum(1, np.maximum(np.abs(low), np.abs(high))))
    for t in range(trees):
        mine = x[t * size : (t + 1) * size] if apart else x[rng.choice(len(x), size, replace=False)] if len(x) else x
        todo, used = [(0, mine, 0)], 1
        while todo:
            node, rows, d = todo.pop()
            if d == depth or len(rows) <= 1:
                length[t, node] = d + _c(len(rows))
                continue
            f = int(rng.integers(x.shape[1]))
            lo, hi = rows[:, f].min() - 0.5 * wide[f], rows[:, f].max() + 0.5 * wide[f]
            at = rng.uniform(max(lo, low[f] - wide[f]), min(hi, high[f] + wide[f]))
            feature[t, node], split[t, node], left[t, node], right[t, node] = f, at, used, used + 1
            mask = rows[:, f] < at
            todo += [(used, rows[mask], d + 1), (used + 1, rows[~mask], d + 1)]
            used += 2
    return Forest(feature, split, left, right, length, depth, max(_c(size), 1.0))


def threshold(scores: DataFrame) -> float:
    """Of the thresholds that reject at most LOSE_GOOD of the good rows, the one that parts good and bad best (rates of both; midway to the next score).

    scores: score, good and bad (how many rows have it), each score once. Rows
    are counted up to every score: within a bin, after all that lower bins have.
    """
    binned = scores.withColumn("bin", F.least(F.floor(F.col("score") * BINS), F.lit(BINS)))
    totals = binned.groupBy("bin").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    lower, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    # at most BINS + 1 rows
    totals = totals.select("bin", *(F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"{c}0") for c in "gb"), *(F.sum(c).over(whole).alias(f"{c}1") for c in "gb"))
    up = Window.partitionBy("bin").orderBy("score")
    upto = binned.join(F.broadcast(totals), "bin").select("score", *((F.sum(c).over(up) + F.col(f"{k}0")).alias(k) for c, k in (("good", "g"), ("bad", "b"))), "g1", "b1")
    lost, caught = 1 - F.col("g") / F.col("g1"), 1 - F.col("b") / F.greatest(F.col("b1"), F.lit(1))
    best = upto.where(lost <= LOSE_GOOD).agg(F.max(F.struct((caught - lost).alias("worth"), (-F.col("score")).alias("at")))["at"]).first()[0]
    at = -best
    after = scores.where(F.col("score") > at).agg(F.min("score")).first()[0]
    return float(at + (at if after is None else after)) / 2 + 1e-9


def fit_on(docs: DataFrame, labels: DataFrame) -> Forest:
    """The forest of all labelled documents that pass the base rule (quality 1 is good): grown on the good ones, its threshold set on all.

    Each tree takes SUBSAMPLE good rows, as the method has it, drawn by hash
    from all of them; ranges, deviations and the threshold are aggregates over
    all rows. The drawn rows' statistics come to the driver, no texts. With
    fewer than 20 good rows nothing is known and all are kept.
    """
    id_type, others = docs.schema["doc_id"].dataType.simpleString(), written()

    def run(batches):
        for b in batches:
            counts, x = statistics(b)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in x.T)], ["doc_id", *RATIOS]).filter(pa.array(~base_failed(counts)))

    # statistics meet the labels, not texts: both tables grow
    rows = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(freed(run), f"doc_id {id_type}, " + ", ".join(f"{c} double" for c in RATIOS))
    rows = keep(rows.join(label_of(labels, "quality"), "doc_id"), "quality-labelled")
    good = rows.where("label = 1")
    ends = good.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}_{c}") for k, f in (("low", F.min), ("high", F.max), ("wide", F.stddev_pop)) for c in RATIOS)).first()
    if ends["n"] < 20:
        clear(docs.sparkSession, spare=others)
        none = np.zeros(len(RATIOS))
        forest = grow(np.zeros((0, len(RATIOS))), none, none, none, 1)
        forest.threshold = 2.0
        return forest
    drawn = good.orderBy(F.xxhash64(F.lit(SEED), "doc_id", *RATIOS), *RATIOS).limit(TREES * SUBSAMPLE).select(*RATIOS).toArrow()
    low, high, wide = (np.array([ends[f"{k}_{c}"] for c in RATIOS]) for k in ("low", "high", "wide"))
    # sums come in any order: digits that hold whatever it is
    forest = grow(np.column_stack([drawn[c].to_numpy() for c in RATIOS]), low, high, wide.round(9))
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def scored(batches):
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy() for k in range(len(RATIOS))])
            is_good = b.column(len(RATIOS)).to_numpy() == 1
            yield pa.RecordBatch.from_arrays([pa.array(model.value.score(x)), pa.array(is_good.astype(np.int64)), pa.array((~is_good).astype(np.int64))], ["score", "good", "bad"])

    scores = rows.select(*RATIOS, "label").mapInArrow(freed(scored), "score double, good long, bad long").groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    forest.threshold = threshold(keep(scores, "quality-scores"))
    clear(docs.sparkSession, spare=others)
    return forest


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the rule statistics, base_failed, score and kept of every whole text.

    Null or empty text has no words: all counts 0, base_failed, not kept.
    kept is false if base_failed, else whether the forest's score is within its
    threshold; without 20 good labelled rows it rejects nothing. Long texts
    count whole. Repeated rows and doc_ids repeat; no rows, no rows; other
    columns don't matter.
    """
    forest = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *COUNTS, "base_failed", "score", "kept"]

    def run(batches):
        for b in batches:
            counts, x = statistics(b)
            failed, score = base_failed(counts), forest.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score <= forest.value.threshold))], names)

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select("doc_id", "text").mapInArrow(freed(run), f"doc_id {id_type}, {kinds}, base_failed boolean, score double, kept boolean")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that judge() keeps, with all their columns whatever they are called.

    Null and empty texts have no words and go; repeated rows go or stay
    together; an empty table gives an empty one.
    """
    forest = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels))

    def run(batches):
        for b in batches:
            counts, x = statistics(b)
            yield b.filter(pa.array(~base_failed(counts) & (forest.value.score(x) <= forest.value.threshold)))

    return docs.mapInArrow(freed(run), docs.schema)
