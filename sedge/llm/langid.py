"""Language identification by a byte convolutional network: filters of several widths, max pooling, softmax; numpy only.

A text is cut into windows of WINDOW bytes, all of it. A filter of width w is a
table of weights by place and byte class, so a convolution is a sum of table
rows; rows of two neighbouring places are added beforehand. Windows give class
probabilities, and a document takes the sum of their logarithms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import freed, text_batches

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 16
#: Labelled documents that the network learns from, about; of each language at least about so many (or all it has); and windows of each, at most.
FIT_DOCS, FIT_LANG, FIT_WINDOWS = 4_000, 300, 3
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.004, 11
#: Windows that one vectorised step predicts.
STEP = 256


def _classes() -> tuple[np.ndarray, int]:
    """Byte classes: white space and controls 0, digits 1, other ASCII marks 2, letters without case, and each byte from 128 on."""
    out = np.zeros(256, np.int64)
    out[33:127] = 2
    out[48:58] = 1
    for i in range(26):
        out[65 + i] = out[97 + i] = 3 + i
    out[128:] = 29 + np.arange(128)
    return out, 29 + 128


CLASS, N_CLASSES = _classes()


@dataclass
class Network:
    """Filters by width: weights[w][place, class, filter], biases; a dense softmax layer over all maxima."""

    langs: list[str]
    weights: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray

    def compile(self) -> Network:
        """Adds the rows of neighbouring places; call once before predicting."""
        self.tables = []
        for w, k in zip(WIDTHS, self.weights, strict=True):
            parts = []
            for o in range(0, w, 2):
                if o + 1 < w:
                    parts.append((o, 2, (k[o][:, None, :] + k[o + 1][None, :, :]).reshape(-1, FILTERS)))
                else:
                    parts.append((o, 1, k[o]))
            self.tables.append((w, parts))
        return self

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Max over places of every filter, for windows of classes x."""
        pair = x[:, :-1] * N_CLASSES + x[:, 1:]
        out = []
        for w, parts in self.tables:
            n = x.shape[1] - w + 1
            total = None
            for o, wide, table in parts:
                rows = table.take((pair if wide == 2 else x)[:, o : o + n], axis=0, mode="clip")
                total = rows if total is None else np.add(total, rows, out=total)
            out.append(total.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.dense + self.out
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the cross entropy, languages drawn alike often, windows cut to random lengths so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.3, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
    n_feat = FILTERS * len(WIDTHS)
    bias, dense, out = np.zeros(n_feat, np.float32), rng.normal(0, 0.2, (n_feat, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    params = [*weights, bias, dense, out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    members = [np.flatnonzero(labels == k) for k in range(len(langs))]
    t = 0
    for _ in range(epochs):
        for _ in range(max(1, len(windows) // BATCH)):
            y = rng.integers(len(langs), size=BATCH)
            x = windows[[members[k][rng.integers(len(members[k]))] for k in y]].copy()
            cuts = rng.integers(24, WINDOW + 1, BATCH)
            x[np.arange(WINDOW)[None, :] >= np.where(rng.random(BATCH) < 0.5, cuts, WINDOW)[:, None]] = 0
            places, feats = [], []
            for w, k in zip(WIDTHS, weights, strict=True):
                n = WINDOW - w + 1
                total = sum(k[o].take(x[:, o : o + n], axis=0) for o in range(w))
                at = total.argmax(axis=1)
                places.append(at)
                feats.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0])
            pre = np.concatenate(feats, axis=1) + bias
            h = np.maximum(pre, 0)
            z = h @ dense + out
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(BATCH), y] -= 1
            p /= BATCH
            gh = (p @ dense.T) * (pre > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g, part = np.zeros_like(weights[i]), gh[:, i * FILTERS : (i + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), part.shape)
                for o in range(w):
                    np.add.at(g[o], (np.take_along_axis(x, places[i] + o, 1), f), part)
                grads.append(g)
            grads += [gh.sum(0), h.T @ p, p.sum(0)]
            t += 1
            for q, g, a, b in zip(params, grads, m, v, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                q -= (RATE / (1 - 0.9**t)) * a / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return Network(langs, weights, bias, dense, out).compile()


def windows_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes that cover every document, the last one filled up with white space, and the document of each."""
    size = np.diff(offs)
    n = np.maximum(1, -(-size // WINDOW))
    doc = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = offs[doc] + nth * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offs[doc + 1][:, None]
    if not len(data):
        return np.zeros((len(doc), WINDOW), np.int64), doc
    return np.where(inside, CLASS[data[np.minimum(at, len(data) - 1)]], 0), doc


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 4 == 2


def sample(docs: DataFrame, rows: int = FIT_DOCS) -> pa.Table:
    """At most FIT_WINDOWS windows, spread over the text, of each of about `rows` labelled documents that are not held out, every language among them."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    total = sum(r["n"] for r in counts)
    # a document's place among those of its language is a hash; languages with few rows give all of them
    share = {r["lang"]: min(1.0, max(rows / total, FIT_LANG / r["n"])) for r in counts}
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30))
    limit = F.lit(0)
    for least in sorted(set(share.values())):
        limit = F.when(F.col("lang").isin([k for k, v in share.items() if v == least]), int(least * (1 << 30)) + 1).otherwise(limit)
    chosen = usable.where(place < limit).select("text", "lang")

    def run(batches):
        for b in batches:
            texts, langs = [], []
            for text, lang in zip(b.column(0).cast(pa.large_binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = max(1, -(-len(text) // WINDOW))
                for i in sorted({k * n // FIT_WINDOWS for k in range(FIT_WINDOWS)}):
                    texts.append(text[i * WINDOW : (i + 1) * WINDOW])
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(langs, pa.string())], ["text", "lang"])

    return chosen.mapInArrow(freed(run), "text binary, lang string").toArrow()


def fit_on(docs: DataFrame, rows: int = FIT_DOCS) -> Network | None:
    """The network of the sample; None if no document is labelled."""
    found = sample(docs, rows)
    pairs = sorted(zip(found["lang"].to_pylist(), found["text"].to_pylist(), strict=True))
    if not pairs:
        return None
    langs = sorted({k for k, _ in pairs})
    raw = b"".join(t.ljust(WINDOW, b" ") for _, t in pairs)
    x = CLASS[np.frombuffer(raw, np.uint8)].reshape(-1, WINDOW)
    return train(x, np.array([langs.index(k) for k, _ in pairs]), langs)


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    Null text and text without a letter is 'und' with score 0; so is all
    without a network. score is the mean probability of the language over the
    windows, which cover long texts whole; of equal ones the first language
    learned is taken. Only the text counts. Repeated rows repeat; no rows, no
    rows; other columns don't matter.
    """
    net = docs.sparkSession.sparkContext.broadcast(network)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    letter = np.zeros(256, bool)
    letter[[i for i in range(128) if chr(i).isalpha()]] = True

    def run(batches):
        model = net.value
        for b in batches:
            lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            for first, _, data, offs in text_batches(b) if model else ():
                n = len(offs) - 1
                x, doc = windows_of(data, offs)
                logs = np.concatenate([model.log_probabilities(x[i : i + STEP]) for i in range(0, len(x), STEP)])
                begin = np.searchsorted(doc, np.arange(n))
                total, mean = np.add.reduceat(logs, begin), np.add.reduceat(np.exp(logs), begin) / np.bincount(doc, minlength=n)[:, None]
                best = total.argmax(1)
                plain = np.concatenate([[0], np.cumsum(letter[data])])
                known = plain[offs[1:]] > plain[offs[:-1]]
                for i in range(n):
                    if known[i] or (offs[i + 1] > offs[i] and _has_letter(data[offs[i] : offs[i + 1]].tobytes())):
                        lang[first + i] = model.langs[best[i]]
                        score[first + i] = min(1.0, max(0.0, float(mean[i, best[i]])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(freed(run), f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
