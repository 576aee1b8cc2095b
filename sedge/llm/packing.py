"""Best-fit packing by patterns: lengths that fill a sequence together, their repeats fitted to the histogram by non-negative least squares.

Everything is planned on the histogram of piece lengths, which has as many bins
as a sequence has tokens whatever the corpus holds: patterns of up to three
lengths, the fit, rounding, and best fit for the residual. The plan is a bounded
list of runs, (length, first rank, count, first sequence, step, offset), and a
piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.bpe import library, utf8
from sedge.llm.common import freed, keep

WIDTH = 2048
#: Lengths that may take part in patterns of three: the fullest bins; patterns of one or two use all. It bounds the plan's time; every piece is placed whatever it is.
TRIPLE_BINS = 160
ITERATIONS = 300


def pieces(docs: DataFrame, path: str, width: int = WIDTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (part, nth): where the piece stands among its length in its task.

    The end-of-document id 0 follows every document, the null or empty one too.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches):
        from pyspark import TaskContext

        c, part = library(path), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, text in enumerate(utf8(b.column(1))):
                ids = c.ids(text) + b"\0\0\0\0"
                for k in range(0, len(ids), 4 * width):
                    part_ids = ids[k : k + 4 * width]
                    n = len(part_ids) // 4
                    row.append(i)
                    piece.append(k // (4 * width))
                    start.append(k // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part_ids))
                    nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())], names)

    # not freed: the words of one task serve the next
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def patterns(histogram: np.ndarray, width: int) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a sequence exactly: all of one and two, and of three those whose two longer or shorter lengths are common."""
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    found = []
    if width < len(histogram) and histogram[width]:
        found.append([width, 0, 0])
    found += [[width - a, a, 0] for a in have if a <= width - a and histogram[width - a]]
    common = have[np.argsort(-histogram[have], kind="stable")][:TRIPLE_BINS]
    a, b = np.meshgrid(common, common)
    a, b = a.ravel(), b.ravel()
    c = width - a - b
    ok = (c > 0) & (a <= b)
    a, b, c = a[ok], b[ok], c[ok]
    ok = histogram[c] > 0
    triples = np.unique(np.sort(np.column_stack([a[ok], b[ok], c[ok]]), axis=1)[:, ::-1], axis=0)
    return np.concatenate([np.array(found, np.int64).reshape(-1, 3), triples])


def repeats(rows: np.ndarray, histogram: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Non-negative x that least squares fits A x to the histogram, weighed by length: accelerated projected gradient."""
    if not len(rows):
        return np.zeros(0)
    n = len(histogram)
    # a length left over costs as much as it fills, relative to how many there are
    weight = np.arange(n) / n / np.sqrt(np.maximum(histogram, 1))
    w2 = weight**2
    x = np.zeros(len(rows))
    use = rows > 0
    flat, owner = rows[use], np.repeat(np.arange(len(rows)), use.sum(1))

    def residual(v: np.ndarray) -> np.ndarray:
        return np.bincount(flat, v[owner], n) - histogram

    # a diagonal majoriser: pattern j's own weights times how many patterns meet there
    meet = np.bincount(flat, minlength=n)
    step = 1 / np.maximum(np.bincount(owner, (w2 * meet)[flat], len(rows)), 1e-30)
    y, t = x, 1.0
    for _ in range(iterations):
        g = np.bincount(owner, (w2 * residual(y))[flat], len(rows))
        new = np.maximum(y - step * g, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(new + (t - 1) / t2 * (new - x), 0)
        x, t = new, t2
    return x


def plan(histogram: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """Runs (length, rank, count, sequence, per, offset) and the number of sequences.

    Piece `rank + i` of a run, i < count, goes to sequence `sequence + i // per`,
    at offset + length * (i % per). histogram[l]: pieces of length l.
    """
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, count: int, sequence: int, per: int, offset: int) -> None:
        runs.append((length, int(used[length]), count, sequence, per, offset))
        used[length] += count
        left[length] -= count

    rows = patterns(histogram, width)
    x = repeats(rows, histogram)
    for j in np.lexsort((np.arange(len(x)), -x)):
        wanted = int(np.round(x[j]))
        if wanted < 1:
            break
        lengths, times = np.unique(rows[j][rows[j] > 0], return_counts=True)
        n = min(wanted, *(int(left[a] // k) for a, k in zip(lengths, times, strict=True)))
        if n < 1:
            continue
        offset = 0
        for a, k in zip(lengths[::-1], times[::-1], strict=True):
            place(int(a), n * int(k), sequences, int(k), offset)
            offset += int(a) * int(k)
        sequences += n
    # the residual: best fit, longest first, on groups of sequences with equal room
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, how many)
    free = np.zeros(width + 1, bool)
    for a in range(width, 0, -1):
        while left[a]:
            fits = np.flatnonzero(free[a:])
            if len(fits):
                r = a + int(fits[0])
                first, many = room[r].pop()
                if not room[r]:
                    free[r] = False
                per = min(r // a, int(left[a]))
                n = min(many, int(left[a]) // per)
                if n < many:
                    room[r].append((first + n, many - n))
                    free[r] = True
                place(a, n * per, first, per, width - r)
                rest = r - a * per
            else:
                per = min(width // a, int(left[a]))
                n, first = int(left[a]) // per, sequences
                sequences += n
                place(a, n * per, first, per, 0)
                rest = width - a * per
            if rest:
                room[rest].append((first, n))
                free[rest] = True
    out = np.array(sorted(runs), np.int64).reshape(-1, 6)
    return out, sequences


def pack(docs: DataFrame, path: str, width: int = WIDTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    Documents longer than a sequence are cut, no others; null text is the end
    id alone. Repeated rows are packed as often as they occur; which of equally
    long pieces goes where is their order within a task. No rows, no sequences;
    other columns don't matter.
    """
    spark = docs.sparkSession
    cut = keep(pieces(docs, path, width), "pieces")
    counts = keep(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(width + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `width` rows
        histogram[r["length"]] = r["n"]
    runs = spark.sparkContext.broadcast(plan(histogram, width)[0])
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    # counts by task grow with the input, so they are never broadcast
    ranked = cut.join(firsts.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        table = runs.value
        key = table[:, 0] * (1 << 44) + table[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            r = table[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1]
            i = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(r[:, 3] + i // r[:, 4]), pa.array(r[:, 5] + length * (i % r[:, 4]))], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(freed(run), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
