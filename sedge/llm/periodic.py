"""Periodic runs of words: stretches that repeat with a period at least four times.

A run of smallest period q has length >= max(6, 4 * q), so each of its 5-word
shingles recurs within it. Words that no recurring shingle covers are in no run
and part a text into segments. Within a segment runs are found by the method of
Kolpakov and Kucherov: the segment is cut into factors, each the longest that
occurred before (found with a suffix automaton); Main's step finds the runs that
cross or touch a boundary of factors; runs inside of a factor are copied from
the factor's earlier occurrence.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import freed, mix, own

#: A run holds its period so many times, and so many words, at least.
TIMES, LEAST = 4, 6
#: Every window of so many words of a run recurs in the run.
WINDOW = 5
#: Rounds of parting a text at words that no run can hold; more would only spare work.
ROUNDS = 4


class Automaton:
    """The suffix automaton of a sequence: transitions, and where what a state stands for ended first."""

    def __init__(self, word: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.first: list[int] = [-1]
        length, link = [0], [-1]
        nxt, first, last = self.next, self.first, 0
        for i, c in enumerate(word):
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            first.append(i)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    first.append(first[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, back): the longest piece that also starts `back` places before, or a new letter (back 0)."""
    a = Automaton(word)
    nxt, first = a.next, a.first
    out, i, n = [], 0, len(word)
    while i < n:
        state, j = 0, i
        while j < n:
            t = nxt[state][word[j]]
            if first[t] >= j:
                break
            state, j = t, j + 1
        out.append((i, j, j - 1 - first[state]) if j > i else (i, i + 1, 0))
        i = out[-1][1]
    return out


def prefix_lengths(s: list[int]) -> list[int]:
    """How many letters s has in common with its own rest from each place on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def touching(word: list[int], a: int, b: int, end: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) that cross or touch the boundary b and end by `end`, where [a, b) and [b, end) are factors.

    One that ends beyond b begins within a period of a, or else the factor at a
    would be longer; so its period is under a third of both factors. One that
    ends at b and begins earlier than that has touched an earlier boundary.
    """
    most = (end - 1 - a) // (TIMES - 1)
    low = max(0, a - most)
    if most < 1 or end - low < LEAST:
        return []
    left, right = word[low:b], word[b : end + 1]
    back = left[::-1]
    nl, nr = len(left), len(right)
    own_r, own_l = prefix_lengths(right), prefix_lengths(back)
    pr, pl = min(most, nr), min(most, nl)
    # over the boundary: back from b against back from b + p, and on from b against on from b - p
    to_left = prefix_lengths([*back, -1, *(left + right[:pr])[::-1]])
    to_right = prefix_lengths([*right, -1, *left[nl - pl :], *right])
    out = []
    for p in range(1, most + 1):
        if p <= pr:
            s, e = b - to_left[nl + 1 + pr - p], b + p + (own_r[p] if p < nr else 0)
            out.append((s, e, p))
        if p <= pl:
            s, e = b - p - (own_l[p] if p < nl else 0), b + to_right[nr + 1 + pl - p]
            out.append((s, e, p))
    return [(s, e, p) for s, e, p in out if e <= end and e - s >= max(LEAST, TIMES * p) and (s > low or not low)]


def segment_runs(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of a sequence, by start and end."""
    period: dict[tuple[int, int], int] = {}
    order: list[tuple[int, int]] = []

    def add(s: int, e: int, p: int) -> None:
        if (s, e) not in period:
            insort(order, (s, e))
            period[s, e] = p
        elif p < period[s, e]:
            period[s, e] = p

    cut = factors(word)
    for (a, b, _), (_, end, back) in pairwise([(0, 0, 0), *cut, (len(word), len(word), 0)]):
        for run in touching(word, a, b, end):
            add(*run)
        if back:
            k = bisect_right(order, (b - back, len(word) + 1))
            while k < len(order) and order[k][0] < end - back:
                s, e = order[k]
                if e < end - back:
                    add(s + back, e + back, period[s, e])
                k += 1
    return [(s, e, period[s, e]) for s, e in order]


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the stretches that runs can be in."""
    n = len(ids)
    if n < LEAST:
        return []
    shingle = ids[: n - WINDOW + 1].astype(np.uint64)
    for k in range(1, WINDOW):
        shingle = mix(shingle) + ids[k : n - WINDOW + 1 + k].astype(np.uint64)
    part = np.zeros(n, np.int64)
    for _ in range(ROUNDS):
        # an equal shingle of the same segment is asked for; chance hits only keep more
        at = np.flatnonzero((part[: n - WINDOW + 1] >= 0) & (part[: n - WINDOW + 1] == part[WINDOW - 1 :]))
        _, back, times = np.unique(mix(shingle[at]) ^ mix(part[at].astype(np.uint64)), return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int64)
        again = at[times[back] > 1]
        np.add.at(edge, again, 1)
        np.add.at(edge, again + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        starts = covered.copy()
        starts[1:] &= ~covered[:-1] | (part[1:] != part[:-1])
        new = np.where(covered, np.cumsum(starts) - 1, -1)
        if np.array_equal(new, part):
            break
        part = new
    begin = np.flatnonzero(starts)
    return [(int(s), int(s + k)) for s, k in zip(begin, np.bincount(part[covered], minlength=len(begin)), strict=True) if k >= LEAST] if len(begin) else []


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, by start and period."""
    ids = np.fromiter(map(_Numbers().__getitem__, words), np.int64, len(words))
    found = []
    for a, b in segments(ids):
        found += [(a + s, e - s, p) for s, e, p in segment_runs(ids[a:b].tolist())]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words but for what a run holds after its first period, joined by one space."""
    edge = np.zeros(len(words) + 1, np.int64)
    for s, length, p in found:
        edge[s + p] += 1
        edge[s + length] -= 1
    gone = np.cumsum(edge) > 0
    return b" ".join([w for w, out in zip(words, gone.tolist(), strict=False) if not out])


def detect(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, and runs (start, length, period, from word 0) and collapsed (the text without repeats).

    The new columns get underscores where docs has columns called so. Null,
    empty or blank text has no runs and an empty collapsed text; a long text
    is one step, about 600 bytes of memory for each word of its longest
    segment; each row is by itself, so repeated rows have equal results. No
    rows, no rows.
    """
    names = own(docs, "runs"), own(docs, "collapsed")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            found, texts = [], []
            for t in b.column(at):
                words = (t.as_py() or "").encode("utf-8", "replace").split()  # bytes split at 0x20 and 0x09 to 0x0D
                mine = runs(words) if len(words) >= LEAST else []
                found.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
                texts.append((collapse(words, mine) if mine else b" ".join(words)).decode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind), pa.array(texts, pa.string())], [*b.schema.names, *names])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(freed(run), f"{schema}, `{names[0]}` array<struct<start:long, length:long, period:long>>, `{names[1]}` string")


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; of documents whose crc32(doc_id) ends in 0, the words from a place on repeat with a period, both told by the crc32.

    With h that crc32, g = floor(h / 10) and n words: word i >= a = g % n is
    word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Rows without
    doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    docs = docs.select("doc_id", "text", h.alias("_h")).withColumn("_w", F.when(F.col("_h") % 10 == 0, F.expr(words)))
    tail = docs.withColumn("_a", F.expr("(_h div 10) % size(_w)")).withColumn("_p", F.expr("1 + (size(_w) - _a) div (3 + (_h div 10) % 8)"))
    made = F.expr("array_join(transform(_w, (w, i) -> if(i < _a, w, element_at(_w, int(1 + _a + (i - _a) % _p)))), ' ')")
    return tail.select("doc_id", F.when((F.col("_h") % 10 == 0) & (F.size("_w") > 0), made).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period (ties: start, then period) and digests of all runs and of the collapsed text. Odd rows: see detect()."""
    best = F.expr("aggregate(runs, cast(null as struct<start:long, length:long, period:long>), (m, r) -> if(m is null or r.length * m.period > m.length * r.period, r, m))")
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    found = detect(docs.select("doc_id", "text")).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
