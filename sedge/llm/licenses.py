"""License notices in texts, exact or with a few edits.

A text is its words (A-Z lower-cased), joined by one space. A notice of m
characters allows a few edits. Cut into one piece more than that, at least one
piece of any place of it is free of edits, so an automaton that looks for the
pieces of all notices finds a candidate for every place. The regex library's
bounded-error matching then verifies the edits in the candidate's window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import _CACHES, freed

#: A notice allows one edit for so many characters, and no more than MOST_EDITS.
CHARS_PER_EDIT, MOST_EDITS = 12, 4
#: Windows whose result a task remembers.
REMEMBER = 50_000

# Phrases that count exactly, with their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Short notices of public licenses, words only.
NOTICES = [
    ("licensed under the mit license", "mit"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("spdx license identifier mit", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("spdx license identifier apache 2 0", "apache"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("you can redistribute it and or modify it under the terms of the gnu", "gpl"),
    ("spdx license identifier gpl", "gpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under the bsd license", "bsd"),
    ("spdx license identifier bsd", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "boost"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons attribution", "cc"),
    ("licensed under cc by", "cc"),
    ("creativecommons org licenses by", "cc"),
    ("all rights reserved", "reserved"),
]

_BREAK = bytes(i for i in range(128) if not chr(i).isalnum())
#: A-Z lower-cased, other ASCII that is no digit or letter made a space.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _BREAK, bytes(range(97, 123)) + b" " * len(_BREAK))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN = "struct<label:string, notice:string, base:boolean, edits:int, score:double, word:long, words:long, start:long, end:long>"


@dataclass(frozen=True)
class Notice:
    """text: words joined by one space; base: whether places without edits count as base places."""

    text: str
    label: str
    base: bool = False

    @property
    def edits(self) -> int:
        return min(len(self.text) // CHARS_PER_EDIT, MOST_EDITS)

    def pieces(self) -> Iterator[tuple[int, str]]:
        """(offset, piece), one more than the edits allowed."""
        n = self.edits + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield a, self.text[a:b]


ALL = tuple([Notice(t, label, True) for t, label in BASE] + [Notice(t, label) for t, label in NOTICES])


class Scanner:
    """Finds the places of notices in a text of words joined, led and ended by one space."""

    def __init__(self, notices: tuple[Notice, ...] = ALL):
        self.notices = notices
        self.patterns = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n.text, special_only=True)}){{e<={n.edits}}}(?= )") for n in notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            for at, piece in n.pieces():
                pieces.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def best(self, k: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of the place of notice k with fewest edits in the window."""
        key = (k, window)
        if key not in self.known:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            m = self.patterns[k].search(window)
            self.known[key] = m and (*m.span(), sum(m.fuzzy_counts))
        return self.known[key]

    def places(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits), by notice and start. All exact places; of other places that overlap one with fewest edits."""
        starts: dict[int, set[int]] = {}
        for end, (length, where) in self.seeds.iter(text):
            for k, at in where:
                starts.setdefault(k, set()).add(end + 1 - length - at)
        out = []
        for k in sorted(starts):
            n = self.notices[k]
            m, found = len(n.text), []
            for s in sorted(starts[k]):
                if s > 0 and text.startswith(f" {n.text} ", s - 1):
                    found.append((s, s + m, 0))
                elif n.edits:
                    low = max(0, s - n.edits - 1)
                    if hit := self.best(k, text[low : s + m + n.edits + 1]):
                        found.append((hit[0] + low, hit[1] + low, hit[2]))
            kept: list[tuple[int, int, int]] = []
            for place in sorted(set(found)):
                if kept and place[0] < kept[-1][1] and (place[2] or kept[-1][2]):
                    if place[2] < kept[-1][2]:
                        kept[-1] = place
                else:
                    kept.append(place)
            out += [(k, *place) for place in kept]
        return out

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """Number of words and the spans of a text, in code points of the text as it is."""
        words = (text or "").encode("utf-8", "replace").translate(_FOLD).split(b" ")
        words = [w for w in words if w]
        joined = f" {b' '.join(words).decode()} "
        found = self.places(joined)
        if not found:
            return len(words), []
        at = [m.span() for m in _WORD.finditer(text)]
        spans = []
        for k, start, end, edits in found:
            n = self.notices[k]
            first, count = joined.count(" ", 0, start) - 1, joined.count(" ", start, end) + 1
            spans.append({"label": n.label, "notice": n.text, "base": n.base and not edits, "edits": edits, "score": 1 - edits / len(n.text), "word": first, "words": count, "start": at[first][0], "end": at[first + count - 1][1]})
        return len(words), spans


@cache
def _scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


_CACHES.append(_scanner.cache_clear)


def scan(docs: DataFrame, notices: tuple[Notice, ...] = ALL) -> DataFrame:
    """doc_id, n_words and spans of every whole text.

    A span has label, notice, edits, score (1 less the share of edits), word
    (its first, from 0), words, start and end (code points, end exclusive), and
    whether it is a base place. Null or blank text has no words and no spans;
    a long text is scanned whole; every row is judged by itself, so repeated
    rows have equal results; of overlapping inexact places of a notice the one
    with fewest edits stays, ties to the first. No rows, no rows; other columns
    don't matter.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {id_type}, n_words long, spans array<{SPAN}>"
    arrow = pa.list_(pa.struct([(n, t) for n, t in (("label", pa.string()), ("notice", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()), ("score", pa.float64()), ("word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64()))]))

    def run(batches):
        scanner = _scanner(notices)
        for b in batches:
            found = [scanner.scan(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], arrow)], ["doc_id", "n_words", "spans"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), kind)


def _labels(spans: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))))


def report(docs: DataFrame, notices: tuple[Notice, ...] = ALL) -> DataFrame:
    """A row for each document of scan(): words, base places and labels, all labels, the best score (0 without a span). Odd rows: see scan()."""
    base = F.filter("spans", lambda s: s["base"])
    first = F.transform(base, lambda s: s["word"])
    return scan(docs, notices).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
