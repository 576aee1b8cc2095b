"""Personal data: expressions propose spans, validators confirm them, words nearby adjust a score. DataFrame functions only.

A pattern's matches and the pieces between them (split by the same pattern)
alternate, so running lengths give every match's place in code points without
leaving the JVM. All that is done for each match looks at its own pieces only,
so a text costs what its length and its number of matches cost, not their
product: running values are folded in runs of FOLD, and masks are put in between
blocks of BLOCK characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import own

#: What the four base kinds look like. The classes are disjoint where one repeat
#: follows another, so possessive repeats match the same and never backtrack or recurse; a match
#: begins where a run begins or the last match ended, so long runs cost one pass.
_LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the method adds: kinds confirmed by a checksum, or by words nearby.
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
}
KINDS = [*BASE, *ADDED]
#: The score of a span before its validator and the words nearby are seen, and the words.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.6, "iban": 0.4, "ssn": 0.35, "local_phone": 0.35, "secret": 0.35}
VALIDATED, NEARBY, ENOUGH, REACH = 0.4, 0.3, 0.6, 48
#: Elements folded one after the other, and characters of a block; cost only.
FOLD, BLOCK = 256, 1024
#: After the end of any text.
NEVER = 2**31 - 1
CONTEXT = {
    "email": "mail|contact|write|reply",
    "ip": r"\bip\b|address|server|host|login",
    "card": "card|visa|credit|payment|account",
    "phone": r"phone|\btel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": r"\bssn\b|social security|tax id",
    "local_phone": r"phone|\btel|call|mobile|fax",
    "secret": r"token|secret|password|passwd|credential|\bauth|api.?key|access.?key|private.?key|bearer",
}
MASK = {k: f"<{k.removeprefix('local_').upper()}>" for k in KINDS}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number passes ISO 7064's mod 97-10 check (first four to the end, letters as 10 to 35)."""
    flat = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substr(flat, F.lit(5), F.length(flat)), F.substr(flat, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 14) & (n <= 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        n = F.length(F.regexp_replace(m, " ", ""))
        return F.when(n.between(15, 34), mod97(m)).otherwise(F.lit(False))
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike("^(.)\\1*$")
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return {"ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "iban": text.rlike("[A-Z]{2}[0-9]{2}"), "secret": text.rlike("[A-Za-z0-9_/+=-]{20}")}.get(kind, text.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{2}"))


def running(xs: Column, start: int, merge: Callable[[Column, Column], Column]) -> Column:
    """array<int>: the running fold of an array<int> column, in runs of FOLD so that no long array is copied at every element."""

    def fold(part: Column, first: Column) -> Column:
        done = F.aggregate(part, F.array(first), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))
        return F.slice(done, F.lit(2), F.size(part))

    n = F.ceil(F.size(xs) / FOLD).cast("int")
    runs = F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.slice(xs, r * FOLD + 1, FOLD))
    totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(start), merge))
    before = F.aggregate(totals, F.array(F.lit(start)), lambda acc, t: F.concat(acc, F.array(merge(F.element_at(acc, -1), t))))
    long = F.flatten(F.zip_with(runs, F.slice(before, F.lit(1), n), fold))
    return F.when(F.size(xs) <= FOLD, fold(xs, F.lit(start))).otherwise(long)


def _later(a: Column, x: Column) -> Column:
    return F.greatest(a, x)


def _near(matches: Column, gaps: Column, i: Column) -> Column:
    """What stands within REACH characters of match i (from 0) on either side: of every piece its REACH nearest characters are enough."""
    pieces = REACH // 2  # a match and the gap before it are two characters at least
    first = F.greatest(i - pieces, F.lit(0))
    left = F.zip_with(F.slice(gaps, first + 1, i - first), F.slice(matches, first + 1, i - first), lambda g, m: F.concat(F.right(g, F.lit(REACH)), F.right(m, F.lit(REACH))))
    right = F.zip_with(F.slice(matches, i + 2, pieces), F.slice(gaps, i + 3, pieces), lambda m, g: F.concat(F.left(m, F.lit(REACH)), F.left(g, F.lit(REACH))))
    before = F.concat(F.array_join(left, ""), F.right(F.element_at(gaps, i + 1), F.lit(REACH)))
    after = F.concat(F.left(F.element_at(gaps, i + 2), F.lit(REACH)), F.array_join(right, ""))
    return F.lower(F.concat(F.right(before, F.lit(REACH)), F.lit(" "), F.left(after, F.lit(REACH))))


def _scored(kind: str, matches: Column, gaps: Column, ends: Column) -> Column:
    """array<struct<start, ord, end, kind, score>> of the kind's matches that its validator passes."""
    checked = VALIDATED if kind in ("card", "iban", "ip") else 0.0
    # ends goes in beside the matches: named in the lambda only, it could be put in there and made anew for every match
    pairs = F.transform(F.zip_with(matches, ends, lambda m, e: F.struct(m.alias("m"), e.alias("e"))), lambda s, i: F.struct(s["m"].alias("m"), s["e"].alias("e"), i.alias("i")))
    spans = F.filter(pairs, lambda s: _valid(kind, s["m"]))

    def score(s: Column) -> Column:
        end = s["e"]
        value = F.lit(PRIOR[kind] + checked) + F.when(_near(matches, gaps, s["i"]).rlike(CONTEXT[kind]), NEARBY).otherwise(0.0)
        return F.struct((end - F.length(s["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), F.least(value, F.lit(1.0)).alias("score"))

    return F.transform(spans, score)


def with_spans(docs: DataFrame, text: Column, base: str = "_pii_base", every: str = "_pii_all") -> DataFrame:
    """Adds two arrays of struct<start, ord, end, kind, score>: the base spans, and with what the method adds.

    Null text is empty and has no spans. Base spans stay whatever their score;
    an added one needs a score of ENOUGH and must not overlap a base span.
    Spans are in code points, sorted by start, then kind. `base` and `every` must not be columns of docs; helper columns
    take names that docs doesn't have.
    """
    at = {k: own(docs, f"_pii_{k}") for k in ("text", "found", "ends", "starts", *(f"{x}_{k}" for k in KINDS for x in "mge"))}
    c = {k: F.col(f"`{v}`") for k, v in at.items()}
    df = docs.withColumn(at["text"], F.coalesce(text, F.lit("")))
    none = F.expr("cast(array() as array<string>)")
    pattern = {**BASE, **ADDED}
    df = df.withColumns({at[f"m_{k}"]: F.when(_may_hold(k, c["text"]), F.regexp_extract_all(c["text"], F.lit(pattern[k]), F.lit(0))).otherwise(none) for k in KINDS})
    df = df.withColumns({at[f"g_{k}"]: F.when(F.size(c[f"m_{k}"]) > 0, F.split(c["text"], pattern[k], -1)).otherwise(none) for k in KINDS})
    long = {k: F.zip_with(c[f"m_{k}"], F.slice(c[f"g_{k}"], F.lit(1), F.size(c[f"m_{k}"])), lambda m, g: F.length(m) + F.length(g)) for k in KINDS}
    df = df.withColumns({at[f"e_{k}"]: long[k] for k in KINDS})
    df = df.withColumns({at[f"e_{k}"]: running(c[f"e_{k}"], 0, lambda a, x: a + x) for k in KINDS})
    scored = {k: _scored(k, c[f"m_{k}"], c[f"g_{k}"], c[f"e_{k}"]) for k in KINDS}
    df = df.withColumn(base, F.array_sort(F.concat(*(scored[k] for k in BASE))))
    # an added span overlaps a base one before it if that ends later, one after it if that begins earlier
    df = df.withColumn(at["found"], F.array_sort(F.concat(F.col(base), F.filter(F.concat(*(scored[k] for k in ADDED)), lambda s: s["score"] >= ENOUGH))))
    is_base = lambda s: s["ord"] < len(BASE)
    df = df.withColumns({at["ends"]: F.transform(c["found"], lambda s: F.when(is_base(s), s["end"]).otherwise(0)), at["starts"]: F.reverse(F.transform(c["found"], lambda s: F.when(is_base(s), s["start"]).otherwise(NEVER)))})
    df = df.withColumns({at["ends"]: running(c["ends"], 0, _later), at["starts"]: F.reverse(running(c["starts"], NEVER, lambda a, x: F.least(a, x)))})
    around = F.zip_with(F.zip_with(c["found"], c["ends"], lambda s, e: F.struct(s.alias("s"), e.alias("e"))), c["starts"], lambda a, b: F.struct(a["s"].alias("s"), a["e"].alias("e"), b.alias("b")))
    free = F.filter(around, lambda x: is_base(x["s"]) | ((x["e"] <= x["s"]["start"]) & (x["b"] >= x["s"]["end"])))
    kept = F.when(F.size(c["found"]) == F.size(base), F.col(base)).otherwise(F.transform(free, lambda x: x["s"]))
    return df.withColumn(every, kept).drop(*at.values())


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans by kind, the digest of the base list, the list of all spans and their number, of every whole text.

    Null and empty text has no spans: counts 0 and the digest of nothing.
    Spans of several kinds may overlap and all count. Repeated rows and doc_ids repeat;
    an empty table gives an empty one; other columns don't matter.
    """
    df = with_spans(docs.select("doc_id", "text"), F.col("text"))

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("_pii_base"), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return df.select("doc_id", *counts, F.sha2(listed(F.col("_pii_base")), 256).alias("base_sha256"), listed(F.col("_pii_all")).alias("spans"), F.size("_pii_all").cast("long").alias("n_spans"))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end (exclusive, from 0) of a text cut into blocks of BLOCK characters."""
    first = F.floor(start / BLOCK).cast("int")
    inside = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.substring(inside, start - first * BLOCK + 1, end - start)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in text and n_chars set anew where it was.

    Of overlapping spans the union is masked once, as the first. Other columns
    keep names and values whatever they are called; null texts stay null,
    texts without spans as they are; repeated rows repeat.
    """
    base, every = own(docs, "_pii_base"), own(docs, "_pii_all")
    df = with_spans(docs, F.col("text"), base, every)
    reach, blocks = own(df, "_pii_reach"), own(df, "_pii_blocks")
    spans, r, b = F.col(every), F.col(reach), F.col(blocks)
    some = F.size(spans) > 0
    df = df.withColumn(reach, F.transform(spans, lambda s: s["end"]))
    df = df.withColumn(reach, running(r, 0, _later)).withColumn(blocks, F.when(some, F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    masks = F.create_map(*(F.lit(x) for k, v in MASK.items() for x in (k, v)))
    before = lambda i: F.when(i == 0, 0).otherwise(F.element_at(r, F.greatest(i, F.lit(1))))
    parts = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(b, before(i), s["start"]), masks[s["kind"]])).otherwise(""))
    done = F.concat(F.array_join(parts, ""), piece(b, F.element_at(r, -1), F.length("text")))
    df = df.withColumn("text", F.when(some, done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))
