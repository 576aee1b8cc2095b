"""Phrases that occur together more often than their parts would, by hierarchical naming of pairs.

Texts are read once, into blocks of a language: a block is its words by numbers
of its own, with a 0 where a piece ends. Words that are frequent over the whole
corpus get a global id by a join; then, for k from 2 to 5, each place where two
(k-1)-grams with ids are adjacent is a pair of ids, pairs are counted over all
blocks, and frequent ones get an id by a join again. Most pairs are rare, so
pairs are first counted by bin of their hash, about a byte a pair of a block;
only pairs of bins that are frequent as a whole, which all frequent pairs are
in, are counted one by one, a range of bins in a task. A phrase's pair of ids is
also its pointers to its first and last k-1 words: counts of all prefixes and
suffixes, and what a longer phrase makes superfluous, are found along them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.common import drop, freed, give_back, keep, mix

#: Occurrences that make a phrase a candidate, words of the longest, phrases returned for each language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text in a block.
BLOCK_BYTES = 1 << 24
#: Words for each bin of pairs, bins that one task adds up at once.
BIN_WORDS, RANGE_BINS = 4, 1 << 19
ZSTD = {"compression": "zstd"}

# Characters that end a piece, and those that part words.
_PIECE, _SPACE = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
#: A-Z lower-cased, ends of pieces made a full stop.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _PIECE + _SPACE, bytes(range(97, 123)) + b"." * len(_PIECE) + b" " * len(_SPACE))


class _Numbers(dict):
    """Numbers words as they come; the end of a piece is 0."""

    def __init__(self):
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs, all first bytes first, compressed; their count and width stand before."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(numbers).to_bytes(7, "little") + bytes([width]) + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n, width = int.from_bytes(packed[:7], "little"), packed[7]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.Codec("zstd").decompress(packed[8:], n * width), np.uint8).reshape(width, n).T
    return out.view("<i8").reshape(n)


def _after_null(numbers: np.ndarray) -> pa.Array:
    """Numbers but for the first, which is null: the block's own row."""
    return pa.array(numbers.astype(np.int64), mask=np.arange(len(numbers)) == 0)


def _first(packed: bytes, n: int) -> pa.Array:
    """The block's places in its own row, then n nulls."""
    return pa.concat_arrays([pa.array([packed], pa.binary()), pa.nulls(n, pa.binary())])


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each block a row with its places, and one with number, word and count for each of its words. docs: lang, text.

    Blocks are numbered with room for all of their places, so that block +
    number is another one for each row, of pairs later on too.
    """

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        open_blocks: dict[str, tuple[_Numbers, list[np.ndarray], list[int]]] = {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            numbers, parts, _ = open_blocks.pop(lang)
            places = np.concatenate(parts)
            n = len(numbers) - 1
            words = pa.array([None] + [w.decode() for w in numbers][1:], pa.string())
            block, made = (task << 40) + made, made + len(places) + 1
            count = np.bincount(places, minlength=n + 1)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + 1, block)), pa.array([lang] * (n + 1), pa.string()), _after_null(np.arange(n + 1)), words, _after_null(count), _first(_packed(places), n)],
                ["block", "lang", "number", "word", "n", "places"],
            )

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").translate(_FOLD).replace(b".", b" . ").split()
                if not words:
                    continue
                numbers, parts, size = open_blocks.setdefault(lang, (_Numbers(), [], [0]))
                at = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                parts += [at, np.zeros(1, np.uint32)]
                size[0] += 6 * len(words)
                if size[0] >= block_bytes:
                    yield closed(lang)
                elif sum(x[2][0] for x in open_blocks.values()) >= 4 * block_bytes:
                    yield from [closed(x) for x in list(open_blocks)]
        yield from [closed(x) for x in list(open_blocks)]

    return docs.select("lang", "text").mapInArrow(freed(run), "block long, lang string, number long, word string, n long, places binary")


def _merged(places: np.ndarray) -> np.ndarray:
    """One 0 parts as well as several."""
    return places[(places > 0) | np.concatenate([[True], places[:-1] > 0])]


def _adjacent(at: np.ndarray, id_of: np.ndarray, bins: int) -> tuple[np.ndarray, ...]:
    """Where two grams are adjacent in the places `at`, which pair each is; and of each pair the ids, count and bin."""
    where = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
    size = len(id_of)
    pair, back, times = np.unique(at[where] * size + at[where + 1], return_inverse=True, return_counts=True)
    left, right = id_of[pair // size], id_of[pair % size]
    bin_of = mix(mix(left) + right.astype(np.uint64)) % np.uint64(bins)
    return where, back, left, right, times, bin_of.astype(np.int64)


_BINNED = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("bins", pa.binary()), ("n", pa.binary()), ("places", pa.binary()), ("ids", pa.binary())])
_PAIRS = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("first", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.binary()), ("places", pa.binary())])
_COUNTED = pa.schema([("block", pa.int64()), ("number", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64())])


def _kinds(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def _by_block(left: DataFrame, right: DataFrame, run, schema: pa.Schema) -> DataFrame:
    """run(left, right) for the rows of each block that has some in both."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right) if left.num_rows and right.num_rows else schema.empty_table()
        finally:
            give_back()

    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns)).groupBy("block")  # noqa: E731  both may come from one table
    return fresh(left).cogroup(fresh(right)).applyInArrow(task, _kinds(schema))


def binned(places: DataFrame, named: DataFrame, ranges: int, least: int, range_bins: int = RANGE_BINS) -> DataFrame:
    """For each block a row with its places of named grams and their ids, and for each range of bins one with its bins and their counts (`least` at most).

    places: block, places; named: block, number, id of the grams that have one, a row each or packed.
    """
    whole = lambda c: np.concatenate([_unpacked(x.as_py()) for x in c]) if pa.types.is_binary(c.type) else c.to_numpy()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = _unpacked(left["places"][0].as_py())
        number, ids = whole(right["number"]), whole(right["id"])
        own = np.zeros(max(int(at.max(initial=0)), int(number.max())) + 1, np.int64)
        own[number] = np.arange(1, len(number) + 1)
        own[0] = 0
        at, ids = _merged(own[at]), np.concatenate([[0], ids])
        *_, times, bin_of = _adjacent(at, ids, ranges * range_bins)
        if not len(times):
            return _BINNED.empty_table()
        order = np.argsort(bin_of)
        bins, start = np.unique(bin_of[order], return_index=True)
        count = np.minimum(np.add.reduceat(times[order], start), least)
        edge = np.flatnonzero(np.diff(bins // range_bins, prepend=-1))
        parts = list(zip(edge, [*edge[1:], len(bins)], strict=True))
        block, none = left["block"][0].as_py(), [None] * len(parts)
        steps = [np.diff(bins[a:b], prepend=bins[a] // range_bins * range_bins) for a, b in parts]
        return pa.table([[block] * (len(parts) + 1), [None, *(bins[edge] // range_bins).tolist()], [None, *map(_packed, steps)], [None, *(_packed(count[a:b]) for a, b in parts)], [_packed(at), *none], [_packed(ids), *none]], schema=_BINNED)

    return _by_block(places, named, run, _BINNED)


def frequent_bins(rows: DataFrame, least: int, range_bins: int = RANGE_BINS) -> DataFrame:
    """(block, range, bins) with those of each row's bins that hold `least` pairs or more over all blocks. rows: block, range, bins, n."""

    def run(rows: pa.Table) -> pa.Table:
        try:
            total, first = np.zeros(range_bins, np.int64), rows["range"][0].as_py() * range_bins
            for bins, n in zip(rows["bins"], rows["n"], strict=True):
                total[np.cumsum(_unpacked(bins.as_py()))] += _unpacked(n.as_py())
            often = total >= least
            out = [b[often[b]] for b in (np.cumsum(_unpacked(bins.as_py())) for bins in rows["bins"])]
            some = [i for i, b in enumerate(out) if len(b)]
            return pa.table({"block": rows["block"].take(pa.array(some, pa.int64())), "range": rows["range"].take(pa.array(some, pa.int64())), "bins": pa.array([_packed(np.diff(out[i] + first, prepend=0)) for i in some], pa.binary())})
        finally:
            give_back()

    return rows.select("block", "range", "bins", "n").groupBy("range").applyInArrow(run, "block long, `range` long, bins binary")


def pairs(places: DataFrame, often: DataFrame, ranges: int, range_bins: int = RANGE_BINS) -> DataFrame:
    """For each block a row with its places of pairs by number, and for each range of bins one with its pairs of ids and counts, numbered on from `first`.

    Adjacent named grams whose bin is frequent are pairs. places: block, places, ids; often: block, bins.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, ids = (_unpacked(left[c][0].as_py()) for c in ("places", "ids"))
        where, back, first, last, times, bin_of = _adjacent(at, ids, ranges * range_bins)
        some = np.flatnonzero(np.isin(bin_of, np.concatenate([np.cumsum(_unpacked(b.as_py())) for b in right["bins"]])))
        some = some[np.lexsort((last[some], first[some], bin_of[some] // range_bins))]
        number = np.zeros(len(bin_of), np.int64)
        number[some] = np.arange(1, len(some) + 1)
        new = np.zeros(len(at), np.int64)
        new[where] = number[back]
        range_of = bin_of[some] // range_bins
        edge = np.flatnonzero(np.diff(range_of, prepend=-1))
        parts = [some[a:b] for a, b in zip(edge, [*edge[1:], len(some)], strict=True)]
        block, none = left["block"][0].as_py(), [None] * len(parts)
        packed = ([None, *(_packed(values[p]) for p in parts)] for values in (first, last, times))
        return pa.table([[block] * (len(parts) + 1), [None, *range_of[edge].tolist()], [None, *(edge + 1).tolist()], *packed, [_packed(_merged(new)), *none]], schema=_PAIRS)

    return _by_block(places, often, run, _PAIRS)


def frequent_pairs(rows: DataFrame, least: int) -> DataFrame:
    """(id, left, right, f) of pairs that occur `least` times or more over all blocks, and rows with a block's numbers of such pairs and their ids.

    rows: those of `pairs` that have a range. A block has a pair once at most.
    An id is the least block + number of its pair.
    """

    def run(rows: pa.Table) -> pa.Table:
        try:
            block, first = rows["block"].to_numpy(), rows["first"].to_numpy()
            left, right, n = ([_unpacked(x.as_py()) for x in rows[c]] for c in ("left", "right", "n"))
            number = [a + np.arange(len(x)) for a, x in zip(first, left, strict=True)]
            ends = np.cumsum([len(x) for x in left])[:-1]
            own = np.concatenate([b + x for b, x in zip(block, number, strict=True)])
            left, right, n = map(np.concatenate, (left, right, n))
            order = np.lexsort((right, left))
            new = np.concatenate([[True], (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)])
            start, which = np.flatnonzero(new), np.cumsum(new) - 1
            f, ids = np.add.reduceat(n[order], start), np.minimum.reduceat(own[order], start)
            often, id_of = f >= least, np.zeros(len(order), np.int64)
            id_of[order] = np.where(often, ids, -1)[which]
            found = [(b, _packed(x[i >= 0]), _packed(i[i >= 0])) for b, x, i in zip(block, number, np.split(id_of, ends), strict=True) if (i >= 0).any()]
            of, m = order[start][often], int(often.sum())
            lists = [[x[c] for x in found] + [None] * m for c in range(3)]
            grams = [pa.concat_arrays([pa.nulls(len(found), pa.int64()), pa.array(x[often] if x is f or x is ids else x[of])]) for x in (ids, left, right, f)]
            return pa.table([*lists, *grams], schema=_COUNTED)
        finally:
            give_back()

    return rows.select("block", "range", "first", "left", "right", "n").groupBy("range").applyInArrow(run, _kinds(_COUNTED))


def frequent(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """(block, number, key, f, id) of the rows whose key occurs `least` times or more over all blocks. rows: block, number, n, key.

    All rows are dealt by key once; a key has one row a block at most. Its id is
    the least block + number of its rows.
    """
    w = Window.partitionBy(*key)
    # two numbers in one: most of the bytes that are dealt are such rows
    packed = rows.select("block", F.expr("shiftleft(number, 31) | n").alias("_p"), *key).repartition(*key)
    one = packed.select("block", F.expr("shiftright(_p, 31)").alias("number"), F.expr("_p & 2147483647").alias("_n"), *key)
    counted = one.withColumn("f", F.sum("_n").over(w)).withColumn("id", F.min(F.col("block") + F.col("number")).over(w)).where(F.col("f") >= least)
    return keep(counted.select("block", "number", *key, "f", "id"), "often-1", **ZSTD)


def grams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length the frequent grams.

    A gram has id, lang, words, f, prefixes and suffixes (counts of its first
    and last 1, 2, ... words), and from two words on its parents left and right
    with their counts f_left and f_right.
    """
    read = keep(blocks(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), block_bytes), "places-1", **ZSTD)
    rows = read.where("number is not null")
    total = keep(rows.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    ranges = (total.agg(F.sum("n")).first()[0] or 0) // (BIN_WORDS * RANGE_BINS) + 1
    often = frequent(rows.select("block", "number", "n", "lang", "word"), ["lang", "word"], least)
    # a gram's row where its id comes from is the one that stands for it
    names = often.where("id = block + number")
    named = often.select("block", "number", "id")
    out = [names.select("id", "lang", F.array("word").alias("words"), "f", F.array("f").alias("prefixes"), F.array("f").alias("suffixes"))]
    for k in range(2, longest + 1):
        bins = keep(binned(read.where(f"{'number' if k == 2 else '`range`'} is null").select("block", "places"), named, ranges, least), f"bins-{k}", **ZSTD)
        drop(read)
        kept = frequent_bins(bins.where("`range` is not null"), least)
        read = keep(pairs(bins.where("`range` is null").select("block", "places", "ids"), kept.select("block", "bins"), ranges), f"places-{k}", **ZSTD)
        drop(bins)
        often = keep(frequent_pairs(read.where("`range` is not null"), least), f"often-{k}", **ZSTD)
        named = often.where("id is null").select("block", "number", F.col("ids").alias("id"))
        first = out[-1].select(F.col("id").alias("left"), "lang", F.col("words").alias("head"), F.col("f").alias("f_left"), "prefixes")
        last = out[-1].select(F.col("id").alias("right"), F.element_at("words", -1).alias("tail"), F.col("f").alias("f_right"), "suffixes")
        whole = often.where("id is not null").select("id", "left", "right", "f").join(first, "left").join(last, "right")
        grown = lambda c: F.concat(c, F.array("f")).alias(c)
        out.append(keep(whole.select("id", "lang", F.concat("head", F.array("tail")).alias("words"), "f", grown("prefixes"), grown("suffixes"), "left", "right", "f_left", "f_right"), f"grams-{k}"))
    drop(read)
    return total, out


def least_cut() -> Column:
    """cut: the least score over the cuts of a gram (n: all words), with the words before the cut and both counts; ties to the first cut."""
    score = "(cast(f * 1000 as decimal(20, 0)) * cast(n as decimal(18, 0))) div (cast(prefixes[j - 1] as decimal(18, 0)) * cast(suffixes[size(words) - j - 1] as decimal(18, 0)))"
    return F.expr(f"array_min(transform(sequence(1, size(words) - 1), j -> struct({score} as score, j as j, prefixes[j - 1] as l, suffixes[size(words) - j - 1] as r)))").alias("cut")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases.

    A phrase of 2 to `longest` words that occurs `least` times or more within
    pieces scores floor(1000 * a * n / (l * r)) at the cut where that is least
    (ties: the first cut). A phrase inside a longer one of the same count is
    left out. Rank is by score and count, descending, then phrase by bytes.
    Null, empty or blank texts hold no words; null lang is `und`; a long text is
    one step; repeated rows count each; other columns don't matter; no rows, no
    rows. Products are exact to 38 digits.
    """
    total, levels = grams(docs, least, longest, block_bytes)
    found = None
    for k in range(2, longest + 1):
        own = levels[k - 1].select("id", "lang", "words", "f", "prefixes", "suffixes")
        if k < longest:
            longer = levels[k]
            inside = longer.where("f = f_left").select(F.col("left").alias("id")).unionAll(longer.where("f = f_right").select(F.col("right").alias("id"))).distinct()
            own = own.join(inside, "id", "left_anti")
        found = own if found is None else found.unionAll(own)
    scored = found.join(total, "lang").withColumn("cut", least_cut())
    scored = keep(scored.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score"), "scored")
    # a language may hold most phrases: the best of each part first
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = int((scored.count() / max(1, top)) ** 0.5) + 1
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    best = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
