"""Near-duplicate documents by min-max hashing.

One pass hashes every whole text: words, 5-word shingles, and for each of
PERMUTATIONS permutations the least and the greatest shingle. Both are kept, so
half as many hash evaluations fill a signature, and both are equal between two
documents with a chance of their similarity. The signature is cut into bands.

Documents with the same shingle set are one class from then on. Pairs of classes
that share two bands in small buckets are candidates if their signatures agree
in AGREE of all values; a large bucket joins all its classes. Candidates make
coarse groups; each group's texts meet once, in chunks of bounded size, where
full shingle sets confirm links. Groups over one chunk are chunked twice at
random, and what is then outside of the group's largest component has its
signature compared with the whole group's, and meets every chunk that holds a
candidate of it, so that no link is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import Words, freed, keep, mix, own, segment_bounds, segment_sums, text_batches
from sedge.llm.components import components, hot_keys, spread_join

WORDS = 5
#: 100 * intersection >= SIMILAR * union links two documents.
SIMILAR = 75
#: 84 permutations give 168 values, 42 bands of 4; two documents of similarity 0.75 share under two bands once in 400,000.
PERMUTATIONS, BAND = 84, 4
SHARED_BANDS = 2
#: Values of two signatures (their low bytes) that agree; of similarity 0.75 about 126 do, and fewer than this once in 10 million.
AGREE = 95
#: Signatures that one step compares with as many.
GRID = 1024
#: A band's bucket up to this size makes pairs; a larger one joins all its classes to its first, which only widens the coarse group.
BUCKET = 24
#: Classes whose texts meet in one task.
CHUNK = 160
_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(1 << 31, (1 << 32) - 1, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, (1 << 32) - 1, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every 5-word shingle, in order; of a shorter text, of all its words."""
    n = len(offs) - 1
    w = Words(data, offs, lower=True)
    h, doc = w.hashes(), w.doc
    count = np.diff(segment_bounds(doc, n))
    full = np.flatnonzero(doc[WORDS - 1 :] == doc[: len(doc) - WORDS + 1]) if len(doc) >= WORDS else np.zeros(0, np.int64)
    s = np.zeros(len(full), np.uint64)
    for k in range(WORDS):
        s = mix(s + h[full + k])
    few = np.flatnonzero((count > 0) & (count < WORDS))
    if not len(few):
        return s, doc[full]
    starts = segment_bounds(doc, n)
    short = np.zeros(len(few), np.uint64)
    for i, d in enumerate(few):
        x = np.full(1, count[d], np.uint64)
        for k in range(starts[d], starts[d] + count[d]):
            x = mix(x + h[k : k + 1])
        short[i] = x[0]
    s, at = np.concatenate([s, short]), np.concatenate([doc[full], few])
    order = np.argsort(at, kind="stable")
    return s[order], at[order]


def distinct(s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's set of shingles, documents in order."""
    if not len(s):
        return s, doc
    _, first = np.unique(mix(s) ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    first.sort()
    return s[first], doc[first]


def signatures(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of 2 * PERMUTATIONS values for documents with a shingle: the least and the greatest under each permutation."""
    rows = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, 2 * PERMUTATIONS), np.uint32)
    if len(rows):
        low = (s >> np.uint64(32)).astype(np.uint32)
        at = bounds[rows]
        for k in range(PERMUTATIONS):
            v = low ^ _XOR[k]
            v *= _MUL[k]
            v ^= v >> np.uint32(15)
            out[rows, 2 * k] = np.minimum.reduceat(v, at)
            out[rows, 2 * k + 1] = np.maximum.reduceat(v, at)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands, a column each."""
    n = signature.shape[1] // BAND
    key = np.broadcast_to(np.arange(n, dtype=np.uint64), (len(signature), n)).copy()
    for k in range(BAND):
        key = mix(key + signature[:, k::BAND].astype(np.uint64))
    return key.view(np.int64)


def fingerprints(s: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit number for each document's set."""
    return mix(segment_sums(mix(s), bounds) + n.astype(np.uint64)).view(np.int64)


def features(rows: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, n_shingles, two fingerprints of the set, band keys and the signature's low bytes (null without words) of every whole text. rows: row, doc_id, text."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            size, one, two, keys, low = [], [], [], [], []
            for _, _, data, offs in text_batches(b):
                s, doc = distinct(*shingles(data, offs))
                bounds = segment_bounds(doc, len(offs) - 1)
                n = np.diff(bounds)
                size.append(n)
                one.append(fingerprints(s, bounds, n))
                two.append(mix(segment_sums(mix(s ^ np.uint64(0x5555)), bounds) - n.astype(np.uint64)).view(np.int64))
                signature = signatures(s, bounds)
                keys.append(bands(signature))
                low.append(signature.astype(np.uint8))
            if not size:
                continue
            n, keys, low = np.concatenate(size), np.concatenate(keys), np.concatenate(low)
            none = pa.array(n == 0)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()), mask=none)
            short = pa.array([None if k == 0 else x.tobytes() for k, x in zip(n, low, strict=True)], pa.binary())
            made = [pa.array(n), pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), listed, short]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], ["row", "doc_id", "text_hash", "n_shingles", "fp", "fp2", "bands", "sig"])

    kind = f"row long, doc_id {id_type}, text_hash long, n_shingles long, fp long, fp2 long, bands array<long>, sig binary"
    return rows.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(freed(run), kind)


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * PERMUTATIONS)


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (src, dst) of classes whose signatures agree."""
    one, two = classes.select(F.col("id").alias("src"), F.col("sig").alias("a")), classes.select(F.col("id").alias("dst"), F.col("sig").alias("b"))

    def run(batches):
        for b in batches:
            same = (_bytes(b.column(2)) == _bytes(b.column(3))).sum(1) >= AGREE
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["src", "dst"]).filter(pa.array(same))

    return pairs.join(one, "src").join(two, "dst").select("src", "dst", "a", "b").mapInArrow(freed(run), "src long, dst long")


def star(joined: DataFrame) -> DataFrame:
    """Edges (src, dst) with the components of (id, low): an id with the least of its lows, and that with its others, which many ids share. An id has a low a band at most."""
    lows = joined.groupBy("id").agg(F.collect_set("low").alias("lows")).select("id", "lows", F.array_min("lows").alias("dst"))
    return lows.select(F.explode(F.concat(F.array("id"), "lows")).alias("src"), "dst").where("src != dst").distinct()


def coarse(classes: DataFrame) -> DataFrame:
    """(node, root) of classes that may be linked: a superset of the true components. classes: id, bands, sig."""
    rows = classes.select("id", F.explode("bands").alias("key"))
    sizes = keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).where("n > 1"), "buckets")
    # a passage that very many texts share makes a bucket of as many rows: its rows are dealt over several parts
    hot = hot_keys(sizes, "key", sizes.agg(F.sum("n")).first()[0] or 0)
    rows = keep(spread_join(rows, sizes, "key", hot).select("key", "id", "n", "low"), "bands")
    large = star(rows.where(F.col("n") > BUCKET).select("id", "low"))
    members = rows.where(F.col("n") <= BUCKET).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("all"))
    pairs = members.select(F.explode(F.expr("flatten(transform(all, (a, i) -> transform(slice(all, i + 2, size(all)), b -> struct(a as src, b as dst))))")).alias("p")).select("p.*")
    small = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED_BANDS).select("src", "dst")
    return components(large.unionAll(agreeing(small, classes)), "coarse")


def _sets(pdf_text: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles as small numbers, in document order, with bounds."""
    batch = pa.RecordBatch.from_arrays([pa.array(pdf_text, pa.large_string())], ["text"])
    s, doc = [], []
    for a, _, data, offs in text_batches(batch):
        x, d = distinct(*shingles(data, offs))
        s.append(x)
        doc.append(d + a)
    s, doc = np.concatenate(s), np.concatenate(doc)
    _, number = np.unique(s, return_inverse=True)
    return number, doc, segment_bounds(doc, len(pdf_text))


def local_links(texts: list[str], left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of these texts (of left against all, if given), confirmed on full sets.

    Breadth first: a document meets all that is not yet reached, so that a
    dense group takes few rounds; one pass over inverted lists counts what it
    shares with every other.
    """
    number, doc, bounds = _sets(texts)
    n = len(texts)
    size = np.diff(bounds)
    order = np.argsort(number, kind="stable")
    post_doc, post_at = doc[order], np.searchsorted(number[order], np.arange(int(number.max()) + 2 if len(number) else 1))

    def linked(i: int) -> np.ndarray:
        mine = number[bounds[i] : bounds[i + 1]]
        starts, ends = post_at[mine], post_at[mine + 1]
        total = int((ends - starts).sum())
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts) + np.arange(total)
        shared = np.bincount(post_doc[at], minlength=n)
        return (100 * shared >= SIMILAR * (size + size[i] - shared)) & (size > 0)

    out = []
    if left is not None:
        for i in left:
            hit = linked(i)
            out += [(int(i), int(j)) for j in np.flatnonzero(hit) if j != i]
        return out
    todo = size > 0
    for first in range(n):
        if not todo[first]:
            continue
        todo[first] = False
        front = [first]
        while front and todo.any():
            i = front.pop()
            new = np.flatnonzero(linked(i) & todo)
            todo[new] = False
            out += [(i, int(j)) for j in new]
            front += new.tolist()
    return out


def _table(ids: np.ndarray, links: list[tuple[int, int]]) -> pd.DataFrame:
    out = pd.DataFrame({"src": ids[[a for a, _ in links]], "dst": ids[[b for _, b in links]]}, dtype="int64")
    return out[out.src != out.dst]


def _chunk_links(texts: DataFrame, *by: str) -> DataFrame:
    """Links among the rows of each chunk. texts: id, text and the columns that name the chunk."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return _table(pdf["id"].to_numpy(), local_links(pdf["text"].tolist()) if len(pdf) else [])

    return texts.groupBy(*by).applyInPandas(run, "src long, dst long")


def _rest_links(texts: DataFrame, *by: str) -> DataFrame:
    """Links of the rows marked `rest` with all rows of the chunk."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "rest"])
        left = np.flatnonzero(pdf["rest"].to_numpy())
        return _table(pdf["id"].to_numpy(), local_links(pdf["text"].tolist(), left) if len(left) else [])

    return texts.groupBy(*by).applyInPandas(run, "src long, dst long")


def _candidate_chunks(rest: DataFrame, every: DataFrame) -> DataFrame:
    """(root, id, chunk): which chunks hold a class of another part whose signature agrees with that of a rest class.

    rest, every: root, id, part, sig, every also chunk. Signatures meet in
    squares of GRID by GRID within their group.
    """
    blocks = lambda df, name: df.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / GRID).alias(name))
    counts = blocks(rest, "rests").join(blocks(every, "alls"), "root")
    # groups are few against their rows, and each row of either table goes to as many squares as the other has blocks
    left = rest.join(counts, "root").select("root", F.pmod(F.xxhash64("id", F.lit(4)), F.col("rests")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("alls") - 1)).alias("j"), F.lit(True).alias("rest"), "id", "part", F.lit(0).cast("long").alias("chunk"), "sig")
    right = every.join(counts, "root").select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).alias("i"), F.pmod(F.xxhash64("id", F.lit(5)), F.col("alls")).alias("j"), F.lit(False).alias("rest"), "id", "part", "chunk", "sig")

    def run(t: pa.Table) -> pa.Table:
        is_rest = t["rest"].to_numpy()
        at, other = np.flatnonzero(is_rest), np.flatnonzero(~is_rest)
        sig = _bytes(t["sig"].combine_chunks())
        ids, part, chunk = t["id"].to_numpy(), t["part"].to_numpy(), t["chunk"].to_numpy()
        found = []
        theirs = np.ascontiguousarray(sig[other].T)
        for i in at:
            same = np.zeros(len(other), np.uint8)
            for k, mine in enumerate(sig[i]):
                same += theirs[k] == mine
            hit = other[(same >= AGREE) & (part[other] != part[i])]
            found += [(ids[i], c) for c in np.unique(chunk[hit])]
        out = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"root": np.full(len(out), t["root"][0].as_py() if t.num_rows else 0, np.int64), "id": out[:, 0], "chunk": out[:, 1]})

    return left.unionAll(right).groupBy("root", "i", "j").applyInArrow(run, "root long, id long, chunk long").distinct()


def _salt(key: str, chunks: str, seed: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.col(chunks))


def links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (src, dst) between classes, enough to span their components. rows: row, text; classes: id (a row with the class's set), bands, sig."""
    groups = coarse(classes)
    sizes = keep(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(sizes, "root", total)
    members = spread_join(groups, sizes.select("root", F.ceil(F.col("n") / CHUNK).alias("chunks")), "root", hot).select(F.col("node").alias("id"), "root", "chunks")
    texts = rows.select(F.col("row").alias("id"), "text").join(members, "id")
    texts = keep(texts.select("root", "chunks", _salt("id", "chunks", 1).alias("chunk"), "id", "text"), "texts")
    one = _chunk_links(texts, "root", "chunk")
    large = texts.where("chunks > 1")
    if large.isEmpty():
        return keep(one, "links")
    two = _chunk_links(large.withColumn("chunk", _salt("id", "chunks", 2)), "root", "chunk")
    found = keep(one.unionAll(two), "links")
    # what is outside of the largest component of a large group
    part = components(found, "inner")
    ids = members.where("chunks > 1").select("root", _salt("id", "chunks", 1).alias("chunk"), "id").join(part.select(F.col("node").alias("id"), F.col("root").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
    ids = keep(ids.join(classes.select("id", "sig"), "id").select("root", "chunk", "id", "part", "sig"), "parts")
    counts = ids.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"))
    main = keep(counts.groupBy("root").agg(F.max(F.struct("n", "part")).alias("m")).select("root", F.col("m.part").alias("main")), "main")
    rest = spread_join(ids, main, "root", hot).where(F.col("part") != F.col("main")).select("root", "id", "part", "sig")
    rest = keep(rest, "rest")
    meet = keep(_candidate_chunks(rest, ids.join(rest.select("root").distinct(), "root", "left_semi")), "meet")
    # the chunks that hold candidates, and the rest classes that meet them, CHUNK at a time
    rounds = keep(meet.groupBy("root", "chunk").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("rounds")), "rounds")
    queries = meet.join(rounds, ["root", "chunk"]).withColumn("round", _salt("id", "rounds", 3)).join(large.select("id", "text"), "id")
    every = large.join(rounds, ["root", "chunk"]).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)))
    shape = ["root", "chunk", "round", "id", "text"]
    more = _rest_links(queries.select(*shape).withColumn("rest", F.lit(True)).unionAll(every.select(*shape).withColumn("rest", F.lit(False))), "root", "chunk", "round")
    return keep(found.unionAll(more), "links-all")


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seen, classes, groups): features of each row; each set's class with its group; each group with its lead row. rows: row (no two alike), doc_id, text."""
    seen = keep(features(rows), "features")
    sets = seen.where("n_shingles > 0")
    # the row that stands for others: the least doc_id, rows without one last, then the least row number
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    equal = sets.groupBy("fp", "fp2", "n_shingles").agg(F.min(lead).alias("lead"), F.count(F.lit(1)).alias("copies"))
    equal = equal.select(F.col("lead.row").alias("id"), F.struct("fp", "fp2").alias("set"), "lead", "copies")
    whole = keep(equal.join(sets.select(F.col("row").alias("id"), "bands", "sig"), "id"), "classes")
    roots = components(links(rows, whole), "final")
    named = whole.select("id", "set", "lead", "copies").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    named = keep(named.withColumn("root", F.coalesce("root", "id")), "named")
    groups = keep(named.groupBy("root").agg(F.min("lead").alias("lead"), F.sum("copies").alias("members"), F.count(F.lit(1)).alias("n")), "groups")
    return seen, named, groups


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    component_id is the least doc_id that links reach, kept whether it is the
    document's own. Null, empty or blank text has no shingles and is linked
    with nothing. Each row is a document: repeated rows are linked with each
    other, rows of one doc_id with different texts only where their sets are.
    Rows without doc_id take part; null is a component's id only where all of
    its ids are null. No rows, no rows; other columns don't matter.
    """
    rows = keep(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    seen, named, groups = grouped(rows)
    hot = hot_keys(groups, "root", groups.agg(F.sum("n")).first()[0] or 0)
    by_class = spread_join(named.select("set", "root"), groups.where("members > 1").select("root", F.col("lead.doc_id").alias("component_id")), "root", hot).select("set", "component_id", F.lit(True).alias("linked"))
    # a set with very many copies is one key: its rows are dealt too
    counted = named.select("set", F.col("copies").alias("n"))
    crowd = hot_keys(counted, "set", counted.agg(F.sum("n")).first()[0] or 0)
    known = seen.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.struct("fp", "fp2")).otherwise(F.struct(F.col("row").alias("fp"), F.lit(0).cast("long").alias("fp2"))).alias("set"))
    out = spread_join(known, by_class, "set", crowd, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group, that with the least doc_id (rows without one last), with all its columns.

    Texts without words are copies only of rows with the same doc_id and text.
    Rows of one doc_id with different texts are different documents. Other
    columns keep their names and values; no rows, no rows.
    """
    row = own(docs, "_row")
    rows = keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    seen, _, groups = grouped(rows.select(F.col(row).alias("row"), "doc_id", "text"))
    blank = seen.where("n_shingles = 0").groupBy("doc_id", "text_hash").agg(F.min("row").alias("row")).select("row")
    stay = groups.select(F.col("lead.row").alias("row")).unionAll(blank)
    # what goes are fewer rows than what stays, as a rule
    drop = keep(seen.select("row").join(stay, "row", "left_anti").select(F.col("row").alias(row)), "drop")
    return rows.join(drop, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
