"""Near-duplicates where ids repeat or are missing: each row is a document."""

import time

import numpy as np

from sedge.llm import dedup

SCHEMA = "doc_id long, text string, _row string"


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{k}" for k in rng.integers(0, 5000, 12)) for _ in range(n)]


def test_different_texts_of_one_id_stay(spark):
    docs = spark.createDataFrame([(2, "", "x"), (2, "a " * 60, "y"), (2, "b " * 60, "z"), (2, "", "again"), (3, "a " * 60, "copy"), (2, None, "null")], SCHEMA)
    out = dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], (r["text"] or "-")[:1], r["text"] is None) for r in out.collect()) == [(2, "-", False), (2, "-", True), (2, "a", False), (2, "b", False)]
    near = dedup.near_duplicates(docs)
    assert near.count() == 6 and {r["component_id"] for r in near.collect() if r["doc_id"] == 3} == {2}


def test_rows_without_id_are_linked_too(spark):
    a, b = texts(2)
    near = f"{a} {a} {b} {b} {a} {b} tail"
    docs = spark.createDataFrame([(None, f"{near} one", ""), (9, f"{near} two", ""), (None, b, ""), (None, b, ""), (None, None, "")], SCHEMA)
    got = sorted(((r["n_shingles"], r["component_id"], r["kept"]) for r in dedup.near_duplicates(docs).where("doc_id is null").collect()), key=str)
    sizes = sorted(k for k, _, _ in got)
    assert sizes[0] == 0 and {(c, kept) for k, c, kept in got if k > 20} == {(9, False)} and {(c, kept) for k, c, kept in got if k <= 20} == {(None, True)}
    kept = dedup.deduplicated(docs).collect()
    assert sorted((r["doc_id"] is None, r["text"] == b) for r in kept) == [(False, False), (True, False), (True, True)]


def test_very_many_texts_of_one_id_take_as_long_as_others(spark):
    took, groups = [], []
    rows = texts(1500)
    rows += [f"{t} tail" for t in rows[:50]] + rows[:20]
    for one in (False, True):
        docs = spark.createDataFrame([(7 if one else i, t, "") for i, t in enumerate(rows)], SCHEMA).cache()
        docs.count()
        start = time.time()
        groups.append(dedup.deduplicated(docs).count())
        took.append(time.time() - start)
    assert groups[0] == groups[1] < len(rows) and took[1] < 3 * took[0] + 10


def test_a_band_that_very_many_share(spark):
    """One passage makes the buckets of its bands hold all rows; clusters around it are found."""
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"{passage} {' '.join(f'u{i // 4}_{k}' for k in range(12))} {'x' * int(i % 4)}") for i in range(400)]
    rng.shuffle(rows)
    got = dedup.near_duplicates(spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")).toPandas().set_index("doc_id")
    sets = {int(i): {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows if (w := t.split())}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    assert all(got.component_id[i] == find(i) for i in sets)
