"""What must stay linear or spread out: texts of many matches, tags or tokens, one very large component, groups with many clusters."""

import time

import numpy as np
from pyspark.sql import functions as F

from sedge.llm import bpe, dedup, dom, pii, toxicity
from sedge.llm.common import own
from sedge.llm.components import components, hot_keys, spread_join


def test_one_component_of_a_hundred_thousand_nodes(spark):
    n = 100_000
    star = spark.range(1, n // 2).select(F.lit(n * 10).cast("long").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(n // 2, n // 2 + 64).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    tree = spark.range(n // 2 + 65, n).select(F.col("id").alias("src"), F.floor((F.col("id") + n // 2) / 2).cast("long").alias("dst"))
    bridge = spark.createDataFrame([(7, n // 2), (n // 2 + 3, n // 2 + 3), (n * 20, n * 20 + 1)], "src long, dst long")
    got = components(star.unionAll(chain).unionAll(tree).unionAll(bridge), "test").toPandas()
    assert len(got) == n + 2 and got.node.is_unique
    assert set(got.root[got.node < n * 20]) == {1} and set(got.root[got.node >= n * 20]) == {n * 20}
    assert components(spark.createDataFrame([], "src long, dst long"), "none").count() == 0


def test_rows_of_a_hot_key_are_dealt_over_parts(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(sizes, "k", 20_000)
    assert [(r.k, r.parts) for r in hot.collect()] == [(5, 334)]
    got = spread_join(rows, sizes.where("k % 2 = 1"), "k", hot, "left")
    assert got.count() == 20_000 and got.where("k = 5 and n = 6668").count() == 6668 and got.where("k % 2 = 0 and n is not null").count() == 0


def test_texts_of_a_million_characters(spark):
    n = 330_000
    texts = ["12," * n, "a@b.co " * (n // 3), "<a \"" * (n // 4), "<a \">\"" * (n // 6), "<p>x<li>" * (n // 8), "<|endoftext|>" * (n // 13)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.time()
    got = pii.report(docs).toPandas().set_index("doc_id")
    assert got.n_email[1] == n // 3 and got.n_card[0] == 0
    masked = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert masked[0] == texts[0] and masked[1] == "<EMAIL> " * (n // 3)
    assert time.time() - start < 120
    start = time.time()
    for t in texts[2:]:
        dom.parse(t)
    codec = bpe.Codec(bpe.vocabulary())
    assert len(codec.ids(texts[-1].encode())) == 4 * (n // 13)
    assert time.time() - start < 30


def test_masks_across_blocks_and_overlaps(spark):
    pad = "é🙂x " * 300
    text = f"{pad}write to a.b@c.org now {pad}host 10.0.0.300.1 or 10.0.0.1{pad}+44 20 7946 0958 call{pad} token = \"{'a1' * 20}\""
    docs = spark.createDataFrame([(1, text, "mine", 3), (1, text, "mine", 3), (2, None, "mine", None)], "doc_id long, text string, _pii_all string, n_chars int")
    spans = pii.report(docs.where("text is not null")).first()["spans"]
    want, at = [], 0
    for kind, start, end in sorted((s.split(":") for s in spans.split(",")), key=lambda s: int(s[1])):
        if int(start) >= at:
            want += [text[at : int(start)], pii.MASK[kind]]
            at = int(end)
    assert {"email", "ip", "phone", "secret"} <= {s.split(":")[0] for s in spans.split(",")}
    got = pii.redacted(docs).collect()
    assert [r["text"] for r in got if r["doc_id"] == 1] == ["".join(want) + text[at:]] * 2
    assert all(r["_pii_all"] == "mine" for r in got) and [r["text"] for r in got if r["doc_id"] == 2] == [None]
    assert own(docs, "_pii_all") == "_pii_all_"


def test_many_clusters_under_one_boilerplate(spark):
    """One large coarse group: texts share a passage, clusters of a few are near copies, none may be lost."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    common = " ".join(rng.choice(words, 70))
    rows = []
    for cluster in range(120):
        own_words = list(rng.choice(words, 70))
        for _ in range(int(rng.integers(1, 5))):
            v = list(own_words)
            v[int(rng.integers(70))] = "z" + str(rng.integers(9999))
            rows.append((len(rows), common + " " + " ".join(v), cluster))
    got = dedup.near_duplicates(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).toPandas().set_index("doc_id")

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert len({find(i) for i in range(len(rows))}) > 100
    assert got.component_id.sort_index().tolist() == [find(i) for i in range(len(rows))]


def test_severity_by_hand(spark):
    """Expected severity from the weights of each text's distinct features, word by word."""
    import pyarrow as pa

    texts = ["You fool, fool of a clown", None, "", "kind words only", "clowning about " * 500]
    word = lambda t: next(iter(toxicity.doc_features(pa.RecordBatch.from_arrays([pa.array([t])], ["text"]))))[2]
    weights = {int(word("fool")[0]): 1.25, int(word("clown")[0]): 0.5, int(word("clowning")[2]): 0.75}
    features = np.sort(np.array(list(weights), np.uint64))
    model = toxicity.Ordinal(features, np.array([weights[int(f)] for f in features]), np.array([0.5, 1.5]))
    got, p = model.severity(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    for text, s, first in zip(texts, got, p, strict=True):
        seen = {int(k) for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split() for k in word(w)}
        total = sum(v for k, v in weights.items() if k in seen)
        chances = [1 / (1 + np.exp(t - total)) for t in (0.5, 1.5)]
        assert abs(s - sum(chances)) < 1e-12 and abs(first - chances[0]) < 1e-12
    assert got[0] > got[3] == got[1] and got[4] > got[3]


def test_convolution_by_hand():
    """Pooled filters and language chances against loops over places."""
    from sedge.llm import langid

    rng = np.random.default_rng(1)
    net = langid.Network(["x", "y"], [rng.normal(size=(w, langid.N_CLASSES, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS], rng.normal(size=48).astype(np.float32), rng.normal(size=(48, 2)).astype(np.float32), np.zeros(2, np.float32)).compile()
    x = rng.integers(0, langid.N_CLASSES, (3, langid.WINDOW))
    want = np.array([[max(sum(k[o, row[at + o], f] for o in range(w)) for at in range(langid.WINDOW - w + 1)) for w, k in zip(langid.WIDTHS, net.weights, strict=True) for f in range(langid.FILTERS)] for row in x])
    assert np.allclose(net.pooled(x), np.maximum(want + net.bias, 0), atol=1e-4)


def test_rare_languages_are_learned(spark):
    from sedge.llm import langid

    rows = [(i, "the of and " * 40, "en") for i in range(3000)] + [(5000 + i, "żółć gęś " * 40, "pl") for i in range(12)]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 60).to_pandas()
    assert set(got.lang) == {"en", "pl"} and (got.lang == "pl").sum() >= 12


def test_large_buckets_make_stars(spark):
    """Pipeline: ids that share many large buckets are joined by an edge each, not by one for each bucket; the components stay."""
    from sedge.llm.components import components
    from sedge.llm.dedup import star

    rows = [(i, b * 7 if i >= b * 7 else i) for i in range(40, 400) for b in range(6)] + [(1000 + i, 1000) for i in range(30)] + [(1005, 3)]
    joined = spark.createDataFrame(rows, "id long, low long")
    edges = star(joined)
    whole = components(joined.selectExpr("id as src", "low as dst"), "whole").collect()
    assert sorted(map(tuple, components(edges, "star").collect())) == sorted(map(tuple, whole))
    assert edges.count() < 450 < joined.where("id != low").distinct().count() / 4
