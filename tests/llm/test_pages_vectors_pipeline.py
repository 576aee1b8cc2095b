"""Pages, embeddings and the pipeline against brute force."""

import html
import re

import numpy as np

import corpus_pipeline
from sedge.llm import dom, embeddings, htmltext
from sedge.llm.common import table


def article_text(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"<(/?)(p|h1|br|li|ul)\b[^>]*>", " ", inner)
    return " ".join(html.unescape(re.sub(r"<!--.*?-->|</?b>", "", inner)).split())


def test_pages_of_the_tables(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = {r["page_id"]: r for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == article_text(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_held_out_composed_pages():
    rng = np.random.default_rng(4242)
    pages = [htmltext.training_page(rng) for _ in range(120)]
    found = htmltext.texts([p.replace("†", "") for p in pages], htmltext.model())
    same = 0
    for p, t in zip(pages, found, strict=True):
        _, own, _ = dom.node_features(dom.parse(p), {})
        same += " ".join(" ".join(o.replace("†", "") for o in own if "†" in o).split()) == t
    assert same / 120 > 0.95


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "<p>unclosed <b>bold<p>next &amp; &eacute;", "x"), (4, "u", "<" * 2000, "x"), (5, "u", "<div>" * 1500 + "deep", "x"), (6, "u", '<a "' * 500, "x"), (6, "u", "<script>var a='</p>'", "x")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).toPandas()
    assert len(got) == 7 and set(got.columns) == {"page_id", "url", "text", "n_chars"}
    assert (got[got.page_id <= 2].text == "").all()
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decoding_never_contradicts():
    rng = np.random.default_rng(0)
    for _ in range(50):
        parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, 12)])
        odds = rng.normal(size=12) * 3
        got = htmltext.decode(odds, parent)
        assert all(got[parent[i]] for i in range(1, 12) if got[i])
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        best = max(sum(yes[i] if y >> i & 1 else no[i] for i in range(12)) for y in range(1 << 12) if all(not y >> i & 1 or y >> parent[i] & 1 for i in range(1, 12)))
        assert np.isclose(best, np.where(got, yes, no).sum())


def brute_links(ids, x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(hit), strict=True):
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return dict(zip(ids, hit.sum(1).tolist(), strict=True)), {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 32))
    x = np.stack([base[k % 60 if k % 3 else 0] + rng.normal(size=32) * rng.choice([0, 0.02, 0.1, 0.3]) for k in range(400)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0, None]), (904, [1.0] * 3), (905, []), (906, [float("inf")] * 32)]
    # a vec_id that repeats is a vector of its own, and other lengths are linked among themselves
    again = [rows[7], (7, [-v for v in rows[7][1]])]
    short = [(1000 + i, [float(i % 2), 1.0 - i % 2, 0.01 * i]) for i in range(6)]
    got = embeddings.near_duplicates(spark.createDataFrame([*rows, *odd, *again, *short], "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == len(rows) + len(odd) + len(again) + len(short) and (got.recall >= 0.98).all()
    links, comps = brute_links([*range(400), "again", "turned"], np.vstack([x, x[7], -x[7]]))
    comps = {k: 7 if v in ("again", "turned") else v for k, v in comps.items()}
    assert sorted(got.n_links[got.vec_id == 7]) == sorted([links[7], links["again"], links["turned"]])
    got = got.drop_duplicates("vec_id").set_index("vec_id")
    del links["again"], links["turned"], comps["again"], comps["turned"]
    assert all(got.n_links[i] == links[i] for i in links if i != 7)
    assert all(got.component_id[i] == comps[i] for i in comps)
    assert got.n_links[[1000, 1001]].tolist() == [2, 2] and got.component_id[[1003, 1004]].tolist() == [1001, 1000]
    assert (got.n_links[[i for i, _ in odd]] == 0).all() and got.kept[[i for i, _ in odd]].all()
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "pii", "packing"]
    left = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        n = docs.count()
        assert 0 < n <= left and (name != "pii" or n == left)
        left = n
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(out.doc_id) == {r[0] for r in docs.select("doc_id").collect()}
    run = corpus_pipeline.run(spark, sf_dir).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert run[key].sort_values(key).values.tolist() == out[key].sort_values(key).values.tolist()
