"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sedge.llm import bpe, dedup, langid, packing, pii, quality, shard, toxicity
from sedge.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string, shard string, kept string, _at int, label string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z", 1, "w") for i, t in rows], SCHEMA)


def edge_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "one  TWO"), (5, "x " * 30000), (6, "Ünïcode ß İ 中文   x\u0085y \x1c z")]
    base = [[word() for _ in range(60)] for _ in range(3)]
    for k in range(60):
        w = list(base[k % 3])
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = word()
        rows.append((10 + k, " ".join(w).title() if k % 4 == 0 else " ".join(w)))
    rows += [(200, rows[20][1]), (201, rows[20][1]), (202, "!" * 5000), (203, "<|endoftext|>a<|startoftext|>")]
    return rows


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(rows[b][0])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def test_dedup_equals_brute_force(spark):
    rows = edge_rows()
    got = {r["doc_id"]: r for r in dedup.near_duplicates(docs_of(spark, rows)).collect()}
    want = brute_components(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_dedup_of_large_groups(spark, monkeypatch):
    """Chunks far smaller than the groups: the second chunking and the rest must find every link."""
    monkeypatch.setattr(dedup, "CHUNK", 5)
    monkeypatch.setattr(dedup, "BUCKET", 3)
    rows = edge_rows()
    got = {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


def test_deduplicated_keeps_columns_and_one_of_each_group(spark):
    rows = [*edge_rows(), (3, "one two"), (None, "one two"), (None, "one two")]
    out = dedup.deduplicated(docs_of(spark, rows))
    assert out.columns == docs_of(spark, rows).columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in brute_components(edge_rows()).items() if i == c)


def test_minmax_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 4000).astype(np.uint64), None
    b = np.concatenate([a[:3000], rng.integers(0, 2**63, 1000).astype(np.uint64)])
    s = dedup.signatures(np.concatenate([a, b]), np.array([0, 4000, 8000]))
    assert s.shape == (2, 2 * dedup.PERMUTATIONS)
    assert abs((s[0] == s[1]).mean() - 3000 / 5000) < 0.12


@pytest.mark.parametrize("empty", [[], [(1, None)]])
def test_empty_tables(spark, empty):
    docs = docs_of(spark, empty)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    n = len(empty)
    assert dedup.near_duplicates(docs).count() == n
    assert dedup.deduplicated(docs).count() == n
    assert toxicity.grade(docs, labels).where("kept").count() == n
    assert quality.judge(docs, labels).count() == n
    assert bpe.digests(docs, bpe.vocabulary()).count() == n
    assert langid.predict(docs, langid.fit_on(docs)).count() == n
    assert packing.pack(docs, bpe.vocabulary()).count() == n
    assert shard.assign(docs, [1.0] * 3).count() == n
    assert pii.report(docs).count() == n


def test_bpe_equals_the_library(spark):
    path = bpe.vocabulary()
    lib = Tokenizer.from_file(path)
    rows = edge_rows()
    got = {r["doc_id"]: r for r in bpe.digests(docs_of(spark, rows), path).collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(docs_of(spark, rows), path)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, path).collect()}
    assert back[3] == lib.decode(lib.encode("one two", add_special_tokens=False).ids, skip_special_tokens=False)


def test_bpe_fuzz():
    path = bpe.vocabulary()
    lib, own, other = Tokenizer.from_file(path), bpe.codec(path), bpe.library(path)
    rnd = random.Random(7)
    letters = "abcdeinthre'sdm .,!?éİΣ́ \u0085\x1c中0129\n ſßÀ²½ªŁ_\xad<|"
    for k in range(1500):
        t = "".join(rnd.choice(letters if k % 3 else "aehinst") for _ in range(rnd.randint(0, 40)))
        want = np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.ids(t.encode()) == want and other.ids(t.encode()) == want, t


def test_gadgets_of_a_small_automaton():
    letters = {c: i for i, c in enumerate("ab")}
    letters |= {c + "</w>": 2 + i for i, c in enumerate("ab")}
    merges = [["a", "a"], ["aa", "b"]]
    vocab = letters | {"aa": 4, "aab": 5}
    a = bpe.Automaton(vocab, merges)
    assert not a.arc(vocab["a"], vocab["a"])  # taken away by the first gadget
    assert a.arc(vocab["aa"], vocab["a"]) and a.arc(vocab["aa"], vocab["aa"])
    assert not a.arc(vocab["aa"], vocab["b"])  # by the second
    assert not a.arc(vocab["a"], vocab["aa"])


LUHN = "4111 1111 1111 1111"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x * 2 > 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    for o, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            ok = k == "email" or (k == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (k == "card" and 14 <= len(d) <= 19 and luhn(d)) or (k == "phone" and 10 <= len(d) <= 15)
            if ok:
                out.append((m.start(), o, m.end(), k))
    return sorted(out)


def test_pii_equals_regular_expressions(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("0123456789 .-+@ab()é😀") for _ in range(rnd.randint(0, 90))) for _ in range(400)]
    texts += [None, "", f"{LUHN}, {LUHN}", "a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8 999.1.1.1.2 0001.2.3.4", "+1 (555) 123-4567 call"]
    got = {r["doc_id"]: r for r in pii.report(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest(), t
        n = Counter(k for *_, k in want)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [n[k] for k in PATTERNS]


def test_pii_adds_checked_and_contextual_spans_and_masks(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00."), (2, "IBAN DE89 3704 0044 0532 0130 01."), (3, "my ssn 123-45-6789"), (4, "part 123-45-6789"), (5, f"pay {LUHN} now"), (6, None), (7, "clean")]
    docs = docs_of(spark, rows)
    spans = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert spans[1] == "iban:5:32" and spans[2] == "" and spans[3] == "ssn:7:18" and spans[4] == ""
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert text[5] == ("pay <CARD> now", 14) and text[6] == (None, None) and text[7] == ("clean", 5)


def test_long_texts_of_digits_and_dots_end(spark):
    rows = [(1, "1" * 100000), (2, "a." * 50000 + "@b" + ".c" * 20000), (3, "9 " * 30000)]
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs_of(spark, rows)).collect()}
    assert got[2] == "email:0:140002" and got[1] == ""


def test_sharding_moves_rows_into_the_new_shard_only(spark):
    rows = [*[(i, f"t{i % 7}") for i in range(2000)], (None, None), (5, "again")]
    got = shard.assign(docs_of(spark, rows), [1.0] * 24).toPandas()
    assert len(got) == len(rows)
    moved = got[got.shard != got.grown_shard]
    assert set(moved.grown_shard) == {24} and 0 < len(moved) < 200
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    by = dict(zip(got.doc_id, got.text_crc32, strict=True))
    assert by[10] == zlib.crc32(b"t3")
    assert set(got[got["size"] == 8].text_crc32) == {0}


def test_weights_give_shares(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    n = dict(df.groupBy(shard.rendezvous(F.col("k"), [1.0, 3.0, 0.0]).alias("s")).count().collect())
    assert 2 not in n and abs(n[1] / 20000 - 0.75) < 0.02


def test_slots_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(shard, "BLOCK_ROWS", 20)
    got = shard.assign(docs_of(spark, [(i, "x") for i in range(500)]), [1.0] * 3).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_packing_is_whole_and_gapless(spark):
    path = bpe.vocabulary()
    lib = Tokenizer.from_file(path)
    rows = [*edge_rows(), (3, "one two")]
    got = packing.pack(docs_of(spark, rows), path).toPandas()
    want = Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()))] += 1
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()
    assert g.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    x = np.clip(rng.lognormal(5.5, 1.1, 4000).astype(int), 1, 2048)
    h = np.bincount(x, minlength=2049)
    runs, n = packing.plan(h)
    used = np.bincount(runs[:, 0], runs[:, 2], 2049)
    assert (used == h).all()
    assert n <= np.ceil(x.sum() / 2048) * 1.01 + 1


def test_fitted_repeats_explain_the_histogram():
    h = np.zeros(11, np.int64)
    h[[10, 7, 3, 5]] = [4, 6, 6, 8]
    rows = packing.patterns(h, 10)
    x = packing.repeats(rows, h)
    fitted = np.bincount(rows[rows > 0], np.repeat(x, (rows > 0).sum(1)), 11)
    assert np.allclose(fitted, h, atol=0.2)


def quality_brute(t):
    w = WORD.findall(t or "")
    tri = {}
    for k in range(len(w) - 2):
        tri.setdefault(tuple(w[k : k + 3]), []).append(k)
    cover = {k + d for v in tri.values() if len(v) > 1 for k in v for d in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(cover)]


def test_quality_counts_and_held_out_labels(spark, sf_dir):
    rows = [*edge_rows(), (300, "a b c\na b c\n\na b c"), (301, "x #*$ y |<> z")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, rows), labels).collect()}
    for i, t in rows:
        r = got[i]
        n = quality_brute(t)
        assert [r[c] for c in quality.COUNTS] == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])
    sf = sf_dir.replace("0.001", "0.01")
    docs, known = table(spark, sf, "documents"), table(spark, sf, "labels")
    judged = quality.judge(docs, known.where("doc_id % 2 = 0")).join(known.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good, bad = judged[(judged.quality == 1) & ~judged.base_failed], judged[judged.quality == 0]
    assert good.kept.mean() > 0.95 and bad.kept.mean() < 0.3


def test_toxicity_on_held_out_labels(spark, sf_dir):
    bad = ["idiot", "scum", "worthless"]
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        w = [rnd.choice(["the", "rain", "fell", "on", "plain", "and", "grass"]) + rnd.choice(["", "s", "er"]) for _ in range(60)]
        y = i % 4 == 0
        if y:
            for _ in range(1 + i % 3):
                w[rnd.randrange(60)] = rnd.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(y)))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*rows, (900, None), (901, "")])
    got = toxicity.grade(docs, known.where("doc_id % 5 <> 1")).join(known.where("doc_id % 5 = 1").withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    assert (got.toxic.astype(int) == got.y).mean() > 0.97
    kept = toxicity.accepted(docs, known)
    assert kept.columns == docs.columns and kept.where("doc_id >= 900").count() == 2


def test_ordinal_thresholds_are_in_order_and_severity_grows():
    rng = np.random.default_rng(0)
    n = 600
    grades = rng.integers(0, 4, n)
    rows, cols = [], []
    for i, g in enumerate(grades):
        for f in range(g):
            rows.append(i)
            cols.append(f)
    w, theta = toxicity.fit_ordinal(np.array(rows), np.array(cols), grades, 3)
    assert (np.diff(theta) > 0).all() and (w >= 0).all()
    model = toxicity.Ordinal(np.arange(3, dtype=np.uint64), w, theta)
    severity = model.expected(np.cumsum(np.concatenate([[0], w])))[0]
    assert (np.diff(severity) > 0).all()


def test_language_held_out_accuracy_and_und(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    net = langid.fit_on(docs, 600)
    got = langid.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    odd = langid.predict(docs_of(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "中文字"), (5, "the " * 5000)]), net).toPandas().set_index("doc_id")
    assert odd.lang_pred[[1, 2, 3]].tolist() == ["und"] * 3 and odd.lang_pred[4] != "und" and odd.lang_pred[5] in net.langs
    for i in (1, 2, 17, 4711):
        assert spark.range(1).select(langid.held_out(F.lit(i))).first()[0] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_quality_is_fitted_on_all_labels(spark):
    """ranges, draws and threshold come from all labelled rows, none of which is left out."""
    import numpy as np

    from sedge.llm import quality

    assert not hasattr(quality, "FIT_ROWS")
    rng = np.random.default_rng(4)
    score = np.concatenate([rng.normal(0.4, 0.03, 3000), rng.normal(0.5, 0.05, 900)]).round(4)
    good = np.arange(3900) < 3000
    rows = [(float(s), int((good & (score == s)).sum()), int((~good & (score == s)).sum())) for s in np.unique(score)]
    got = quality.threshold(spark.createDataFrame(rows, "score double, good long, bad long").repartition(7))
    ordered = np.unique(score)
    lost = 1 - np.searchsorted(np.sort(score[good]), ordered, "right") / good.sum()
    caught = 1 - np.searchsorted(np.sort(score[~good]), ordered, "right") / (~good).sum()
    at = int(np.argmax(np.where(lost <= quality.LOSE_GOOD, caught - lost, -1.0)))
    assert got == float(ordered[at] + ordered[min(at + 1, len(ordered) - 1)]) / 2 + 1e-9
