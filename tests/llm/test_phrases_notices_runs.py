"""Collocations, license notices and periodic runs against plain loops, with odd rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sedge.llm import collocations, common, licenses, periodic

SCHEMA = "doc_id long, text string, lang string, n long, runs string, block long, score string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, 5, "x", 7, "y") for i, t, lang in rows], SCHEMA)


# ---- collocations ----


def phrases(rows, least, longest, top):
    """The contract, by loops over every place of every phrase."""
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = {(lang, p[i:j]) for (lang, p), b in cand.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and b >= f[lang, p[i:j]]}
    out = []
    for (lang, p), a in cand.items():
        if (lang, p) not in inside:
            score, _, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(mine)]
    return sorted(ranked)


def some_texts(seed, n=120):
    rnd = random.Random(seed)
    words = ["a", "B", "c", "Été", "中", "x\u0085", "d-e", "\x1f", "f"]
    rows = [(0, None, "en"), (1, "", None), (2, " .\t, \n", "en"), (3, "a b " * 4000, "fr"), (4, "one", "de"), (None, "a B. a B", "en")]
    for i in range(n):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 6))]
        rows.append((10 + i // 2, rnd.choice(". , ; : ! ? \n \r \x0b".split(" ")).join(parts), rnd.choice(["en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("least, top, block_bytes", [(5, 2000, 1 << 22), (3, 7, 600), (2, 1, 1)])
def test_phrases_by_loops(spark, least, top, block_bytes):
    rows = some_texts(least)
    got = collocations.mine(table_of(spark, rows).repartition(5), least, 5, top, block_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases(rows, least, 5, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) >= 3


def test_no_phrases(spark):
    assert collocations.mine(table_of(spark, [])).count() == 0
    assert collocations.mine(table_of(spark, [(1, "a b", "en")])).count() == 0


def test_scores_beyond_64_bits(spark):
    """The division of products is exact."""
    a, n, left, right = 9_000_000_000_000, 700_000_000_000_001, 9_500_000_000_001, 99_000_000_000_007
    row = spark.createDataFrame([(a, n, [left], [right], ["x", "y"])], "f long, n long, prefixes array<long>, suffixes array<long>, words array<string>")
    assert row.select(collocations.least_cut()).first()["cut"]["score"] == 1000 * a * n // (left * right)


def test_rare_pairs_make_no_rows(spark, monkeypatch):
    """Most pairs of frequent words are rare: they are counted by bin, and no row is written or dealt for them."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(60)) + (" . x y z" if i % 2 else ""), "en") for i in range(240)]
    dealt, frequent_pairs = [], collocations.frequent_pairs

    def counted(df, least):
        n = [x for r in df.collect() for x in collocations._unpacked(r["n"])]
        dealt.append((sum(n), len(n)))
        return frequent_pairs(df, least)

    monkeypatch.setattr(collocations, "frequent_pairs", counted)
    before = len(common.written())
    got = collocations.mine(table_of(spark, rows).repartition(3), 100, 5, 2000, 6000)
    assert sorted(map(tuple, got.collect())) == phrases(rows, 100, 5, 2000) and got.count() == 1
    assert dealt[0][0] == 240 and dealt[0][1] < 120
    assert not [x for x in common.written()[before:] if "-places-" in x or "-bins-" in x]


@pytest.mark.parametrize("ranges, range_bins", [(1, 1), (3, 2), (5, 64)])
def test_pairs_of_few_bins(spark, ranges, range_bins):
    """However pairs clash in bins, no frequent one is lost, and counts stay those of the pairs."""
    docs = table_of(spark, some_texts(8)).repartition(4).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    read = common.keep(collocations.blocks(docs, 900), "test-places")
    named = read.where("number is not null").groupBy("lang", "word").agg(F.min(F.col("block") + F.col("number")).alias("id"))
    often = read.where("number is not null").join(named, ["lang", "word"]).select("block", "number", "id")
    places = read.where("number is null").select("block", "places")
    sums = {}
    for least in (1, 12):
        bins = common.keep(collocations.binned(places, often, ranges, least, range_bins), "test-bins")
        kept = collocations.frequent_bins(bins.where("`range` is not null"), least, range_bins)
        made = collocations.pairs(bins.where("`range` is null").select("block", "places", "ids"), kept.select("block", "bins"), ranges, range_bins)
        sums[least] = Counter()
        for r in made.where("`range` is not null").collect():
            for left, right, n in zip(*(collocations._unpacked(r[c]).tolist() for c in ("left", "right", "n")), strict=True):
                sums[least][left, right] += n
    assert len(sums[1]) > 60 and set(sums[12].items()) <= set(sums[1].items())
    assert {x for x, n in sums[1].items() if n >= 12} <= set(sums[12])
    assert range_bins < 64 or len(sums[12]) < len(sums[1])


def test_wide_numbers():
    import numpy as np

    for top in (5, 65535, 65536, 1 << 31):
        x = np.array([0, top, 3])
        assert collocations._unpacked(collocations._packed(x)).tolist() == x.tolist()
    assert collocations._unpacked(collocations._packed(np.zeros(0, np.int64))).tolist() == []


# ---- license notices ----

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def fewest_edits(notice, words):
    """Least edits between the notice and any stretch of whole words, by a table over every start (None above the allowance)."""
    text, best = notice.text, None
    for i in range(len(words)):
        target = ""
        for j in range(i, len(words)):
            target += (" " if j > i else "") + words[j]
            if len(target) > len(text) + notice.edits:
                break
            if abs(len(target) - len(text)) <= notice.edits:
                row = list(range(len(target) + 1))
                for a, x in enumerate(text):
                    last, row[0] = row[0], a + 1
                    for b, y in enumerate(target):
                        last, row[b + 1] = row[b + 1], min(row[b + 1] + 1, row[b] + 1, last + (x != y))
                if row[-1] <= notice.edits and (best is None or row[-1] < best):
                    best = row[-1]
    return best


def garbled(rnd, text):
    out = list(text)
    for _ in range(rnd.randint(0, 5)):
        at = rnd.randrange(len(out))
        out[at] = rnd.choice(["", "q", out[at] + "é", " ", out[at].upper()])
    return "".join(out)


def notice_texts():
    rnd = random.Random(4)
    filler = "the permit license of general use and source forms license public apache mit software".split()
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "MIT License"), (4, "mit\tlicense, MIT-License; mit licensee permit license"), (5, "Apache licence"), (6, "Ünïcode MIT 中文 license")]
    for i in range(60):
        parts = [" ".join(rnd.choices(filler, k=rnd.randint(0, 5))) for _ in range(3)]
        notices = [garbled(rnd, rnd.choice(licenses.ALL).text) for _ in range(2)]
        rows.append((10 + i, f"{parts[0]}\n{notices[0]}. {parts[1]} {notices[1].title()}! {parts[2]}"))
    return rows + [(90, "mit license " * 3000), (91, "apache licence public " * 2000), (23, rows[20][1])]


def test_notices_by_edit_tables(spark):
    rows = notice_texts()
    got = {}
    for r in licenses.scan(table_of(spark, [(i, t, "en") for i, t in rows])).collect():
        got.setdefault(r["doc_id"], r)
    for i, text in rows[:-3]:
        words, spans = words_of(text), got[i]["spans"]
        assert got[i]["n_words"] == len(words)
        for n in licenses.ALL:
            mine = [s["edits"] for s in spans if s["notice"] == n.text]
            assert (min(mine) if mine else None) == fewest_edits(n, words), (i, text, n.text)
        for s in spans:
            assert words_of(text[s["start"] : s["end"]]) == words[s["word"] : s["word"] + s["words"]]
            assert s["score"] == 1 - s["edits"] / len(s["notice"])
    assert sum(s["edits"] > 0 for r in got.values() for s in r["spans"]) > 30


def test_notice_report_by_loops(spark):
    rows = notice_texts()
    out = {r["doc_id"]: r for r in licenses.report(table_of(spark, [(i, t, "en") for i, t in rows])).collect()}
    for i, text in rows:
        w, r = words_of(text), out[i]
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    assert out[5]["labels"] == "apache" and out[5]["n_base"] == 0 and out[90]["n_base"] == 3000
    assert licenses.report(table_of(spark, [])).count() == 0


# ---- periodic runs ----


def brute_runs(w):
    """(start, length, smallest period) of all runs: maximal stretches for each period, least period first."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def words_with_runs(rnd, letters, size):
    w = []
    while len(w) < size:
        unit = [rnd.choice(letters) for _ in range(rnd.choice([1, 1, 2, 3, 5, 8]))]
        w += (unit * rnd.choice([1, 1, 2, 4, 5, 9]))[: rnd.randint(1, 40)]
        if len(w) > 10 and rnd.random() < 0.3:
            a = rnd.randrange(len(w))
            w += w[a : a + rnd.randint(1, 40)]
    return w


def test_runs_by_periods():
    rnd = random.Random(2)
    for i in range(3000):
        w = [x.encode() for x in words_with_runs(rnd, "ab" if i % 3 else "abcdefghijkl", rnd.choice([5, 8, 20, 60, 150]))]
        assert periodic.runs(w) == brute_runs(w), w
        # the same without parting the text first
        assert sorted(((s, e - s, p) for s, e, p in periodic.segment_runs([ord(x) for x in w])), key=lambda r: (r[0], r[2])) == brute_runs(w)
    assert periodic.runs([b"a"] * 5) == [] and periodic.runs([b"a"] * 6) == [(0, 6, 1)] and periodic.runs([]) == []


def test_factors_are_longest_earlier_pieces():
    rnd = random.Random(3)
    for _ in range(300):
        w = [ord(x) for x in words_with_runs(rnd, "abc", 30)]
        at = 0
        for s, e, back in periodic.factors(w):
            longest = max((k for k in range(1, len(w) - s + 1) if any(w[j : j + k] == w[s : s + k] for j in range(s))), default=0)
            assert s == at and e - s == max(1, longest) and (back == 0) == (longest == 0) and (not back or w[s - back : e - back] == w[s:e])
            at = e
        assert at == len(w)


def test_run_digests_by_loops(spark):
    rnd = random.Random(6)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "x"), (None, "a " * 9), (4, "long  text\x0b" * 3000), (5, "a\u0085b a\u0085b " * 4)]
    rows += [(k, " ".join(words_with_runs(rnd, ["é", "b", "c d"], 40))) for k in range(10, 130)] + [(10, "other text")]
    got = periodic.digests(periodic.with_tails(table_of(spark, [(i, t, "en") for i, t in rows]))).collect()
    assert len(got) == len(rows)
    seen, changed = Counter(), 0
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        if i is not None:
            h = zlib.crc32(str(i).encode())
            if h % 10 == 0 and w:
                g, n = h // 10, len(w)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
                changed += 1
        runs = brute_runs(w) if len(w) < 5000 else [(0, len(w), 2)]
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        seen[(i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    assert Counter(map(tuple, got)) == seen and changed > 3


def test_runs_beside_clashing_columns(spark):
    got = periodic.detect(table_of(spark, [(1, "b b b b b b c", "en")])).first()
    assert got["runs"] == "x" and [tuple(r) for r in got["runs_"]] == [(0, 6, 1)] and got["collapsed"] == "b c" and got["n"] == 5
    assert periodic.detect(table_of(spark, [])).count() == 0
