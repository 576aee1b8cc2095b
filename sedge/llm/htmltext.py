"""Main text of web pages: boosted trees judge every block, a tree-wide decoding makes the judgements agree.

The trees learn from pages that `training_page` composes: layouts, names and
lengths vary, and which blocks are the article is known. A block is positive if
it holds or belongs to the article. Decoding picks the labels of highest total
log probability under which no positive block stands in a negative one.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sedge.llm.boosting import Trees, boost
from sedge.llm.common import freed
from sedge.llm.dom import Block, node_features, parse

TRAINING_PAGES, SEED = 900, 17
#: Times that an attribute word must be seen.
WORD_SEEN = 8
#: Pages whose blocks are judged together.
STEP = 64
_MARK = "†"  # marks article text in training pages


def _words(rng: np.random.Generator, low: int, high: int) -> str:
    parts = ["an", "ber", "co", "del", "en", "for", "ge", "hi", "in", "ja", "ko", "le", "mo", "na", "os", "pre", "qui", "re", "sch", "ta", "un", "ver", "wo", "za", "é", "ü"]
    n = int(np.exp(rng.uniform(np.log(low), np.log(high + 1))))
    words = ["".join(parts[i] for i in rng.integers(len(parts), size=rng.integers(1, 4))) for _ in range(max(1, n))]
    for i in range(len(words)):
        if rng.random() < 0.08:
            words[i] += rng.choice([",", ".", "."])
    return " ".join(words).capitalize()


def training_page(rng: np.random.Generator) -> str:
    """A page whose article text carries a mark in every block."""
    pick = lambda *x: x[rng.integers(len(x))]
    maybe = lambda p, f: f() if rng.random() < p else ""

    def named(tag: str, *names: str) -> tuple[str, str]:
        name = pick(*names)
        attribute = pick(f' class="{name}"', f' id="{name}"', f' class="x{rng.integers(99)} {name}"', "" if tag not in ("div", "section") else f' class="{name}"')
        return f"<{tag}{attribute}>", f"</{tag}>"

    def wrap(tag: str, names: tuple, inner: str) -> str:
        a, b = named(tag, *names)
        return f"{a}{inner}{b}"

    def links(low: int, high: int) -> str:
        items = "".join(f'<li><a href="/x">{_words(rng, 1, 4)}</a></li>' for _ in range(rng.integers(low, high)))
        return pick(f"<ul>{items}</ul>", items.replace("<li>", "").replace("</li>", " "))

    def good(text: str) -> str:
        return _MARK + text

    def sentence() -> str:
        t = _words(rng, 3, 90)
        if rng.random() < 0.25:
            w = t.split(" ")
            i = rng.integers(len(w))
            w[i] = pick(f'<a href="/y">{w[i]}</a>', f"<b>{w[i]}</b>", f"<em>{w[i]}</em>", f"<b>{w[i]}")
            t = " ".join(w)
        return t

    def advert() -> str:
        body = pick(_words(rng, 1, 40), f'<p>{_words(rng, 2, 30)}</p>', f'<a href="/ad">{_words(rng, 2, 12)}</a>')
        return wrap(pick("div", "div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "promoted", "ad-slot", "banner-ad", "adv", "advertising"), body)

    def article_body() -> str:
        out = []
        for _ in range(max(1, int(np.exp(rng.uniform(0, np.log(16)))))):
            r = rng.random()
            if r < 0.74:
                out.append(f"<p>{good(sentence())}" + pick("</p>", "</p>", "</p>", "<br>", ""))
            elif r < 0.82:
                out.append(pick("<h2>{}</h2>", "<h3>{}</h3>").format(good(_words(rng, 1, 10))))
            elif r < 0.88:
                out.append("<ul>" + "".join(f"<li>{good(_words(rng, 1, 20))}</li>" for _ in range(rng.integers(1, 6))) + "</ul>")
            elif r < 0.92:
                out.append(f"<blockquote>{pick('<p>{}</p>', '{}').format(good(_words(rng, 4, 40)))}</blockquote>")
            elif r < 0.95:
                out.append("<table><tr>" + "".join(f"<td>{good(_words(rng, 1, 6))}</td>" for _ in range(rng.integers(2, 5))) + "</tr></table>")
            else:
                out.append(f"<pre>{good(_words(rng, 3, 20))}</pre>")
            if rng.random() < 0.06:
                out.append(advert())
        return "".join(out)

    def comments() -> str:
        items = "".join(wrap(pick("div", "li", "article"), ("comment", "reply", "comment-item", "response"), pick("<p>{}</p>", "{}").format(_words(rng, 2, 60))) for _ in range(rng.integers(1, 6)))
        return wrap(pick("div", "section"), ("comments", "comment-list", "discussion", "disqus", "respond", "reader-comments", "replies", "readers", "feedback"), maybe(0.5, lambda: f"<h3>{_words(rng, 1, 3)}</h3>") + items)

    def notice() -> str:
        return wrap(pick("div", "div", "section", "aside"), ("cookie-notice", "cookies", "consent", "notice", "notification", "newsletter", "alert", "gdpr", "popup", "modal", "overlay", "subscribe-box", "signup", "paywall"), pick("<p>{}</p>", "{}").format(_words(rng, 3, 50)) + maybe(0.5, lambda: f"<button>{_words(rng, 1, 3)}</button>"))

    def form() -> str:
        return f'<form action="/s">{maybe(0.5, lambda: "<label>" + _words(rng, 1, 4) + "</label>")}<input name="q"><button>{_words(rng, 1, 2)}</button>{maybe(0.3, lambda: "<p>" + _words(rng, 2, 20) + "</p>")}</form>'

    def sidebar() -> str:
        inner = pick(links(2, 9), f"<h3>{_words(rng, 1, 4)}</h3>{links(2, 9)}", f"<p>{_words(rng, 4, 60)}</p>")
        return wrap(pick("aside", "aside", "div", "section"), ("sidebar", "side", "widget", "widgets", "related", "recommended", "popular", "trending", "complementary", "right-rail", "share", "social", "tags", "byline-box"), inner)

    def top() -> str:
        inner = maybe(0.6, lambda: pick("<h2>{}</h2>", "<div>{}</div>", "<p>{}</p>", "{}").format(_words(rng, 1, 12))) + maybe(0.7, menu) + maybe(0.3, form)
        return wrap(pick("header", "header", "div"), ("header", "masthead", "site-header", "topbar", "top", "banner", "brand", "logo"), inner or _words(rng, 1, 4))

    def menu() -> str:
        return wrap(pick("nav", "nav", "div"), ("nav", "menu", "navbar", "navigation", "main-menu", "menubar", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs"), links(2, 9))

    def footer() -> str:
        return wrap(pick("footer", "footer", "div"), ("footer", "site-footer", "copyright", "bottom", "legal", "colophon", "contentinfo", "imprint"), pick("&copy; {}", "<p>{}</p>", "{}").format(_words(rng, 2, 40)) + maybe(0.3, lambda: links(2, 6)))

    title = maybe(0.85, lambda: pick("<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>").format(good(_words(rng, 2, 14))))
    body = title + article_body()
    tag = pick("article", "article", "article", "main", "div", "section")
    if tag in ("article", "main") and rng.random() < 0.6:
        story = f"<{tag}>{body}{maybe(0.15, comments)}{maybe(0.1, advert)}</{tag}>"
    else:
        story = wrap(tag, ("article", "content", "post", "entry-content", "story", "article-body", "post-body", "text", "hentry", "blog-post", "news-text", "single"), body + maybe(0.15, comments) + maybe(0.1, advert))
    for _ in range(rng.integers(0, 3)):
        if rng.random() < 0.1:  # columns made of a table
            story = f"<table><tr>{maybe(0.6, lambda: '<td>' + links(2, 9) + '</td>')}<td>{story}</td>{maybe(0.3, lambda: '<td>' + sidebar() + '</td>')}</tr></table>"
            continue
        names = ("container", "wrapper", "row", "page", "layout", "main", "content") if rng.random() < 0.7 else tuple("".join(rng.choice(list("bcdfgkqvxz"), 5)) for _ in range(3))
        story = wrap(pick("div", "main", "div", "section"), names, maybe(0.25, sidebar) + story + maybe(0.25, sidebar) + maybe(0.2, comments))
    extra = [f() for f, p in ((advert, 0.5), (notice, 0.3), (form, 0.15), (sidebar, 0.2)) if rng.random() < p]
    lower = [f() for f, p in ((advert, 0.3), (comments, 0.35), (sidebar, 0.35), (notice, 0.2), (form, 0.15)) if rng.random() < p]
    before = maybe(0.5, top) + maybe(0.7, menu) + "".join(rng.permutation(extra) if extra else [])
    after = "".join(rng.permutation(lower) if lower else []) + maybe(0.85, footer)
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 1, 8)}</title></head><body>{before}{story}{after}</body></html>"


def attribute_odds(trees: list[list[Block]], labels: list[np.ndarray]) -> dict[str, float]:
    """For every word in class, id and role names: the log odds ratio that a block so named belongs to the article, of words seen WORD_SEEN times or more."""
    yes, no = Counter(), Counter()
    for blocks, y in zip(trees, labels, strict=True):
        for b, positive in zip(blocks, y.tolist(), strict=True):
            (yes if positive else no).update(set(b.names))
    p, q = sum(int(y.sum()) for y in labels) + 1.0, sum(int((~y).sum()) for y in labels) + 1.0
    return {w: float(np.log((yes[w] + 0.5) / p) - np.log((no[w] + 0.5) / q)) for w in sorted({*yes, *no}) if yes[w] + no[w] >= WORD_SEEN}


@dataclass
class Model:
    """What was learned: the odds of attribute words, and the trees over block features that use them."""

    odds: dict[str, float]
    trees: Trees


@lru_cache(maxsize=1)
def model() -> Model:
    """Fitted on TRAINING_PAGES composed pages; the same on every run. The trees see odds that the other half of the pages gave."""
    rng = np.random.default_rng(SEED)
    pages = [parse(training_page(rng)) for _ in range(TRAINING_PAGES)]
    labels = []
    for blocks in pages:
        y = np.array([any(_MARK in x for x in b.items if isinstance(x, str)) for b in blocks])
        for i in range(len(y) - 1, 0, -1):
            if y[i]:
                y[blocks[i].parent] = True
        labels.append(y)
    halves = [attribute_odds(pages[k::2], labels[k::2]) for k in range(2)]
    x = np.concatenate([node_features(blocks, halves[1 - k % 2])[0] for k, blocks in enumerate(pages)])
    weight = np.concatenate([np.full(len(y), 6 / np.sqrt(len(y))) for y in labels])
    return Model(attribute_odds(pages, labels), boost(x, np.concatenate(labels).astype(float), weight))


def decode(log_odds: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The labels of highest total log probability with no positive block in a negative one. Blocks come after their parents."""
    yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    best_yes, best_no = yes.copy(), no.copy()
    for i in range(len(parent) - 1, 0, -1):
        best_yes[parent[i]] += max(best_yes[i], best_no[i])
        best_no[parent[i]] += best_no[i]
    label = np.zeros(len(parent), bool)
    label[0] = best_yes[0] > best_no[0]
    for i in range(1, len(parent)):
        label[i] = label[parent[i]] and best_yes[i] > best_no[i]
    return label


def texts(pages: list[str], fitted: Model) -> list[str]:
    """The main text of every page."""
    out = []
    for a in range(0, len(pages), STEP):
        read = [node_features(parse(p), fitted.odds) for p in pages[a : a + STEP]]
        odds = fitted.trees.log_odds(np.concatenate([x for x, _, _ in read]))
        at = 0
        for x, own, parent in read:
            label = decode(odds[at : at + len(x)], parent)
            at += len(x)
            out.append(" ".join(t for t, y in zip(own, label, strict=True) if y and t))
    return out


def extract(pages: DataFrame, fitted: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null or empty html has empty text; so has a page without an article.
    Repeated rows repeat; text outside of tags counts as a block. Long pages
    are read whole, in time that grows with their length; blocks that the model
    finds as likely article as not are left out. No rows, no rows; other
    columns don't matter.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fitted or model())
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches):
        for b in batches:
            found = texts([h or "" for h in b.column(2).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(freed(run), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
