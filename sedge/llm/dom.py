"""HTML as a tree of blocks: a tolerant reader with the usual implied end tags, and features of every block.

Inline markup belongs to the text around it. A block that holds text beside
other blocks gets a child of its own for each run of such text ('#text').
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np

#: Where something may begin: a comment, a declaration, a tag.
OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: Elements whose content is no page text, with what ends them.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template svg iframe textarea select title math object video audio canvas".split()}
QUOTES = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
LETTERS = re.compile("[a-z]+")
#: Fixed values of HTML: elements without content, and elements that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body article main section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend button blockquote pre figure figcaption address details summary hr dialog menu center".split())
#: A start tag of the first closes an open one of the second, up to the nearest of the third.
P_CLOSERS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
TAGS = ["html", "body", "article", "main", "section", "nav", "aside", "header", "footer", "div", "p", "h", "list", "li", "table", "cell", "form", "button", "quote", "figure", "#text", "other"]
_TAG = {**{t: t for t in TAGS}, **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "h"), **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"), "dt": "li", "dd": "li", **dict.fromkeys(("td", "th", "caption"), "cell"), **dict.fromkeys(("thead", "tbody", "tfoot", "tr"), "table"), "fieldset": "form", "legend": "form", "blockquote": "quote", "pre": "quote", "figcaption": "figure"}
TAG_NUMBER = {k: TAGS.index(v) for k, v in _TAG.items()}
class Block:
    __slots__ = ("children", "depth", "items", "links", "names", "parent", "tag")

    def __init__(self, tag: str, parent: int, depth: int, names: tuple[str, ...]):
        self.tag, self.parent, self.depth, self.names = tag, parent, depth, names
        self.items: list = []  # text, or the number of a child block
        self.links = 0
        self.children: list[int] = []


def _names(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role."""
    return tuple(w for _, value in ATTRIBUTE.findall(attributes) for w in LETTERS.findall(value.lower())) if "=" in attributes else ()


def tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of quotes and '>', and for each where a tag that is outside of quotes there ends (-1: a quote is never closed). From the end, so once for the page."""
    at = [m.start() for m in QUOTES.finditer(page)]
    ends = [-1] * (len(at) + 2)
    later = {'"': len(at), "'": len(at)}  # the next quote of either kind
    for k in range(len(at) - 1, -1, -1):
        c = page[at[k]]
        if c == ">":
            ends[k] = at[k]
        else:
            ends[k] = ends[later[c] + 1] if later[c] < len(at) else -1
            later[c] = k
    return at, ends


def _tokens(page: str):
    """(text before, slash, name, attributes) of every tag in order; comments and elements without page text have no name. The last has the text that is left."""
    at, ends = tag_ends(page)
    last = page.rfind(">")
    done = place = 0
    while True:
        m = OPEN.search(page, place)
        if m is None or (m.start() > last and not m[1]):
            yield page[done:], "", "", ""
            return
        if m[1]:
            close = page.find("-->", m.end())
            yield page[done : m.start()], "", "", ""
            done = place = len(page) if close < 0 else close + 3
            continue
        first = page.find(">", m.end())
        if first < 0:  # the name holds the last '>' of none: no tag
            place = m.end()
            continue
        if m[2]:
            yield page[done : m.start()], "", "", ""
            done = place = first + 1
            continue
        name = m[4].lower()
        if not m[3] and name in RAW:
            close = RAW[name].search(page, first + 1)
            yield page[done : m.start()], "", "", ""
            done = place = len(page) if close is None else close.end()
            continue
        end = ends[bisect_left(at, m.end())]
        if end < 0:
            end = first
        yield page[done : m.start()], m[3], name, page[m.end() : end]
        done = place = end + 1


def parse(page: str) -> list[Block]:
    """The blocks of a page in document order; the first is the page itself."""
    blocks = [Block("html", -1, 0, ())]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the block each belongs to
    block_at = [0]  # where in the stack blocks are, all and by name, and the open inline elements above each
    where: dict[str, list[int]] = defaultdict(list)
    inline: list[Counter[str]] = [Counter()]
    link = 0

    def close(i: int) -> None:
        for name, _ in reversed(stack[i:]):
            if name in BLOCKS:
                where[name].pop()
                block_at.pop()
                inline.pop()
            else:
                inline[-1][name] -= 1
        del stack[i:]

    for text, slash, name, attributes in _tokens(page):
        if text:
            b = blocks[stack[-1][1]]
            t = html.unescape(text)
            b.items.append(t)
            if link:
                b.links += len(t.strip())
        if not name:
            continue
        if slash:
            if name == "a":
                link = max(0, link - 1)
            if where[name] if name in BLOCKS else inline[-1][name]:  # an inline end tag doesn't close blocks
                i = len(stack) - 1
                while stack[i][0] != name:  # what is passed is closed
                    i -= 1
                close(i)
            continue
        if name == "br":
            blocks[stack[-1][1]].items.append(" ")
            continue
        if name in P_CLOSERS and stack[block_at[-1]][0] == "p":
            close(block_at[-1])
        if name in IMPLIED:
            ended, scope = IMPLIED[name]
            floor = max((where[e][-1] for e in scope if where[e]), default=0)
            cut = min((where[e][bisect_right(where[e], floor)] for e in ended if where[e] and where[e][-1] > floor), default=0)
            if cut:
                close(cut)
        if name in VOID:
            if name == "hr":
                blocks[stack[-1][1]].items.append(" ")
            continue
        if name in ("html", "body", "head"):
            blocks[0].names += _names(attributes)
            continue
        if name in BLOCKS:
            parent = stack[-1][1]
            link = 0
            blocks.append(Block(name, parent, blocks[parent].depth + 1, _names(attributes)))
            blocks[parent].items.append(len(blocks) - 1)
            where[name].append(len(stack))
            block_at.append(len(stack))
            inline.append(Counter())
            stack.append((name, len(blocks) - 1))
        else:
            if name == "a":
                link += 1
            inline[-1][name] += 1
            stack.append((name, stack[-1][1]))
        if len(stack) > 400:  # nesting beyond this shares a block; its end tags find their own starts
            stack[-1] = (name, stack[399][1])
    return _with_text_blocks(blocks)


def _with_text_blocks(blocks: list[Block]) -> list[Block]:
    """Gives runs of text beside blocks a block of their own and puts all in document order."""
    out: list[Block] = []
    todo: list[tuple[object, int]] = [(0, -1)]
    while todo:
        what, parent = todo.pop()
        if isinstance(what, int):
            old = blocks[what]
            b = Block(old.tag, parent, out[parent].depth + 1 if parent >= 0 else 0, old.names)
            me = len(out)
            out.append(b)
            if parent >= 0:
                out[parent].children.append(me)
            if any(isinstance(x, int) for x in old.items):
                runs: list = []
                for x in old.items:
                    if isinstance(x, str) and runs and isinstance(runs[-1], str):
                        runs[-1] += x
                    else:
                        runs.append(x)
                todo += [(x, me) for x in reversed(runs) if isinstance(x, int) or x.strip()]
            else:
                b.items, b.links = ["".join(old.items)] if old.items else [], old.links
        else:
            b = Block("#text", parent, out[parent].depth + 1, ())
            b.items = [what]
            out[parent].children.append(len(out))
            out.append(b)
    return out


NAMES = [*(f"tag_{t}" for t in TAGS), *(f"in_{t}" for t in TAGS), *(f"{where}_{what}" for where in ("name", "above") for what in ("low", "high", "sum", "known")), "depth", "chars", "share", "before", "links", "density", "marks", "blocks", "paragraphs", "lists", "place", "siblings", "sibling_chars", "left_tag", "right_tag", "inner_article"]


def _said(odds: list[float]) -> tuple[float, float, float, float]:
    """Least, greatest, sum and number of the odds of an element's attribute words; 0 is unknown."""
    return (min(min(odds), 0.0), max(max(odds), 0.0), sum(odds), float(len(odds))) if odds else (0.0, 0.0, 0.0, 0.0)


def node_features(blocks: list[Block], odds: dict[str, float]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Features of every block, its own text (white space folded, trimmed), and its parent. odds: what was learned of attribute words, a log odds ratio of article text."""
    n = len(blocks)
    parent = np.array([b.parent for b in blocks])
    own = [" ".join(b.items[0].split()) if b.items else "" for b in blocks]
    tag = [TAG_NUMBER.get(b.tag, len(TAGS) - 1) for b in blocks]
    chars = np.array([len(t) for t in own], float)
    links = np.array([min(b.links, len(t)) for b, t in zip(blocks, own, strict=True)], float)
    marks = np.array([t.count(".") + t.count(",") for t in own], float)
    before = np.concatenate([[0], np.cumsum(chars)[:-1]])
    total, below_links, below_marks, count = chars.copy(), links.copy(), marks.copy(), np.ones(n)
    para, lists = np.array([b.tag == "p" for b in blocks], float), np.array([b.tag == "li" for b in blocks], float)
    article = np.array([b.tag in ("article", "main") for b in blocks], float)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        below_links[p] += below_links[i]
        below_marks[p] += below_marks[i]
        count[p] += count[i]
        para[p] += para[i]
        lists[p] += lists[i]
        article[p] += article[i]
    inside = [0] * n
    own_names = [_said([odds[w] for w in b.names if w in odds]) for b in blocks]
    above = [(0.0, 0.0, 0.0, 0.0)] * n
    x = np.zeros((n, len(NAMES)), np.float32)
    t = len(TAGS)
    for i, b in enumerate(blocks):
        if i:
            inside[i] = inside[parent[i]] | 1 << tag[parent[i]]
            low, high, total_odds, known = above[parent[i]]
            p_low, p_high, p_sum, p_known = own_names[parent[i]]
            above[i] = (min(low, p_low), max(high, p_high), total_odds + p_sum, known + p_known)
        x[i, tag[i]] = 1
        bits = inside[i]
        while bits:
            least = bits & -bits
            x[i, t + least.bit_length() - 1] = 1
            bits ^= least
        kids = b.children
        for k, c in enumerate(kids):
            x[c, -6:-1] = (k / len(kids), len(kids), 0, tag[kids[k - 1]] if k else -1, tag[kids[k + 1]] if k + 1 < len(kids) else -1)
            x[c, -4] = (total[i] - total[c]) / max(total[i], 1)
    whole = max(total[0], 1)
    x[:, 2 * t : 2 * t + 4] = own_names
    x[:, 2 * t + 4 : 2 * t + 8] = above
    f = 2 * t + 8
    x[:, f : f + 10] = np.column_stack([[b.depth for b in blocks], np.log1p(total), total / whole, before / whole, below_links / np.maximum(total, 1), total / count, below_marks / np.maximum(total, 1), np.log1p(count), para, lists])
    x[:, -1] = article
    return x, own, parent
