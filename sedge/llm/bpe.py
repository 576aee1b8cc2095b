"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled one after the other by merge gadgets. The automaton
starts with one state that reads every base symbol. The gadget of a merge
(u, v) -> w lets every state that reads u read w too, on to where v led from
there, and takes v away from the state behind u. All arcs of one label then
lead to one state, so a state is named by the label that leads to it, and what
it reads is inherited: the state behind w starts as a copy of the one behind v
(before the gadget), and the arc w starts as a copy of the arc u (after it).
The copies are kept as parents with their time instead of as 49k x 49k rows;
`arc` follows them and remembers the answer.

Labels are several bytes long, so over bytes that automaton is made
deterministic: a state is the set of (label that was read last, how far into the
next label), built when it is first met and kept in a transition table of (state,
byte). Every prefix of a word has one tokenization, so a transition completes at
most one label. A word is one walk through the table; the labels of its one
path are read off from its end.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from sedge.llm.common import _CACHES, freed

#: Words that the automaton's and the library's codec remember before the older half goes; bounds memory (about 500 bytes a word), never changes results.
CODEC_WORDS, LIBRARY_WORDS = 150_000, 150_000
#: Transitions that the table holds before it is begun anew (about 300 bytes each); likewise.
TABLE_STEPS = 400_000
#: The part of an entry of a state that is the trie node.
NODES = (1 << 24) - 1
#: Marks the end of a word; no UTF-8 text holds this byte.
END = b"\xff"


#: The tokenizer's own pattern, and the same split for texts up to U+017F without odd white space, where Python's tables surely agree with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t\n\r\x0b\x0c{_LETTERS}{_NUMBERS}]+")
SURE = re.compile("[\t\n\x0b\x0c\r -~\xa1-\u012f\u0131-\u017f]*")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return out


class Automaton:
    """Merges as a deterministic automaton over token labels."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "</w>"):
        letters = byte_letters()

        def raw(token: str) -> bytes:
            end = token.endswith(suffix) and token != suffix
            return bytes(letters[c] for c in (token[: -len(suffix)] if end else token)) + (END if end else b"")

        size = max(vocab.values()) + 1
        self.born = [-1] * size  # time of the gadget that made the label
        self.left, self.right = [-1] * size, [-1] * size
        self.taken: dict[int, int] = {}  # (u, v) -> time at which u's state lost its arc v
        self.size = size
        for t, pair in enumerate(merges):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            self._gadget(t, vocab[a], vocab[b], vocab[a + b])
        self.table: dict[int, bool] = {}
        # the trie of labels: (node, byte) -> node, the label that ends in a node, and whether it goes on
        self.go: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [False]
        self.lengths = [0] * size
        unused = next(c for c, b in letters.items() if b == END[0])
        for text, i in sorted((raw(k), i) for k, i in vocab.items() if unused not in k and all(c in letters for c in k.removesuffix(suffix))):
            node = 0
            for byte in text:
                key = node << 8 | byte
                if key not in self.go:
                    self.inner[node] = True
                    self.go[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = self.go[key]
            self.lengths[i] = len(text)
            if self._made(i):
                self.ends[node] = i
        self.shift = size.bit_length() + 1
        self._forget()

    def _forget(self) -> None:
        """Empties the table of the deterministic automaton: state 0 has read nothing.

        A state is a tuple of label << 24 | trie node; `size` stands for the beginning of a word.
        """
        self.states: list[tuple[int, ...]] = [(self.size << 24,)]
        self.number = {self.states[0]: 0}
        self.steps: dict[int, int] = {}

    def _gadget(self, t: int, u: int, v: int, w: int) -> None:
        self.taken.setdefault(u * self.size + v, t)
        if self.born[w] < 0 and self.left[w] < 0:
            self.born[w], self.left[w], self.right[w] = t, u, v

    def arc(self, x: int, y: int) -> bool:
        """Whether the state behind label x reads label y."""
        key = x * self.size + y
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 300_000:
                self.table.clear()
            known = self.table[key] = self._inherited(x, y)
        return known

    def _made(self, w: int) -> bool:
        """Whether the gadget of w found an arc to take: else no text is ever tokenized with w."""
        return self.born[w] < 0 or self._inherited(self.left[w], self.right[w], self.born[w])

    def _inherited(self, x: int, y: int, limit: int = 1 << 60) -> bool:
        """Whether x's state reads y once the gadgets before time `limit` are done."""
        taken, born, size = self.taken, self.born, self.size
        while True:
            lost = taken.get(x * size + y)
            if lost is not None and lost < limit:
                return False
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            if by >= bx and not (by == bx and limit == by + 1):
                limit, y = by + 1, self.left[y]
            else:
                limit, x = bx, self.right[x]

    def _step(self, state: int, byte: int) -> int:
        """Makes the transition of (state, byte): the state that follows, and one more than the label that is complete there."""
        go, ends, inner, table, size = self.go, self.ends, self.inner, self.table, self.size
        after, label = [], -1
        for at in self.states[state]:
            node = go.get((at & NODES) << 8 | byte, -1)
            if node < 0:
                continue
            last = at >> 24
            y = ends[node]
            if y >= 0:
                known = True if last == size else table.get(last * size + y)
                if self.arc(last, y) if known is None else known:
                    label = y
            if inner[node]:
                after.append(last << 24 | node)
        if label >= 0:
            after.append(label << 24)
        follows = tuple(after)
        to = self.number.get(follows)
        if to is None:
            to = self.number[follows] = len(self.states)
            self.states.append(follows)
        step = self.steps[state << 8 | byte] = to << self.shift | label + 1
        return step

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one path for a pre-split word."""
        if len(self.steps) > TABLE_STEPS:
            self._forget()
        known, shift, mask = self.steps.get, self.shift, (1 << self.shift) - 1
        state, complete = 0, [0]
        done = complete.append
        for byte in word + END:
            step = known(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
            state = step >> shift
            done(step & mask)
        path, at = [], len(word) + 1
        while at:
            label = complete[at] - 1
            if label < 0:
                raise ValueError(f"no path for {word!r}")
            path.append(label)
            at -= self.lengths[label]
        path.reverse()
        return path


class Codec:
    """Whole texts to ids and back, with the automaton of a tokenizer file."""

    remember = CODEC_WORDS

    def __init__(self, path: str, compiled: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], model["merges"], model["end_of_word_suffix"] or "") if compiled else None
        self.split_by = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.any_special = re.compile("|".join(map(re.escape, sorted(self.special))) or "(?!)")
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for k, i in (*model["vocab"].items(), *self.special.items()):
            self.labels[i] = k.encode()
        self.letters = {ord(c): b for c, b in byte_letters().items()}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.own_split = spec["normalizer"]["normalizers"][-1]["type"] == "Lowercase" and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == PATTERN

    def new_words(self, words: list[str]) -> None:
        """Encodes words not seen before, each by the automaton."""
        encode = self.automaton.encode
        for w in words:
            self.words[w] = np.array(encode(w.encode()), "<u4").tobytes()

    def join(self, words: list[str]) -> bytes:
        """Ids of pre-split words, remembered."""
        known = self.words
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > self.remember:
                self.older, self.words = known, {}
                known, new = self.words, set(words)
            older = self.older
            again = {w for w in new if w in older}
            for w in again:
                known[w] = older[w]
            self.new_words(sorted(new - again))
        return b"".join(map(known.__getitem__, words))

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens that the library normalises and splits."""
        own, letters = self.split_by, self.letters
        split = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))
        return self.join([bytes(letters[ord(c)] for c in w).decode() for w, _ in split])

    def other(self, text: str) -> bytes:
        """Ids of a text with characters or special tokens that the fast split leaves out."""
        out, at = [], 0
        for m in self.any_special.finditer(text):
            out += [self.plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def ids(self, text: bytes) -> bytes:
        """Ids of a whole UTF-8 text as little-endian 32-bit integers."""
        t = text.decode()
        if self.own_split and "<|" not in t and SURE.fullmatch(t):
            return self.join(SPLIT.findall(t.lower()))
        return self.other(t)

    def decode(self, ids: bytes) -> bytes:
        """The labels of the path, joined as a tokenizer without a decoder joins them."""
        return b" ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Library(Codec):
    """The same ids, with the tokenizers library's BPE in place of the automaton for words not seen before."""

    remember = LIBRARY_WORDS

    def __init__(self, path: str):
        super().__init__(path, compiled=False)
        self.shown = {b: c for c, b in byte_letters().items()}

    def new_words(self, words: list[str]) -> None:
        """Encodes words not seen before, each by the library's model on its byte letters."""
        tokenize, shown = self.split_by.model.tokenize, self.shown
        for w in words:
            letters = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(shown)
            self.words[w] = np.array([t.id for t in tokenize(letters)], "<u4").tobytes()


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One codec a worker: compiled once, kept with its words and table while the worker lives."""
    return Codec(path)


@lru_cache(maxsize=1)
def library(path: str) -> Library:
    """Kept with its words until a task of an operator that gives memory back ends in this worker."""
    return Library(path)


_CACHES.append(library.cache_clear)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def utf8(column: pa.Array) -> list[bytes]:
    """Rows as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array<long>) of every whole text; null or empty text has no ids. Repeated rows repeat."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for b in batches:
            ids = [np.frombuffer(c.ids(t), "<u4").astype(np.int64) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], [id_column, "ids"])

    return docs.select(id_column, text_column).mapInArrow(freed(run), f"`{id_column}` {id_type}, ids array<long>")


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """doc_id and text of the ids; null ids decode to the empty text."""
    id_type = encoded.schema[id_column].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [c.decode(np.array(x or [], "<u4").tobytes()).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    return encoded.select(id_column, "ids").mapInArrow(freed(run), f"`{id_column}` {id_type}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every whole text and returns counts and digests.

    doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (decoded text in UTF-8). Null text is empty:
    0 tokens and the digests of nothing. Long texts are encoded whole.
    Repeated rows and doc_ids repeat; no rows, no rows; other columns don't
    matter.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for b in batches:
            n, a, d = [], [], []
            for text in utf8(b.column(1)):
                ids = c.ids(text)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
