"""Byte-level BPE by a tokenization automaton.

The automaton's states are the last tokens read, its arcs the tokens that may follow. It is compiled from the merge
list by one gadget a merge, in the order of the merges: the gadget of (u, v) -> uv adds the arc uv wherever the path u, v
exists, and then splits the state reached by u, so that v no longer follows there. A token made of (x, y) enters the
state that y had when the merge was made. Arcs never need to be stored one by one: ``_arc_at`` derives from the gadgets'
times whether p may be followed by t.

Every prefix of a pre-split word is spelled by exactly one path, so the automaton over tokens becomes a deterministic one
over bytes. A state of that one is the set of arcs that may be under way: pairs of a node in the tree of labels and the
token before it. A step over a byte moves all of them at once and marks the one arc that ends there: the last token of
the prefix read so far. Its table of state x byte is filled as steps are first taken. Encoding a word is one step a byte,
never going back; the marks, read from the word's end by the lengths of their tokens, are the path. Decoding emits the
labels of the arcs.

Defined results: a null or empty text has no tokens and decodes to the empty text; a special token's string in a text is
that token; repeated rows and null ids are encoded like any other; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import pickle
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate, chain
from operator import getitem

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattica.llm import shared

#: The pattern that pre-splits text for byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the tables of words, of arcs and of states at which they start anew.
MAX_WORDS = 120_000
MAX_ARCS = 250_000
MAX_STATES = 100_000
#: Bytes of text that are encoded before their results go on.
MOST = 2 << 20


#: Code points (hex, or ranges) that the regex module takes as letters or numbers of a later Unicode, while
#: the vocabulary's own library does not know them and takes them as symbols.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F "
    "12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
_LATER_FROM = "\u0530"


@lru_cache(maxsize=1)
def _careful() -> regex.Pattern:
    """PATTERN without the later letters and numbers."""
    later = "".join("-".join(f"\\U{int(x, 16):08X}" for x in span.split("-")) for span in LATER.split())
    letter, number = rf"[\p{{L}}--[{later}]]", rf"[\p{{N}}--[{later}]]"
    other = rf"[[^\s\p{{L}}\p{{N}}]||[{later}]]"
    return regex.compile(
        PATTERN.replace(r"[^\s\p{L}\p{N}]", "OTHER").replace(r"\p{L}", letter).replace(r"\p{N}", number).replace("OTHER", other),
        flags=regex.V1,
    )


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Words(dict):
    """Pre-split text -> its tokens, filled as it is asked; what was asked before the last time that it was full stays
    at hand in a second table."""

    def __init__(self, make):
        super().__init__()
        self._make, self._old = make, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        tokens = self._old.get(piece)
        if tokens is None:
            tokens = tuple(self._make(piece))
            if len(piece) >= 64:
                return tokens
        if len(self) >= MAX_WORDS:
            self._old = dict(self)
            self.clear()
        self[piece] = tokens
        return tokens


class _State(dict):
    """A state of the byte automaton: its row of the table (byte -> next state), the arcs under way and the mark."""

    __slots__ = ("go", "mark", "step")

    def __init__(self, go: tuple[tuple[int, int], ...], step):
        super().__init__()
        self.go, self.mark, self.step = go, go[-1][1], step

    def __missing__(self, byte: int) -> _State:
        found = self[byte] = self.step(self.go, byte)
        return found


class Automaton:
    """Compiled from labels (bytes of each token id), merges (pairs of ids and the id they make, in order) and special
    tokens (string -> id)."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels, self.merges, self.special = labels, merges, special
        self._compile()

    def __getstate__(self):
        return self.labels, self.merges, self.special

    def __setstate__(self, state):
        self.labels, self.merges, self.special = state
        self._compile()

    @classmethod
    def from_json(cls, text: str) -> Automaton:
        """From the text of a tokenizers file with a byte-level BPE model."""
        spec = json.loads(text)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        labels = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        return cls(
            labels | {i: s.encode() for s, i in special.items()}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special
        )

    def _compile(self) -> None:
        count = max(self.labels, default=0) + 1
        if count > 1 << 20:
            raise ValueError("ids must lie below 2^20: the keys of pairs hold twenty bits of each")
        self._split: dict[int, int] = {}  # u << 20 | v -> time at which the state after u lost the arc v
        # token -> time of the gadget that made it (-1: a byte, -2: no gadget), and its parts
        self._made = [-1 if len(self.labels.get(i, b"")) == 1 else -2 for i in range(count)]
        self._left, self._right = [-1] * count, [-1] * count
        self._arcs: dict[int, bool] = {}  # the transition table, as far as it was asked for
        for time, (u, v, made) in enumerate(self.merges):
            if self._made[made] >= 0 or self._made[u] < -1 or not self._arc_at(u, v, time):
                continue  # no path u, v is left for this gadget
            self._made[made], self._left[made], self._right[made] = time, u, v
            self._split[u << 20 | v] = time
        reached = {i for i in self.labels if self._made[i] >= 0 or len(self.labels[i]) == 1}
        self._token = {self.labels[i]: i for i in reached}
        self._size = {i: len(x) for i, x in self.labels.items()}
        self._tree: dict[int, tuple[int, int | None]] = {}  # node << 8 | byte -> node and token, of the tree of labels
        inner = set()
        for label, i in self._token.items():
            node, key = 0, 0
            for byte in label:
                key = node << 8 | byte
                inner.add(node)
                node = self._tree.setdefault(key, (len(self._tree) + 1, None))[0]
            self._tree[key] = (node, i)
        self._inner = inner  # nodes with something below them
        self._states: dict[tuple, _State] = {}
        self._restart()
        self._text = {i: str(i) for i in self.labels}
        self._pre = regex.compile(PATTERN)
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._crowded = re.compile(r"\s\s")
        self._words = _Words(lambda word: self.encode_word(word.encode()))
        self._first = _Words(self._pieces)
        self._next = _Words(self._spaced)

    def _arc_at(self, p: int, t: int, before: int) -> bool:
        """Whether the state after p had the arc t before a time: each gadget on the way to t found its left part, and no
        split had taken it, neither one of p's own nor one that p got from its right part until p was made."""
        split, made, left, right = self._split, self._made, self._left, self._right
        while True:
            state, until = p, before
            while True:
                lost = split.get(state << 20 | t)
                if lost is not None and lost < until:
                    return False
                time = made[state]
                if time < 0:
                    break
                if time < until:
                    until = time
                state = right[state]
            time = made[t]
            if time < 0:
                return time == -1
            before, t = time + 1, left[t]

    def _restart(self) -> None:
        """The byte automaton with its first state only: the root of the tree, with no token before it."""
        for state in self._states.values():
            state.clear()
        start = ((0, -1),)
        self._start = _State(start, self._step)
        self._states = {start: self._start}

    def arc(self, p: int, t: int) -> bool:
        """Whether t may follow p (-1: the word's beginning)."""
        if p < 0:
            return True
        known = self._arcs.get(p << 20 | t)
        if known is None:
            if len(self._arcs) >= MAX_ARCS:
                self._arcs.clear()
            known = self._arcs[p << 20 | t] = self._arc_at(p, t, len(self.merges))
        return known

    def _step(self, go: tuple[tuple[int, int], ...], byte: int) -> _State:
        """The next state: all arcs under way read the byte; the one that ends is the mark, and the next arc begins
        after it."""
        under_way, mark = [], -1
        tree, inner = self._tree, self._inner
        for node, before in go:
            found = tree.get(node << 8 | byte)
            if found is None:
                continue
            child, token = found
            if token is not None and mark < 0 and self.arc(before, token):
                mark = token
            if child in inner:
                under_way.append((child, before))
        if mark < 0:
            raise ValueError(f"no path spells a word with the byte {byte:#x}")
        under_way.append((0, mark))
        key = tuple(under_way)
        state = self._states.get(key)
        if state is None:
            if len(self._states) >= MAX_STATES:
                self._restart()
            state = self._states[key] = _State(key, self._step)
        return state

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The tokens of one pre-split word: a step for each byte, then the marks from the end."""
        whole = self._token.get(word)
        if whole is not None:
            return (whole,)
        states = list(accumulate(word, getitem, initial=self._start))
        at, path, size = len(word), [], self._size
        while at:
            token = states[at].mark
            path.append(token)
            at -= size[token]
        return tuple(reversed(path))

    def _pieces(self, text: str) -> Iterable[int]:
        pre = self._pre if max(text) < _LATER_FROM else _careful()
        return chain.from_iterable(map(self._words.__getitem__, pre.findall(text)))

    def _spaced(self, piece: str) -> Iterable[int]:
        """The tokens of a space and a piece without spaces; most are a word, or a word and a sign."""
        if piece.isalpha():
            return self.encode_word((" " + piece).encode())
        if piece[-1:] in ".,;:!?" and piece[:-1].isalpha():
            return self._next[piece[:-1]] + self._words[piece[-1]]
        return self._pieces(" " + piece)

    def _plain(self, text: str) -> Iterable[int]:
        if not text:
            return ()
        if self._crowded.search(text):  # white space beside white space: words are not simply parted by spaces
            pre = self._pre if max(text) < _LATER_FROM else _careful()
            return chain.from_iterable(map(self._first.__getitem__, pre.findall(text)))
        first, *rest = text.split(" ")
        return chain(self._first[first] if first else (), chain.from_iterable(map(self._next.__getitem__, rest)))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self._special is None or not self._special.search(text):
            return list(self._plain(text))
        out: list[int] = []
        at = 0
        for m in self._special.finditer(text):
            out.extend(self._plain(text[at : m.start()]))
            out.append(self.special[m[0]])
            at = m.end()
        out.extend(self._plain(text[at:]))
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The labels of the arcs; ids that no arc has emit nothing."""
        try:
            return b"".join(map(self.labels.__getitem__, ids))
        except KeyError:
            return b"".join(self.labels.get(i, b"") for i in ids)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def written(self, ids: Iterable[int]) -> str:
        """The decimal ids, joined by commas."""
        return ",".join(map(self._text.__getitem__, ids))


def load(path: str) -> Automaton:
    with open(path, encoding="utf-8") as file:
        return Automaton.from_json(file.read())


#: The one automaton of this worker process, by the hash of what it was made from. It outlives the tasks and queries that
#: use it, with its tables, which are bounded; another vocabulary takes its place, and other work in the process ends it.
_kept: dict[bytes, Automaton] = {}


def _drop() -> None:
    _kept.clear()
    gc.collect()  # an automaton and its states refer to each other


def kept(key: bytes, pickled: bytes) -> Automaton:
    """The automaton of this process, made if it is another one."""
    shared.keeps("bpe", _drop)
    if key not in _kept:
        _drop()
        _kept[key] = pickle.loads(pickled)
    return _kept[key]


def _rows(docs: DataFrame, automaton: Automaton, ddl: str, row, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    pickled = pickle.dumps(automaton)
    # as large as the vocabulary, whatever the input
    sent = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(pickled).digest(), pickled))

    def rows(values):
        machine = kept(*sent.value)
        gc.disable()  # what encoding makes has no cycles
        try:
            return [row(machine, *v) for v in zip(*values, strict=True)]
        finally:
            gc.enable()

    return shared.rows_by_batch(docs, list(columns), T.StructType.fromDDL(ddl), rows, most=MOST, owner="bpe")


def encode_documents(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """doc_id, ids."""
    return _rows(
        docs, automaton, "doc_id bigint, ids array<int>", lambda m, i, text: (i, m.encode((text or b"").decode()))
    )


def decode_documents(encoded: DataFrame, automaton: Automaton) -> DataFrame:
    """doc_id, text of a table of doc_id, ids (null ids: the empty text)."""
    return _rows(encoded, automaton, "doc_id bigint, text string", lambda m, i, ids: (i, m.decode(ids or ())), ("doc_id", "ids"))


def digests(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def row(machine, doc_id, text):
        ids = machine.encode((text or b"").decode())
        return (
            doc_id,
            len(ids),
            hashlib.sha256(machine.written(ids).encode()).hexdigest(),
            hashlib.sha256(machine.decode(ids).encode()).hexdigest(),
        )

    return _rows(docs, automaton, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)
