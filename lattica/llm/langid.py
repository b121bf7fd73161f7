"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built and flattened into one transition table over letter
classes; the most frequent DENSE letters have columns there, all other letters that were learned have their transitions
in one sorted list. A text is parsed against each language into longest matches: the parse follows the automaton, and where it
cannot go on, a phrase ends and the next begins at that letter. The language that needs the fewest phrases, normalised
by the bits of a pointer into its text, wins. Texts are parsed in lanes of SEGMENT letters, all lanes and languages of a
batch in step; a lane's end ends a phrase, for every language alike.

The automata are built on a bounded sample of the labelled rows: of each language at most BUCKETS documents, that with
the smallest hash of doc_id in each bucket. Each of them has an equal share of CHARS letters; a longer one gives runs of
RUN letters, evenly spread from its beginning to its end, so no single document makes up a model.

Defined results: null texts and texts without a letter are `und` with score 0; so is every text where nothing could be
learned; ties go to the first language by name; repeated rows and null ids are judged like any other (a null doc_id is
neither learned from nor held out); an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import shared

BUCKETS = 64
CHARS = 30_000
RUN = 117
DENSE = 63
SEGMENT = 2048
#: How fast the score falls with the normalised phrases that the next languages need more.
SHARPNESS = 0.02
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of the automaton of all substrings of codes; state 0 is the start."""
    to: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return to


@dataclass(frozen=True)
class Model:
    """table[state * width + class] = next state * 2 + 1 if a phrase ended, for classes below width; rare[i] = state *
    (number of other classes) + class - width, sorted, leads to state target[i]; start: each language's first state."""

    languages: tuple[str, ...]
    start: np.ndarray
    bits: np.ndarray
    table: np.ndarray
    width: int
    letters: str
    rare: np.ndarray
    target: np.ndarray

    @cached_property
    def _class(self) -> np.ndarray:
        to = np.zeros(max(map(ord, self.letters), default=0) + 2, dtype=np.int32)
        to[[ord(c) for c in self.letters]] = np.arange(1, len(self.letters) + 1)
        return to

    def classes(self, text: str) -> np.ndarray:
        """The class of each letter (0: any other character)."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return self._class[np.minimum(codes, len(self._class) - 1)]

    def _rarely(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the table would hold for states (languages x lanes) and the lanes' classes from width on."""
        others = max(1, len(self.letters) + 1 - self.width)

        def reached(at):
            key = at.astype(np.int64) * others + (codes - self.width)
            i = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            return self.rare[i] == key, self.target[i]

        if not len(self.rare):
            return np.broadcast_to(self.start[:, None] * 2 + 1, state.shape)
        on, there = reached(state)
        begun, first = reached(np.broadcast_to(self.start[:, None], state.shape))
        return np.where(on, there * 2, np.where(begun, first, self.start[:, None]) * 2 + 1)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Normalised phrases per text and language."""
        coded = [self.classes(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [-(-len(c) // SEGMENT) for c in coded])
        parts = [c[at : at + SEGMENT] for c in coded for at in range(0, len(c), SEGMENT)]
        total = np.zeros((len(texts), len(self.languages)))
        wide = 1 << 14  # lanes at a time
        order = np.argsort([-len(p) for p in parts], kind="stable")
        for at in range(0, len(parts), wide):
            lanes = order[at : at + wide]
            size = np.array([len(parts[k]) for k in lanes])
            grid = np.zeros((size[0], len(lanes)), dtype=np.int32)
            for j, k in enumerate(lanes):
                grid[: size[j], j] = parts[k]
            state = np.repeat(self.start[:, None], len(lanes), axis=1)
            ended = np.ones(state.shape, dtype=np.int32)
            alive = np.searchsorted(-size, -np.arange(size[0]), side="left")  # lanes longer than the step
            for step in range(size[0]):
                n = alive[step]
                codes = grid[step, :n]
                got = self.table[state[:, :n] * self.width + np.minimum(codes, self.width - 1)]
                beyond = np.flatnonzero(codes >= self.width) if len(self.letters) >= self.width else ()
                if len(beyond):
                    got[:, beyond] = self._rarely(state[:, beyond], codes[beyond])
                ended[:, :n] += got & 1
                state[:, :n] = got >> 1
            np.add.at(total, owner[lanes], ended.T)
        return total * self.bits

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        usable = [k for k, t in enumerate(texts) if t and self.languages and has_letter(t)]
        out = [("und", 0.0)] * len(texts)
        if usable:
            need = self.phrases([texts[k] for k in usable])
            best = need.argmin(axis=1)
            score = 1 / np.exp(SHARPNESS * (need.min(axis=1, keepdims=True) - need)).sum(axis=1)
            for k, b, s in zip(usable, best, score, strict=True):
                out[k] = (self.languages[b], float(s))
        return out


def build(samples: dict[str, list[str]], dense: int = DENSE) -> Model:
    """The model of some texts per language."""
    languages = tuple(sorted(samples))
    text = {x: "\0".join(samples[x]).lower() for x in languages}
    seen: dict[str, int] = {}
    for x in languages:
        for c in text[x]:
            if c.isalpha():
                seen[c] = seen.get(c, 0) + 1
    alphabet = "".join(sorted(seen, key=lambda c: (-seen[c], c)))
    code = {c: k + 1 for k, c in enumerate(alphabet)}
    width = min(len(alphabet), dense) + 1
    others = max(1, len(alphabet) + 1 - width)
    tables, start, at = [], [], 0
    rare: list[tuple[int, int]] = []
    for x in languages:
        to = suffix_automaton([code.get(c, 0) for c in text[x]])
        table = np.empty((len(to), width), dtype=np.int32)
        table[:] = [(at + to[0].get(c, 0)) * 2 + 1 for c in range(width)]
        for state, row in enumerate(to):
            for c, target in row.items():
                if c < width:
                    table[state, c] = (at + target) * 2
                else:
                    rare.append(((at + state) * others + c - width, at + target))
        tables.append(table)
        start.append(at)
        at += len(to)
    bits = np.array([np.log2(max(2, len(text[x]))) for x in languages])
    whole = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.int32)
    keys, targets = np.array(sorted(rare), dtype=np.int64).reshape(-1, 2).T
    return Model(languages, np.array(start, dtype=np.int32), bits, whole, width, alphabet, keys, targets.astype(np.int32))


def share(text: F.Column, most: int, run: int = RUN) -> F.Column:
    """The text, or runs of it, evenly spread from its beginning to its end, of at most `most` letters together."""
    runs = max(2, most // run)
    gap = (F.length(text) - run) / (runs - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda k: F.substring(text, F.floor(k * gap).cast("int") + 1, F.lit(run)))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(spread, "\0"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, buckets: int = BUCKETS, chars: int = CHARS) -> Model:
    """The model of a bounded sample of the rows that are not held out."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    h = F.xxhash64("doc_id").alias("h")
    chosen = labelled.groupBy("lang", F.pmod(h, F.lit(buckets)).alias("bucket")).agg(F.min(h).alias("h")).select("lang", "h")
    sampled = (
        labelled.select("lang", h, "text")
        .join(F.broadcast(chosen), ["lang", "h"])  # at most `buckets` rows a language
        .select("lang", "h", share(F.col("text"), chars // buckets).alias("text"))
        .groupBy("lang", "h")
        .agg(F.min("text").alias("text"))
    )
    samples: dict[str, list[str]] = {}
    for r in sorted(sampled.collect(), key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return build(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    schema = T.StructType.fromDDL("doc_id bigint, held_out boolean, lang_pred string, score double")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by CHARS for each language

    def rows(columns):
        ids, held, texts = columns
        found = sent.value.predict([t.decode() if t is not None else None for t in texts])
        return [(i, h, *f) for i, h, f in zip(ids, held, found, strict=True)]

    return shared.rows_by_batch(docs.select("doc_id", held_out().alias("held"), "text"), ["doc_id", "held", "text"], schema, rows)
