"""Toxicity by a weighted finite-state grammar of clauses.

Five small transducers read the classes of a clause's words (insult, threat, target, negation, report, intent, other):
one passes insults; one passes threats, with their whole weight only after a word of intent ("will kill"); one remembers
whether a target and a match met, which the clause's end rewards; one weakens what a negation reaches; one weakens what
follows reported speech. They are composed into one table of states and classes, whose weights are the products of the
parts' weights. A document's clause scores are summed and calibrated by a logistic curve; only clauses with a matched
insult or threat can score.

Insults are learned: words and word beginnings that stand out in labelled toxic texts, with their log odds as weights.
They and the curve are learned on a bounded sample (MAX_TRAINING_ROWS labelled rows, those with the smallest hash of
doc_id); all other word lists are fixed.

Defined results: null and empty texts score as a text without matches; without usable labels nothing is learned and all
score 0; repeated rows and null ids are scored like any other; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import shared

MAX_TRAINING_ROWS = 8192
MIN_TOXIC_DOCUMENTS = 5
MIN_WEIGHT = 2.0
MIN_PREFIX = 4
THRESHOLD = 0.7

#: Fixed word lists in the languages of the corpus.
THREATS = "kill murder stab shoot hurt destroy töten umbringen erschießen tuer frapper assassiner matar golpear".split()
TARGETS = (
    "you your yours he she they him her them his their everyone du dich dir dein deine ihr euch er sie tu te toi ton ta "
    "vous votre il ils elle elles usted ustedes ellos ellas tú él"
).split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco".split()
INTENTS = "will going gonna want must should werde werden wirst wollen muss vais vas allons veux dois voy vas vamos quiero debo".split()
REPORTS = "said says wrote told called claims sagte schrieb nannte dit écrit appelle dijo escribió llamó".split()

_THREATS = frozenset(THREATS)
_INSULT, _THREAT, _TARGET, _NEGATION, _REPORT, _INTENT, _OTHER = range(7)
_CLASSES = 7
_MATCHES = (_INSULT, _THREAT)
_WINDOW = 3  # words that a negation reaches
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """A weighted machine over word classes that begins in state 0. step gives the next state and the factor of the word
    read (which counts for words with a weight), final the factor at the clause's end."""

    step: Callable[[int, int], tuple[int, float]]
    final: Callable[[int], float] = lambda state: 1.0


#: Every insult passes whole.
INSULT = Transducer(lambda state, c: (0, 1.0))
#: State 1 after a word of intent; a threat without one is weak ("they kill time").
THREAT = Transducer(lambda state, c: (int(state or c == _INTENT), 0.4 if c == _THREAT and not state else 1.0))
#: Bit 1 for a target, bit 2 for a match; both together aim the clause at somebody, in either order.
TARGET = Transducer(lambda state, c: (state | (c == _TARGET) | 2 * (c in _MATCHES), 1.0), lambda state: 1.25 if state == 3 else 1.0)
#: The state counts the words that the last negation still reaches.
NEGATION = Transducer(lambda state, c: (_WINDOW if c == _NEGATION else max(0, state - 1), 0.4 if state else 1.0))
#: State 1 after reported speech has begun.
REPORT = Transducer(lambda state, c: (int(state or c == _REPORT), 0.7 if state else 1.0))
PARTS = (INSULT, THREAT, TARGET, NEGATION, REPORT)


def compose(parts: tuple[Transducer, ...] = PARTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, factor, factor at the clause's end) of the transducers read side by side, over the states that can be
    reached from the start; factors are the products of the parts' factors. State 0 begins a clause."""
    states = [(0,) * len(parts)]
    index = {states[0]: 0}
    after, factor = [], []
    for state in states:  # grows while it is read
        steps = [[part.step(s, c) for part, s in zip(parts, state, strict=True)] for c in range(_CLASSES)]
        row = []
        for ends in steps:
            new = tuple(int(s) for s, _ in ends)
            if new not in index:
                index[new] = len(states)
                states.append(new)
            row.append(index[new])
        after.append(row)
        factor.append([float(np.prod([w for _, w in ends])) for ends in steps])
    final = [float(np.prod([part.final(s) for part, s in zip(parts, state, strict=True)])) for state in states]
    return np.array(after, dtype=np.int32), np.array(factor), np.array(final)


@dataclass
class Grammar:
    """Weights of words ("trash") and of word beginnings ("trash*"), and the curve: probability from the summed score and
    the number of words (chance hits grow with it)."""

    weights: dict[str, float]
    slope: float = 0.0
    length: float = 0.0
    offset: float = -20.0
    _parts: tuple = field(default=None, repr=False)

    def _tables(self):
        if self._parts is None:
            fixed = {w: _TARGET for w in TARGETS} | {w: _NEGATION for w in NEGATIONS} | {w: _REPORT for w in REPORTS} | {w: _INTENT for w in INTENTS}
            begins = sorted({x.rstrip("*") for x in self.weights} | set(THREATS))
            shortest: list[str] = []
            for x in begins:
                if not shortest or not x.startswith(shortest[-1]):
                    shortest.append(x)
            find = ahocorasick.Automaton()
            for x in shortest:
                find.add_word(x, len(x))
            if shortest:
                find.make_automaton()
            begins = {x[:MIN_PREFIX] for x in begins}
            self._parts = (fixed, find, *(x.tolist() for x in compose()), begins)
        return self._parts

    def __getstate__(self):
        return {"weights": self.weights, "slope": self.slope, "length": self.length, "offset": self.offset, "_parts": None}

    def _weight(self, word: str, begins: set[str]) -> float:
        if word[:MIN_PREFIX] not in begins:
            return 0.0
        found = self.weights.get(word)
        if found is not None:
            return found
        for k in range(len(word), MIN_PREFIX - 1, -1):
            found = self.weights.get(word[:k] + "*")
            if found is not None:
                return found
        return 0.0

    def clause(self, words: list[str]) -> float:
        fixed, _, after, factor, final, begins = self._tables()
        state, total = 0, 0.0
        for word in words:
            weight = self._weight(word, begins)
            c = _INSULT if weight else fixed.get(word, _OTHER)
            if c == _OTHER and word in _THREATS:
                c, weight = _THREAT, 1.0
            total += weight * factor[state][c]
            state = after[state][c]
        return total * final[state]

    def full_total(self, text: str | None) -> float:
        """The same as total, by reading every clause."""
        return sum(self.clause(_WORD.findall(clause)) for clause in _CLAUSE_END.split((text or "").lower()))

    def total(self, text: str | None) -> float:
        """The sum of the clauses' scores over the whole text."""
        text = (text or "").lower()
        total, done = 0.0, -1
        for last, size in self._tables()[1].iter(text) if text else ():
            start = last - size + 1
            if start < done or (start and text[start - 1].isalpha()):
                continue  # in a clause that was read, or within a word
            begin = max(text.rfind(sign, max(done, 0), start) for sign in ".!?;:\n")
            begin = max(begin, done) + 1
            end = _CLAUSE_END.search(text, start)
            done = end.start() if end else len(text)
            total += self.clause(_WORD.findall(text, begin, done))
        return total

    def score(self, text: str | None) -> float:
        margin = self.slope * np.log1p(self.total(text)) + self.length * np.log1p(len((text or "").split())) + self.offset
        return float(1 / (1 + np.exp(-margin)))


def features(text: str) -> set[str]:
    """The different words of a text and the beginnings ("abcd*") of at least MIN_PREFIX letters of each."""
    out: set[str] = set()
    for word in set(_WORD.findall(text.lower())):
        out.add(word)
        out.update(word[:k] + "*" for k in range(MIN_PREFIX, min(len(word), 12) + 1))
    return out


def lexicon(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of the features that stand out. Of beginnings with the same toxic texts, the longest stays."""
    weights = {}
    for x, (t, c) in counts.items():
        weight = float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))
        if t >= MIN_TOXIC_DOCUMENTS and weight >= MIN_WEIGHT:
            weights[x] = weight
    longer: dict[str, int] = {}
    for x in counts:
        stem = x[:-1] if x.endswith("*") else x
        shorter = (stem[:-1] if x.endswith("*") else stem) + "*"
        longer[shorter] = max(longer.get(shorter, 0), counts[x][0])
    return {x: w for x, w in weights.items() if not (x.endswith("*") and longer.get(x, 0) == counts[x][0])}


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Grammar:
    chosen = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(~held_out())
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(most)
    )
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # `most` rows
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # repeated rows count once
    sample = shared.written(sample, "toxic-sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), sum(n for k, n in size.items() if k != 1)
    if not toxic or not clean:
        return Grammar({})

    def words(columns):
        seen = Counter(), Counter()  # of texts that are not toxic and that are
        for text, label in zip(*columns, strict=True):
            seen[label == 1].update(features(text.decode()))
        return [(x, seen[1][x], seen[0][x]) for x in seen[0] | seen[1]]

    counted = (
        shared.rows_by_batch(sample, ["text", "toxic"], T.StructType.fromDDL("x string, t int, c int"), words, most=1 << 20)
        .groupBy("x")
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .where(F.col("t") >= MIN_TOXIC_DOCUMENTS)
    )
    grammar = Grammar(lexicon({r["x"]: (r["t"], r["c"]) for r in counted.collect()}, toxic, clean))

    def totals(columns):
        return [(grammar.total(t.decode()), len(t.decode().split()), int(y == 1)) for t, y in zip(*columns, strict=True)]

    schema = T.StructType.fromDDL("total double, words int, y int")
    found = sorted(tuple(r) for r in shared.rows_by_batch(sample, ["text", "toxic"], schema, totals).collect())
    grammar.slope, grammar.length, grammar.offset = calibrate(*np.array(found).T)
    return grammar


def calibrate(total: np.ndarray, words: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """The logistic curve over log(1 + total) and log(1 + words), by Newton's method: slope, length and offset."""
    x = np.stack([np.log1p(total), np.log1p(words), np.ones(len(total))], axis=1)
    w = np.zeros(3)
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(3), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1]), float(w[2])


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    schema = T.StructType.fromDDL("doc_id bigint, held_out boolean, score double, predicted int")

    def rows(columns):
        for doc_id, held, text in zip(*columns, strict=True):
            s = grammar.score(text.decode() if text else None)
            yield doc_id, held, s, int(s >= THRESHOLD)

    return shared.rows_by_batch(docs.select("doc_id", held_out().alias("held"), "text"), ["doc_id", "held", "text"], schema, rows)
