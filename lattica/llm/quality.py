"""Quality rules: gradient-boosted trees over document statistics.

``measure`` computes the statistics of whole texts, ``fit`` trains boosted trees with monotonic constraints on a bounded
sample of labelled rows and flattens them into numpy node arrays, ``Forest.score`` walks all trees for a whole batch at
once, and ``judge`` applies the fixed rules and then the trees.

Defined results: a null, empty or all-white text has no words, so the fixed rules reject it; repeated rows and rows with
a null doc_id are judged like any other; without usable labels (an empty table, one class only) the fixed rules decide
alone; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import shared

#: The bound on labelled rows that the trees are fitted on: those with the smallest hash of doc_id.
MAX_TRAINING_ROWS = 8192
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document goes if the trees give it less than this probability of label 1.
MIN_PROBABILITY = 0.35

#: Feature -> direction in which the probability of quality may move with it (0: free).
FEATURES = {
    "log_words": 0,
    "mean_word_bytes": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "exclaim_per_word": -1,
    "pipe_per_word": -1,
    "distinct_word_share": 0,
    "words_per_line": 0,
    "stop_per_word": 0,
}

_SYMBOLS = b"#*$%&|<>"
_WHITE = shared.WHITE.encode()
_TAIL = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_DIGITS = b"0123456789"


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, its first occurrence included; each word counts once."""
    n = len(words) - 2
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    if len(known) == len(words):
        return 0
    pair = ids[:-2] * len(known) + ids[1:-1]
    if len(known) >= 1 << 20:  # three ids would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * len(known) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : n + shift] |= twice
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[tuple[int, int, int, int, int], tuple[float, ...]]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), features in the order of FEATURES)."""
    text = text or b""
    words = text.split()
    n = len(words)
    white = _count(text, _WHITE)
    points = len(text) - _count(text, _TAIL)
    symbols = _count(text, _SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    letters = max(1, _count(text, _LETTERS))
    per_word = max(1, n)
    features = (
        float(np.log1p(n)),
        (len(text) - white) / per_word,
        symbols / per_word,
        dup_lines / max(1, len(lines)),
        repeat / per_word,
        _count(text, _UPPER) / letters,
        _count(text, _DIGITS) / max(1, points),
        _count(text, b"!") / per_word,
        _count(text, b"|") / per_word,
        len(set(words)) / per_word,
        n / max(1, len(lines)),
        _count(text, b".,;:?") / per_word,
    )
    return (n, points - white, symbols, dup_lines, repeat), features


@dataclass(frozen=True)
class Forest:
    """Boosted trees as node arrays: node i sends x left if x[feature[i]] <= threshold[i]; leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x, all trees and rows at once."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        for at in range(0, len(self.roots), 16):
            node = np.broadcast_to(self.roots[at : at + 16], (len(x), len(self.roots[at : at + 16])))
            for _ in range(self.depth):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: Iterable[int] = tuple(FEATURES.values()),
    trees: int = 80,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 48,
    shrink: float = 2.0,
) -> Forest | None:
    """Newton boosting of logistic loss on binned features. A constrained feature's split must order its two values, and
    the values below stay on their side of the split's middle. None where y has not both classes."""
    if len(y) == 0 or y.min() == y.max():
        return None
    way = tuple(monotone)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []

    def best_split(rows, g, h, low, high):
        found = (1e-6, None)
        gt, ht = g[rows].sum(), h[rows].sum()
        whole = gt * gt / (ht + shrink)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.bincount(binned[rows, j], weights=g[rows], minlength=len(c) + 1).cumsum()[:-1]
            hl = np.bincount(binned[rows, j], weights=h[rows], minlength=len(c) + 1).cumsum()[:-1]
            gr, hr = gt - gl, ht - hl
            vl, vr = np.clip(-gl / (hl + shrink), low, high), np.clip(-gr / (hr + shrink), low, high)
            gain = gl * gl / (hl + shrink) + gr * gr / (hr + shrink) - whole
            gain[(hl < 1.0) | (hr < 1.0)] = -1
            if way[j]:
                gain[(vr - vl) * way[j] < 0] = -1
            k = int(gain.argmax())
            if gain[k] > found[0]:
                found = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
        return found[1]

    def grow(rows, g, h, level, low, high) -> int:
        here = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + shrink), low, high))
        nodes.append([0, 0.0, here, here, rate * value])
        split = best_split(rows, g, h, low, high) if level < depth else None
        if split is None:
            margin[rows] += rate * value
            return here
        j, k, vl, vr = split
        middle = (vl + vr) / 2
        left_to, right_to = ((low, middle), (middle, high)) if way[j] > 0 else ((middle, high), (low, middle)) if way[j] < 0 else ((low, high),) * 2
        goes = binned[rows, j] <= k
        left = grow(rows[goes], g, h, level + 1, *left_to)
        right = grow(rows[~goes], g, h, level + 1, *right_to)
        nodes[here] = [j, float(cuts[j][k]), left, right, 0.0]
        return here

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
    flat = np.array(nodes)
    whole = lambda k: flat[:, k].astype(np.int32)
    return Forest(whole(0), flat[:, 1], whole(2), whole(3), flat[:, 4], np.array(roots, dtype=np.int32), base, depth)


def training_set(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `most` labelled rows, those with the smallest hash of doc_id."""
    chosen = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .select("doc_id", F.col("quality").cast("double").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(most)
    )
    wanted = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by `most` rows
    wanted = wanted.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # repeated rows count once
    schema = T.StructType.fromDDL("y double, x array<double>")

    def rows(columns):
        for text, y in zip(*columns, strict=True):
            yield y, [float(v) for v in measure(text)[1]]

    found = sorted((r["y"], tuple(r["x"])) for r in shared.rows_by_batch(wanted, ["text", "quality"], schema, rows).collect())
    return np.array([x for _, x in found]).reshape(-1, len(FEATURES)), np.array([y for y, _ in found])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Forest | None:
    return fit(*training_set(docs, labels, most))


def _verdicts(texts: list[bytes | None], forest: Forest | None, least: float) -> list[tuple]:
    measured = [measure(t) for t in texts]
    good = forest.score(np.array([x for _, x in measured])) if forest and measured else np.ones(len(measured))
    out = []
    for (base, _), p in zip(measured, good, strict=True):
        failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
        out.append((*base, failed, bool(not failed and p >= least), float(p)))
    return out


def judge(docs: DataFrame, forest: Forest | None, least: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability."""
    schema = T.StructType.fromDDL(
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, kept boolean, probability double"
    )

    def rows(columns):
        ids, texts = columns
        return [(i, *v) for i, v in zip(ids, _verdicts(texts, forest, least), strict=True)]

    return shared.rows_by_batch(docs, ["doc_id", "text"], schema, rows)


def keep(docs: DataFrame, forest: Forest | None, least: float = MIN_PROBABILITY) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in shared.small(batch):
                texts = part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array([v[6] for v in _verdicts(texts, forest, least)]))

    return docs.mapInArrow(run, docs.schema)
