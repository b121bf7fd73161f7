"""Alignment of two tokenizers' tokens by the bytes that they cover.

The texts of a slice of an Arrow batch are laid end to end; with the documents' byte offsets known, the ends of all tokens
of a tokenizer are running sums of their lengths. The ends of A and of B are counted by position once (bincount): where both
end, a group ends; where either does, a link does, since each piece between neighbouring ends lies in one token of A and
one of B. Running sums of these marks, cut at the documents' offsets, give each document's counts, groups and links.

Links are counted over the whole corpus by pair of ids. The most frequent pairs (up to HEAD of them, by powers of two
of their counts) go to every task as sorted arrays; what is left of a document after these is joined with the other pairs
by a shuffle, so no hot pair is ever a join key.

Defined results: a text that is null or empty, or that a tokenizer does not give back byte by byte (with the space before
it), has no tokens: zeros and an empty string; repeated rows each count and each get their results; a null doc_id is an id
like any other; an empty table gives no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import shared
from lattica.llm.bpe import PATTERN, byte_letters

#: Pairs of ids that tasks hold at most (some 17 bytes each).
HEAD = 1 << 18
#: Bytes of text whose tokens are aligned at once; a longer text is aligned alone.
MOST = 2 << 20


@dataclass(frozen=True)
class Tokenizers:
    """Labels (bytes of each id) of A in the order of their ids, of which some are special; the model of B."""

    labels: tuple[bytes, ...]
    special: frozenset[int]
    model: bytes

    def open(self) -> _Pair:
        return _Pair(self)


def load(a: str, b: str) -> Tokenizers:
    """A from a tokenizers file with a byte-level BPE model whose ids are in the order of its merges, B from a
    sentencepiece model."""
    with open(a, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = {letter: i for i, letter in enumerate(byte_letters())}
    special = {t["id"] for t in spec["added_tokens"]}
    vocab = {i: token for token, i in spec["model"]["vocab"].items()}
    labels = tuple(b"" if i in special or i not in vocab else bytes(byte_of[c] for c in vocab[i]) for i in range(max([*vocab, *special]) + 1))
    with open(b, "rb") as file:
        return Tokenizers(labels, frozenset(special), file.read())


class _Pair:
    """Both tokenizers at work: made once a task."""

    def __init__(self, spec: Tokenizers):
        ranks = {label: i for i, label in enumerate(spec.labels) if label}
        self._a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=spec.model)
        n = self._b.get_piece_size()
        pieces = [self._b.id_to_piece(i) for i in range(n)]
        self.labels = (
            list(spec.labels),
            [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)],
        )
        self.lengths = tuple(np.array([len(x) for x in labels], dtype=np.int64) for labels in self.labels)
        # decimal ids with what may follow them: a comma, or the end of A's or of B's part of a group
        self.text = [f"{i}{c}" for labels, ends in zip(self.labels, (",|", ",;"), strict=True) for c in ends for i in range(len(labels))]

    def encode(self, text: bytes | None) -> tuple[list[int], list[int]] | None:
        """The ids of A and of B, if both give the text back."""
        if not text:
            return None
        plain = text.decode()
        a, b = self._a.encode_ordinary(" " + plain), self._b.encode(plain)
        whole = b" " + text
        for ids, labels in zip((a, b), self.labels, strict=True):
            if b"".join(map(labels.__getitem__, ids)) != whole:
                return None
        return a, b


def _offsets(counts) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def _between(running: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums between neighbouring cuts, from running sums that begin with 0."""
    return np.diff(running[cuts])


@dataclass
class Aligned:
    """Of each document: numbers of tokens, groups and links, and the groups as text; its different pairs of linked ids
    (cuts: where each document's begin) and how many links each has."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    cuts: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n: np.ndarray


def align(pair: _Pair, texts: list[bytes | None]) -> Aligned:
    encoded = [pair.encode(t) or ((), ()) for t in texts]
    ids = [np.fromiter((i for e in encoded for i in e[side]), dtype=np.int64) for side in (0, 1)]
    counts = [np.array([len(e[side]) for e in encoded], dtype=np.int64) for side in (0, 1)]
    size = [len(t) + 1 if e[0] else 0 for t, e in zip(texts, encoded, strict=True)]
    bounds = _offsets(size)  # documents' byte offsets
    total = int(bounds[-1])
    ends = [np.cumsum(pair.lengths[side][ids[side]]) for side in (0, 1)]
    marks = [np.bincount(e, minlength=total + 1).astype(bool) for e in ends]
    both, either = marks[0] & marks[1], marks[0] | marks[1]
    groups = np.cumsum(both)  # at a position: groups that have ended there or before
    links = np.cumsum(either)

    # a link ends at each position where a token ends; its tokens are the first of A and of B that end there or later
    at = np.flatnonzero(either)
    linked = [ids[side][np.cumsum(marks[side])[at] - marks[side][at]] for side in (0, 1)]
    n_links = _between(links, bounds)
    document = np.repeat(np.arange(len(texts)), n_links)
    wide = len(pair.labels[1])
    key = (document * len(pair.labels[0]) + linked[0]) * wide + linked[1]
    key, n = np.unique(key, return_counts=True)
    rest, b = np.divmod(key, wide)
    owner, a = np.divmod(rest, len(pair.labels[0]))

    # texts of groups: A's ids of a group, then B's; a token comes after all of the groups before it, and one of B also after A's
    # tokens of its own group
    began = [groups[e] - both[e] for e in ends]  # groups that ended before a token's own
    of_group = [np.bincount(g, minlength=int(groups[-1]) + 1) for g in began]
    before = [_offsets(x) for x in of_group]
    place = [np.arange(len(ids[0])) + before[1][began[0]], np.arange(len(ids[1])) + before[0][began[1] + 1]]
    order = np.empty(len(ids[0]) + len(ids[1]), dtype=np.int64)
    n_labels = len(pair.labels[0])
    order[place[0]] = ids[0] + n_labels * both[ends[0]]
    order[place[1]] = 2 * n_labels + ids[1] + wide * both[ends[1]]
    written = list(map(pair.text.__getitem__, order.tolist()))
    cut = _offsets(counts[0] + counts[1])
    return Aligned(
        *counts, _between(groups, bounds), n_links, ["".join(written[i:j])[:-1] for i, j in zip(cut[:-1], cut[1:], strict=True)],
        _offsets(np.bincount(owner, minlength=len(texts))), a, b, n,
    )


COLUMNS = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "row bigint, a array<int>, b array<int>, n array<int>"
)


def aligned(docs: DataFrame, tokenizers: Tokenizers, with_groups: bool = False) -> DataFrame:
    """COLUMNS of every row, row being a number of its own (and the groups as text, if asked for)."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizers)  # as large as the vocabularies, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = sent.value.open()
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in shared.small(batch, MOST):
                x = align(pair, part.column(1).to_pylist())
                rows = np.arange(row, row + part.num_rows)
                row += part.num_rows
                hashed = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups]
                cuts = pa.array(x.cuts, type=pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v, type=pa.int32())) for v in (x.a, x.b, x.n)]
                numbers = [pa.array(v) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *numbers, pa.array(hashed, type=pa.string()), pa.array(rows), *lists, *([pa.array(x.groups)] if with_groups else [])],
                    names=[c.split()[0] for c in COLUMNS.split(", ")] + ["groups"] * with_groups,
                )

    selected = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return selected.mapInArrow(run, COLUMNS + ", groups string" * with_groups)


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, n, best of a table from aligned(): how many links of all documents hold the pair, and whether no other pair of
    its b has more. Each task adds up its documents' pairs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (c.flatten().to_numpy().astype(np.int64) for c in batch.columns)
            key, at = np.unique(a << 32 | b, return_inverse=True)
            sums = np.zeros(len(key), dtype=np.int64)
            np.add.at(sums, at, n)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sums)], names=["key", "n"])

    each = found.select("a", "b", "n").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    counted = shared.written(each.select(F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n"), "pairs")
    top = counted.groupBy("b").agg(F.max("n").alias("top"))  # a row an id of B: as large as its vocabulary at most
    return counted.join(F.broadcast(top), "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def digests(docs: DataFrame, tokenizers: Tokenizers, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark = docs.sparkSession
    found = shared.written(aligned(docs, tokenizers), "aligned")
    rated = shared.written(pair_counts(found).withColumn("size", F.floor(F.log2("n")).cast("int")), "rated")
    least, held, more = 64, 0, False
    for r in rated.groupBy("size").count().orderBy(F.desc("size")).collect():  # a row a power of two
        if held + r["count"] > head:
            more = True
            break
        least, held = r["size"], held + r["count"]
    top = rated.where(F.col("size") >= least).select((F.shiftleft(F.col("a").cast("bigint"), 32) + F.col("b")).alias("key"), "n", "best").toPandas()
    top = top.sort_values("key")  # at most `head` rows
    sent = spark.sparkContext.broadcast((top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    types = dict(found.dtypes)
    schema = "row bigint, n_best bigint, count_sum bigint, left array<struct<a: int, b: int, n: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = sent.value
        for batch in batches:
            rows, lists, rest = batch.column(0), batch.columns[1:4], batch.columns[4:]
            cuts = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
            a, b, n = (c.flatten().to_numpy().astype(np.int64) for c in lists)
            key = a << 32 | b
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[at] == key if len(keys) else np.zeros(len(key), dtype=bool)
            links, good = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)
            links[known] = n[known] * counts[at[known]]
            good[known] = n[known] * best[at[known]]
            left = pa.StructArray.from_arrays([pa.array(x[~known], type=pa.int32()) for x in (a, b, n)], names=["a", "b", "n"])
            left = pa.ListArray.from_arrays(pa.array(_offsets(~known)[cuts], type=pa.int32()), left)
            sums = [pa.array(_between(_offsets(x), cuts)) for x in (good, links)]
            yield pa.RecordBatch.from_arrays([rows, *sums, left, *rest], names=["row", "n_best", "count_sum", "left", *plain])

    summed = found.select("row", "a", "b", "n", *plain).mapInArrow(run, schema + "".join(f", {c} {types[c]}" for c in plain))
    if not more:
        return summed.select(*plain[:5], "n_best", "count_sum", "groups_sha256")
    summed = shared.written(summed, "summed")
    rest = rated.where(F.col("size") < least).select("a", "b", F.col("n").alias("count"), "best")
    later = (
        summed.select("row", F.explode("left").alias("x"))
        .select("row", "x.*")
        .join(rest, ["a", "b"])
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_count"))
    )
    more_of = lambda c: F.coalesce(F.col(c), F.lit(0))
    return summed.join(later, "row", "left").select(
        *plain[:5], (F.col("n_best") + more_of("more_best")).alias("n_best"), (F.col("count_sum") + more_of("more_count")).alias("count_sum"), "groups_sha256"
    )
