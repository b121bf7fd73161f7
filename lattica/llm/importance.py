"""Importance resampling towards a target corpus, by hashed word n-grams.

Words of a slice of a partition get ids in the order in which they come; the slice's suffix array over these ids, sorted
as deep as the longest n-gram, puts the occurrences of an n-gram beside each other. Where the common prefix of
neighbouring suffixes falls below n a run of one n-gram ends, so each different n-gram of a slice is hashed once, and its
bucket is scattered back to the positions of the run. Both corpora are counted by bucket; a bucket's gain is the
log ratio of its smoothed shares, a document's weight the mean gain of its occurrences. Documents are drawn without
replacement by weight plus Gumbel noise from a hash of their id: the highest scores of all documents, ranked over range
partitions.

Only tables of a number of rows that the parameters fix reach the driver: one row a bucket, and one a range partition.

Defined results: null and empty texts, and texts without a word, have no features and weight 0, and have a score like
any other; a null doc_id is hashed as "null" and comes after all others in ties; repeated rows are rows like any other
(they tie, and may be drawn both); an empty table, or an empty target, leaves the smoothing only; columns beside doc_id
and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import shared

#: Bytes that part words: the ASCII ones that are neither letters nor digits. A-Z are lower-cased.
_PART = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


class _Ids(dict):
    """Word -> its number in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PART).split()


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next `depth` ids, by doubling; left: words from a position to its document's end."""
    rank = ids.astype(np.int64) + 1
    known = 1
    while known < depth:
        after = np.zeros_like(rank)
        inside = np.flatnonzero(left > known)
        after[inside] = rank[inside + known]
        rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1].reshape(-1) + 1
        known *= 2
    return np.argsort(rank, kind="stable")


def occurrences(texts: list[bytes | None], depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the number of words and of features, and all texts' buckets, one for each occurrence, in their order."""
    parted = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, parted), dtype=np.int64, count=len(parted))
    words = [w for p in parted for w in p]
    known = _Ids()
    ids = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(ids))
    left = ends - at
    order = suffix_array(ids, left, depth)
    same = np.ones(len(order), dtype=bool)  # whether a suffix shares its first n words with the one before it
    same[:1] = False
    found, owner = [], []
    document = np.repeat(np.arange(len(texts)), sizes)
    for n in range(1, depth + 1):
        long = left[order] >= n
        word = np.full(len(order), -1, dtype=np.int64)
        word[long] = ids[order[long] + n - 1]
        same[1:] &= long[1:] & long[:-1] & (word[1:] == word[:-1])
        first = long & ~same  # where a run begins
        run = np.cumsum(first) - 1
        hashed = np.fromiter(
            (zlib.crc32(b" ".join(words[p : p + n])) % buckets for p in order[first].tolist()), dtype=np.int32, count=int(first.sum())
        )
        scattered = np.empty(len(order), dtype=np.int32)
        scattered[order[long]] = hashed[run[long]]
        holds = left >= n
        found.append(scattered[holds])
        owner.append(document[holds])
    owners = np.concatenate(owner)
    by_text = np.argsort(owners, kind="stable") if depth > 1 else slice(None)
    return sizes, np.bincount(owners, minlength=len(texts)), np.concatenate(found)[by_text]


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def features(docs: DataFrame, depth: int = 1, buckets: int = 10_000, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_words, buckets (array: one for each occurrence of a feature) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.small(batch):
                n_words, counts, found = occurrences(part.column(1).to_pylist(), depth, buckets)
                lists = pa.ListArray.from_arrays(pa.array(_offsets(counts), type=pa.int32()), pa.array(found, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), lists], names=["doc_id", "n_words", "buckets"])

    selected = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return selected.mapInArrow(run, "doc_id bigint, n_words bigint, buckets array<int>")


def totals(found: DataFrame, buckets: int) -> list[int]:
    """How many features each bucket holds."""
    counts = [0] * buckets
    for r in found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():  # a row a bucket
        counts[r["bucket"]] = r["count"]
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln ratio) of each bucket's share of the target and of the source, each count raised by one."""
    n = len(source)
    all_source, all_target = float(sum(source) + n), float(sum(target) + n)
    return [math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source, target, strict=True)]


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 g) of a standard Gumbel variate g from the hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(found: DataFrame, gain: list[int], seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of a table of features."""
    table = np.array(gain, dtype=np.int64)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            counts = np.diff(lists.offsets.to_numpy())
            sums = np.diff(_offsets(table[lists.flatten().to_numpy()])[_offsets(counts)])
            weights = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
            drawn = np.array([noise(i, seed) for i in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts.astype(np.int64)), pa.array(weights), pa.array(weights + drawn)],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return found.select("doc_id", "n_words", "buckets").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
    )


def ranked(scores: DataFrame, share: int, least: int) -> DataFrame:
    """scores with a rank (1, 2, ...) for the `share` hundredths of the rows of at least `least` words with the highest
    scores, ties to the smaller doc_id; other rows have none."""
    spark = scores.sparkSession
    keys = [F.col("n_words") < least, F.desc("score"), F.asc_nulls_last("doc_id")]
    schema = f"{', '.join(f'{c} {t}' for c, t in scores.dtypes)}, part int, at bigint"
    counted = scores.columns.index("n_words")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            if n:
                long = batch.column(counted).to_numpy() >= least
                place = at + np.cumsum(long)
                at = int(place[-1])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(place, mask=~long)],
                    names=[*batch.schema.names, "part", "at"],
                )

    placed = shared.written(scores.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(numbered, schema), "ranks")
    before, start = 0, []
    for r in placed.groupBy("part").agg(F.count("at").alias("n")).orderBy("part").collect():  # a row a partition
        start.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(start, "part int, before bigint")
    rank = F.col("before") + F.col("at")
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= share * before // 100, rank)).drop("part", "at", "before")


def resample(
    docs: DataFrame, target: DataFrame, depth: int = 1, buckets: int = 10_000, share: int = 10, least: int = 20, seed: int = 2024,
    target_id: str = "item_id",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that were not drawn."""
    found = shared.written(features(docs, depth, buckets), "features")
    gain = gains(totals(found, buckets), totals(features(target, depth, buckets, target_id), buckets))
    scores = shared.written(scored(found, gain, seed), "scores")
    return ranked(scores, share, least).select("doc_id", "n_features", "weight", "score", "rank")
