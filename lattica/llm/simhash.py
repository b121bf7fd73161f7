"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of the segments' bit counts. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, so a range join of the
embeddings under Manhattan distance loses nothing. The join lays a grid over the embedding: its 32 coordinates are dealt
into radius + k blocks, and two points within the radius agree exactly in at least k of them, so each fingerprint enters
one cell for every choice of k blocks. Within a cell, candidates are bounded by Manhattan distance and then verified by
exact Hamming distance.

Only different fingerprints enter the grid. A cell emits a spanning forest of its links and never its pairs; a cell of
more than `hot` fingerprints is dealt in pairs of chunks of at most half of that, so no task holds a whole hot cell.

Defined results: null, empty and all-white texts have fingerprint zero and link like any other; texts of fewer than
four words have their whole sequence as only shingle; rows with one doc_id are one document; a null doc_id gets a
fingerprint and the component of the others that share it (null if there are none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import shared

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Blocks that must agree. More of them make finer cells, for more rows a fingerprint: C(RADIUS + k, k).
MATCHING_BLOCKS = 3
#: Fingerprints in a cell above which it is dealt in chunks.
HOT_CELL = 4096
_ODD = 0x5555555555555555


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned SimHash: a bit is 1 if set in over half of the shingles' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < size:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[k:] if k else words for k in range(size)), strict=False))
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        octets = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    schema = T.StructType.fromDDL("doc_id bigint, fp bigint")

    def rows(columns):
        for doc_id, text in zip(*columns, strict=True):
            fp = fingerprint(text)
            yield doc_id, fp - (1 << 64) if fp >> 63 else fp

    return shared.rows_by_batch(docs, ["doc_id", "text"], schema, rows)


def embedding(fp: F.Column | np.ndarray):
    """Bit counts of the 32 two-bit segments, each in unary (0, 01, 11), so that the Manhattan distance of two
    embeddings is the number of bits in which these codes differ."""
    if isinstance(fp, np.ndarray):
        odd, one = np.uint64(_ODD), np.uint64(1)
        return ((fp | fp >> one) & odd) | ((fp & fp >> one & odd) << one)
    high = F.shiftrightunsigned(fp, 1)
    odd = F.lit(_ODD)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1))


def cell_masks(radius: int = RADIUS, matching: int = MATCHING_BLOCKS) -> list[int]:
    """For each choice of `matching` of radius + matching blocks, the bits of the coordinates in them (signed)."""
    n = radius + matching
    edges = [round(32 * k / n) for k in range(n + 1)]
    blocks = [sum(3 << 2 * s for s in range(edges[k], edges[k + 1])) for k in range(n)]
    masks = [sum(blocks[k] for k in chosen) for chosen in combinations(range(n), matching)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints, each component a star about its smallest member:
    a search that compares each reached fingerprint with the unreached ones only."""
    left = np.sort(fp)
    code = embedding(left)
    out: list[tuple[int, int]] = []
    while len(left):
        centre, queue = left[0], [(left[0], code[0])]
        left, code = left[1:], code[1:]
        while queue and len(left):
            x, u = queue.pop()
            near = np.flatnonzero(np.bitwise_count(code ^ u) <= radius)  # Manhattan: a lower bound
            near = near[np.bitwise_count(left[near] ^ x) <= radius]  # Hamming: exact
            if len(near):
                out += [(int(y), int(centre)) for y in left[near]]
                queue += list(zip(left[near], code[near], strict=True))
                stays = np.ones(len(left), dtype=bool)
                stays[near] = False
                left, code = left[stays], code[stays]
    return out


def _runs(start: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within runs; start[i] is the index at which the run of i begins. Short runs go through all offsets at once."""
    first, size = np.unique(start, return_counts=True)
    out: list[tuple[int, int]] = []
    for at, n in zip(first[size > 12], size[size > 12], strict=True):
        out += forest(fp[at : at + n], radius)
    end = np.repeat(first + size, size)
    end[np.repeat(size > 12, size)] = 0
    code = embedding(fp)
    i = np.arange(len(fp))
    for offset in range(1, 12):
        i = i[i + offset < end[i]]
        if not len(i):
            break
        near = i[np.bitwise_count(code[i] ^ code[i + offset]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[near + offset]) <= radius]
        out += [(int(max(a, b)), int(min(a, b))) for a, b in zip(fp[near], fp[near + offset], strict=True)]
    return out


def _links(cells: DataFrame, radius: int) -> DataFrame:
    """cells(a, b, fp): links among the fingerprints of each (a, b), as streamed from partitions sorted by (a, b)."""
    schema = T.StructType.fromDDL("x bigint, y bigint")
    signed = pa.int64()

    def emit(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if pairs:
            both = np.array(pairs, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0], signed), pa.array(both[:, 1], signed)], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, dtype=np.int64)] * 3
        for batch in batches:
            a, b, fp = (np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True))
            if not len(a):
                continue
            new = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            last = int(new[-1]) if len(new) else 0  # the run that begins here may go on in the next batch
            if last:
                start = np.zeros(last, dtype=np.int64)
                start[new[:-1]] = new[:-1]
                yield from emit(_runs(np.maximum.accumulate(start), fp[:last].view(np.uint64), radius))
            rest = [a[last:], b[last:], fp[last:]]
        if len(rest[0]):
            yield from emit(_runs(np.zeros(len(rest[0]), dtype=np.int64), rest[2].view(np.uint64), radius))

    return cells.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, schema)


def links(fps: DataFrame, radius: int = RADIUS, matching: int = MATCHING_BLOCKS, hot: int = HOT_CELL) -> DataFrame:
    """x, y: links among the different fingerprints in fps(fp) that connect all that are within the radius."""
    masks = F.array(*[F.lit(m) for m in cell_masks(radius, matching)])
    cells = fps.select("fp", F.posexplode(masks).alias("a", "mask")).select(
        F.col("a").cast("bigint").alias("a"), embedding(F.col("fp")).bitwiseAND(F.col("mask")).alias("b"), "fp"
    )
    large = shared.written(cells.groupBy("a", "b").count().where(F.col("count") > hot), "cells")
    if not large.take(1):
        return _links(cells, radius).distinct()
    crowded = cells.join(large, ["a", "b"])
    chunks = F.ceil(F.col("count") / F.lit(hot // 2)).cast("bigint")
    mine = F.pmod(F.xxhash64("fp"), chunks)
    dealt = (
        crowded.withColumn("n", chunks)
        .withColumn("i", mine)
        .select("a", "b", "fp", "n", "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("j"))
        .select(
            F.xxhash64("a", "b").alias("a"), (F.least("i", "j") * F.col("n") + F.greatest("i", "j")).alias("b"), "fp"
        )
    )
    return _links(cells.join(large, ["a", "b"], "left_anti"), radius).union(_links(dealt, radius)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of edges(x, y), the smallest node reachable. Every round takes the smallest label among
    the neighbours and then jumps to that label's own label, until none changes; labels only fall, so that comes, and paths
    shorten by half with most jumps. Rounds are written to the shared folder."""
    both = edges.select(F.col("x").alias("u"), F.col("y").alias("v"))
    both = shared.written(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = shared.written(
        both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")),
        "labels",
    )
    while True:
        offered = (
            both.join(labels.select(F.col("node").alias("v"), "root"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("root").alias("offer"))
        )
        lower = labels.join(offered, "node", "left").select(
            "node", F.least("root", "offer").alias("next"), F.col("root").alias("was")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("further"))
        moved = shared.written(
            lower.join(jump, "next", "left").select("node", F.least("next", "further").alias("root"), "was"), "labels"
        )
        labels = moved.select("node", "root")
        if not moved.where("root != was").take(1):
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    marked = shared.written(fingerprints(docs), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(classes.select("fp")))
    joined = shared.written(
        classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        ),
        "classes",
    )
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return shared.join_back(marked, named, ["fp"], "inner").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs without those of documents that are not the first of their component; a null doc_id stays."""
    gone = near_duplicates(docs).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(shared.written(gone, "copies").hint("shuffle_hash"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
