"""Near-duplicates by exact Jaccard similarity of word shingles, with no pair lost.

A text is the set of the hashes of its shingles of `words` words (lower case, ASCII white space). Equal sets are one node;
two nodes link at a Jaccard similarity of `least` or more. All sets are sorted in one order, rare shingles first; sets that
reach the similarity then share a shingle among their first n - ceil(least * n) + 1 (prefix filter), so each node enters one
cell for each of these. What is common is counted in a sample; the order decides the cost only, never the result.

Three passes over the cells find the components, mostly without all pairs of a large group: the first compares each node with
its cell's smallest one, the second with its hub (the node with the most cells), and the third only nodes of one cell that
are in different components by then. A pair is a candidate
only where the shared shingle's places leave room for the similarity, and where the sketches do: these count a set's hashes
in SKETCH buckets, and two sets differ in no fewer elements than their counts do. What is left is verified on the whole sets.

Defined results: null, empty and all-white texts have the empty set and are copies of each other; texts of fewer words have
their whole sequence as only shingle; rows with one doc_id are one document; a null doc_id gets the component of the others
that share it (null if there are none); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lattica.llm import shared, simhash

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
#: Documents in the sample that tells common shingles, the least number of them with such a shingle, and how many are taken.
SAMPLE, COMMON, MOST_COMMON = 16384, 3, 200_000
#: Nodes in a cell above which it is dealt in chunks.
HOT_CELL = 4096
SKETCH = 128


def shingles(text: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted set of the shingles' hashes."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, dtype=np.int64)
    size = min(words, len(found))
    grams = map(b" ".join, zip(*(found[k:] if k else found for k in range(size)), strict=False))
    n = len(found) - size + 1
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(simhash.SEED)), dtype=np.uint64, count=n).view(np.int64))


def _key(hashes: np.ndarray) -> int:
    key = xxhash.xxh64_intdigest(hashes.tobytes())
    return key - (1 << 64) if key >> 63 else key


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many documents of a sample have, the most common one last."""
    share = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    rows = lambda columns: ((int(h),) for text in columns[0] for h in shingles(text, words))
    counted = shared.rows_by_batch(sample, ["text"], T.StructType.fromDDL("h bigint"), rows).groupBy("h").count()
    top = counted.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").collect()
    return np.array([r.h for r in reversed(top)], dtype=np.int64)


def marks(docs: DataFrame, words: int, least: float) -> DataFrame:
    """doc_id, key (of the set), n (its size), prefix (its first shingles in the common order, as bytes), sketch."""
    common = common_shingles(docs, words)
    by_hash = np.argsort(common)
    known = common[by_hash]

    def rows(columns):
        for doc_id, text in zip(*columns, strict=True):
            hashes = shingles(text, words)
            n = len(hashes)
            rank = np.zeros(n, dtype=np.int64)
            if len(known) and n:
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                rank = np.where(known[at] == hashes, by_hash[at] + 1, 0)
            first = hashes[np.argsort(rank, kind="stable")][: n - math.ceil(least * n - 1e-9) + 1]
            sketch = np.minimum(np.bincount(hashes & (SKETCH - 1), minlength=SKETCH), 255).astype(np.uint8)
            yield doc_id, _key(hashes), n, first.tobytes(), sketch.tobytes()

    schema = T.StructType.fromDDL("doc_id bigint, key bigint, n int, prefix binary, sketch binary")
    return shared.rows_by_batch(docs, ["doc_id", "text"], schema, rows)


def cells(nodes: DataFrame) -> DataFrame:
    """h, key, n, pos of each prefix shingle of nodes(key, n, prefix) that two nodes or more have."""
    schema = T.StructType.fromDDL("h bigint, key bigint, n int, pos int")
    names = schema.names

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.small(batch, 1 << 20):
                key, n, prefix = (c.to_pylist() for c in part.columns)
                size = np.array([len(x) // 8 for x in prefix], dtype=np.int64)
                h = np.frombuffer(b"".join(prefix), dtype=np.int64)
                pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                key, n = np.repeat(np.array(key, dtype=np.int64), size), np.repeat(np.array(n, dtype=np.int32), size)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, key, n, pos.astype(np.int32))], names)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, was = None, False  # the last row so far, and whether the one before it has its shingle
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*([rest] if rest else []), batch]).combine_chunks().to_batches()[0]
            h = table.column(0).to_numpy()
            same = h[1:] == h[:-1]
            stays = np.concatenate([[was], same]) | np.concatenate([same, [False]])
            yield table.slice(0, len(h) - 1).filter(pa.array(stays[:-1]))
            was = bool(same[-1]) if len(same) else was
            rest = table.slice(len(h) - 1)
        if rest and was:
            yield rest

    rows = nodes.select("key", "n", "prefix").mapInArrow(spread, schema)
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(repeated, schema)


def _possible(n, pos, m, other, least):
    """Whether sets of n and m shingles can reach the similarity if the first that they share is at pos and other."""
    return np.minimum(n - pos, m - other) * (1 + least) >= least * (n + m) - 1e-9


def _across(start: np.ndarray, key, n, pos, root, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of different roots within runs; start[i] is the index at which the run of i begins."""
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    first, size = np.unique(start, return_counts=True)
    for at, count in zip(first[size > 12], size[size > 12], strict=True):
        run = slice(at, at + count)
        k, r, a, b = key[run], root[run], n[run], pos[run]
        roots, counts = np.unique(r, return_counts=True)
        largest = roots[np.argmax(counts)]
        for i in np.flatnonzero(r != largest):
            others = np.flatnonzero((r != r[i]) & ((r == largest) | (k > k[i])) & _possible(a[i], b[i], a, b, least))
            if len(others):
                yield np.repeat(k[i], len(others)), k[others]
    end = np.repeat(np.where(size > 12, 0, first + size), size)
    i = np.arange(len(key))
    for offset in range(1, 12):
        i = i[i + offset < end[i]]
        if not len(i):
            break
        j = i + offset
        near = (root[i] != root[j]) & _possible(n[i], pos[i], n[j], pos[j], least)
        if near.any():
            yield key[i[near]], key[j[near]]


def hubs(rooted: DataFrame, least: float) -> DataFrame:
    """x, y: the nodes of each cell of rooted(h, key, n, pos, root) with the cell's hub, where their roots differ. The hub is
    the node with the most cells: a text that others were copied from has no shingles of its own, its copies have."""
    cells_of = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("cells"))
    known = rooted.join(cells_of, "key")
    mixed = known.groupBy("h").agg(
        F.max(F.struct("cells", "key", "n", "pos", "root")).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    room = F.least(F.col("n") - F.col("pos"), F.col("c.n") - F.col("c.pos")) * (1 + least) >= least * (F.col("n") + F.col("c.n")) - 1e-9
    near = rooted.join(mixed.where("low != high").select("h", "c"), "h").where((F.col("root") != F.col("c.root")) & room)
    return near.select(F.least("key", "c.key").alias("x"), F.greatest("key", "c.key").alias("y")).distinct()


def candidates(rooted: DataFrame, least: float, hot: int = HOT_CELL) -> DataFrame:
    """x, y: candidates within the cells of rooted(h, key, n, pos, root) whose roots differ."""
    mixed = rooted.groupBy("h").agg(F.count(F.lit(1)).alias("count"), F.min("root").alias("low"), F.max("root").alias("high"))
    chunks = F.when(F.col("count") > hot, F.ceil(F.col("count") / F.lit(hot // 2))).otherwise(1).cast("bigint")
    dealt = (
        rooted.join(mixed.where("low != high").select("h", chunks.alias("c")), "h")
        .withColumn("i", F.pmod(F.xxhash64("key"), F.col("c")))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)))
        .select("h", (F.least("i", "j") * F.col("c") + F.greatest("i", "j")).alias("b"), "key", "n", "pos", "root")
    )
    schema = T.StructType.fromDDL("x bigint, y bigint")

    def emit(start, columns) -> Iterator[pa.RecordBatch]:
        for x, y in _across(start, *columns, least):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate([r, c]) for r, c in zip(rest, columns, strict=True)]
            h, b = columns[:2]
            new = np.flatnonzero((h[1:] != h[:-1]) | (b[1:] != b[:-1])) + 1
            last = int(new[-1]) if len(new) else 0  # the run that begins here may go on in the next batch
            if last:
                start = np.zeros(last, dtype=np.int64)
                start[new[:-1]] = new[:-1]
                yield from emit(np.maximum.accumulate(start), [c[:last] for c in columns[2:]])
            rest = [c[last:] for c in columns]
        if rest is not None and len(rest[0]):
            yield from emit(np.zeros(len(rest[0]), dtype=np.int64), rest[2:])

    return dealt.repartition("h", "b").sortWithinPartitions("h", "b").mapInArrow(run, schema).distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows of pairs(x, y) whose sets(key, hashes) reach the similarity."""
    schema = T.StructType.fromDDL("x bigint, y bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.small(batch):
                a, b = part.column(2).to_pylist(), part.column(3).to_pylist()
                stays = []
                for u, v in zip(a, b, strict=True):
                    both = len(np.intersect1d(np.frombuffer(u, dtype=np.int64), np.frombuffer(v, dtype=np.int64), assume_unique=True))
                    stays.append(both >= least * ((len(u) + len(v)) // 8 - both) - 1e-9)
                yield part.select([0, 1]).filter(pa.array(stays, type=pa.bool_()))

    left = sets.select(F.col("key").alias("x"), F.col("hashes").alias("a"))
    right = sets.select(F.col("key").alias("y"), F.col("hashes").alias("b"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "a", "b").mapInArrow(run, schema)


def sketched(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The rows of pairs(x, y) whose sketches(key, n, sketch) leave room for the similarity."""
    schema = T.StructType.fromDDL("x bigint, y bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH).astype(np.int16) for k in (3, 4))
            most = batch.column(2).to_numpy() * (1 - least) / (1 + least) + 1e-6
            yield batch.select([0, 1]).filter(pa.array(np.abs(a - b).sum(axis=1) <= most))

    left = sketches.select(F.col("key").alias("x"), F.col("n").alias("n1"), F.col("sketch").alias("a"))
    right = sketches.select(F.col("key").alias("y"), F.col("n").alias("n2"), F.col("sketch").alias("b"))
    both = pairs.join(left, "x").join(right, "y").select("x", "y", (F.col("n1") + F.col("n2")).alias("n"), "a", "b")
    return both.mapInArrow(run, schema)


def _sets(docs: DataFrame, marked: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """key, hashes (as bytes) of the sets in pairs(x, y)."""
    keys = pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct()
    wanted = marked.join(keys, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("wanted"))
    wanted = shared.written(wanted.select("wanted").distinct(), "partners")
    some = docs.select("doc_id", "text").join(shared.checked_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")

    def rows(columns):
        for text in columns[0]:
            hashes = shingles(text, words)
            yield _key(hashes), hashes.tobytes()

    schema = T.StructType.fromDDL("key bigint, hashes binary")
    sets = shared.written(shared.rows_by_batch(some, ["text"], schema, rows), "sets")
    if sets.groupBy("key").count().where("count > 1").take(1):  # repeated rows, or several without an id
        sets = shared.written(sets.groupBy("key").agg(F.first("hashes").alias("hashes")), "sets")
    return sets


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, least: float = MIN_SIMILARITY, hot: int = HOT_CELL) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable by links)."""
    marked = shared.written(marks(docs, words, least), "marks")
    nodes = marked.groupBy("key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    placed = shared.written(cells(nodes), "cells")
    sketches = shared.written(marked.groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")

    def linked(pairs: DataFrame) -> DataFrame:
        close = shared.written(sketched(pairs, sketches, least), "candidates")
        return shared.written(verified(close, _sets(docs, marked, close, words), least), "links")


    centre = F.min(F.struct("key", "n", "pos")).over(Window.partitionBy("h"))
    fits = F.least(F.col("n") - F.col("pos"), F.col("c.n") - F.col("c.pos")) * (1 + least) >= least * (F.col("n") + F.col("c.n")) - 1e-9
    stars = placed.withColumn("c", centre).where((F.col("key") != F.col("c.key")) & fits)
    edges = linked(stars.select(F.col("c.key").alias("x"), F.col("key").alias("y")).distinct())

    def rooted(links: DataFrame) -> DataFrame:
        labels = simhash.components(links).withColumnRenamed("node", "key")
        return shared.written(placed.join(labels, "key", "left").select("h", "key", "n", "pos", F.coalesce("root", "key").alias("root")), "rooted")

    edges = edges.union(linked(hubs(rooted(edges), least)))
    further = linked(candidates(rooted(edges), least, hot))
    roots = simhash.components(edges.union(further)).withColumnRenamed("node", "key")

    classes = marked.groupBy("key").agg(F.min("doc_id").alias("first")).join(roots, "key", "left")
    classes = shared.written(classes.select("key", "first", F.coalesce("root", "key").alias("root")), "classes")
    component = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(component, "root").select("key", "component_id")
    return shared.join_back(marked.select("doc_id", "key"), named, ["key"], "inner").select("doc_id", "component_id")


def keep(docs: DataFrame, words: int = SHINGLE_WORDS, least: float = MIN_SIMILARITY) -> DataFrame:
    """The rows of docs without those of documents that are not the first of their component; a null doc_id stays."""
    gone = near_duplicates(docs, words, least).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(shared.written(gone, "copies").hint("shuffle_hash"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
