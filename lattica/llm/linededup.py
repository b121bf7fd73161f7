"""Line dedup by range partitions, a secondary sort and keep bitmaps.

Every line of at least `min_chars` code points gives a row (128-bit hash of its key, doc_id, position). The rows are
range-partitioned by (hash, doc_id) and sorted by hash, doc_id from the largest, position; so a hash that holds a third
of all rows spreads over many partitions. A partition is streamed once with memory for a few documents: the first
document of a hash keeps its lines, and those of the others go as soon as a fifth document shows that the key is
frequent. A hash that touches an end of what one read split holds may go on in the next; those ends, two of each split, are
put together in a table of their own, and lines of such a hash that the stream cannot decide are joined with it. What
comes back is a bitmap of the lines that stay for every document that loses some, not text.

Defined results: a null or empty text is one empty line; repeated rows with one doc_id are one document, and all of them
keep or lose their lines together; rows with a null doc_id neither count nor lose lines; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lattica.llm import shared

MIN_CHARS = 40
MIN_DOCUMENTS = 5
_WHITE = shared.WHITE.encode()


def line_keys(text: bytes | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(position, key) of the lines that are long enough to count."""
    out = []
    for position, line in enumerate((text or b"").split(b"\n")):
        key = line.strip(_WHITE).lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            out.append((position, key))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """high, low (halves of the key's hash), doc_id, position."""
    schema = T.StructType.fromDDL("high bigint, low bigint, doc_id bigint, position int")

    def rows(columns):
        for doc_id, text in zip(*columns, strict=True):
            for position, key in line_keys(text, min_chars):
                h = xxhash.xxh3_128_intdigest(key)
                yield _signed(h >> 64), _signed(h & ((1 << 64) - 1)), doc_id, position

    return shared.rows_by_batch(docs.where("doc_id IS NOT NULL"), ["doc_id", "text"], schema, rows)


def _split() -> F.Column:
    """The read split of a row: a block of one written file. A task may read several of them, in any order."""
    return F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("split")


def _ends(lines: DataFrame) -> DataFrame:
    """high, low, documents, keeper (the largest doc_id) of the hashes at the ends of the read splits."""
    names = ["high", "low", "most", "least", "n"]
    schema = T.StructType.fromDDL(", ".join(f"{x} bigint" for x in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[int]] = []
        now: list[int] | None = None  # the open run
        its_split, is_first = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            high, low, doc, part = (c.to_numpy() for c in batch.columns)
            change = np.ones(len(high), dtype=bool)
            change[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (part[1:] != part[:-1])
            other = change.copy()
            other[1:] |= doc[1:] != doc[:-1]
            at = np.flatnonzero(change)
            count = np.add.reduceat(other.astype(np.int64), at)
            stop = np.append(at[1:], len(high)) - 1
            parts = part[at]
            begins = np.append(True, parts[1:] != parts[:-1])
            shown = begins.copy()
            shown[-1] = True
            shown[:-1] |= begins[1:]
            for k in np.flatnonzero(shown):
                head = [int(high[at[k]]), int(low[at[k]]), int(doc[at[k]]), int(doc[stop[k]]), int(count[k])]
                if k == 0 and now and its_split == parts[0]:
                    if now[:2] == head[:2]:
                        now[4] += head[4] - (now[3] == head[2])
                        now[3] = head[3]
                        continue
                    begins[0] = False
                if now and (is_first or its_split != parts[k]):
                    found.append(now)
                now, its_split, is_first = head, parts[k], bool(begins[k])
        if now:
            found.append(now)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], names)

    ends = lines.select("high", "low", "doc_id", _split()).mapInArrow(run, schema)
    # a document at the end of one split and the beginning of the next is one
    before = F.lag("least").over(Window.partitionBy("high", "low").orderBy(F.desc("most"), F.desc("least")))
    counted = ends.withColumn("own", F.col("n") - F.coalesce((before == F.col("most")).cast("bigint"), F.lit(0)))
    return counted.groupBy("high", "low").agg(F.sum("own").alias("documents"), F.max("most").alias("keeper"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, position of every line that goes."""
    found = shared.written(line_rows(docs, min_chars), "line-rows")  # the range partitioner reads them twice
    lines = shared.written(
        found
        .repartitionByRange("high", "low", F.desc("doc_id"))
        .sortWithinPartitions("high", "low", F.desc("doc_id"), "position"),
        "lines",
    )
    ends = shared.written(_ends(lines), "ends")
    schema = T.StructType.fromDDL("high bigint, low bigint, doc_id bigint, position int, sure boolean")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = split = keeper = last = None
        first, frequent, seen = False, False, 0  # whether the hash is the first of its split
        waits: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for high, low, doc, position, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != split or key != (high, low):
                    if part != split:
                        out += waits  # the last hash of a split may go on in the next
                    first, split, key = part != split, part, (high, low)
                    frequent, waits, seen, last, keeper = False, [], 0, None, doc  # the first that comes is the largest
                if first:
                    out.append((high, low, doc, position, False))
                    continue
                if doc != last:
                    seen, last = seen + 1, doc
                    if not frequent and seen >= min_documents:
                        frequent = True
                        out += [(*w[:4], True) for w in waits]
                        waits = []
                if doc != keeper:
                    (out if frequent else waits).append((high, low, doc, position, frequent))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], schema.names)
        if waits:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*waits, strict=True), types, strict=True)], schema.names)

    marked = shared.written(lines.select("high", "low", "doc_id", "position", _split()).mapInArrow(run, schema), "marked-lines")
    open_ends = marked.where(~F.col("sure")).join(shared.checked_broadcast(ends), ["high", "low"])
    late = open_ends.where((F.col("documents") >= min_documents) & (F.col("doc_id") != F.col("keeper")))
    return marked.where("sure").select("doc_id", "position").union(late.select("doc_id", "position"))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """doc_id, bitmap: zlib of the bits of lines that stay, as far as the last line that goes (those after it stay)."""

    @F.pandas_udf("binary")
    def packed(positions):
        out = []
        for p in positions:
            bits = np.ones(max(p) + 1, dtype=np.uint8)
            bits[np.asarray(p)] = 0
            out.append(zlib.compress(np.packbits(bits).tobytes() + bytes([len(bits) % 8])))
        return type(positions)(out)

    return dropped.groupBy("doc_id").agg(F.collect_set("position").alias("p")).select("doc_id", packed("p").alias("bitmap"))


def unpacked(bitmap: bytes | None) -> np.ndarray:
    """True for the lines that stay, as far as the bitmap goes."""
    if not bitmap:
        return np.ones(0, dtype=bool)
    raw = zlib.decompress(bitmap)
    n = 8 * (len(raw) - 1) - (8 - raw[-1]) % 8
    return np.unpackbits(np.frombuffer(raw[:-1], dtype=np.uint8))[:n].astype(bool)


def apply_bitmap(text: bytes | None, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """(lines before, lines that go, text that stays)."""
    lines = (text or b"").split(b"\n")
    stays = unpacked(bitmap)
    if not len(stays):
        return len(lines), 0, text or b""
    kept = [x for k, x in enumerate(lines) if k >= len(stays) or stays[k]]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def with_bitmaps(docs: DataFrame, name: str = "bitmap") -> DataFrame:
    """docs with its keep bitmap (null: all lines stay). Small bitmaps travel to the texts, texts are not sorted."""
    maps = shared.written(keep_bitmaps(dropped_lines(docs)), "bitmaps").withColumnRenamed("bitmap", name)
    return docs.join(maps.hint("shuffle_hash"), "doc_id", "left")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    schema = T.StructType.fromDDL("doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")

    def rows(columns):
        for doc_id, text, bitmap in zip(*columns, strict=True):
            n, gone, kept = apply_bitmap(text, bitmap)
            yield doc_id, n, gone, hashlib.sha256(kept).hexdigest()

    return shared.rows_by_batch(with_bitmaps(docs.select("doc_id", "text")), ["doc_id", "text", "bitmap"], schema, rows)


def keep(docs: DataFrame) -> DataFrame:
    """docs with the text that stays (a null text stays null); all other columns as they were."""
    name = "bitmap"
    while name in docs.columns:
        name = f"_{name}"
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.small(batch):
                texts, bitmaps = part.column(at), part.column(part.num_columns - 1).to_pylist()
                new = [
                    t if t is None or not b else apply_bitmap(t, b)[2]
                    for t, b in zip(texts.cast(pa.binary()).to_pylist(), bitmaps, strict=True)
                ]
                columns = [*part.columns[:-1]]
                columns[at] = pa.array(new, pa.binary()).cast(texts.type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    joined = with_bitmaps(docs, name).select(*[F.col(f"`{c}`") for c in docs.columns], name)
    return joined.mapInArrow(run, docs.schema)
