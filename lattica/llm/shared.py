"""What the operators of this subpackage share: tables, the shared folder, iteration over Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space characters that end a word, as bytes.split() takes them.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A folder of our own, made where spark.checkpoint.dir is unset, and all tables written by this process.
_own: list[str] = []
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder of our own
    serves a local session; on a cluster that would be the driver's disk only, so it is an error there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lattica-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lattica-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key from which it is joined by itself, and how many rows are broadcast at most.
HOT_ROWS = 2048
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20


def join_back(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", most: int = HOT_ROWS) -> DataFrame:
    """big joined (left or inner) with small, which has at most one row a key. The rows of keys that hold more than `most`
    rows of big stay where they are and get their few rows of small by broadcast, so no task gathers a hot key; there are
    at most rows / `most` of such keys, and beyond MAX_BROADCAST_ROWS of them the join is an ordinary one."""
    counted = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    hot = written(counted.where(F.col("__rows") > most).select(*keys), "hot-keys")
    found = hot.count()
    if not found or found > MAX_BROADCAST_ROWS:
        return big.join(small, keys, how)
    theirs = written(hot.join(small, keys, how), "of-hot-keys")
    cold = big.join(F.broadcast(hot), keys, "left_anti").join(small, keys, how)
    return cold.unionByName(big.join(F.broadcast(theirs), keys))


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """big joined (left or inner) with small, a written table of at most one row a key: by broadcast where it is small enough,
    and as in join_back where it is not."""
    side = checked_broadcast(small, [c for c, t in small.dtypes if t in ("string", "binary") or t.startswith("array")])
    return join_back(big, small, keys, how) if side is small else big.join(side, keys, how)


def checked_broadcast(df: DataFrame, wide: list[str] | None = None) -> DataFrame:
    """df marked for broadcast if it has few rows and, counting the arrays and strings in `wide`, few bytes; else as it is,
    so that the join shuffles."""
    size = F.lit(8 * len(df.columns))
    for c in wide or ():
        size = size + F.coalesce(F.length(c) if dict(df.dtypes)[c] in ("string", "binary") else 8 * F.size(c), F.lit(0))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("bigint")).alias("bytes")).first()
    small = found["n"] <= MAX_BROADCAST_ROWS and (found["bytes"] or 0) <= MAX_BROADCAST_BYTES
    return F.broadcast(df) if small else df


def cleanup(spark: SparkSession) -> None:
    """Deletes the tables that written() has left in the shared folder; call it once their results have been used."""
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What this worker process keeps between tasks: an owner's name and how to drop it.
_keepers: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    _keepers[owner] = drop


def drop_others(owner: str) -> None:
    """Drops what other owners keep in this process, which now does other work."""
    for other in [o for o in _keepers if o != owner]:
        _keepers.pop(other)()


def rows_by_batch(
    df: DataFrame, columns: list[str], schema: T.StructType, rows: Callable[[list[list]], Iterable[tuple]], end: Callable[[], None] | None = None,
    most: int = 8 << 20, owner: str = "",
) -> DataFrame:
    """mapInArrow over some columns: rows() gets each batch's columns as Python lists (text as bytes) and returns tuples
    of the given schema. Batches are cut so that one holds at most some `most` bytes of text, but always whole rows. end() is
    called after a task's last batch. owner names what rows() keeps in the process (see keeps()); that of others is dropped."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    types = dict(df.select(*columns).dtypes)
    selected = df.select(*[F.col(c).cast("binary").alias(c) if types[c] == "string" else F.col(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(owner)
        try:
            for batch in batches:
                for part in small(batch, most):
                    out = list(rows([c.to_pylist() for c in part.columns]))
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v, type=f.type) for v, f in zip(zip(*out), arrow, strict=True)], schema=arrow
                        )
        finally:
            if end:
                end()

    return selected.mapInArrow(run, schema)


def small(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `most` bytes or one row."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * most / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)
