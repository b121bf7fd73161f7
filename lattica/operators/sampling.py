"""Sampling without replacement by hash order: the same result in any engine, partitioning or order of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators import marginals


def draw(seed: int, *columns: Column | str) -> Column:
    """A pseudo-random order that depends on the seed and the columns only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def downsample(layer: DataFrame, samples: int | DataFrame, seed: int) -> DataFrame:
    """Each observation's counts cut down to `samples` units (a number, or one for each in samples(obs_id, samples)), drawn
    without replacement; those with fewer stay. No unit has a row of its own: a row's values are drawn one after the other,
    each from a hypergeometric distribution given what is left, with a generator seeded by the hash of the observation. Row
    totals that are cut must lie below 10^9."""
    cells = F.sort_array(F.collect_list(F.struct("var_id", F.col("value").cast("double").alias("value"))))
    rows = layer.groupBy("obs_id").agg(cells.alias("cells"), F.sum("value").cast("double").alias("total"))
    rows = rows.withColumn("samples", F.lit(samples).cast("bigint")) if isinstance(samples, int) else rows.join(samples, "obs_id")
    rows = rows.select("obs_id", "cells", "total", F.col("samples").cast("bigint").alias("samples"), F.xxhash64(F.lit(seed), F.col("obs_id").cast("string")).alias("h"))
    kinds = dict(layer.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            values = flat.field("value").to_numpy().copy()
            for i, (total, most, h) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                if total > most:
                    part = slice(cuts[i], cuts[i + 1])
                    random = np.random.Generator(np.random.PCG64(h & (1 << 64) - 1))
                    values[part] = random.multivariate_hypergeometric(values[part].astype(np.int64), most, method="marginals")
            drawn = pa.StructArray.from_arrays([flat.field("var_id"), pa.array(values)], names=["var_id", "value"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), drawn)], names=["obs_id", "cells"])

    found = rows.mapInArrow(run, f"obs_id {kinds['obs_id']}, cells array<struct<var_id: {kinds['var_id']}, value: double>>")
    return found.select("obs_id", F.explode("cells").alias("c")).select("obs_id", "c.var_id", "c.value").where("value > 0")


def downsample_size(layer: DataFrame, obs: DataFrame, least: int = 750, low: float = 0.05, high: float = 0.5) -> int:
    """round(min(max(least, the low quantile of the totals), the high quantile))."""
    totals = obs.select("obs_id").join(layer.groupBy("obs_id").agg(F.sum("value").alias("t")), "obs_id", "left")
    a, b = totals.agg(F.percentile(F.coalesce("t", F.lit(0.0)), low), F.percentile(F.coalesce("t", F.lit(0.0)), high)).first()
    return round(min(max(least, a or 0), b or 0))


def shuffle(layer: DataFrame, axis: DataFrame, seed: int) -> DataFrame:
    """Each observation's values dealt anew to the variables (implicit zeros too): sums of observations stay."""
    n = axis.count()
    numbered = axis.select("var_id", (F.row_number().over(Window.orderBy("var_id")) - 1).alias("slot"))  # a row a variable
    values = layer.withColumn("k", F.row_number().over(Window.partitionBy("obs_id").orderBy("var_id")) - 1)
    slots = layer.select("obs_id").distinct().select("obs_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    order = Window.partitionBy("obs_id").orderBy(draw(seed, "obs_id", "slot"), "slot")
    dealt = slots.withColumn("k", F.row_number().over(order) - 1)
    return values.select("obs_id", "k", "value").join(dealt, ["obs_id", "k"]).join(F.broadcast(numbered), "slot").select("obs_id", "var_id", "value")


def sample_obs(obs: DataFrame, count: int, seed: int) -> DataFrame:
    """`count` observations, drawn without replacement."""
    return obs.select("obs_id").orderBy(draw(seed, "obs_id"), "obs_id").limit(count)


def pile_count(elements: int, target: int) -> int:
    """The number of piles, of the two next to elements / target, whose size is off by the smaller factor."""
    if elements <= target:
        return 1
    few, many = max(1, elements // target), -(-elements // target)
    off = lambda k: max(elements / k / target, target / (elements / k))
    return few if off(few) < off(many) else many


def random_piles(obs: DataFrame, target: int, seed: int) -> DataFrame:
    """obs_id, pile: a balanced random partition; sizes differ by one at most."""
    piles = pile_count(obs.count(), target)
    from lattica.operators.ranking import positions

    hashed = obs.select("obs_id", F.xxhash64(F.lit(seed), "obs_id").alias("h"))
    return positions(hashed, ["h", "obs_id"]).select("obs_id", F.pmod("position", F.lit(piles)).cast("int").alias("pile"))


def target_pile_size(layer: DataFrame, obs: DataFrame, size: int = 48, umis: float = 160000, least: int = 8000, most: int = 24000, groups: int = 100) -> int:
    """Observations in a pile of `groups` groups, by the target size of a group or its target total, whichever is more."""
    n = obs.count()
    mean = (marginals.whole(layer, n, 1).first()["total"] or 0.0) / max(n, 1)
    return int(min(max(size * groups, round(umis / mean * groups) if mean else 0, least), most))
