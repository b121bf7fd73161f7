"""Aggregates of a layer for each observation or variable, and over the whole layer.

per is the axis that stays: "obs_id" or "var_id". axis is its dimension table, n the size of the other one. Layers hold
non-zeros only, so every formula says how the n - count zeros enter; nothing is made dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def other(per: str) -> str:
    return "var_id" if per == "obs_id" else "obs_id"


def size(axis: DataFrame) -> int:
    return axis.count()


def reduce_per(layer: DataFrame, axis: DataFrame, per: str, n: int) -> DataFrame:
    """per and total, total_squared, nnz, mean, maximum, minimum, variance, stdev, normalized_variance, geomean (of rows
    without zeros, else 0), for every member of the axis, with one shuffle."""
    v = F.col("value")
    found = layer.groupBy(per).agg(
        F.sum(v).alias("s"),
        F.sum(v * v).alias("q"),
        F.count_if(v != 0).alias("k"),
        F.max(v).alias("hi"),
        F.min(v).alias("lo"),
        F.avg(F.when(v > 0, F.ln(v))).alias("g"),
        F.count_if(v > 0).alias("p"),
    )
    s, q, k = (F.coalesce(F.col(c), F.lit(0)) for c in ("s", "q", "k"))
    zeros = k < n
    variance = F.greatest((q - s * s / n) / n, F.lit(0.0))
    mean = s / n
    return axis.select(per).join(found, per, "left").select(
        per,
        s.cast("double").alias("total"),
        q.cast("double").alias("total_squared"),
        k.cast("bigint").alias("nnz"),
        mean.alias("mean"),
        F.when(zeros, F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("hi")).alias("maximum"),
        F.when(zeros, F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("lo")).alias("minimum"),
        variance.alias("variance"),
        F.sqrt(variance).alias("stdev"),
        normalized_variance(variance, mean).alias("normalized_variance"),
        F.when(F.col("p") == n, F.exp("g")).otherwise(F.lit(0.0)).alias("geomean"),
    )


def normalized_variance(variance: Column, mean: Column, zero_value: float = 1.0) -> Column:
    return F.when(mean == 0, F.lit(zero_value)).otherwise(F.try_divide(variance, mean))


def nan_reduce_per(values: DataFrame, per: str) -> DataFrame:
    """nanmean, nanmax, nanmin of explicit values; NaN and NULL are ignored."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return values.groupBy(per).agg(F.avg(v).alias("nanmean"), F.max(v).alias("nanmax"), F.min(v).alias("nanmin"))


def nan_whole(values: DataFrame) -> DataFrame:
    """One row: nanmean, nanmax, nanmin of all explicit values; NaN and NULL are ignored, and of nothing all three are NULL."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return values.agg(F.avg(v).alias("nanmean"), F.max(v).alias("nanmax"), F.min(v).alias("nanmin"))


def values_at_ranks(layer: DataFrame, axis: DataFrame, per: str, n: int, ranks: dict[str, int]) -> DataFrame:
    """Values at ascending 0-based ranks, zeros included: the zeros lie between negative and positive values."""
    order = Window.partitionBy(per).orderBy("value", other(per))
    ranked = layer.where("value != 0").select(per, "value", (F.row_number().over(order) - 1).alias("i"))
    counts = F.count_if(F.col("value") < 0).over(Window.partitionBy(per)), F.count("*").over(Window.partitionBy(per))
    ranked = ranked.withColumn("neg", counts[0]).withColumn("zeros", n - counts[1])
    at = lambda r: F.when(F.lit(r) < F.col("neg"), F.lit(r)).when(F.lit(r) >= F.col("neg") + F.col("zeros"), F.lit(r) - F.col("zeros"))
    found = ranked.groupBy(per).agg(*[F.max(F.when(F.col("i") == at(r), F.col("value"))).alias(name) for name, r in ranks.items()])
    return axis.select(per).join(found, per, "left").select(per, *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ranks])


def quantiles_per(layer: DataFrame, axis: DataFrame, per: str, n: int, quantiles: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, zeros included."""
    ranks, parts = {}, []
    for name, q in quantiles.items():
        at = q * (n - 1)
        low = int(at)
        ranks[f"{name}_lo"], ranks[f"{name}_hi"] = low, min(low + 1, n - 1)
        parts.append((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (at - low)).alias(name))
    return values_at_ranks(layer, axis, per, n, ranks).select(per, *parts)


def median_per(layer: DataFrame, axis: DataFrame, per: str, n: int) -> DataFrame:
    return quantiles_per(layer, axis, per, n, {"median": 0.5})


def fraction_per(layer: DataFrame, axis: DataFrame, per: str) -> DataFrame:
    """Each member's share of the grand total."""
    sums = layer.groupBy(per).agg(F.sum("value").alias("s"))
    total = sums.groupBy().agg(F.sum("s").alias("all"))
    return axis.select(per).join(sums, per, "left").crossJoin(F.broadcast(total)).select(  # one row
        per, F.coalesce(F.try_divide("s", "all"), F.lit(0.0)).alias("fraction")
    )


def fraction_by(layer: DataFrame, by: str) -> DataFrame:
    """Entries divided by the sum of their row (by obs_id) or column; sums of zero give none."""
    sums = layer.groupBy(by).agg(F.sum("value").alias("s")).where("s != 0")
    return layer.join(sums, by).select("obs_id", "var_id", (F.col("value") / F.col("s")).alias("value"))


def scale_by(layer: DataFrame, scale: DataFrame, by: str, column: str) -> DataFrame:
    """Entries times the element of their row or column in scale(by, column)."""
    return layer.join(scale.select(by, column), by).select("obs_id", "var_id", (F.col("value") * F.col(column)).alias("value"))


def whole(layer: DataFrame, n_obs: int, n_vars: int) -> DataFrame:
    """One row: total, nnz, mean, maximum, minimum of the whole matrix, zeros included."""
    cells = n_obs * n_vars
    full = F.count_if(F.col("value") != 0) == cells
    hi, lo = F.max("value"), F.min("value")
    zero = F.lit(0.0)
    return layer.agg(
        F.coalesce(F.sum("value"), zero).alias("total"),
        F.count_if(F.col("value") != 0).alias("nnz"),
        (F.coalesce(F.sum("value"), zero) / cells).alias("mean"),
        F.when(full, hi).otherwise(F.greatest(F.coalesce(hi, zero), zero)).alias("maximum"),
        F.when(full, lo).otherwise(F.least(F.coalesce(lo, zero), zero)).alias("minimum"),
    )


def bincount(values: DataFrame, column: str, least: int = 0) -> DataFrame:
    """bin, count of non-negative integers; bins from 0 to the largest value or least - 1 are all there."""
    spark = values.sparkSession
    found = values.groupBy(F.col(column).cast("bigint").alias("bin")).agg(F.count("*").alias("count"))
    top = found.agg(F.max("bin")).first()[0]
    bins = spark.range(max(least, -1 if top is None else top + 1)).withColumnRenamed("id", "bin")
    return bins.join(found, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def folds_and_aurocs(
    layer: DataFrame, obs: DataFrame, var: DataFrame, subset: DataFrame, normalization: float, scale: DataFrame | None = None
) -> DataFrame:
    """var_id, fold, auroc of each variable for the observations in subset(obs_id) against the rest: the ratio of the two
    means (plus normalization) and the chance that a member exceeds another, ties counting half (from mid-ranks; zeros
    share one rank, so they are counted and not listed). An empty subset has auroc 0, an empty rest 1."""
    flags = obs.select("obs_id").join(subset.select("obs_id", F.lit(1).alias("f")), "obs_id", "left")
    flags = flags.select("obs_id", (F.coalesce("f", F.lit(0)) == 1).alias("inside"))
    n_in, n = flags.agg(F.count_if("inside"), F.count("*")).first()
    n_out = n - n_in
    if scale is not None:
        layer = layer.join(scale, "obs_id").select("obs_id", "var_id", F.try_divide("value", "scale").alias("value"))
    marked = layer.where("value != 0").join(flags, "obs_id")
    ties = marked.groupBy("var_id", "value").agg(F.count_if("inside").alias("a"), F.count_if(~F.col("inside")).alias("b"))
    zero = ties.groupBy("var_id").agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).select(
        "var_id", F.lit(0.0).alias("value"), (n_in - F.col("na")).alias("a"), (n_out - F.col("nb")).alias("b")
    )
    below = Window.partitionBy("var_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    wins = ties.union(zero).withColumn("lower", F.coalesce(F.sum("b").over(below), F.lit(0)))
    scored = wins.groupBy("var_id").agg(
        F.sum(F.col("a") * (F.col("lower") + F.col("b") / 2)).alias("won"),
        F.sum(F.col("value") * F.col("a")).alias("s_in"),
        F.sum(F.col("value") * F.col("b")).alias("s_out"),
    )
    mean = lambda s, k: F.coalesce(F.col(s), F.lit(0.0)) / k if k else F.lit(0.0)
    auroc = F.lit(0.0) if not n_in else F.lit(1.0) if not n_out else F.coalesce(F.col("won"), F.lit(n_in * n_out / 2)) / (n_in * n_out)
    fold = F.try_divide(mean("s_in", n_in) + normalization, mean("s_out", n_out) + normalization)
    return var.select("var_id").join(scored, "var_id", "left").select("var_id", fold.alias("fold"), auroc.alias("auroc"))
