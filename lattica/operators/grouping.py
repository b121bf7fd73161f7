"""Grouped aggregation: sums, annotations and robust profiles of groups of observations. Negative groups are outliers
and belong to none."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import dense
from lattica.operators.marginals import other


def members(obs: DataFrame, group: str) -> DataFrame:
    return obs.where(F.col(group) >= 0).select("obs_id", F.col(group).alias("group_id"))


def sum_groups(layer: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    """group_id, var_id, value."""
    return layer.join(members(obs, group), "obs_id").groupBy("group_id", "var_id").agg(F.sum("value").alias("value"))


def group_sizes(obs: DataFrame, group: str) -> DataFrame:
    """group_id, grouped."""
    return members(obs, group).groupBy("group_id").agg(F.count("*").alias("grouped"))


def majority(obs: DataFrame, group: str, value: str, least_fraction: float = 0.5, conflict=None) -> DataFrame:
    """group_id, value: the most frequent value, or `conflict` if it is held by too few; ties go to the smaller value."""
    counts = obs.where(F.col(group) >= 0).groupBy(F.col(group).alias("group_id"), value).agg(F.count("*").alias("n"))
    per = Window.partitionBy("group_id")
    ranked = counts.withColumn("all", F.sum("n").over(per)).withColumn("place", F.row_number().over(per.orderBy(F.desc("n"), value)))
    enough = F.col("n") / F.col("all") >= least_fraction
    return ranked.where("place = 1").select("group_id", F.when(enough, F.col(value)).otherwise(F.lit(conflict)).alias(value))


def unique(obs: DataFrame, group: str, value: str) -> DataFrame:
    """group_id, value of the last member (by id)."""
    return obs.where(F.col(group) >= 0).groupBy(F.col(group).alias("group_id")).agg(F.max_by(value, "obs_id").alias(value))


# aggregates of a group's values, as Columns for agg()


def most_frequent(value: Column | str) -> Column:
    """The mode; ties go to the smallest."""
    return F.mode(value, True)


def strongest(value: str, tie: str) -> Column:
    """The value of largest size; ties go to the first by `tie`."""
    return F.max_by(value, F.struct(F.abs(value), -F.col(tie)))


def weighted_mean(weight: str, value: str) -> Column:
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight))


def fraction_of(value: str, constant) -> Column:
    return F.avg((F.col(value) == F.lit(constant)).cast("double"))


def highest_weight(rows: DataFrame, group: str, weight: str, value: str) -> DataFrame:
    """group, value with the largest sum of weights; ties go to the smaller value."""
    sums = rows.groupBy(group, value).agg(F.sum(weight).alias("w"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("w"), value))
    return sums.withColumn("place", place).where("place = 1").select(group, value)


def compress(rows: DataFrame, group: str) -> DataFrame:
    """rows with the groups renumbered from 0 in their order; -1 stays."""
    from lattica.operators.ranking import positions

    new = positions(rows.where(F.col(group) >= 0).select(group).distinct(), [group]).select(group, F.col("position").cast("int").alias("compressed"))
    return rows.join(new, group, "left").withColumn(group, F.coalesce("compressed", F.lit(-1))).drop("compressed")


def group_names(obs: DataFrame, group: str, prefix: str = "M", name: str = "obs_name") -> DataFrame:
    """group_id, name: prefix, index and a two-digit checksum of the members' names."""

    @F.pandas_udf("string")
    def checksum(texts):
        return texts.map(lambda t: f"{int.from_bytes(hashlib.shake_128(t.encode()).digest(8), 'big') % 100:02d}")

    joined = (
        obs.where(F.col(group) >= 0)
        .groupBy(F.col(group).alias("group_id"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obs_id", F.col(name).cast("string").alias("n")))), lambda s: s["n"]), "").alias("t"))
    )
    return joined.select("group_id", F.concat(F.lit(prefix), F.col("group_id").cast("string"), F.lit("."), checksum("t")).alias("name"))


def profile(layer: DataFrame, obs: DataFrame, group: str, regularization: float = 1 / 16) -> DataFrame:
    """group_id, var_id, value: the robust profile, a weighted geometric mean of the members' fractions.

    Member i with total u has weight log2(u) and regularisation c / u. The mean over all members of ln(fraction +
    regularisation) is that of the zeros for every member, corrected for the non-zeros, so only these are read. The
    regularisation's own mean is taken off and the profile is normalised. Groups without weight have none."""
    joined = layer.join(members(obs, group), "obs_id")
    totals = layer.groupBy("obs_id").agg(F.sum("value").alias("u")).where("u > 0").join(members(obs, group), "obs_id")
    totals = totals.withColumn("w", F.log2("u")).withColumn("r", F.lit(regularization) / F.col("u"))
    bases = totals.groupBy("group_id").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.ln("r")).alias("b"))
    entries = joined.join(totals.select("obs_id", "u", "w", "r"), "obs_id")
    sums = entries.groupBy("group_id", "var_id").agg(
        F.sum(F.col("w") * (F.ln(F.col("value") / F.col("u") + F.col("r")) - F.ln("r"))).alias("d")
    )
    raw = sums.join(bases, "group_id").where("sw > 0").select(
        "group_id", "var_id", F.greatest(F.exp((F.col("b") + F.col("d")) / F.col("sw")) - F.exp(F.col("b") / F.col("sw")), F.lit(0.0)).alias("g")
    )
    norm = raw.groupBy("group_id").agg(F.sum("g").alias("all"))
    return raw.join(norm, "group_id").select("group_id", "var_id", F.try_divide("g", "all").alias("value")).where("value > 0")


def binned(layer: DataFrame, per: str, bound: float, fill: bool = False) -> DataFrame:
    """obs_id, var_id, bin: each row's (or column's) entries in bins of at most `bound`, or, with fill, of at least `bound`.
    A task has one row or column, whose entries are bounded by the other axis."""
    far = other(per)
    kinds = dict(layer.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(far, kind="stable")
        sizes = part["value"].tolist()
        return part[[per, far]].assign(bin=dense.bin_fill(sizes, bound) if fill else dense.bin_pack(sizes, bound))

    return layer.groupBy(per).applyInPandas(run, f"{per} {kinds[per]}, {far} {kinds[far]}, bin int")
