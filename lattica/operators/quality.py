"""Distinctness and quality statistics of observations, groups and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators import grouping, marginals, ranking, similarity, sparse
from lattica.sources.shared import checkpointed


def expected_fractions(layer: DataFrame, var: DataFrame) -> DataFrame:
    """var_id, e: each variable's share of the grand total."""
    return marginals.fraction_per(layer, var, "var_id").withColumnRenamed("fraction", "e")


def _fold(fraction: Column, normalization: float) -> Column:
    """log2 of a fraction over the expected one (both plus normalization); without an expected one, 0."""
    return F.when(F.col("e") == 0, F.lit(0.0)).otherwise(F.log2((fraction + normalization) / (F.col("e") + normalization)))


def distinct_folds(layer: DataFrame, obs: DataFrame, var: DataFrame, normalization: float) -> DataFrame:
    """obs_id, var_id, value: log2 of each fraction over the variable's overall fraction (both plus normalization);
    variables without any total have 0. One row for each pair, zeros included, unless normalization is 0: then a zero
    has no finite fold and no row. top_distinct() finds the largest without a row for each pair."""
    expected = expected_fractions(layer, var)
    if not normalization:
        return _entry_folds(layer, expected, normalization)
    rows = layer.groupBy("obs_id").agg(F.sum("value").alias("r"))
    cells = obs.select("obs_id").join(rows, "obs_id", "left").crossJoin(expected).join(layer, ["obs_id", "var_id"], "left")
    f = F.coalesce(F.try_divide("value", "r"), F.lit(0.0))
    return cells.select("obs_id", "var_id", _fold(f, normalization).alias("value"))


def _entry_folds(layer: DataFrame, expected: DataFrame, normalization: float, *more: str) -> DataFrame:
    rows = layer.groupBy("obs_id").agg(F.sum("value").alias("r"))
    f = F.coalesce(F.try_divide("value", "r"), F.lit(0.0))
    return layer.join(rows, "obs_id").join(expected, "var_id").select("obs_id", "var_id", _fold(f, normalization).alias("value"), *more)


def top_distinct(layer: DataFrame, obs: DataFrame, var: DataFrame, normalization: float, count: int = 20) -> DataFrame:
    """obs_id, rank, var_id, value: the `count` variables with the largest absolute distinct_folds() of each observation,
    ties to the smaller id. A zero's fold depends on its variable only, so the variables are put in the order of it once,
    and an observation's own zeros are the first places there that it does not hold: rows grow with the non-zeros."""
    expected = expected_fractions(layer, var)
    if not normalization:
        return ranking.distinct_variables(_entry_folds(layer, expected, normalization), count)
    zeros = expected.withColumn("zero", _fold(F.lit(0.0), normalization)).withColumn("order", -F.abs("zero"))
    placed = checkpointed(ranking.positions(zeros, ["order", "var_id"]))
    entries = _entry_folds(layer, placed, normalization, "position")
    missing = sparse.first_missing(obs.select("obs_id", F.lit(var.count()).alias("n")), entries, ["obs_id"], count)
    of_zeros = missing.join(placed, "position").select("obs_id", "var_id", F.col("zero").alias("value"))
    return ranking.distinct_variables(entries.drop("position").join(obs.select("obs_id"), "obs_id", "left_semi").unionByName(of_zeros), count)


def stdev_logs(layer: DataFrame, obs: DataFrame, group: str, least: float = 40) -> DataFrame:
    """group_id, var_id, value: over the members, the deviation of log2 of the fraction of value + 1 among the variables
    with a group total over `least`. A member without the variable has -log2 of its own denominator, so those are known
    from sums over members."""
    joined = layer.join(grouping.members(obs, group), "obs_id")
    totals = joined.groupBy("group_id", "var_id").agg(F.sum("value").alias("t")).where(F.col("t") > least)
    kept = totals.groupBy("group_id").agg(F.count("*").alias("k"))
    entries = joined.join(totals.select("group_id", "var_id"), ["group_id", "var_id"])
    sums = entries.groupBy("group_id", "obs_id").agg(F.sum("value").alias("x"))
    cells = grouping.members(obs, group).join(kept, "group_id").join(sums, ["group_id", "obs_id"], "left")
    cells = cells.select("group_id", "obs_id", F.log2(F.col("k") + F.coalesce("x", F.lit(0.0))).alias("d"))
    bases = cells.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("d").alias("sd"), F.sum(F.col("d") * F.col("d")).alias("qd"))
    part = entries.join(cells, ["group_id", "obs_id"]).withColumn("l", F.log2(F.col("value") + 1))
    found = part.groupBy("group_id", "var_id").agg(F.sum("l").alias("sl"), F.sum(F.col("l") * F.col("l") - 2 * F.col("l") * F.col("d")).alias("ql"))
    s, q, n = F.col("sl") - F.col("sd"), F.col("ql") + F.col("qd"), F.col("n")
    return found.join(bases, "group_id").select("group_id", "var_id", F.sqrt(F.greatest((q - s * s / n) / n, F.lit(0.0))).alias("value"))


def deviant_folds(layer: DataFrame, obs: DataFrame, profiles: DataFrame, group_totals: DataFrame, group: str, similar: DataFrame | None = None, least: float = 40) -> DataFrame:
    """obs_id, var_id, value: log2 of each value + 1 over the value that the group's profile expects + 1, for variables
    with enough in the group. Outliers take the group in similar(obs_id, group_id), if given, and count their own values
    (plus one) towards `least`."""
    own = grouping.members(obs, group).withColumn("outlier", F.lit(False))
    if similar is not None:
        outliers = obs.where(F.col(group) < 0).select("obs_id").join(similar, "obs_id")
        own = own.union(outliers.select("obs_id", "group_id", F.lit(True)))
    totals = layer.groupBy("obs_id").agg(F.sum("value").alias("u"))
    expected = group_totals.withColumnRenamed("value", "t").join(profiles.withColumnRenamed("value", "f"), ["group_id", "var_id"], "left")
    cells = own.join(totals, "obs_id").join(expected, "group_id").join(layer, ["obs_id", "var_id"], "left")
    x, f = F.coalesce("value", F.lit(0.0)), F.coalesce("f", F.lit(0.0))
    enough = F.when(F.col("outlier"), x + 1 + F.col("t")).otherwise(F.col("t")) >= least
    fold = F.log2(x + 1) - F.log2(F.col("u") * f + 1)
    return cells.where(enough).select("obs_id", "group_id", "var_id", fold.alias("value"), "outlier")


def inner_folds(layer: DataFrame, obs: DataFrame, profiles: DataFrame, group_totals: DataFrame, group: str, least: float = 40) -> DataFrame:
    """group_id, var_id, value: the members' deviant_folds() of largest size, with its sign (of +x and -x, +x).

    A member without the variable has -log2(total * expected + 1), which is largest for the largest total. So the members
    are ranked by their totals, and the first rank that does not hold the variable stands for all zeros."""
    falling = Window.partitionBy("group_id").orderBy(F.desc("u"), "obs_id")
    totals = layer.groupBy("obs_id").agg(F.sum("value").alias("u"))
    members = grouping.members(obs, group).join(totals, "obs_id")
    members = checkpointed(members.withColumn("position", (F.row_number().over(falling) - 1).cast("bigint")))
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n"))
    expected = group_totals.where(F.col("value") >= least).select("group_id", "var_id")
    expected = expected.join(profiles.withColumnRenamed("value", "f"), ["group_id", "var_id"], "left").fillna({"f": 0.0})
    expected = checkpointed(expected.join(sizes, "group_id"))
    keys = ["group_id", "var_id"]
    held = layer.join(members, "obs_id").join(expected.select(*keys, "f"), keys)
    fold = F.log2(F.col("value") + 1) - F.log2(F.col("u") * F.col("f") + 1)
    most = held.groupBy(*keys).agg(F.max_by(fold, F.struct(F.abs(fold), fold)).alias("entry"))
    missing = sparse.first_missing(expected, held, keys).join(members.select("group_id", "position", "u"), ["group_id", "position"])
    both = expected.join(most, keys, "left").join(missing.select(*keys, "u"), keys, "left").withColumn("zero", -F.log2(F.col("u") * F.col("f") + 1))
    larger = F.col("entry").isNull() | (F.abs("zero") > F.abs("entry"))
    return both.select(*keys, F.when(larger, F.col("zero")).otherwise(F.col("entry")).alias("value"))


def significant_inner_folds(folds: DataFrame, var: DataFrame, least: float = 3.0) -> DataFrame:
    """var_id, count of groups whose (signed) inner fold reaches `least`."""
    counts = folds.groupBy("var_id").agg(F.count_if(F.col("value") >= least).alias("n"))
    return var.select("var_id").join(counts, "var_id", "left").select("var_id", F.coalesce("n", F.lit(0)).alias("count"))


def log_fractions(layer: DataFrame, obs: DataFrame, var: DataFrame, regularization: float) -> DataFrame:
    """obs_id, var_id, value: log2(fraction + regularization) less that of a zero, so that zeros stay implicit (the shift
    is the same for all and changes no correlation)."""
    fractions = marginals.fraction_by(layer, "obs_id")
    return fractions.select("obs_id", "var_id", (F.log2(F.col("value") + regularization) - F.log2(F.lit(regularization))).alias("value"))


def outlier_matches(layer: DataFrame, obs: DataFrame, var: DataFrame, group_layer: DataFrame, groups: DataFrame, group: str, regularization: float = 1e-5) -> DataFrame:
    """obs_id, group_id: for each outlier the group of the most correlated log fractions."""
    outliers = obs.where(F.col(group) < 0).select("obs_id")
    mine = log_fractions(layer.join(outliers, "obs_id", "left_semi"), outliers, var, regularization)
    named = group_layer.withColumnRenamed("group_id", "obs_id")
    theirs = log_fractions(named, groups, var, regularization)
    near = similarity.top_across(mine, outliers, theirs, groups.select(F.col("group_id").alias("obs_id")), var, 1)
    return near.select(F.col("src").alias("obs_id"), F.col("dst").alias("group_id"))


def type_normalized_variances(layer: DataFrame, obs: DataFrame, group: str, types: DataFrame, quantile: float = 0.95) -> DataFrame:
    """type, var_id, value: over the groups of a type (types(group_id, type)), the quantile of the members' normalised
    variance of fractions times their median total."""
    own = grouping.members(obs, group)
    totals = layer.groupBy("obs_id").agg(F.sum("value").alias("u")).join(own, "obs_id")
    sizes = totals.groupBy("group_id").agg(F.count("*").alias("n"), F.percentile("u", 0.5).alias("m"))
    fractions = layer.join(totals.where("u > 0"), "obs_id").withColumn("f", F.col("value") / F.col("u"))
    sums = fractions.groupBy("group_id", "var_id").agg(F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("q"))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    per = sums.join(sizes, "group_id").select(
        "group_id", "var_id", (F.greatest((q - s * s / n) / n, F.lit(0.0)) / (s / n) * F.col("m")).alias("v")
    )
    return per.join(types, "group_id").groupBy("type", "var_id").agg(F.percentile("v", quantile).alias("value"))


def projected_folds(corrected: DataFrame, projected: DataFrame, totals: DataFrame, regularization: float = 1e-5, least: float = 40) -> DataFrame:
    """obs_id, var_id, value: log2 of the corrected over the projected fraction where totals (query + atlas) are enough."""
    both = corrected.withColumnRenamed("value", "a").join(projected.withColumnRenamed("value", "b"), ["obs_id", "var_id"], "full")
    both = both.join(totals.withColumnRenamed("value", "t").where(F.col("t") >= least), ["obs_id", "var_id"])
    fold = F.log2(F.coalesce("a", F.lit(0.0)) + regularization) - F.log2(F.coalesce("b", F.lit(0.0)) + regularization)
    return both.select("obs_id", "var_id", fold.alias("value"))


def similar_verdicts(folds: DataFrame, obs: DataFrame, var: DataFrame, most_fold: float = 3.0, noisy_fold: float = 2.0, most_misfits: int = 3, essential: DataFrame | None = None, least_essential: int | None = None, fitted: str | None = None) -> DataFrame:
    """obs_id, misfits, similar: few enough variables with a large fold and, if asked, enough essential ones that fit.
    Noisy variables (noisy_gene of var) are allowed more."""
    noisy = F.coalesce(F.col("noisy_gene").cast("boolean"), F.lit(False)) if "noisy_gene" in var.columns else F.lit(False)
    chosen = var if fitted is None else var.where(F.col(fitted))
    marked = folds.join(chosen.select("var_id", noisy.alias("noisy")), "var_id")
    misfit = F.abs("value") > F.lit(most_fold) + F.when(F.col("noisy"), noisy_fold).otherwise(0.0)
    counted = marked.groupBy("obs_id").agg(F.count_if(misfit).alias("misfits"))
    out = obs.select("obs_id").join(counted, "obs_id", "left").select("obs_id", F.coalesce("misfits", F.lit(0)).alias("misfits"))
    good = F.col("misfits") <= most_misfits
    if essential is not None and least_essential:
        bad = marked.where(misfit).select("obs_id", "var_id").join(essential.select("var_id").distinct(), "var_id").groupBy("obs_id").agg(F.count("*").alias("bad"))
        count = essential.select("var_id").distinct().count()
        out = out.join(bad, "obs_id", "left")
        good = good & (count - F.coalesce("bad", F.lit(0)) >= least_essential)
    return out.select("obs_id", "misfits", good.alias("similar"))
