"""Projection of query groups onto an annotated atlas: weights, fractions, corrections, types."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.dense import represent
from lattica.operators import convey, marginals, quality, similarity


def candidates(atlas: DataFrame, atlas_obs: DataFrame, query: DataFrame, query_obs: DataFrame, var: DataFrame, count: int = 50, regularization: float = 1e-5) -> DataFrame:
    """src (query), dst (atlas), place: the atlas members with the most correlated log fractions, the anchor first."""
    mine = quality.log_fractions(query, query_obs, var, regularization)
    theirs = quality.log_fractions(atlas, atlas_obs, var, regularization)
    return similarity.top_across(mine, query_obs, theirs, atlas_obs, var, count).select("src", "dst", "place")


def weights(atlas: DataFrame, atlas_obs: DataFrame, query: DataFrame, query_obs: DataFrame, var: DataFrame, log: bool = True, regularization: float = 1e-5, least_umis: float = 40, most_fold: float = 2.0, count: int = 50, least_share: float = 1 / 3, least_weight: float = 1e-5) -> DataFrame:
    """src (query), dst (atlas), weight. Each query member has its own task of at most `count` candidates: those whose
    log fractions are off the anchor's by more than the fold (for variables with enough in both; those without any are no
    candidates) are dropped, the worst first, down to a third of `count`; what is left represents the member by least squares on the simplex."""
    # a candidate without a significant variable gives its place to the next
    near = candidates(atlas, atlas_obs, query, query_obs, var, 2 * count, regularization)
    codes = cut(similarity.numbered(atlas.select("var_id").union(query.select("var_id")), "var_id"), atlas.sparkSession)

    def rows(x: DataFrame, name: str) -> DataFrame:
        # a list of numbers and one of values, as an atlas row goes to each query member that it is a candidate of
        cells = similarity.packed(x.join(codes, "var_id"), x.select("obs_id").distinct(), ["obs_id"], ["value"])
        return cells.select(F.col("obs_id").alias(name), F.col("value.v").alias("v"), F.col("value.x").alias("x"))

    theirs, mine = near.join(rows(atlas, "dst"), "dst"), rows(query, "src")
    kinds = dict(query_obs.dtypes)["obs_id"], dict(atlas_obs.dtypes)["obs_id"]

    def run(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(own):
            return pd.DataFrame(columns=["src", "dst", "weight"], dtype=object)
        part = part.sort_values("place")
        numbers, values = ([*part[c], own[c].iloc[0]] for c in ("v", "x"))
        found = np.concatenate(numbers)
        names = np.unique(found)
        dense = np.zeros((len(numbers), len(names)))
        dense[np.repeat(np.arange(len(numbers)), [len(v) for v in numbers]), np.searchsorted(names, found)] = np.concatenate(values)
        total = dense.sum(axis=1, keepdims=True)
        fraction = dense / np.maximum(total, 1e-300)
        level = np.log2(fraction + regularization)
        enough = dense[:-1] + dense[0] >= least_umis
        live = [i for i in range(len(part)) if i == 0 or enough[i].any()][:count]
        off = np.array([np.abs(level[i] - level[0])[enough[i]].max(initial=0.0) for i in range(len(part))])
        while len(live) > max(1, count * least_share):
            worst = max(live, key=lambda i: off[i])
            if off[worst] <= most_fold:
                break
            live.remove(worst)
        data = level if log else fraction
        _, w = represent(data[-1], data[live])
        w[w < least_weight] = 0.0
        w /= w.sum()
        keep = np.flatnonzero(w)
        return pd.DataFrame({"src": part["src"].iloc[0], "dst": part["dst"].to_numpy()[[live[k] for k in keep]], "weight": w[keep]})

    return theirs.groupBy("src").cogroup(mine.groupBy("src")).applyInPandas(run, f"src {kinds[0]}, dst {kinds[1]}, weight double")


def projected_fractions(used: DataFrame, atlas_fractions: DataFrame, log: bool = True, regularization: float = 1e-5) -> DataFrame:
    """obs_id (query), var_id, value: the weighted mean of the atlas' fractions (of their logs), normalised. A weighted
    mean of logs starts from that of zeros, so only non-zeros are joined."""
    r = F.lit(regularization)
    part = F.log2(F.col("value") + r) - F.log2(r) if log else F.col("value")
    sums = used.join(atlas_fractions.withColumnRenamed("obs_id", "dst"), "dst").groupBy(F.col("src").alias("obs_id"), "var_id").agg(
        F.sum(F.col("weight") * part).alias("s")
    )
    value = F.pow(F.lit(2.0), F.col("s") + F.log2(r)) - r if log else F.col("s")
    return marginals.fraction_by(sums.select("obs_id", "var_id", F.greatest(value, F.lit(0.0)).alias("value")).where("value > 0"), "obs_id")


def correction_factors(query: DataFrame, projected: DataFrame, query_obs: DataFrame, var: DataFrame, least_correlation: float = 0.8, least_factor: float = 0.15) -> DataFrame:
    """var_id, factor: the ratio of mean projected to mean query fractions, for variables that correlate well but whose
    ratio is off by more than the least factor; 1 for all others."""
    n = query_obs.count()
    r = similarity.aligned_pearson(query, projected, var, "var_id", n)
    a = query.groupBy("var_id").agg(F.sum("value").alias("a"))
    b = projected.groupBy("var_id").agg(F.sum("value").alias("b"))
    ratio = F.try_divide("b", "a")
    off = (F.col("correlation") >= least_correlation) & ((ratio > 1 + least_factor) | (ratio < 1 / (1 + least_factor)))
    return r.join(a, "var_id", "left").join(b, "var_id", "left").select("var_id", F.when(off, ratio).otherwise(F.lit(1.0)).alias("factor"))


def corrected(query: DataFrame, factors: DataFrame) -> DataFrame:
    """Fractions times the factors, normalised."""
    return marginals.fraction_by(marginals.scale_by(query, factors, "var_id", "factor"), "obs_id")


def range_overlaps(query: DataFrame, projected: DataFrame, query_obs: DataFrame, var: DataFrame, regularization: float = 1e-5, quantile: float = 0.02, least: float = 0.5) -> DataFrame:
    """var_id, overlaps: whether the middle ranges of the log fractions of query and projection share at least `least` of the
    query's own range; a range of zero counts as one."""
    n = query_obs.count()
    bounds = {}
    base = math.log2(regularization)
    for name, x in (("a", query), ("b", projected)):
        # logs above that of a zero, so that zeros stay implicit
        logs = x.withColumn("value", F.log2(F.col("value") + regularization) - base)
        found = marginals.quantiles_per(logs, var, "var_id", n, {"lo": quantile, "hi": 1 - quantile})
        bounds[name] = found.select("var_id", *[F.col(c).alias(f"{name}_{c}") for c in ("lo", "hi")])
    joined = bounds["a"].join(bounds["b"], "var_id")
    common = F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")
    own = F.col("a_hi") - F.col("a_lo")
    return joined.select("var_id", (common / F.when(own == 0, 1.0).otherwise(own) >= least).alias("overlaps"))


def misfit_variables(folds: DataFrame, types: DataFrame, var: DataFrame, most_fold: float = 3.0, noisy_fold: float = 2.0, least_share: float = 0.5) -> DataFrame:
    """type, var_id of variables whose (signed) fold is too high in at least that share of the type's members."""
    noisy = F.coalesce(F.col("noisy_gene").cast("boolean"), F.lit(False)) if "noisy_gene" in var.columns else F.lit(False)
    sizes = types.groupBy("type").agg(F.count("*").alias("n"))
    marked = folds.join(var.select("var_id", noisy.alias("noisy")), "var_id").join(types, "obs_id")
    high = F.count_if(F.col("value") > F.lit(most_fold) + F.when(F.col("noisy"), noisy_fold).otherwise(0.0))
    return marked.groupBy("type", "var_id").agg(high.alias("k")).join(sizes, "type").where(F.col("k") >= least_share * F.col("n")).where("k > 0").select("type", "var_id")


def least_essential(typed_mask: DataFrame, fraction: float = 0.75) -> DataFrame:
    """type, other, least: how many essential variables of a type, or of two types together, must fit."""
    essential = typed_mask.where("mask").select("type", "var_id")
    counts = essential.groupBy("type").agg(F.count("*").alias("n"))
    both = essential.join(essential.withColumnRenamed("type", "other"), "var_id").groupBy("type", "other").agg(F.count("*").alias("shared"))
    pairs = counts.join(counts.select(F.col("type").alias("other"), F.col("n").alias("m")), F.col("type") <= F.col("other"))
    union = pairs.join(both, ["type", "other"], "left").withColumn("u", F.when(F.col("type") == F.col("other"), F.col("n")).otherwise(F.col("n") + F.col("m") - F.coalesce("shared", F.lit(0))))
    return union.select("type", "other", F.ceil(F.col("u") * fraction).alias("least"))


def project(atlas: DataFrame, atlas_obs: DataFrame, query: DataFrame, query_obs: DataFrame, var: DataFrame, type_name: str = "type", rounds: int = 3) -> dict[str, DataFrame]:
    """The whole projection: corrections and range filter in a few rounds, weights, projected fractions and folds, types,
    variables that misfit their type, verdicts, and a second anchor for members that are not similar.

    Returns weights, factors, fitted, projected_fraction, projected_fold, projected_type, misfit, similar, correlation."""
    spark = atlas.sparkSession
    query_fractions, atlas_fractions = marginals.fraction_by(query, "obs_id"), marginals.fraction_by(atlas, "obs_id")
    fitted = var.select("var_id")
    factors = var.select("var_id", F.lit(1.0).alias("factor"))
    for _ in range(rounds):
        now = cut(corrected(query_fractions, factors), spark)
        inside = now.join(fitted, "var_id", "left_semi")
        used = cut(weights(atlas.join(fitted, "var_id", "left_semi"), atlas_obs, query.join(fitted, "var_id", "left_semi"), query_obs, fitted), spark)
        projected = cut(projected_fractions(used, atlas_fractions), spark)
        more = correction_factors(inside, projected, query_obs, fitted).withColumnRenamed("factor", "more")
        changed = more.where("more != 1").take(1)
        factors = cut(factors.join(more, "var_id", "left").select("var_id", (F.col("factor") * F.coalesce("more", F.lit(1.0))).alias("factor")), spark)
        good = cut(range_overlaps(inside, projected, query_obs, fitted).where("overlaps").select("var_id"), spark)
        dropped = fitted.join(good, "var_id", "left_anti").take(1)
        if good.take(1):
            fitted = good
        if not changed and not dropped:
            break
    now = cut(corrected(query_fractions, factors), spark)
    totals = query.groupBy("obs_id", "var_id").agg(F.sum("value").alias("value"))
    folds = cut(quality.projected_folds(now, projected, totals), spark)
    types = convey.atlas_to_query(used, atlas_obs, type_name)
    misfit = misfit_variables(folds, types.withColumnRenamed(type_name, "type"), var)
    left = folds.join(types, "obs_id").join(misfit.withColumnRenamed("type", type_name), [type_name, "var_id"], "left_anti").select("obs_id", "var_id", "value")
    verdicts = quality.similar_verdicts(left, query_obs, var)
    second = second_types(used, atlas_obs, types, verdicts, type_name)
    return {
        "weights": used, "factors": factors, "fitted": fitted, "projected_fraction": projected, "projected_fold": folds,
        "projected_type": types.join(second, "obs_id", "left"), "misfit": misfit, "similar": verdicts,
        "correlation": similarity.aligned_pearson(now, projected, query_obs, "obs_id", var.count()),
    }


def second_types(used: DataFrame, atlas_obs: DataFrame, types: DataFrame, verdicts: DataFrame, type_name: str) -> DataFrame:
    """obs_id, secondary: for members that are not similar, the type with the highest weight besides their own."""
    rest = used.join(atlas_obs.select(F.col("obs_id").alias("dst"), F.col(type_name).alias("t")), "dst").withColumnRenamed("src", "obs_id")
    rest = rest.join(verdicts.where(~F.col("similar")).select("obs_id"), "obs_id", "left_semi").join(types, "obs_id").where(F.col("t") != F.col(type_name))
    from lattica.operators.grouping import highest_weight

    return highest_weight(rest, "obs_id", "weight", "t").withColumnRenamed("t", "secondary")


def cut(df: DataFrame, spark) -> DataFrame:
    """df with its lineage cut, in the shared folder if one is named."""
    from lattica.sources.shared import checkpointed

    return checkpointed(df)
