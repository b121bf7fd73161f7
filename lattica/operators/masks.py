"""Masks of observations and variables: by name, by statistics, by expression; slices by masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.dataset import MAIN, Dataset
from lattica.operators import marginals, ranking


def names_match(name: Column, names: list[str] | None = None, patterns: list[str] | None = None, invert: bool = False) -> Column:
    """Whether a name is in a list or matches one of the patterns as a whole, in either case of letters."""
    match = F.lit(False)
    if names:
        match = match | F.lower(name).isin([n.lower() for n in names])
    for p in patterns or []:
        match = match | F.rlike(name, F.lit(f"^(?i:(?:{p}))$"))
    return ~match if invert else match


def mark_variables(
    data: Dataset, to: str, names: list[str] | None = None, patterns: list[str] | None = None, op: str = "set",
    invert: bool = False, name: str = "var_name",
) -> Dataset:
    """Sets a mask of variables by name, or adds to it or removes from it. Lateral, noisy, selected and ignored variables
    are masks under these names."""
    column = F.col(name if name in data.var.columns else "var_id").cast("string")
    match = names_match(column, names, patterns, invert)
    old = F.coalesce(F.col(to), F.lit(False)) if to in data.var.columns else F.lit(False)
    new = {"set": match, "add": old | match, "remove": old & ~match}[op]
    return data.with_var(data.var.select("var_id", new.alias(to)))


def mark_by_type(var: DataFrame, names: dict[str, list[str]] | None = None, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """var_id, type, mask: essential or ignored variables of each type, long."""
    types = sorted({*(names or {}), *(patterns or {})})
    column = F.col("var_name" if "var_name" in var.columns else "var_id").cast("string")
    rows = [F.struct(F.lit(t).alias("type"), names_match(column, (names or {}).get(t), (patterns or {}).get(t)).alias("mask")) for t in types]
    if not rows:
        return var.select("var_id", F.lit("").alias("type"), F.lit(False).alias("mask")).limit(0)
    return var.select("var_id", F.explode(F.array(*rows)).alias("r")).select("var_id", "r.type", "r.mask").where("mask")


def combine(columns: list[str], masks: list[str], invert: bool = False) -> Column:
    """Masks folded from left to right: "&name", "|name", "~" negates, a final "?" allows that the mask is not there.
    Numbers count as true if positive."""
    result: Column | None = None
    for text in masks:
        op, rest = (text[0], text[1:]) if text[0] in "&|" else ("&", text)
        negate, rest = rest.startswith("~"), rest.removeprefix("~")
        optional, name = rest.endswith("?"), rest.removesuffix("?")
        if name not in columns:
            if optional:
                continue
            raise KeyError(f"no mask {name!r}")
        value = F.coalesce(F.col(name).cast("double") > 0, F.lit(False))
        value = ~value if negate else value
        result = value if result is None else (result & value if op == "&" else result | value)
    if result is None:
        raise ValueError("no mask to combine")
    return ~result if invert else result


def filter_data(data: Dataset, obs_masks: list[str] = (), var_masks: list[str] = (), invert_obs: bool = False, invert_var: bool = False, track: str | None = None) -> Dataset | None:
    """The slice that the masks leave; None if nothing is left on an axis."""
    obs = data.obs.where(combine(data.obs.columns, list(obs_masks), invert_obs)) if obs_masks else None
    var = data.var.where(combine(data.var.columns, list(var_masks), invert_var)) if var_masks else None
    cut = data.keep(obs, var, track)
    return None if not cut.obs.take(1) or not cut.var.take(1) else cut


def high_total(layer: DataFrame, var: DataFrame, n: int, least: float) -> DataFrame:
    return marginals.reduce_per(layer, var, "var_id", n).select("var_id", (F.col("total") >= least).alias("high_total"))


def high_top(layer: DataFrame, var: DataFrame, n: int, top: int, least: float) -> DataFrame:
    """Variables whose (top + 1)-th largest value is high enough."""
    found = marginals.values_at_ranks(layer, var, "var_id", n, {"v": max(n - top - 1, 1)})
    return found.select("var_id", (F.col("v") >= least).alias("high_top"))


def high_fraction(layer: DataFrame, var: DataFrame, least: float = 1e-5) -> DataFrame:
    return marginals.fraction_per(layer, var, "var_id").select("var_id", (F.col("fraction") >= least).alias("high_fraction"))


def high_normalized_variance(layer: DataFrame, var: DataFrame, n: int, least: float = 2**2.5) -> DataFrame:
    return marginals.reduce_per(layer, var, "var_id", n).select(
        "var_id", (F.col("normalized_variance") >= least).alias("high_normalized_variance")
    )


def high_relative_variance(layer: DataFrame, var: DataFrame, n: int, least: float = 0.1, window: int = 100) -> DataFrame:
    return ranking.relative_variance(layer, var, "var_id", n, window).select(
        "var_id", (F.col("relative_variance") >= least).alias("high_relative_variance")
    )


def markers(layer: DataFrame, var: DataFrame, n: int, fold: float = 2.0, regularization: float = 1e-5, least: float = 1e-4) -> DataFrame:
    """Variables whose fraction gets high enough and varies enough between observations."""
    found = marginals.reduce_per(marginals.fraction_by(layer, "obs_id"), var, "var_id", n)
    spread = F.log2((F.col("maximum") + regularization) / (F.col("minimum") + regularization))
    return found.select("var_id", ((F.col("maximum") >= least) & (spread >= fold)).alias("marker"))


def excluded_umis(layer: DataFrame, data: Dataset, mask: str = "excluded_gene") -> DataFrame:
    """obs_id, excluded_umis: each observation's sum over excluded variables."""
    sums = layer.join(data.var.where(F.col(mask)).select("var_id"), "var_id", "left_semi").groupBy("obs_id").agg(F.sum("value").alias("s"))
    return data.obs.select("obs_id").join(sums, "obs_id", "left").select("obs_id", F.coalesce("s", F.lit(0.0)).alias("excluded_umis"))


def properly_sampled_obs(data: Dataset, least: float | None, most: float | None, excluded_fraction: float | None, mask: str = "excluded_gene") -> DataFrame:
    """obs_id, properly_sampled_cell: totals within bounds and few enough of them on excluded variables."""
    layer = data.layer(MAIN)
    totals = data.obs_values(MAIN, total=True)
    ok = F.lit(True)
    if least is not None:
        ok = ok & (F.col(MAIN) >= least)
    if most is not None:
        ok = ok & (F.col(MAIN) <= most)
    if excluded_fraction is not None and mask in data.var.columns:
        totals = totals.join(excluded_umis(layer, data, mask), "obs_id")
        ok = ok & (F.coalesce(F.try_divide("excluded_umis", MAIN), F.lit(0.0)) <= excluded_fraction)
    return totals.select("obs_id", ok.alias("properly_sampled_cell"))


def properly_sampled_vars(data: Dataset, least: float = 1) -> DataFrame:
    return data.var_values(MAIN, total=True).select("var_id", (F.col(MAIN) >= least).alias("properly_sampled_gene"))


def sparsify(layer: DataFrame, least_maximum: float, least_value: float, absolute: bool = False) -> DataFrame:
    """Without the small entries of variables that are small throughout."""
    v = F.abs("value") if absolute else F.col("value")
    tops = layer.groupBy("var_id").agg(F.max(v).alias("top"))
    return layer.join(tops, "var_id").where(~((F.col("top") < least_maximum) & (v < least_value))).select("obs_id", "var_id", "value")
