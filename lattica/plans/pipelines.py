"""Compositions: exclusion and clean data, variable selection, direct and divide-and-conquer grouping, collected groups,
the statistics of a viewer. A pile is the unit of distribution of the sequential algorithms; piles are bounded."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from lattica.dataset import MAIN, Dataset
from lattica.functions import dense
from lattica.operators import atlas as atlases
from lattica.operators import deviants, graph, grouping, marginals, masks, projection, quality, rare, sampling, similarity
from lattica.operators.marginals import reduce_per
from lattica.operators.ranking import positions
from lattica.sources.shared import checkpointed


@dataclass(frozen=True)
class Direct:
    """Parameters of the grouping of one pile."""

    target_size: int = 48
    least_size: int = 12
    target_umis: float = 160000
    least_samples: int = 750
    low_quantile: float = 0.05
    high_quantile: float = 0.5
    top3: float = 4
    least_total: float = 50
    relative_variance: float = 0.1
    window: int = 100
    least_genes: int = 100
    least_fold: float = 3.0
    least_k: int = 30
    seed: int = 123456


@dataclass(frozen=True)
class Piles:
    """Parameters of the dealing into piles."""

    least: int = 8000
    most: int = 24000
    groups: int = 100
    most_levels: int = 4


# exclusion -------------------------------------------------------------------------------------------------------


def bursty_lonely(data: Dataset, most_sampled: int = 10000, least_samples: int = 750, low: float = 0.5, high: float = 0.05, least_total: float = 100, least_variance: float = 2**2.5, most_similarity: float = 0.1, seed: int = 0, method: str = "abs_pearson") -> DataFrame:
    """var_id, bursty_lonely_gene: variables that vary much but correlate with no other, in a downsampled sample."""
    obs = checkpointed(sampling.sample_obs(data.obs, most_sampled, seed))
    n = obs.count()
    layer = data.layer().join(obs, "obs_id", "left_semi")
    samples = sampling.downsample_size(layer, obs, least_samples, low, high)
    layer = checkpointed(sampling.downsample(layer, samples, seed))
    stats = reduce_per(layer, data.var, "var_id", n)
    high_total = stats.where(F.col("total") >= least_total).select("var_id")
    edges = similarity.similarity(layer.join(high_total, "var_id", "left_semi"), high_total, "var_id", obs, method)
    tops = edges.groupBy(F.col("src").alias("var_id")).agg(F.max("weight").alias("top"))
    bursty = stats.join(high_total, "var_id", "left_semi").where(F.col("normalized_variance") >= least_variance).select("var_id")
    lonely = bursty.join(tops, "var_id", "left").where(F.coalesce("top", F.lit(0.0)) <= most_similarity).select("var_id", F.lit(True).alias("m"))
    return data.var.select("var_id").join(lonely, "var_id", "left").select("var_id", F.coalesce("m", F.lit(False)).alias("bursty_lonely_gene"))


def exclude_variables(data: Dataset, names: list[str] | None = None, patterns: list[str] | None = None, least_total: float = 1, bursty: bool = True, **options) -> Dataset:
    """Adds excluded_gene: named, not properly sampled, or bursty and lonely."""
    data = masks.mark_variables(data, "named_gene", names, patterns)
    data = data.with_var(masks.properly_sampled_vars(data, least_total))
    if bursty:
        data = data.with_var(bursty_lonely(data, **options))
    found = masks.combine(data.var.columns, ["named_gene", "|~properly_sampled_gene", "|bursty_lonely_gene?"])
    return data.with_var(data.var.select("var_id", found.alias("excluded_gene")))


def exclude_observations(data: Dataset, least: float, most: float, excluded_fraction: float, more: list[str] = ()) -> Dataset:
    """Adds excluded_cell: not properly sampled, or in one of more masks."""
    data = data.with_obs(masks.properly_sampled_obs(data, least, most, excluded_fraction))
    found = masks.combine(data.obs.columns, ["~properly_sampled_cell", *more])
    return data.with_obs(data.obs.select("obs_id", found.alias("excluded_cell")))


def clean(data: Dataset) -> Dataset | None:
    return masks.filter_data(data, _there(data.obs, "~excluded_cell"), _there(data.var, "~excluded_gene"), track="full_index")


def _there(axis: DataFrame, mask: str) -> list[str]:
    return [mask] if mask.lstrip("~") in axis.columns else []


# selection -------------------------------------------------------------------------------------------------------


def select_variables(data: Dataset, p: Direct = Direct()) -> tuple[DataFrame, DataFrame]:
    """(downsampled layer, var_id of the selected): a high third-largest value, a high total and a high relative variance
    in the downsampled data, not lateral. With too few of them, the bound on the relative variance falls by eighths until
    there are enough, and then is refined between the last two bounds."""
    n = data.obs.count()
    samples = sampling.downsample_size(data.layer(), data.obs, p.least_samples, p.low_quantile, p.high_quantile)
    layer = checkpointed(sampling.downsample(data.layer(), samples, p.seed))
    from lattica.operators.ranking import relative_variance

    allowed = data.var.where(masks.combine(data.var.columns, ["~lateral_gene"])) if "lateral_gene" in data.var.columns else data.var
    known = masks.high_top(layer, data.var, n, 3, p.top3).join(masks.high_total(layer, data.var, n, p.least_total), "var_id")
    known = known.where("high_top AND high_total").join(allowed.select("var_id"), "var_id", "left_semi").select("var_id")
    scores = checkpointed(relative_variance(layer, data.var, "var_id", n, p.window).join(known, "var_id", "left_semi"))
    count = lambda bound: scores.where(F.col("relative_variance") >= bound).count()
    bound, most = p.relative_variance, scores.count()
    low = high = bound
    while count(low) < min(p.least_genes, most):
        high, low = low, low - 1 / 8
    for _ in range(4 if low < high else 0):
        middle = (low + high) / 2
        low, high = (middle, high) if count(middle) >= min(p.least_genes, most) else (low, middle)
    return layer, scores.where(F.col("relative_variance") >= low).select("var_id")


# grouping --------------------------------------------------------------------------------------------------------


def similar(rows: np.ndarray) -> np.ndarray:
    """Absolute products of all pairs of rows."""
    found = rows @ rows.copy().T  # one array would take another path, with other last digits
    return np.abs(found, out=found)


def _pile_groups(part: pd.DataFrame, p: Direct) -> pd.DataFrame:
    """obs_id, candidate of one pile of long rows (obs_id, var_id, value, u)."""
    table = part.pivot(index="obs_id", columns="var_id", values="value").fillna(0.0).sort_index()
    table = table[table.columns[table.columns.notna()]]
    umis = part.groupby("obs_id")["u"].first().loc[table.index].to_numpy()
    n = len(table)
    if n <= max(3, p.least_size):
        return pd.DataFrame({"obs_id": table.index, "candidate": np.zeros(n, dtype=np.int64)})
    level = np.log2(table.to_numpy() + 1 / 7)
    flat = level.std(axis=1) == 0
    level = level - level.mean(axis=1, keepdims=True)
    norm = np.sqrt((level**2).sum(axis=1))
    norm[flat | (norm == 0)] = 1.0
    level[flat] = 0.0
    level /= norm[:, None]
    middle, tenth = max(np.median(umis), 1.0), max(np.quantile(umis, 0.1), 1.0)
    k = min(n - 1, max(round(n / p.target_size), round(2 * p.target_umis / middle), round(p.target_umis / tenth), p.least_k))
    # no name holds the similarity, or the weights, any longer than it takes
    found = dense.candidates(dense.knn_weights(similar(level), k), umis, p.target_size, p.target_umis, p.least_size, p.seed)
    return pd.DataFrame({"obs_id": table.index, "candidate": found.astype(np.int64)})


def _by_pile(rows: DataFrame, piles: DataFrame) -> GroupedData:
    """rows grouped by pile. A pile is few bytes but much work, so that the piles must not be put together in few tasks."""
    count = piles.agg(F.max("pile")).first()[0] or 0
    return rows.repartition(min(count + 1, similarity.MOST_TASKS), "pile").groupBy("pile")


def groups_of_piles(data: Dataset, piles: DataFrame, layer: DataFrame, selected: DataFrame, p: Direct = Direct()) -> DataFrame:
    """obs_id, cluster: each pile of piles(obs_id, pile) is grouped as one task, over the selected variables of the
    layer; deviants leave and unconvincing groups are dissolved. Ids are unique over all piles."""
    kind = dict(data.obs.dtypes)["obs_id"]
    totals = data.obs_values(MAIN, total=True).withColumnRenamed(MAIN, "u")
    rows = piles.join(totals, "obs_id").join(layer.join(selected, "var_id", "left_semi"), "obs_id", "left").select(
        "pile", "obs_id", F.col("var_id").cast("string").alias("var_id"), "value", "u"
    )
    run = lambda part: _pile_groups(part, p)
    found = checkpointed(
        _by_pile(rows, piles).applyInPandas(lambda key, part: run(part).assign(pile=key[0]), f"obs_id {kind}, candidate bigint, pile int")
    )
    top = found.agg((F.max("candidate") + 1).alias("k"))
    named = found.crossJoin(F.broadcast(top)).select("obs_id", F.when(F.col("candidate") >= 0, F.col("pile") * F.col("k") + F.col("candidate")).otherwise(-1).alias("cluster"))  # one row
    named = checkpointed(grouping.compress(named, "cluster").select("obs_id", F.col("cluster").cast("bigint").alias("cluster")))
    gone = checkpointed(deviants.gaps(data.layer(), named, data.var, "cluster", p.least_fold).where("deviant"))
    return checkpointed(deviants.dissolve(data.layer(), named, "cluster", gone, p.target_size, p.least_size, p.target_umis))


def direct(data: Dataset, p: Direct = Direct(), most: int = 8000) -> Dataset:
    """All observations as one pile, or, if they are more than `most` (a pile is one task), as random piles of about that
    size without the levels of divide and conquer. Adds cluster and selected_gene."""
    data = data.with_layer(MAIN, checkpointed(data.layer()))  # every step reads it
    layer, selected = select_variables(data, p)
    selected = checkpointed(selected)
    piles = checkpointed(sampling.random_piles(data.obs, most, p.seed))
    found = groups_of_piles(data, piles, layer, selected, p)
    chosen = selected.select("var_id", F.lit(True).alias("selected_gene"))
    return data.with_obs(found, {"cluster": -1}).with_var(chosen, {"selected_gene": False})


def divide_and_conquer(data: Dataset, p: Direct = Direct(), piles: Piles = Piles(), with_rare: bool = True, quick: bool = False, **rare_options) -> Dataset:
    """Groups of rare modules first, then random piles; the groups found are piled by similarity (they are grouped
    themselves) for the final piles, and what is left over is piled again, level by level. Adds cluster,
    cluster_level, selected_gene and, with rare modules, rare_gene_module and cells_rare_gene_module."""
    data = data.with_layer(MAIN, checkpointed(data.layer()))  # every step reads it
    layer, selected = select_variables(data, p)
    n = data.obs.count()
    selected = checkpointed(selected)
    results: list[DataFrame] = []
    todo = data.obs.select("obs_id")
    if with_rare:
        genes, cells = rare.rare_modules(data.layer(), data.obs, data.var, n, **rare_options)
        genes, cells = checkpointed(genes), checkpointed(cells)
        data = data.with_var(genes.withColumnRenamed("module", "rare_gene_module"), {"rare_gene_module": -1})
        data = data.with_obs(cells.withColumnRenamed("module", "cells_rare_gene_module"), {"cells_rare_gene_module": -1})
        if cells.take(1):
            both = selected.union(genes.select("var_id")).distinct()
            found = groups_of_piles(data, checkpointed(_cut(cells, ["module"], piles.most, p.seed)), layer, both, p)
            results.append(found.where("cluster >= 0").withColumn("level", F.lit(0)))
            todo = todo.join(results[-1].select("obs_id"), "obs_id", "left_anti")
    size = sampling.target_pile_size(data.layer(), data.obs, p.target_size, p.target_umis, piles.least, piles.most, piles.groups)
    dealt = sampling.random_piles(todo, size, p.seed)
    for level in range(1, piles.most_levels + 1):
        left = data.keep(obs=todo)
        found = groups_of_piles(left, checkpointed(dealt), layer.join(todo, "obs_id", "left_semi"), selected, p)
        if level == 1 and not quick and todo.count() > size:
            found = _regrouped(left, found, layer, selected, p, size)
        results.append(found.where("cluster >= 0").withColumn("level", F.lit(level)))
        before = todo.count()
        todo = checkpointed(todo.join(results[-1].select("obs_id"), "obs_id", "left_anti"))
        rest = todo.count()
        if not rest or rest == before or rest < p.least_size:
            break
        dealt = sampling.random_piles(todo, size, p.seed + level)
    joined = results[0].select("obs_id", "cluster", "level")
    for part in results[1:]:
        joined = joined.union(part.select("obs_id", "cluster", "level"))
    ids = joined.select("level", "cluster").distinct()
    ids = positions(ids, ["level", "cluster"]).withColumnRenamed("position", "id")
    named = joined.join(ids, ["level", "cluster"]).select("obs_id", F.col("id").cast("bigint").alias("cluster"), F.col("level").alias("cluster_level"))
    chosen = selected.select("var_id", F.lit(True).alias("selected_gene"))
    return data.with_obs(checkpointed(named), {"cluster": -1, "cluster_level": -1}).with_var(chosen, {"selected_gene": False})


def _cut(rows: DataFrame, keys: list[str], most: int, seed: int) -> DataFrame:
    """obs_id, pile: a pile for each key, those of more than `most` dealt by hash into parts of about that size."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("parts"))
    cut = rows.join(parts, keys).withColumn("dealt_to", F.pmod(F.xxhash64("obs_id", F.lit(seed)), "parts"))
    keys = [*keys, "dealt_to"]
    ids = positions(cut.select(*keys).distinct(), keys).select(*keys, F.col("position").cast("int").alias("pile"))
    return cut.join(ids, keys).select("obs_id", "pile")


def _regrouped(data: Dataset, found: DataFrame, layer: DataFrame, selected: DataFrame, p: Direct, size: int) -> DataFrame:
    """Final groups of one level: the preliminary groups' sums are grouped, in random piles of bounded size where they are
    many, and each group of groups is a pile."""
    sums = grouping.sum_groups(data.layer(), found, "cluster").withColumnRenamed("group_id", "obs_id")
    groups = sums.select("obs_id").distinct()
    small = Dataset(groups, data.var, {MAIN: checkpointed(sums)})
    n = groups.count()
    count = max(1, n // max(1, size // p.target_size))
    q = Direct(target_size=max(2, n // count), least_size=2, target_umis=0, least_genes=p.least_genes, seed=p.seed)
    dealt = sampling.random_piles(groups, size, p.seed)
    totals = small.obs_values(MAIN, total=True).withColumnRenamed(MAIN, "u")
    chosen = small.layer().join(selected, "var_id", "left_semi")
    rows = dealt.join(totals, "obs_id").join(chosen, "obs_id", "left").select("pile", "obs_id", F.col("var_id").cast("string").alias("var_id"), "value", "u")
    kind = dict(groups.dtypes)["obs_id"]
    run = lambda part: _pile_groups(part, q)
    super_groups = _by_pile(rows, dealt).applyInPandas(lambda key, part: run(part).assign(pile=key[0]), f"obs_id {kind}, candidate bigint, pile int")
    # those in no group of groups stay with others of their pile; each group of groups is cut to piles of a bounded size
    bases = super_groups.select(F.col("obs_id").alias("cluster"), F.col("pile").alias("dealt"), F.greatest("candidate", F.lit(0)).alias("candidate"))
    joined = checkpointed(found.where("cluster >= 0").join(bases, "cluster").select("obs_id", "dealt", "candidate"))
    piles = _cut(joined, ["dealt", "candidate"], 2 * size, p.seed)
    return groups_of_piles(data, checkpointed(piles), layer, selected, p)


# collected groups ------------------------------------------------------------------------------------------------


def collect(data: Dataset, group: str = "cluster", geometric: bool = True, zeros_quantile: float = 0.1, seed: int = 0) -> Dataset:
    """The groups as a dataset of their own: x the profile's fractions, total_umis and zeros layers, grouped and
    total_umis of each group."""
    totals = grouping.sum_groups(data.layer(), data.obs, group)
    if geometric:
        profile = grouping.profile(data.layer(), data.obs, group)
    else:
        from lattica.operators.marginals import fraction_by

        named = totals.withColumnRenamed("group_id", "obs_id")
        profile = fraction_by(named, "obs_id").withColumnRenamed("obs_id", "group_id")
    sizes = grouping.group_sizes(data.obs, group)
    umis = totals.groupBy("group_id").agg(F.sum("value").alias("total_umis"))
    obs = sizes.join(umis, "group_id", "left").fillna(0.0, ["total_umis"]).withColumnRenamed("group_id", "obs_id")
    named = lambda x: x.withColumnRenamed("group_id", "obs_id")
    out = Dataset(obs, data.var, {MAIN: named(profile), "total_umis": named(totals)})
    if zeros_quantile is not None:
        out = out.with_layer("zeros", named(zeros(data.layer(), data.obs, data.var, group, zeros_quantile, seed)))
    return out


def zeros(layer: DataFrame, obs: DataFrame, var: DataFrame, group: str, quantile: float, seed: int) -> DataFrame:
    """group_id, var_id, value: members without the variable, each member cut down to the group's quantile of totals."""
    own = grouping.members(obs, group)
    totals = layer.groupBy("obs_id").agg(F.sum("value").alias("u")).join(own, "obs_id")
    sizes = totals.groupBy("group_id").agg(F.bround(F.percentile("u", quantile)).cast("bigint").alias("samples"))
    counts = grouping.group_sizes(obs, group)
    cut = sampling.downsample(layer, own.join(sizes, "group_id").select("obs_id", "samples"), seed)
    seen = cut.join(own, "obs_id").select("group_id", "obs_id", "var_id")
    have = seen.groupBy("group_id", "var_id").agg(F.count("*").alias("k"))
    return counts.crossJoin(var.select("var_id")).join(have, ["group_id", "var_id"], "left").select(
        "group_id", "var_id", (F.col("grouped") - F.coalesce("k", F.lit(0))).cast("double").alias("value")
    ).where("value > 0")


# the statistics of a viewer --------------------------------------------------------------------------------------


def for_viewer(data: Dataset, groups: Dataset, group: str = "cluster", regularization: float = 1e-5, top: int = 50) -> dict[str, DataFrame]:
    """Markers, coordinates, outlier matches, deviant and inner folds with their counts, deviations of logs, and the most
    and least similar variables."""
    groups = Dataset(checkpointed(groups.obs), groups.var, {name: checkpointed(layer) for name, layer in groups.layers.items()})  # nearly every part reads them
    n = groups.obs.count()
    markers = masks.markers(groups.layer(), groups.var, n)
    totals = groups.layer("total_umis").withColumnRenamed("obs_id", "group_id")
    profile = groups.layer().withColumnRenamed("obs_id", "group_id")
    matches = quality.outlier_matches(data.layer(), data.obs, data.var, totals, groups.obs.select(F.col("obs_id").alias("group_id")), group, regularization)
    folds = quality.deviant_folds(data.layer(), data.obs, profile, totals, group, matches)
    inner = checkpointed(quality.inner_folds(data.layer(), data.obs, profile, totals, group))
    edges = similarity.similarity(quality.log_fractions(groups.layer(), groups.obs, groups.var, regularization), groups.var, "var_id", groups.obs, "pearson")
    return {
        "markers": markers,
        "coordinates": coordinates(groups, markers),
        "matches": matches,
        "deviant_folds": folds,
        "inner_folds": inner,
        "significant_inner_folds": quality.significant_inner_folds(inner, groups.var),
        "stdev_logs": quality.stdev_logs(data.layer(), data.obs, group),
        "similar_variables": similarity.ends(edges, top, top),
    }


def knn_by_markers(groups: Dataset, markers: DataFrame, k: int, method: str = "abs_pearson", regularization: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """(similarity, graph) of groups by the log fractions of the markers."""
    chosen = markers.where("marker").select("var_id")
    logs = quality.log_fractions(groups.layer().join(chosen, "var_id", "left_semi"), groups.obs, chosen, regularization)
    edges = checkpointed(similarity.similarity(logs, groups.obs, "obs_id", chosen, method))
    return edges, graph.knn_graph(edges, groups.obs.count(), k)


def coordinates(groups: Dataset, markers: DataFrame, dimensions: int = 2, k: int = 15, seed: int = 0) -> DataFrame:
    """obs_id, x, y (or u, v, w): the groups laid out by their nearest-neighbour graph over the markers, so that neighbours
    lie close (see graph.layout)."""
    _, near = knn_by_markers(groups, markers, k)
    labels = ["x", "y"] if dimensions == 2 else ["u", "v", "w"][:dimensions]
    return graph.layout(near, groups.obs, labels, seed)


def project_outliers(atlas: Dataset, outliers: Dataset, regularization: float = 1e-5, least: float = 40) -> tuple[DataFrame, DataFrame]:
    """(obs_id, group_id) and (obs_id, var_id, value): the atlas member most like each outlier and the folds against it."""
    odd = outliers.obs.withColumn("g", F.lit(-1))
    named = lambda x: x.withColumnRenamed("obs_id", "group_id")
    totals = named(atlas.layer("total_umis"))
    matches = checkpointed(quality.outlier_matches(outliers.layer(), odd, outliers.var, totals, named(atlas.obs.select("obs_id")), "g", regularization))
    folds = quality.deviant_folds(outliers.layer(), odd, named(atlas.layer()), totals, "g", matches, least)
    return matches, folds.select("obs_id", "var_id", "value")


def project_datasets(atlas: Dataset, query: Dataset, p: atlases.Fit | None = None, type_name: str = "type", name: str = "var_id", never: tuple[str, ...] = ("lateral_gene", "ignored_gene"), ignored: DataFrame | None = None, essential: DataFrame | None = None) -> dict[str, DataFrame]:
    """A query projected onto an atlas of other variables: alignment by name, a first projection over the common variables
    that fit (with corrections), the projection by type, and a second region for what is not similar.

    ignored(type, var_id of the query) are never fitted for a type, essential(type, name) are what a type needs. Returns what
    atlas.project() does, and variables (name, in_atlas, in_query, factor, fitted), missing_essentials(type, name)."""
    p = p or atlases.Fit()
    aligned = checkpointed(atlases.align_variables(atlas.var, query.var, name))
    common = aligned.where("common").select(F.col("query_id").alias("var_id"))
    theirs, mine = checkpointed(atlases.to_query_ids(atlas.layer(), aligned)), checkpointed(query.layer().join(common, "var_id", "left_semi"))
    var = checkpointed(query.var.join(common, "var_id", "left_semi"))
    start = checkpointed(atlases.fitted_variables(theirs, mine, var, p.least_umis, never=never))
    within = lambda x: x.join(start, "var_id", "left_semi")
    first = projection.project(within(theirs), atlas.obs, within(mine), query.obs, within(var), type_name, p.rounds)
    factors = checkpointed(var.select("var_id").join(first["factors"], "var_id", "left").select("var_id", F.coalesce("factor", F.lit(1.0)).alias("factor")))
    corrected = checkpointed(projection.corrected(marginals.fraction_by(mine, "obs_id"), factors))
    fractions = checkpointed(marginals.fraction_by(theirs, "obs_id"))
    types = checkpointed(first["projected_type"].select("obs_id", F.col(type_name).alias("type")))
    masks_ = atlases.masks_by_type(atlas.obs.select(F.col(type_name).alias("type")), first["fitted"], ignored)
    needed = None
    if essential is not None:
        needed = essential.join(aligned.where("common").select("name", F.col("query_id").alias("var_id")), "name").select("type", "var_id")
    found = atlases.project(fractions, theirs, atlas.obs, corrected, mine, types, masks_, var, p, type_name, needed)
    of_variables = factors.join(first["fitted"].select("var_id", F.lit(True).alias("fitted")), "var_id", "left").fillna({"fitted": False})
    variables = atlases.scattered(of_variables, aligned, {"factor": 1.0, "fitted": False})
    missing = {} if essential is None else {"missing_essentials": atlases.missing_essentials(essential, aligned)}
    return found | {"variables": variables} | missing
