"""Rare modules: variables seen in few observations that go together, and the observations that have them; variables
related to a given set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import dense
from lattica.operators import similarity
from lattica.operators.marginals import reduce_per
from lattica.operators.ranking import positions
from lattica.sources.shared import checkpointed


def rare_candidates(layer: DataFrame, var: DataFrame, n: int, most: int = 500, most_fraction: float = 1e-3, least_maximum: float = 7) -> DataFrame:
    """var_id of the variables in few observations but high in some, the rarest `most`; never lateral ones."""
    allowed = var.where(~F.coalesce(F.col("lateral_gene"), F.lit(False))) if "lateral_gene" in var.columns else var
    found = reduce_per(layer, allowed, "var_id", n).where((F.col("nnz") > 0) & (F.col("nnz") <= most_fraction * n) & (F.col("maximum") >= least_maximum))
    return found.orderBy("nnz", "var_id").limit(most).select("var_id")


def matrix_of(edges: DataFrame, names: list) -> np.ndarray:
    """A dense similarity of some names, for the driver; the caller bounds them."""
    index = {v: k for k, v in enumerate(names)}
    out = np.eye(len(names))
    for r in edges.collect():
        out[index[r["src"]], index[r["dst"]]] = r["weight"]
    return out


def rare_modules(layer: DataFrame, obs: DataFrame, var: DataFrame, n: int, method: str = "repeated_pearson", least_genes: int = 4, least_cells: int = 12, most_cells: int | None = None, least_total: float = 4, least_correlation: float = 0.1, related_fold: float = 7, increase: float = 4.0, **options) -> tuple[DataFrame, DataFrame]:
    """(var_id, module) and (obs_id, module): Ward clusters of the (at most 500) candidates whose mean similarity is high
    enough, then related variables (expressed in the module's observations 2^fold times as often as elsewhere), then the
    observations with enough of a module, of several that in which they stand out most against its median."""
    spark = layer.sparkSession
    picked = rare_candidates(layer, var, n, **options)
    names = [r[0] for r in picked.orderBy("var_id").collect()]
    kind_v, kind_o = dict(var.dtypes)["var_id"], dict(obs.dtypes)["obs_id"]
    none = spark.createDataFrame([], f"var_id {kind_v}, module int"), spark.createDataFrame([], f"obs_id {kind_o}, module int")
    if len(names) < least_genes:
        return none
    chosen = layer.join(picked, "var_id", "left_semi")
    sim = matrix_of(similarity.similarity(chosen, picked, "var_id", obs, method), names)
    modules = [m for m in dense.correlated_clusters(dense.ward(sim), sim, least_correlation) if len(m) >= least_genes]
    if not modules:
        return none
    genes = spark.createDataFrame([(names[k], i) for i, m in enumerate(modules) for k in m], f"var_id {kind_v}, module int")
    genes = related(layer, genes, n, related_fold, increase, least_total)
    cells = module_cells(layer, genes, least_total)
    sizes = cells.groupBy("module").agg(F.count("*").alias("size"))
    kept = sizes.where(F.col("size") >= least_cells)
    if most_cells:
        kept = kept.where(F.col("size") <= most_cells)
    new = kept.select("module", (F.row_number().over(Window.orderBy("module")) - 1).alias("new"))  # a row a module
    renumber = lambda x, key: x.join(new, "module").select(key, F.col("new").alias("module"))
    return renumber(genes, "var_id"), renumber(cells, "obs_id")


def related(layer: DataFrame, genes: DataFrame, n: int, fold: float, increase: float, least_total: float) -> DataFrame:
    """genes with the variables of no module that a module's observations have far more often than all observations,
    unless the observations that reach the least total with the variable's help would be too many for the module."""
    totals = layer.join(genes, "var_id").groupBy("obs_id", "module").agg(F.sum("value").alias("t"))
    cells = totals.where(F.col("t") >= least_total)
    sizes = cells.groupBy("module").agg(F.count("*").alias("size"))
    positive = layer.where("value > 0")
    seen = positive.groupBy("var_id").agg(F.count("*").alias("all"))
    inside = positive.join(cells.select("obs_id", "module"), "obs_id").groupBy("module", "var_id").agg(F.count("*").alias("k"))
    strong = inside.join(sizes, "module").join(seen, "var_id").where(F.col("k") / F.col("size") >= 2.0**fold * F.col("all") / n)
    strong = strong.join(genes.select("var_id"), "var_id", "left_anti").select("module", "var_id", "size")
    had = F.coalesce("t", F.lit(0.0))
    more = (
        strong.join(positive, "var_id")
        .join(totals, ["obs_id", "module"], "left")
        .where((had < least_total) & (had + F.col("value") >= least_total))
        .groupBy("module", "var_id")
        .agg(F.count("*").alias("more"))
    )
    kept = strong.join(more, ["module", "var_id"], "left").where(F.col("size") + F.coalesce("more", F.lit(0)) <= F.col("size") * increase)
    return genes.union(kept.select("var_id", "module")).groupBy("var_id").agg(F.min("module").alias("module"))


def module_cells(layer: DataFrame, genes: DataFrame, least_total: float) -> DataFrame:
    """obs_id, module."""
    totals = layer.join(genes, "var_id").groupBy("obs_id", "module").agg(F.sum("value").alias("t")).where(F.col("t") >= least_total)
    middle = totals.groupBy("module").agg(F.percentile("t", 0.5).alias("m"))
    place = F.row_number().over(Window.partitionBy("obs_id").orderBy((F.col("t") / F.col("m")).desc(), "module"))
    return totals.join(middle, "module").withColumn("place", place).where("place = 1").select("obs_id", "module")


def reached(edges: DataFrame, base: DataFrame) -> DataFrame:
    """var_id: the base and all that edges (src, dst) lead to from it, in rounds of joins of those added last."""
    found = frontier = checkpointed(base.select("var_id").distinct())
    while True:
        ends = edges.join(frontier.withColumnRenamed("var_id", "src"), "src", "left_semi").select(F.col("dst").alias("var_id"))
        frontier = checkpointed(ends.distinct().join(found, "var_id", "left_anti"))
        if frontier.isEmpty():
            return found
        found = checkpointed(found.union(frontier))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """var_id, component: the smallest var_id that symmetric edges (src, dst) connect it with. Each round takes the smallest
    component among neighbours and then that of the component found, until nothing changes."""
    named = nodes.select("var_id", F.col("var_id").alias("component"))
    while True:
        near = edges.join(named.withColumnRenamed("var_id", "src"), "src").groupBy(F.col("dst").alias("var_id")).agg(F.min("component").alias("near"))
        lower = named.join(near, "var_id", "left").select("var_id", "component", F.least("component", "near").alias("lower"))
        jump = named.select(F.col("var_id").alias("lower"), F.col("component").alias("jump"))
        step = checkpointed(lower.join(jump, "lower", "left").select("var_id", F.col("component").alias("was"), F.least("lower", "jump").alias("component")))
        named = step.select("var_id", "component")
        if step.where("component != was").isEmpty():
            return named


def bounded_components(nodes: DataFrame, edges: DataFrame, least: float, most: int) -> DataFrame:
    """var_id, component of at most `most` members: the components of edges of a weight of `least` or more; those that are
    too large are taken apart at a weight that rises by tenths, and at last (equal members only) in the order of ids."""
    edges = checkpointed(edges.where((F.col("weight") >= least) & (F.col("src") != F.col("dst"))))
    done, left = None, nodes.select("var_id")
    while True:
        found = components(left, edges)
        sizes = found.groupBy("component").agg(F.count("*").alias("size"))
        sized = checkpointed(found.join(sizes, "component"))
        good = sized.where(F.col("size") <= most).select("var_id", F.struct(F.col("component").alias("first"), F.lit(0).alias("part")).alias("component"))
        done = good if done is None else done.union(good)
        large = sized.where(F.col("size") > most).select("var_id", "component")
        if large.isEmpty():
            return done
        least += 0.1
        if least >= 1:
            place = F.row_number().over(Window.partitionBy("component").orderBy("var_id")) - 1
            part = F.floor(place / most).cast("int")
            return done.union(large.select("var_id", F.struct(F.col("component").alias("first"), part.alias("part")).alias("component")))
        left = large.select("var_id")
        edges = checkpointed(edges.where(F.col("weight") >= least).join(left.withColumnRenamed("var_id", "src"), "src", "left_semi"))


def related_variables(layer: DataFrame, obs: DataFrame, var: DataFrame, n: int, base: str = "lateral_gene", least_fraction: float = 1e-5, least_correlation: float = 0.1, most: int = 64, method: str = "abs_pearson", most_piece: int = 2000) -> DataFrame:
    """var_id, module: the base variables and all that correlate with one of those added last, until none is added, in
    Ward clusters of at most `most`. The layer is of a sample of observations and of the variables with enough of it.

    The search is by rounds of joins. Variables without a chain of correlations between them are never in one module, so
    each task clusters one connected piece of at most `most_piece` variables."""
    from lattica.operators.marginals import fraction_per

    kind = dict(var.dtypes)["var_id"]
    enough = fraction_per(layer, var, "var_id").where(F.col("fraction") >= least_fraction).select("var_id")
    flagged = var.where(F.col(base)).select("var_id")
    pool = enough.union(flagged).distinct()
    edges = checkpointed(similarity.similarity(layer.join(pool, "var_id", "left_semi"), pool, "var_id", obs, method))
    strong = edges.where(F.col("weight") >= least_correlation)
    found = reached(strong, flagged)
    ends = edges.join(found.withColumnRenamed("var_id", "src"), "src", "left_semi").join(found.withColumnRenamed("var_id", "dst"), "dst", "left_semi")
    pieces = checkpointed(bounded_components(found, ends, least_correlation, most_piece))
    there = pieces.select(F.col("var_id").alias("dst"), F.col("component").alias("other"))
    inside = ends.join(pieces.withColumnRenamed("var_id", "src"), "src").join(there, "dst").where("component = other")
    rows = inside.select("component", "src", "dst", "weight").union(
        pieces.select("component", F.col("var_id").alias("src"), F.col("var_id").alias("dst"), F.lit(1.0))
    )

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        sim = part.pivot(index="src", columns="dst", values="weight").sort_index().sort_index(axis=1).fillna(0.0)
        of = dense.cut_tree(dense.ward(sim.to_numpy()), len(sim), most) if len(sim) > 1 else np.zeros(1, dtype=int)
        return pd.DataFrame({"var_id": sim.index, "local": of, "least": pd.Series(sim.index).groupby(of).transform("min")})

    clusters = checkpointed(rows.groupBy("component").applyInPandas(cluster, f"var_id {kind}, local int, least {kind}"))
    ids = clusters.select("least").distinct()
    ids = positions(ids.select("least", F.xxhash64("least").alias("h")), ["h", "least"]).select("least", "position")
    return clusters.join(ids, "least").select("var_id", F.col("position").cast("int").alias("module"))
