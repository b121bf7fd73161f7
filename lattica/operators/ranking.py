"""Window, rank and top-k operators. Ties go to the smaller id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators.marginals import other, reduce_per


def sliding(values: DataFrame, key: str, order: str, value: str, window: int, function: str = "median") -> DataFrame:
    """key, sliding: mean, median, std or var of value over a window (made odd) centred in the given order; at the ends
    the window is shifted, not cut. values has one row for each variable, so the ranks are dealt by range: positions come
    from a range-partitioned count and a join on position, with no global window."""
    window += 1 - window % 2
    total = values.count()
    placed = positions(values.select(key, order, value), [order, key])
    if window >= total:
        whole = placed.agg(_function(function, value, ddof=0).alias("sliding"))
        return placed.select(key).crossJoin(F.broadcast(whole))  # one row
    start = F.least(F.greatest(F.col("position") - window // 2, F.lit(0)), F.lit(total - window))
    around = placed.select(key, F.explode(F.sequence(start, start + window - 1)).alias("at"))
    return around.join(placed.select(F.col("position").alias("at"), value), "at").groupBy(key).agg(
        _function(function, value, ddof=1).alias("sliding")
    )


def _function(name: str, value: str, ddof: int):
    return {
        "mean": F.avg,
        "median": lambda c: F.percentile(c, 0.5),
        "std": F.stddev_samp if ddof else F.stddev_pop,
        "var": F.var_samp if ddof else F.var_pop,
    }[name](value)


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with position, the 0-based place in a global order, without one task for all rows: the rows are ranked within
    value ranges, and the sizes of the ranges before are added."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.stat.approxQuantile(order[0], [i / parts for i in range(1, parts)], 0.001) if dict(rows.dtypes)[order[0]] in ("double", "bigint", "int", "float") else []
    edges = sorted(set(cuts))
    part = F.lit(0)
    for edge in edges:
        part = part + F.when(F.col(order[0]) > edge, 1).otherwise(0)
    cut = rows.withColumn("part", part)
    sizes = cut.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return cut.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn(
        "position", (F.col("inside") + F.col("offset")).cast("bigint")
    ).drop("part", "inside", "offset")


def exact_quantile(rows: DataFrame, value: str, q: float, n: int, rest: float, below: bool = True) -> float:
    """The linearly interpolated quantile of n values: those of the rows, and for all others `rest`, which lies below (or,
    without below, above) every one of the rows. Places come from positions(), so that no task sorts all rows."""
    held = rows.count()
    at = q * (n - 1)
    low = int(at)
    wanted = [low, min(low + 1, n - 1)]
    places = [r - (n - held) if below else r for r in wanted]
    inside = [p for p in places if 0 <= p < held]
    values = {r["position"]: r["v"] for r in positions(rows.select(F.col(value).cast("double").alias("v")), ["v"]).where(F.col("position").isin(inside)).collect()} if inside else {}
    a, b = (values.get(p, rest) for p in places)
    return a + (b - a) * (at - low)


def relative_variance(layer: DataFrame, axis: DataFrame, per: str, n: int, window: int) -> DataFrame:
    """per, relative_variance: log2 of the normalised variance less its sliding median in the order of the mean."""
    base = reduce_per(layer, axis, per, n).select(per, "mean", F.log2("normalized_variance").alias("log_variance"))
    near = sliding(base, per, "mean", "log_variance", window)
    return base.join(near, per).select(per, (F.col("log_variance") - F.col("sliding")).alias("relative_variance"))


def rank_matrix(layer: DataFrame, per: str, ascending: bool) -> DataFrame:
    """Entries replaced by their 1-based rank among the row's (or column's) entries."""
    order = F.col("value").asc() if ascending else F.col("value").desc()
    rank = F.row_number().over(Window.partitionBy(per).orderBy(order, other(per)))
    return layer.select("obs_id", "var_id", rank.cast("double").alias("value"))


def top_per(layer: DataFrame, top: int, per: str, ranks: bool = False) -> DataFrame:
    """The `top` largest entries of each row (or column); with ranks, 1 is the smallest of those."""
    order = F.row_number().over(Window.partitionBy(per).orderBy(F.col("value").desc(), other(per)))
    kept = layer.withColumn("place", order).where(F.col("place") <= top)
    if not ranks:
        return kept.select("obs_id", "var_id", "value")
    rising = F.row_number().over(Window.partitionBy(per).orderBy("value", F.col(other(per)).desc()))
    return kept.select("obs_id", "var_id", rising.cast("double").alias("value"))


def prune_edges(edges: DataFrame, top: int, end: str) -> DataFrame:
    """The `top` heaviest edges at each end ("src": outgoing, "dst": incoming)."""
    far = "dst" if end == "src" else "src"
    place = F.row_number().over(Window.partitionBy(end).orderBy(F.col("weight").desc(), far))
    return edges.withColumn("place", place).where(F.col("place") <= top).select("src", "dst", "weight")


def distinct_variables(folds: DataFrame, count: int = 20) -> DataFrame:
    """obs_id, rank, var_id, value: the variables with the largest absolute folds."""
    order = F.row_number().over(Window.partitionBy("obs_id").orderBy(F.abs("value").desc(), "var_id"))
    return folds.withColumn("rank", order).where(F.col("rank") <= count).select("obs_id", "rank", "var_id", "value")
