"""Nearest-neighbour graphs as edge tables: ranks, balance, prune, weigh; the stability score of a partition."""

from __future__ import annotations

from functools import reduce
from math import pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators import similarity
from lattica.operators.ranking import prune_edges
from lattica.sources.shared import checkpointed

EPSILON = 1e-6


def outgoing_ranks(edges: DataFrame) -> DataFrame:
    """src, dst, weight: the rank of dst for src, 1 for the most similar; never itself."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst"))
    return edges.where("src != dst").select("src", "dst", place.cast("double").alias("weight"))


def nearest_ranks(layer: DataFrame, axis: DataFrame, per: str, variables: DataFrame, k: int, factor: float = sqrt(10), absolute: bool = True) -> DataFrame:
    """src, dst, weight: outgoing ranks, in both directions, of all pairs that balance() can keep for k, without a row for
    each pair of the axis. Each member's K = k * factor + 1 most similar are searched, and the ranks of these pairs the other
    way are counted. A pair with both ranks above K has a product above K^2, so it matters only to a member without any pair
    of a smaller product. These search four times as many, L, and so on: what is then unknown has a rank above L one way and
    above K the other, so a product of (L + 1) * (K + 1) at least."""
    score = similarity.score_absolute if absolute else similarity.score_pearson
    rows, sizes = similarity.packed_rows(layer, axis, per, variables)
    most = int(k * factor) + 2
    near = checkpointed(similarity.top(rows, rows, sizes, most, score))
    found = near.select("src", "dst", F.col("place").cast("bigint").alias("rank"), F.col("weight").alias("x"))

    def both_ways(known: DataFrame) -> DataFrame:
        """known(src, dst, rank, x) with the pairs the other way, whose ranks are counted unless they are known."""
        back = known.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "x").join(known.select("src", "dst"), ["src", "dst"], "left_anti")
        asked = back.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct(F.col("dst").alias("id"), "x")).alias("asked"))
        counted = similarity.ranks_of(rows.join(asked, "id").select("key", "id", "x", "asked"), rows, sizes, score)
        return checkpointed(known.select("src", "dst", "rank").union(counted.select("src", "dst", "rank")))

    ranks = both_ways(found)

    def beyond(some: DataFrame, least: int) -> DataFrame:
        """src of those in some whose pairs all have a product of at least so much."""
        products = some.join(ranks, "src").join(ranks.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("rank").alias("back")), ["src", "dst"])
        return checkpointed(products.groupBy("src").agg(F.min(F.col("rank") * F.col("back")).alias("p")).where(F.col("p") >= least).select("src"))

    far, wide, n = beyond(ranks.select("src").distinct(), most * most + 1), most, axis.count()
    while wide < n and far.take(1):
        wide = min(4 * wide, n)
        some = rows.join(far.select(F.col("src").alias("id")), "id", "left_semi").select("key", "id", "x")
        further = similarity.top(some, rows, sizes, wide, score)
        theirs = both_ways(further.select("src", "dst", F.col("place").cast("bigint").alias("rank"), F.col("weight").alias("x")))
        ranks = checkpointed(ranks.union(theirs).distinct())
        far = beyond(far, (wide + 1) * (most + 1))
    return ranks.select("src", "dst", F.col("rank").cast("double").alias("weight"))


def nearest_graph(layer: DataFrame, axis: DataFrame, per: str, variables: DataFrame, k: int, factor: float = sqrt(10), incoming: float = 3.0, outgoing: float = 1.0, least_degree: int = 2, absolute: bool = True) -> DataFrame:
    """knn_graph() of an axis' own (absolute) correlations, without a table of all pairs. k grows until every node has enough
    outgoing edges; ranks that are known for a larger k hold for the smaller ones."""
    n, known = axis.count(), 0
    while True:
        if k > known:
            known = 2 * k if known else k
            ranks = nearest_ranks(layer, axis, per, variables, known, factor, absolute)
        balanced, best = balance(ranks, k, factor)
        edges = checkpointed(weigh(prune(balanced, best, k, n, incoming, outgoing)))
        least = edges.groupBy("src").count().agg(F.min("count")).first()[0]
        if least is None or least >= min(least_degree, n - 1):
            return edges
        k += max(1, k // 10)


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def balance(ranks: DataFrame, k: int, factor: float = sqrt(10)) -> tuple[DataFrame, DataFrame]:
    """(edges within the balanced rank, each node's best edge): the geometric mean of both ranks, kept up to k * factor and
    turned so that more is better; the best edge of each node stays with 1 at least."""
    back = _turned(ranks).withColumnRenamed("weight", "back")
    both = ranks.join(back, ["src", "dst"]).select("src", "dst", F.sqrt(F.col("weight") * F.col("back")).alias("b"))
    valued = both.withColumn("weight", F.lit(k * factor) + 1 - F.col("b"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("b", "dst"))
    best = valued.withColumn("place", place).where("place = 1").select("src", "dst", F.greatest("weight", F.lit(1.0)).alias("weight"))
    near = valued.where(F.col("weight") > 0).select("src", "dst", "weight")
    return _strongest(near.union(best)), best


def _strongest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def prune(balanced: DataFrame, best: DataFrame, k: int, n: int, incoming: float = 3.0, outgoing: float = 1.0) -> DataFrame:
    """The best incoming and then the best outgoing edges of each node, with each node's best edge and its turn added."""
    kept = prune_edges(balanced, min(round(k * incoming), n - 1), "dst")
    kept = prune_edges(kept, min(round(k * outgoing), n - 1), "src")
    return _strongest(kept.union(best).union(_turned(best)))


def weigh(pruned: DataFrame) -> DataFrame:
    """Weights divided by their sum over each src."""
    total = F.sum("weight").over(Window.partitionBy("src"))
    return pruned.select("src", "dst", (F.col("weight") / total).alias("weight"))


def knn_graph(edges: DataFrame, n: int, k: int, factor: float = sqrt(10), incoming: float = 3.0, outgoing: float = 1.0, least_degree: int = 2) -> DataFrame:
    """The weighted graph; k grows until every node has enough outgoing edges."""
    ranks = outgoing_ranks(edges)
    while True:
        balanced, best = balance(ranks, k, factor)
        edges = weigh(prune(balanced, best, k, n, incoming, outgoing))
        least = edges.groupBy("src").count().agg(F.min("count")).first()[0]
        if least is None or least >= min(least_degree, n - 1):
            return edges
        k += max(1, k // 10)


def mass(umis: Column | str, low: float, target: float, high: float) -> Column:
    """The penalty factor of a partition's size: 1 within bounds, the log of what it lacks or has too much outside."""
    x = F.col(umis) if isinstance(umis, str) else umis
    return F.when(x < low, F.log2(x / low)).when(x > high, F.log2(high / x)).otherwise(F.lit(0.0))


def stability(edges: DataFrame, nodes: DataFrame, partition: str, umis: str, low: float, target: float, high: float) -> DataFrame:
    """One row with score: over nodes in partitions, half the log2 of outgoing times incoming weight within the partition,
    less the log2 of the partition's size and with its penalty; orphans (partition -1) count as unconnected; all of it
    against the incoming weights and divided by the number of nodes."""
    own = nodes.select(F.col("obs_id").alias("id"), F.col(partition).alias("p"), F.col(umis).alias("u"))
    ends = edges.join(own.select(F.col("id").alias("src"), F.col("p").alias("ps")), "src").join(
        own.select(F.col("id").alias("dst"), F.col("p").alias("pd")), "dst"
    )
    inside = ends.where("ps = pd AND ps >= 0")
    out = inside.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("o"))
    into = inside.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("i"))
    incoming = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("all"))
    joined = own.join(out, "id", "left").join(into, "id", "left").join(incoming, "id", "left")
    zero = F.lit(0.0)
    s = 0.5 * F.log2(EPSILON + F.coalesce("o", zero) * F.coalesce("i", zero))
    scored = joined.select("p", "u", s.alias("s"), F.coalesce("all", zero).alias("all"))
    per = scored.where("p >= 0").groupBy("p").agg(F.sum("s").alias("s"), F.count("*").alias("n"), F.sum("u").alias("u"))
    per = per.select((F.col("s") - F.col("n") * F.log2("n") + F.col("n") * mass("u", low, target, high)).alias("s")).agg(F.coalesce(F.sum("s"), zero).alias("s"))
    whole = scored.agg(
        F.count("*").alias("n"), F.count_if(F.col("p") < 0).alias("orphans"), F.coalesce(F.sum(F.log2(F.when(F.col("all") > 0, F.col("all")))), zero).alias("l")
    )
    n = F.col("n")
    total = n * F.log2("n") - F.col("l") + F.col("s") + F.col("orphans") * 0.5 * F.log2(F.lit(EPSILON))
    return whole.crossJoin(per).select((total / n).alias("score"))  # one row each


def small_communities(nodes: DataFrame, partition: str, umis: str, least_size: int, least_umis: float) -> DataFrame:
    """partition, size, umis of the communities with too few members or too small a total."""
    found = nodes.where(F.col(partition) >= 0).groupBy(partition).agg(F.count("*").alias("size"), F.sum(umis).alias("total"))
    return found.where((F.col("size") < least_size) | (F.col("total") < least_umis))


def cancel(nodes: DataFrame, partition: str, cancelled: DataFrame) -> DataFrame:
    """nodes with the cancelled communities unassigned and the others renumbered."""
    from lattica.operators.grouping import compress

    gone = cancelled.select(partition).distinct().withColumn("gone", F.lit(True))
    marked = nodes.join(gone, partition, "left").withColumn(partition, F.when(F.col("gone"), -1).otherwise(F.col(partition))).drop("gone")
    return compress(marked, partition)


# layout ----------------------------------------------------------------------------------------------------------


def _uniform(seed: int, *columns) -> Column:
    """A number from -1 to 1 that depends on the seed and the columns only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(2_000_003)) / 1_000_001 - 1


def layout(edges: DataFrame, nodes: DataFrame, labels: list[str], seed: int = 0, rounds: int = 12) -> DataFrame:
    """obs_id and a coordinate for each label: the smoothest directions of the graph other than the constant one.

    Each round moves every node half way to the weighted mean of its neighbours, twice, by joins over the edges; then the
    coordinates are centred and made orthogonal again (by degree), with factors from one row of sums. Axes are ordered
    by smoothness, each has a variance of 1; nodes without edges lie at 0."""
    both = edges.select("src", "dst", "weight").union(_turned(edges).select("src", "dst", "weight")).where("src != dst")
    both = checkpointed(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    degrees = both.groupBy(F.col("src").alias("obs_id")).agg(F.sum("weight").alias("degree"))
    places = degrees.select("obs_id", "degree", *[_uniform(seed + i, "obs_id").alias(c) for i, c in enumerate(labels)])
    for _ in range(rounds):
        for _ in range(2):
            ends = both.join(places.withColumnRenamed("obs_id", "dst"), "dst").groupBy(F.col("src").alias("obs_id"))
            means = ends.agg(*[(F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(f"{c}_mean") for c in labels])
            places = places.join(means, "obs_id").select("obs_id", "degree", *[((F.col(c) + F.col(f"{c}_mean")) / 2).alias(c) for c in labels])
        places = checkpointed(places)
        places = _orthogonal(places, labels)
    found = nodes.select("obs_id").join(places, "obs_id", "left")
    return found.select("obs_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in labels])


def _orthogonal(places: DataFrame, labels: list[str]) -> DataFrame:
    d = F.col("degree")
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[: i + 1]]
    row = places.agg(
        F.coalesce(F.sum(d), F.lit(0.0)).alias("all"),
        *[F.coalesce(F.sum(d * F.col(c)), F.lit(0.0)).alias(f"s_{c}") for c in labels],
        *[F.coalesce(F.sum(d * F.col(a) * F.col(b)), F.lit(0.0)).alias(f"p_{a}_{b}") for a, b in pairs],
    ).first()  # one row of sums
    whole = max(row["all"], EPSILON)
    mean = np.array([row[f"s_{c}"] / whole for c in labels])
    spread_ = np.zeros((len(labels), len(labels)))
    for a, b in pairs:
        i, j = labels.index(a), labels.index(b)
        spread_[i, j] = spread_[j, i] = row[f"p_{a}_{b}"] / whole - mean[i] * mean[j]
    scale = max(float(spread_.diagonal().max()), 1e-300)
    factor = np.linalg.inv(np.linalg.cholesky(spread_ + 1e-12 * scale * np.eye(len(labels))))
    centred = [F.col(c) - float(m) for c, m in zip(labels, mean, strict=True)]
    turned = [reduce(lambda x, y: x + y, [float(factor[i, j]) * centred[j] for j in range(i + 1)]) for i in range(len(labels))]
    return places.select("obs_id", "degree", *[x.alias(c) for x, c in zip(turned, labels, strict=True)])


def cover_diameter(points: int, area: float, fraction: float) -> float:
    """The diameter at which so many points cover that fraction of the area."""
    return 2 * sqrt(area * fraction / points / pi)


def spread(points: DataFrame, fraction: float = 1 / 3, noise: float = 0.1, seed: int = 0, rounds: int = 50) -> DataFrame:
    """obs_id, x, y moved apart until none overlap as discs that cover the given fraction of their rectangle, in at most
    `rounds` rounds. Only points in neighbouring cells of a grid as wide as a disc are compared."""
    low = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")]).first()
    if low["n"] < 2:
        return points.select("obs_id", "x", "y")
    area = max(low["max_x"] - low["min_x"], 1e-9) * max(low["max_y"] - low["min_y"], 1e-9)
    size = cover_diameter(low["n"], area, fraction)
    moved = points.select("obs_id", *[(F.col(c) + 0.5 * noise * size * _uniform(seed + i, "obs_id")).alias(c) for i, c in enumerate("xy")])
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cell = [F.floor(F.col(c) / size).alias(f"cell_{c}") for c in "xy"]
    for _ in range(rounds):
        moved = checkpointed(moved)
        there = moved.select(F.col("obs_id").alias("near"), F.col("x").alias("near_x"), F.col("y").alias("near_y"), *cell)
        here = moved.select("obs_id", "x", "y", F.explode(steps).alias("step"), *cell)
        here = here.withColumn("cell_x", F.col("cell_x") + F.col("step.i")).withColumn("cell_y", F.col("cell_y") + F.col("step.j"))
        gap_x, gap_y = F.col("x") - F.col("near_x"), F.col("y") - F.col("near_y")
        far = F.greatest(F.sqrt(gap_x * gap_x + gap_y * gap_y), F.lit(1e-9))
        close = here.join(there, ["cell_x", "cell_y"]).where("obs_id != near").withColumn("over", (F.lit(size) - far) / far).where("over > 1e-3")
        push = close.groupBy("obs_id").agg((F.avg(F.col("over") * gap_x) / 2).alias("dx"), (F.avg(F.col("over") * gap_y) / 2).alias("dy"))
        push = checkpointed(push)
        if push.isEmpty():
            break
        moved = moved.join(push, "obs_id", "left").select("obs_id", (F.col("x") + F.coalesce("dx", F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce("dy", F.lit(0.0))).alias("y"))
    return moved
