"""Similarities and distances of all pairs of observations (or variables).

Relational forms join the non-zeros on the other axis, so a pair meets once for each value that both have; Pearson needs
no more than these sums and each side's own sums. That is for many variables: over up to WIDE of them, blocks of dense rows
are multiplied in numpy, one pair of blocks a task, and all pairs are dealt over the tasks, as logistics needs in any case. Where only the most similar few
are asked for, the pairs of blocks keep these, and a table of all pairs never exists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators.marginals import other
from lattica.operators.ranking import positions
from lattica.sources.shared import checkpointed

BLOCK = 256
METHODS = ("pearson", "abs_pearson", "repeated_pearson", "repeated_abs_pearson", "logistics", "logistics_pearson", "logistics_abs_pearson")


def _pearson(n: int, sxy: Column, sx: Column, sy: Column, qx: Column, qy: Column) -> Column:
    """Zero where either side does not vary."""
    vx, vy = n * qx - sx * sx, n * qy - sy * sy
    flat = (vx <= 1e-12 * n * qx) | (vy <= 1e-12 * n * qy)
    return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(n * sxy - sx * sy, F.sqrt(F.when(flat, 1.0).otherwise(vx)) * F.sqrt(F.when(flat, 1.0).otherwise(vy))))


def _sums(layer: DataFrame, axis: DataFrame, per: str, name: str) -> DataFrame:
    sums = layer.groupBy(per).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    zero = F.lit(0.0)
    return axis.select(F.col(per).alias(name)).join(sums.withColumnRenamed(per, name), name, "left").select(
        name, F.coalesce("s", zero).alias(f"s_{name}"), F.coalesce("q", zero).alias(f"q_{name}")
    )


def pearson(layer: DataFrame, axis: DataFrame, per: str, n: int) -> DataFrame:
    """src, dst, weight for all ordered pairs of different members of the axis; a pair that shares no value still has a
    correlation. The result is a row for each pair, as asked for, so the axis must be one of groups, samples or piles."""
    if n <= WIDE:
        rows, sizes = packed_rows(layer, axis, per, layer.select(other(per)).distinct(), n)
        return all_pairs(rows, rows, sizes)
    x = layer.select(F.col(per).alias("src"), F.col(other(per)).alias("on"), F.col("value").alias("a"))
    y = layer.select(F.col(per).alias("dst"), F.col(other(per)).alias("on"), F.col("value").alias("b"))
    return _correlate(x, y, _sums(layer, axis, per, "src"), _sums(layer, axis, per, "dst"), n).where("src != dst")


def cross_pearson(first: DataFrame, first_obs: DataFrame, second: DataFrame, second_obs: DataFrame, n: int) -> DataFrame:
    """src (of the first), dst (of the second), weight."""
    x = first.select(F.col("obs_id").alias("src"), F.col("var_id").alias("on"), F.col("value").alias("a"))
    y = second.select(F.col("obs_id").alias("dst"), F.col("var_id").alias("on"), F.col("value").alias("b"))
    return _correlate(x, y, _sums(first, first_obs, "obs_id", "src"), _sums(second, second_obs, "obs_id", "dst"), n)


def _correlate(x: DataFrame, y: DataFrame, sx: DataFrame, sy: DataFrame, n: int) -> DataFrame:
    products = x.join(y, "on").groupBy("src", "dst").agg(F.sum(F.col("a") * F.col("b")).alias("p"))
    pairs = sx.crossJoin(sy).join(products, ["src", "dst"], "left")
    r = _pearson(n, F.coalesce("p", F.lit(0.0)), F.col("s_src"), F.col("s_dst"), F.col("q_src"), F.col("q_dst"))
    return pairs.select("src", "dst", r.alias("weight"))


def aligned_pearson(first: DataFrame, second: DataFrame, axis: DataFrame, per: str, n: int) -> DataFrame:
    """per, correlation of the same row (or column) of two layers."""
    both = first.select("obs_id", "var_id", F.col("value").alias("a")).join(
        second.select("obs_id", "var_id", F.col("value").alias("b")), ["obs_id", "var_id"], "full"
    )
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    sums = both.groupBy(per).agg(F.sum(a * b).alias("p"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("qa"), F.sum(b * b).alias("qb"))
    c = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    r = _pearson(n, c("p"), c("sa"), c("sb"), c("qa"), c("qb"))
    return axis.select(per).join(sums, per, "left").select(per, r.alias("correlation"))


def aligned_logistics(first: DataFrame, second: DataFrame, axis: DataFrame, n: int, location: float, slope: float) -> DataFrame:
    """obs_id, distance of the same row of two layers."""
    both = first.select("obs_id", "var_id", F.col("value").alias("a")).join(
        second.select("obs_id", "var_id", F.col("value").alias("b")), ["obs_id", "var_id"], "full"
    )
    gap = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    low = 1 / (1 + np.exp(slope * location))
    term = 1 / (1 + F.exp(slope * (location - gap))) - low
    sums = both.groupBy("obs_id").agg(F.sum(term).alias("t"))
    return axis.select("obs_id").join(sums, "obs_id", "left").select("obs_id", (F.coalesce("t", F.lit(0.0)) / n / (1 - low)).alias("distance"))


def logistic_distance(a: np.ndarray, b: np.ndarray, location: float, slope: float) -> np.ndarray:
    """Distances of the rows of a to those of b: the mean logistic of the gaps, scaled so that equal rows have 0."""
    low = 1 / (1 + np.exp(slope * location))
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        out[i] = (1 / (1 + np.exp(slope * (location - np.abs(b - row)))) - low).mean(axis=1) / (1 - low)
    return out


def logistics(layer: DataFrame, axis: DataFrame, per: str, variables: list, location: float, slope: float) -> DataFrame:
    """src, dst, weight: distances of all ordered pairs of different members. Rows are put into blocks by hash; a task
    holds two blocks."""
    total = axis.count()
    blocks = max(1, -(-total // BLOCK))
    index = {v: k for k, v in enumerate(variables)}
    rows = axis.select(per).join(
        layer.groupBy(per).agg(F.collect_list(F.struct(F.col(other(per)).alias("k"), "value")).alias("row")), per, "left"
    ).select(F.col(per).alias("id"), "row", F.pmod(F.xxhash64(per), F.lit(blocks)).cast("int").alias("b"))
    paired = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "id", "row", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q")
    )
    kind = dict(axis.dtypes)[per]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((len(part), len(index)))
        for i, row in enumerate(part["row"]):
            for x in row if row is not None else ():
                dense[i, index[x["k"]]] = x["value"]
        ids, b = part["id"].to_numpy(), part["b"].to_numpy()
        found = logistic_distance(dense, dense, location, slope)
        keep = ids[:, None] != ids[None, :]
        keep &= (b[:, None] != b[None, :]) | (key[0] == key[1])
        i, j = np.nonzero(keep)
        return pd.DataFrame({"src": ids[i], "dst": ids[j], "weight": found[i, j]})

    return paired.groupBy("p", "q").applyInPandas(run, f"src {kind}, dst {kind}, weight double")


def cross_logistics(first: DataFrame, first_obs: DataFrame, second: DataFrame, second_obs: DataFrame, n: int, location: float, slope: float) -> DataFrame:
    """src (of the first), dst (of the second), weight: distances, from the non-zeros of either side: what both lack has
    no gap, so a pair's sum is that of each side alone, corrected where both have a value."""
    low = 1 / (1 + np.exp(slope * location))
    term = lambda gap: 1 / (1 + F.exp(slope * (location - F.abs(gap)))) - low
    alone = lambda x, obs, name: obs.select(F.col("obs_id").alias(name)).join(
        x.groupBy(F.col("obs_id").alias(name)).agg(F.sum(term(F.col("value"))).alias(f"t_{name}")), name, "left"
    )
    x = first.select(F.col("obs_id").alias("src"), "var_id", F.col("value").alias("a"))
    y = second.select(F.col("obs_id").alias("dst"), "var_id", F.col("value").alias("b"))
    both = x.join(y, "var_id").groupBy("src", "dst").agg(F.sum(term(F.col("a") - F.col("b")) - term(F.col("a")) - term(F.col("b"))).alias("c"))
    pairs = alone(first, first_obs, "src").crossJoin(alone(second, second_obs, "dst")).join(both, ["src", "dst"], "left")
    zero = F.lit(0.0)
    total = F.coalesce("t_src", zero) + F.coalesce("t_dst", zero) + F.coalesce("c", zero)
    return pairs.select("src", "dst", (total / n / (1 - low)).alias("weight"))


def similarity(layer: DataFrame, axis: DataFrame, per: str, variables: DataFrame, method: str = "abs_pearson", location: float = 0.8, slope: float = 0.5) -> DataFrame:
    """src, dst, weight by one of METHODS. "repeated" is the correlation of the rows of similarities, themselves
    included with 1; logistics similarity is 1 less the distance."""
    n = variables.count()
    key = other(per)
    if method.startswith("logistics"):
        names = [r[0] for r in variables.select(key).orderBy(key).collect()]  # one of groups, samples or piles
        distance = logistics(layer, axis, per, names, location, slope)
        found = distance.select("src", "dst", (1 - F.col("weight")).alias("weight"))
    else:
        found = pearson(layer, axis, per, n)
        if method in ("abs_pearson", "repeated_abs_pearson"):
            found = found.select("src", "dst", F.abs("weight").alias("weight"))
    if method in ("repeated_pearson", "repeated_abs_pearson", "logistics_pearson", "logistics_abs_pearson"):
        itself = axis.select(F.col(per).alias("src"), F.col(per).alias("dst"), F.lit(1.0).alias("weight"))
        rows = found.union(itself).select(F.col("src").alias("obs_id"), F.col("dst").alias("var_id"), F.col("weight").alias("value"))
        ids = axis.select(F.col(per).alias("obs_id"))
        found = pearson(rows, ids, "obs_id", axis.count())
        if method.endswith("abs_pearson"):
            found = found.select("src", "dst", F.abs("weight").alias("weight"))
    return found


def ends(edges: DataFrame, top: int | None, bottom: int | None) -> DataFrame:
    """The edges of the `top` largest and `bottom` smallest weights of each src."""
    per = Window.partitionBy("src")
    high = F.row_number().over(per.orderBy(F.col("weight").desc(), "dst"))
    low = F.row_number().over(per.orderBy("weight", "dst"))
    ranked = edges.withColumn("hi", high).withColumn("lo", low)
    return ranked.where((F.col("hi") <= (top or 0)) | (F.col("lo") <= (bottom or 0))).select("src", "dst", "weight")


def nearest(edges: DataFrame) -> DataFrame:
    """src, dst of the largest weight; ties go to the smaller dst."""
    return edges.groupBy("src").agg(F.min_by("dst", F.struct(-F.col("weight"), F.col("dst"))).alias("dst"))



# the most similar few -------------------------------------------------------------------------------------------

#: Cells of a block's dense rows; its rows, at least and at most, and where a result has a row for each pair; rows at a time,
#: and pairs where each has a row.
CELLS, ROWS, MOST_ROWS, PAIR_ROWS, SLICE, PAIRS = 1 << 22, 512, 32768, 32768, 256, 1 << 20
#: Blocks on a side up to which larger tables get more blocks, then larger ones; variables up to which all pairs are dense.
BLOCKS, WIDE = 8, 4096
#: Decimal places to which correlations are rounded, so that ties are ties.
PLACES = 12


def correlations(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Pearson's correlations of the rows of x with those of y, n being the number of variables (those left out are zeros);
    zero where a row does not vary."""
    spread = []
    for a in (x, y):
        q = (a * a).sum(axis=1)
        v = n * q - a.sum(axis=1) ** 2
        spread.append(np.where(v <= 1e-12 * n * q, np.inf, v))
    p = n * (x @ y.T) - np.outer(x.sum(axis=1), y.sum(axis=1))
    return np.round(p / (np.sqrt(spread[0])[:, None] * np.sqrt(spread[1])[None, :]), PLACES)  # the same both ways


@dataclass(frozen=True)
class Cells:
    """Rows of lists of (v, x): row i has those from at[i] up to at[i + 1]."""

    at: np.ndarray
    v: np.ndarray
    x: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def part(self, first: int, end: int) -> Cells:
        a, b = self.at[first], self.at[min(end, len(self))]
        return Cells(self.at[first : end + 1] - a, self.v[a:b], self.x[a:b])

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> Cells:
        column = column.combine_chunks()
        cells = column.flatten()
        return cls(cls._ends(column), *(cells.field(c).to_numpy(zero_copy_only=False) for c in ("v", "x")))

    @classmethod
    def of_lists(cls, v: pa.ChunkedArray, x: pa.ChunkedArray) -> Cells:
        """From a list of v and one of x."""
        v, x = v.combine_chunks(), x.combine_chunks()
        return cls(cls._ends(v), *(c.flatten().to_numpy(zero_copy_only=False) for c in (v, x)))

    @staticmethod
    def _ends(column: pa.Array) -> np.ndarray:
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def dense(cells: pd.Series | Cells, columns: np.ndarray) -> np.ndarray:
    """Rows of lists of (v, x) as a matrix over the given sorted values of v."""
    out = np.zeros((len(cells), len(columns)))
    if isinstance(cells, Cells):
        out[np.repeat(np.arange(len(cells)), np.diff(cells.at)), np.searchsorted(columns, cells.v)] = cells.x
        return out
    for i, row in enumerate(cells):
        if row is not None and len(row):
            out[i, np.searchsorted(columns, [c["v"] for c in row])] = [c["x"] for c in row]
    return out


def columns_of(*cells: pd.Series | Cells) -> np.ndarray:
    """All values of v in lists of (v, x), sorted."""
    if all(isinstance(c, Cells) for c in cells):
        return np.unique(np.concatenate([c.v for c in cells]))
    found = [c["v"] for series in cells for row in series if row is not None for c in row]
    return np.unique(np.array(found, dtype=np.int64))


def packed(rows: DataFrame, members: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each of members(*keys): for each name in values, a list of (v, x) of the rows(*keys, v, name...)."""
    cells = [F.array_sort(F.collect_list(F.struct("v", F.col(c).cast("double").alias("x")))).alias(c) for c in values]
    return members.select(*keys).join(rows.groupBy(*keys).agg(*cells), keys, "left")


#: Partitions of the pairs of blocks at most.
MOST_TASKS = 2000


def _blocked(first: DataFrame, second: DataFrame, sizes: DataFrame, most: int = MOST_ROWS):
    """Pairs of blocks, grouped: rows of first have src, those of second dst; n counts their key's variables. A row is sent
    to each block of the other side, so large tables get larger blocks of up to `most` rows rather than more of them, and
    its cells go as a list of v and one of x, which take fewer bytes than a list of both."""
    widest = sizes.agg(F.max("n")).first()[0] or 1
    count = F.greatest(F.lit(ROWS), F.least(F.ceil(F.count("*") / BLOCKS), F.lit(most)))
    rows = F.greatest(F.lit(32), F.least(count, F.lit(CELLS // max(widest, 1))))
    kinds = {name: dict(df.dtypes)["id"] for name, df in (("src", first), ("dst", second))}
    lists = {}
    for c in (c for c in first.columns if c not in ("key", "id")):
        fields = first.schema[c].dataType.elementType.names
        lists |= {f"{c}_{f}": (c, f) for f in fields} if fields == ["v", "x"] else {c: (c, None)}
    counted = [df.groupBy("key").agg(F.ceil(F.count("*") / rows).cast("int").alias(name)) for df, name in ((first, "i"), (second, "j"))]
    grid = checkpointed(counted[0].join(counted[1], "key").join(sizes, "key"))  # a row a key
    tasks = grid.agg(F.sum(F.col("i").cast("bigint") * F.col("j"))).first()[0] or 1

    def dealt(df: DataFrame, own: str, other_: str, name: str) -> DataFrame:
        placed = df.join(grid, "key").withColumn(f"own_{own}", F.pmod(F.xxhash64("id"), own).cast("int"))
        whole = lambda c: F.col(c) if c in df.columns else F.lit(None).cast(first.schema[c].dataType)
        cells = [(whole(c)[f] if f else whole(c)).alias(sent) for sent, (c, f) in lists.items()]
        ids = [F.col("id").alias(c) if c == name else F.lit(None).cast(kinds[c]).alias(c) for c in kinds]
        return placed.withColumn(f"own_{other_}", F.explode(F.sequence(F.lit(0), F.col(other_) - 1))).select("key", "n", "own_i", "own_j", *ids, *cells)

    pairs = dealt(first, "i", "j", "src").unionByName(dealt(second, "j", "i", "dst"))
    keys = ["key", "own_i", "own_j"]
    if tasks > 1:  # few bytes are much work, so small partitions must not be put together
        pairs = pairs.repartition(min(tasks, MOST_TASKS), *keys)
    return pairs.groupBy(*keys), f"key {dict(first.dtypes)['key']}, src {kinds['src']}, dst {kinds['dst']}", kinds


def _sides(part: pa.Table, kinds: dict[str, str]) -> tuple[dict, dict]:
    """The columns of the rows of first and of second, each in the order of its ids."""
    out = []
    for c in ("src", "dst"):
        rows = part.filter(part[c].is_valid())
        ids = rows[c].to_numpy()
        ids = ids.astype(object if kinds[c] == "string" else np.int64)
        order = np.argsort(ids, kind="stable")
        rows = rows.take(order)
        cells = {k[:-2]: Cells.of_lists(rows[k], rows[f"{k[:-2]}_x"]) for k in rows.column_names if k.endswith("_v")}
        out.append({c: ids[order]} | cells | ({"asked": rows["asked"]} if "asked" in rows.column_names else {}))
    return tuple(out)


def _slices(side: dict, name: str, rows: int | None = None):
    """So many rows (or SLICE) of a side at a time."""
    rows = rows or SLICE
    for at in range(0, len(side[name]), rows):
        yield {k: x.part(at, at + rows) if isinstance(x, Cells) else x[at : at + rows] for k, x in side.items()}


def _first(weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, ties to the smaller column."""
    n = weight.shape[1]
    if k < n:
        least = np.partition(weight, n - k, axis=1)[:, n - k]
        i, j = np.nonzero(weight >= least[:, None])
    else:
        i, j = np.nonzero(np.ones(weight.shape, dtype=bool))
    order = np.lexsort((j, -weight[i, j], i))
    i, j = i[order], j[order]
    start = np.searchsorted(i, np.arange(len(weight)))
    keep = np.arange(len(i)) - start[i] < k
    return i[keep], j[keep]


def _found(part: pa.Table, **columns) -> pa.Table:
    n = len(columns["src"])
    key = pa.array([part["key"][0].as_py()] * n, type=part.schema.field("key").type)
    return pa.table({"key": key} | {c: pa.array(x, type=part.schema.field(c).type if c in ("src", "dst") else None) for c, x in columns.items()})


def all_pairs(first: DataFrame, second: DataFrame, sizes: DataFrame, score=None, apart: bool = True) -> DataFrame:
    """src, dst, weight of all pairs, by blocks as in top(). A pair of blocks gives its rows in batches of some PAIRS, so blocks are
    as large as there, and a row goes to as few of them."""
    blocks, schema, kinds = _blocked(first, second, sizes, PAIR_ROWS)
    score = score or score_pearson

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches))
        mine, theirs = _sides(part, kinds)
        for some in _slices(mine, "src", max(1, PAIRS // max(len(theirs["dst"]), 1))):
            weight = score(some, theirs, part["n"][0].as_py())
            src, dst = np.repeat(some["src"], weight.shape[1]), np.tile(theirs["dst"], weight.shape[0])
            keep = src != dst if apart else np.ones(len(src), dtype=bool)
            yield from _found(part, src=src[keep], dst=dst[keep], weight=weight.ravel()[keep]).to_batches()

    return blocks.applyInArrow(run, f"{schema}, weight double").select("src", "dst", "weight")


def top(first: DataFrame, second: DataFrame, sizes: DataFrame, k: int, score=None, apart: bool = True) -> DataFrame:
    """key, src, dst, weight, place (from 1): for each src of first the k dst of second, of the same key, of the largest
    weight; ties go to the smaller dst. first(key, id, x, ...) and second(key, id, x) are packed, x being what is compared;
    ids are integers or strings. sizes(key, n) counts the variables of a key. Both sides are dealt into blocks by hash, and
    each pair of blocks of a key is one task's work. score(first's rows, second's rows, n) gives the weights, correlations
    if it is left out; apart leaves out pairs of one id."""
    blocks, schema, kinds = _blocked(first, second, sizes)
    score = score or score_pearson

    def run(part: pa.Table) -> pa.Table:
        mine, theirs = _sides(part, kinds)
        dst = theirs["dst"]
        out = [(mine["src"][:0], dst[:0], np.zeros(0))]
        for some in _slices(mine, "src") if len(dst) else ():
            weight = score(some, theirs, part["n"][0].as_py())
            if apart:
                weight = np.where(some["src"][:, None] == dst[None, :], -np.inf, weight)
            i, j = _first(weight, k)
            there = np.isfinite(weight[i, j])
            i, j = i[there], j[there]
            out.append((some["src"][i], dst[j], weight[i, j]))
        return _found(part, **dict(zip(("src", "dst", "weight"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = blocks.applyInArrow(run, f"{schema}, weight double")
    place = F.row_number().over(Window.partitionBy("key", "src").orderBy(F.col("weight").desc(), "dst"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def ranks_of(first: DataFrame, second: DataFrame, sizes: DataFrame, score=None) -> DataFrame:
    """key, src, dst, rank: first has a list of (id, x) named asked; the rank of a pair with weight x among all of its src,
    1 for the largest weight, ties to the smaller dst. Counted block by block, without a row for each pair."""
    blocks, schema, kinds = _blocked(first, second, sizes)
    score = score or score_pearson

    def run(part: pa.Table) -> pa.Table:
        mine, theirs = _sides(part, kinds)
        dst = theirs["dst"]
        out = {"src": [], "dst": [], "before": []}
        for some in _slices(mine, "src"):
            weight = score(some, theirs, part["n"][0].as_py())
            for src, asked, w in zip(some["src"], some["asked"], weight, strict=True):
                cells = asked.values
                ids, x = cells.field("id").to_numpy(zero_copy_only=False).astype(dst.dtype), cells.field("x").to_numpy(zero_copy_only=False)
                w = np.where(dst == src, -np.inf, w)
                falling = np.sort(-w)
                low, high = np.searchsorted(falling, -x, "left"), np.searchsorted(falling, -x, "right")
                before = low.astype(np.int64)
                for at in np.flatnonzero(high > low):
                    before[at] += np.count_nonzero(w[: np.searchsorted(dst, ids[at])] == x[at])
                out["src"] += [src] * len(ids)
                out["dst"] += ids.tolist()
                out["before"] += before.tolist()
        return _found(part, src=out["src"], dst=out["dst"], before=pa.array(out["before"], pa.int64()))

    found = blocks.applyInArrow(run, f"{schema}, before bigint")
    return found.groupBy("key", "src", "dst").agg((F.sum("before") + 1).alias("rank"))


def score_pearson(mine: pd.DataFrame, theirs: pd.DataFrame, n: int) -> np.ndarray:
    columns = columns_of(mine["x"], theirs["x"])
    return correlations(dense(mine["x"], columns), dense(theirs["x"], columns), n)


def score_absolute(mine: pd.DataFrame, theirs: pd.DataFrame, n: int) -> np.ndarray:
    return np.abs(score_pearson(mine, theirs, n))


def numbered(axis: DataFrame, key: str) -> DataFrame:
    """key and v, a number from 0, of an axis' different ids."""
    return positions(axis.select(key).distinct(), [key]).select(key, F.col("position").cast("int").alias("v"))


def packed_rows(layer: DataFrame, axis: DataFrame, per: str, variables: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, id, x) of an axis under the one key 0, written, and its sizes(key, n): of all variables unless n is given."""
    on = other(per)
    codes = checkpointed(numbered(variables, on))
    counted = F.count("*") if n is None else F.lit(n).cast("bigint")
    return _packed_rows(layer, axis, per, codes), codes.groupBy().agg(counted.alias("n")).select(F.lit(0).alias("key"), "n")


def _packed_rows(layer: DataFrame, axis: DataFrame, per: str, codes: DataFrame) -> DataFrame:
    on = other(per)
    rows = layer.join(codes, on).select(F.lit(0).alias("key"), F.col(per).alias("id"), "v", F.col("value").alias("x"))
    members = axis.select(F.lit(0).alias("key"), F.col(per).alias("id"))
    return checkpointed(packed(rows, members, ["key", "id"], ["x"]))


def top_across(first: DataFrame, first_obs: DataFrame, second: DataFrame, second_obs: DataFrame, variables: DataFrame, k: int) -> DataFrame:
    """src (of the first), dst (of the second), weight, place: the k of the second with the largest correlation with each of the
    first over the variables, as cross_pearson() has them, without a row for each pair."""
    codes = checkpointed(numbered(variables, "var_id"))
    rows = [_packed_rows(x, obs, "obs_id", codes) for x, obs in ((first, first_obs), (second, second_obs))]
    sizes = codes.groupBy().agg(F.count("*").alias("n")).select(F.lit(0).alias("key"), "n")
    return top(*rows, sizes, k, apart=False).select("src", "dst", "weight", "place")


def top_pearson(layer: DataFrame, axis: DataFrame, per: str, variables: DataFrame, k: int, absolute: bool = False) -> DataFrame:
    """src, dst, weight: the k members of the axis with the largest (absolute) correlation with each."""
    rows, sizes = packed_rows(layer, axis, per, variables)
    return top(rows, rows, sizes, k, score_absolute if absolute else None).select("src", "dst", "weight")
