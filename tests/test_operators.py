"""Operators against numpy and literals: reducers with zeros, ranks, windows, folds, groups, samples, bins and cuts."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.dataset import MAIN
from lattica.functions import dense
from lattica.operators import convey, graph, grouping, marginals, masks, projection, quality, ranking, rare, sampling, similarity
from lattica.plans import pipelines
from lattica.sources import tables


def long(spark, matrix):
    """(layer, obs, var) of a dense matrix."""
    m = np.asarray(matrix, dtype=float)
    rows = [(i, j, float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    layer = spark.createDataFrame([(int(i), int(j), v) for i, j, v in rows], "obs_id bigint, var_id bigint, value double")
    ids = lambda n, name: spark.createDataFrame([(i,) for i in range(n)], f"{name} bigint")
    return layer, ids(len(m), "obs_id"), ids(m.shape[1], "var_id")


def back(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["obs_id"], r["var_id"]] = r["value"]
    return out


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(3)
    m = rng.integers(-3, 9, (13, 7)) * (rng.random((13, 7)) < 0.6)
    m[4] = 0
    m[:, 2] = 0
    return m.astype(float)


@pytest.mark.parametrize("per", ["obs_id", "var_id"])
def test_reducers(spark, matrix, per):
    layer, obs, var = long(spark, matrix)
    axis, m = (obs, matrix) if per == "obs_id" else (var, matrix.T)
    found = {r[per]: r for r in marginals.reduce_per(layer, axis, per, m.shape[1]).collect()}
    for i, row in enumerate(m):
        r = found[i]
        want = [row.sum(), (row**2).sum(), (row != 0).sum(), row.mean(), row.max(), row.min(), row.var(), row.std()]
        assert [r.total, r.total_squared, r.nnz, r.mean, r.maximum, r.minimum, r.variance, r.stdev] == pytest.approx(want)
        assert r.normalized_variance == pytest.approx(1.0 if row.mean() == 0 else row.var() / row.mean())
    q = {r[per]: r for r in marginals.quantiles_per(layer, axis, per, m.shape[1], {"a": 0.05, "b": 0.5, "c": 0.98}).collect()}
    k = {r[per]: r for r in marginals.values_at_ranks(layer, axis, per, m.shape[1], {"x": 2}).collect()}
    for i, row in enumerate(m):
        assert [q[i].a, q[i].b, q[i].c] == pytest.approx(list(np.quantile(row, [0.05, 0.5, 0.98])))
        assert k[i].x == np.sort(row)[2]


def test_whole_fractions_and_bins(spark, matrix):
    m = np.abs(matrix)
    layer, obs, var = long(spark, m)
    r = marginals.whole(layer, *m.shape).first()
    assert [r.total, r.nnz, r.mean, r.maximum, r.minimum] == pytest.approx([m.sum(), (m != 0).sum(), m.mean(), m.max(), 0])
    sums = m.sum(axis=1, keepdims=True)
    assert back(marginals.fraction_by(layer, "obs_id"), m.shape) == pytest.approx(m / np.where(sums, sums, 1))
    found = {r.var_id: r.fraction for r in marginals.fraction_per(layer, var, "var_id").collect()}
    assert [found[j] for j in range(7)] == pytest.approx(list(m.sum(axis=0) / m.sum()))
    counts = marginals.bincount(spark.createDataFrame([(1,), (1,), (3,)], "x int"), "x", 6).orderBy("bin").collect()
    assert [r["count"] for r in counts] == [0, 2, 0, 1, 0, 0]
    del obs


def test_folds_and_aurocs(spark, matrix):
    layer, obs, var = long(spark, np.abs(matrix))
    inside = np.array([i % 3 == 0 for i in range(13)])
    subset = spark.createDataFrame([(int(i),) for i in np.flatnonzero(inside)], "obs_id bigint")
    found = {r.var_id: r for r in marginals.folds_and_aurocs(layer, obs, var, subset, 1e-4).collect()}
    for j, column in enumerate(np.abs(matrix).T):
        a, b = column[inside], column[~inside]
        wins = (a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()
        assert found[j].auroc == pytest.approx(wins / (len(a) * len(b)))
        assert found[j].fold == pytest.approx((a.mean() + 1e-4) / (b.mean() + 1e-4))
    assert {r.auroc for r in marginals.folds_and_aurocs(layer, obs, var, subset.limit(0), 1e-4).collect()} == {0.0}
    assert {r.auroc for r in marginals.folds_and_aurocs(layer, obs, var, obs, 1e-4).collect()} == {1.0}


def test_sliding_windows_are_shifted_at_the_ends(spark):
    values = spark.createDataFrame([(i, float(o), float(i)) for i, o in enumerate([0, 2, 1, 3, 4])], "k bigint, o double, v double")
    run = lambda order, w, f: [r.sliding for r in ranking.sliding(values, "k", order, "v", w, f).orderBy("k").collect()]
    assert run("v", 3, "mean") == pytest.approx([1, 1, 2, 3, 3])
    assert run("o", 3, "mean") == pytest.approx([1, 2, 1, 8 / 3, 8 / 3])
    assert run("v", 9, "median") == [2.0] * 5
    assert run("v", 2, "mean") == run("v", 3, "mean")


def test_ranks_and_tops(spark, matrix):
    layer, *_ = long(spark, np.abs(matrix))
    top = ranking.top_per(layer, 2, "obs_id").collect()
    assert len(top) == sum(min(2, (row != 0).sum()) for row in matrix)
    ranks = back(ranking.top_per(layer, 2, "obs_id", ranks=True), matrix.shape)
    assert set(ranks.ravel()) == {0.0, 1.0, 2.0}


def test_masks(spark):
    var = spark.createDataFrame([(i, n, i % 2 == 0) for i, n in enumerate(["foo", "bar", "baz"])], "var_id bigint, var_name string, even boolean")
    match = lambda **k: [r[0] for r in var.orderBy("var_id").select(masks.names_match(F.col("var_name"), **k)).collect()]
    assert match(patterns=["ba[a-z]?"]) == [False, True, True]
    assert match(names=["FOO"], patterns=["BAR"], invert=True) == [False, False, True]
    combined = lambda *m: [r[0] for r in var.orderBy("var_id").select(masks.combine(var.columns, list(m))).collect()]
    assert combined("~even", "|var_id", "&~gone?") == [False, True, True]
    with pytest.raises(KeyError):
        masks.combine(var.columns, ["&gone"])
    typed = masks.mark_by_type(var, {"t": ["foo"]}, {"u": ["ba."]})
    assert {(r.var_id, r.type) for r in typed.collect()} == {(0, "t"), (1, "u"), (2, "u")}


def test_groups(spark):
    m = [[0, 1, 2], [3, 4, 5], [5, 6, 0], [7, 0, 8]]
    layer, obs, _ = long(spark, m)
    grouped = obs.withColumn("g", F.expr("CASE obs_id WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END"))
    sums = {(r.group_id, r.var_id): r.value for r in grouping.sum_groups(layer, grouped, "g").collect()}
    assert sums == {(0, 0): 5, (0, 1): 7, (0, 2): 2, (1, 0): 3, (1, 1): 4, (1, 2): 5}
    ids = lambda *v: [r.g for r in grouping.compress(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "k int, g int"), "g").orderBy("k").collect()]
    assert ids(0, 3, 2) == [0, 2, 1] and ids(0, -1, 2) == [0, -1, 1]
    named = spark.createDataFrame([(0, 0, "a"), (1, 0, "b"), (2, 0, "a"), (3, 0, "c")], "obs_id bigint, g int, v string")
    assert convey.obs_to_group(named, "g", "v").first().v == "a"
    assert grouping.majority(named, "g", "v", 0.6, "mixed").first().v == "mixed"


def test_profile_equals_its_dense_form(spark):
    rng = np.random.default_rng(0)
    m = rng.poisson(2, (9, 6)).astype(float)
    layer, obs, _ = long(spark, m)
    found = back(grouping.profile(layer, obs.withColumn("g", F.lit(0)), "g").withColumnRenamed("group_id", "obs_id"), (1, 6))[0]
    u = m.sum(axis=1, keepdims=True)
    w, r = np.log2(u), (1 / 16) / u
    mean = lambda x: np.exp((w * np.log(x)).sum(axis=0) / w.sum())
    g = np.where(m.sum(axis=0) > 0, np.maximum(mean(m / u + r) - mean(r), 0), 0)
    assert found == pytest.approx(g / g.sum())


def test_quality_equals_its_dense_form(spark):
    rng = np.random.default_rng(1)
    m = rng.poisson(8, (12, 5)).astype(float)
    layer, obs, var = long(spark, m)
    grouped = obs.withColumn("g", F.lit(0))
    found = {r.var_id: r.value for r in quality.stdev_logs(layer, grouped, "g").collect()}
    p = (m + 1) / (m + 1).sum(axis=1, keepdims=True)
    assert [found[j] for j in range(5)] == pytest.approx(list(np.log2(p).std(axis=0)))
    folds = back(quality.distinct_folds(layer, obs, var, 1e-3), m.shape)
    f = m / m.sum(axis=1, keepdims=True)
    assert folds == pytest.approx(np.log2((f + 1e-3) / (m.sum(axis=0) / m.sum() + 1e-3)))


def test_samples(spark):
    rng = np.random.default_rng(2)
    m = rng.poisson(3, (8, 6))
    layer, obs, var = long(spark, m)
    cut = back(sampling.downsample(layer, 10, 5), m.shape)
    assert list(cut.sum(axis=1)) == [min(10, s) for s in m.sum(axis=1)] and (cut <= m).all()
    each = spark.createDataFrame([(i, 3 + i) for i in range(m.shape[0])], "obs_id bigint, samples bigint")
    assert list(back(sampling.downsample(layer, each, 5), m.shape).sum(axis=1)) == [min(3 + i, s) for i, s in enumerate(m.sum(axis=1))]
    mixed = back(sampling.shuffle(layer, var, 5), m.shape)
    assert (np.sort(mixed, axis=1) == np.sort(m, axis=1)).all() and (mixed != m).any()
    many = spark.range(1000).withColumnRenamed("id", "obs_id")
    sizes = [r["count"] for r in sampling.random_piles(many, 300, 1).groupBy("pile").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) - min(sizes) <= 1 and len(sizes) == 3
    assert sampling.sample_obs(obs, 3, 1).count() == 3


def test_downsampling_is_hypergeometric(spark):
    """Means and variances of many equal rows, those of draws without replacement; results don't depend on the partitions."""
    counts, n, samples = np.array([40, 25, 10, 5, 0, 20]), 3000, 30
    layer = spark.range(n).select(F.col("id").alias("obs_id"), F.explode(F.array(*[F.struct(F.lit(v).alias("var_id"), F.lit(float(c)).alias("value")) for v, c in enumerate(counts) if c])).alias("c"))
    layer = layer.select("obs_id", "c.var_id", "c.value")
    found = back(sampling.downsample(layer, samples, 1), (n, len(counts)))
    assert (found == back(sampling.downsample(layer.repartition(7), samples, 1), found.shape)).all()
    assert (found.sum(axis=1) == samples).all() and (found <= counts).all()
    total, share = counts.sum(), counts / counts.sum()
    variance = samples * share * (1 - share) * (total - samples) / (total - 1)
    assert np.allclose(found.mean(axis=0), samples * share, atol=5 * np.sqrt(variance.max() / n))
    assert np.allclose(found.var(axis=0), variance, rtol=0.15)
    cov = np.cov(found.T)
    assert np.allclose(cov[0, 1], -samples * share[0] * share[1] * (total - samples) / (total - 1), rtol=0.15)


def test_similarities(spark):
    rng = np.random.default_rng(4)
    m = rng.random((9, 20)) * (rng.random((9, 20)) < 0.5)
    m[3] = 0
    layer, obs, var = long(spark, m)
    with np.errstate(invalid="ignore"):
        r = np.nan_to_num(np.corrcoef(m))
    for e in similarity.similarity(layer, obs, "obs_id", var, "pearson").collect():
        assert e.weight == pytest.approx(r[e.src, e.dst], abs=1e-6)
    names = list(range(20))
    want = dense_logistics(m, 0.8, 5)
    for e in similarity.logistics(layer, obs, "obs_id", names, 0.8, 5).collect():
        assert e.weight == pytest.approx(want[e.src, e.dst])
    both = {r.obs_id: r.distance for r in similarity.aligned_logistics(layer, layer, obs, 20, 0.8, 5).collect()}
    assert set(both.values()) == {0.0}


def dense_logistics(m, location, slope):
    low = 1 / (1 + np.exp(slope * location))
    gap = np.abs(m[:, None, :] - m[None, :, :])
    return (1 / (1 + np.exp(slope * (location - gap))) - low).mean(axis=2) / (1 - low)


def test_graph_and_score_equal_their_dense_forms(spark):
    rng = np.random.default_rng(6)
    s = rng.random((25, 25))
    s = (s + s.T) / 2
    edges = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(25) for j in range(25) if i != j], "src bigint, dst bigint, weight double")
    found = np.zeros((25, 25))
    for e in graph.knn_graph(edges, 25, 5).collect():
        found[e.src, e.dst] = e.weight
    want = dense.knn_weights(s, 5)
    assert found.sum(axis=1) == pytest.approx(np.ones(25)) and ((found > 0) == (want > 0)).mean() > 0.97
    of = np.arange(25) % 3
    of[0] = -1
    nodes = spark.createDataFrame([(i, int(of[i]), 10.0) for i in range(25)], "obs_id bigint, p int, u double")
    weights = spark.createDataFrame([(i, j, float(want[i, j])) for i, j in zip(*map(lambda x: x.tolist(), np.nonzero(want)), strict=True)], "src bigint, dst bigint, weight double")
    got = graph.stability(weights, nodes, "p", "u", 90.0, 100.0, 200.0).first().score
    assert got == pytest.approx(dense.partition_score(want, of, np.full(25, 10.0), 90.0, 200.0))


def test_annealing_finds_blocks():
    block = np.kron(np.eye(4), np.ones((10, 10))) + 0.01
    np.fill_diagonal(block, 0)
    weights = block / block.sum(axis=1, keepdims=True)
    of = dense.candidates(weights, np.full(40, 100.0), 10, 1000.0, 3, seed=1)
    for b in range(4):
        assert len(set(of[10 * b : 10 * b + 10])) == 1
    free = dense.candidates(weights, np.full(40, 100.0), 10, 0, 3, seed=1)  # no bound on totals
    assert sorted(np.bincount(free)) == [10, 10, 10, 10]
    side, strength = dense.min_cut(block)
    assert side.sum() in (10, 20, 30) and strength < 0.1


def test_trees_and_simplex():
    points = np.array([[0.0], [0.1], [5.0], [5.2], [9.0]])
    tree = dense.ward(points)
    assert [sorted(x[:2].astype(int).tolist()) for x in tree[:2]] == [[0, 1], [2, 3]]
    assert list(dense.cut_tree(tree, 5, 2)) == [0, 0, 1, 1, 2]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(0, 10_000))
def test_represent_is_optimal(k, seed):
    rng = np.random.default_rng(seed)
    basis, goal = rng.random((k, 9)), rng.random(9)
    residual, w = dense.represent(goal, basis)
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    for other in rng.dirichlet(np.ones(k), 200):
        assert residual <= np.linalg.norm(goal - other @ basis) + 1e-7


def test_bins():
    sizes = [8 * i + 1 for i in range(10)]
    group = lambda of: [[i for i, b in enumerate(of) if b == x] for x in range(max(of) + 1)]
    assert group(dense.bin_pack(sizes, 106)) == [[3, 9], [4, 8], [5, 7], [0, 1, 2, 6]]
    assert group(dense.bin_fill(sizes, 106)) == [[3, 4, 9], [2, 5, 8], [0, 1, 6, 7]]


def test_projection_finds_its_own_atlas(spark):
    rng = np.random.default_rng(7)
    atlas = rng.integers(50, 500, (6, 12))
    layer, obs, var = long(spark, atlas)
    mine = long(spark, np.vstack([atlas[2], atlas[4]]))
    weights = {(r.src, r.dst): r.weight for r in projection.weights(layer, obs, mine[0], mine[1], var).collect()}
    assert weights[0, 2] == pytest.approx(1, abs=1e-4) and weights[1, 4] == pytest.approx(1, abs=1e-4)
    types = obs.withColumn("type", (F.col("obs_id") % 3).cast("int"))
    found = projection.project(layer, types, mine[0], mine[1], var)
    assert {(r.obs_id, r.type) for r in found["projected_type"].collect()} == {(0, 2), (1, 1)}
    assert {r.similar for r in found["similar"].collect()} == {True}


def test_rare_modules(spark):
    rng = np.random.default_rng(8)
    m = rng.poisson(3, (400, 14)).astype(float)
    m[:, :8] = 0
    m[:20, :4] = rng.integers(7, 12, (20, 4))
    m[20:45, 4:8] = rng.integers(7, 12, (25, 4))
    layer, obs, var = long(spark, m)
    genes, cells = rare.rare_modules(layer, obs, var, 400, least_genes=3, least_cells=5, most_fraction=0.1, related_fold=3)
    of = {r.var_id: r.module for r in genes.collect()}
    assert set(of) == set(range(8)) and len({of[j] for j in range(4)}) == len({of[j] for j in range(4, 8)}) == 1 and of[0] != of[4]
    assert {r.obs_id: r.module for r in cells.collect()} == {i: of[0] if i < 20 else of[4] for i in range(45)}


def test_dataset_parts(spark, matrix, tmp_path):
    layer, obs, var = long(spark, np.abs(matrix))
    data = tables.from_parts(obs, var, layer, "m").named(".clean")
    assert data.scalar("name") == "m.clean" and data.has("vo", MAIN) and not data.has("o", "x")
    cut = data.keep(obs.where("obs_id < 5"), var.where("var_id > 3"), track="was")
    assert cut.obs.count() == 5 and cut.var.count() == 3 and cut.layer().where("obs_id >= 5 OR var_id <= 3").count() == 0
    assert [r.x for r in data.obs_values(MAIN, total=True).orderBy("obs_id").collect()] == pytest.approx(list(np.abs(matrix).sum(axis=1)))
    tables.write(data, str(tmp_path / "d"))
    assert tables.read(spark, str(tmp_path / "d")).layer().count() == layer.count()
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.0)], "src bigint, dst bigint, weight double")
    named = obs.withColumn("obs_name", F.concat(F.lit("n"), "obs_id"))
    tables.write_weights(edges, named, named, str(tmp_path / "w"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "w"), header=True).collect()] == [("n0", "n1", "0.5")]
    with pytest.raises(KeyError):
        data.layer("gone")


def test_related_variables_by_rounds_and_pieces(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(10, 3, 300)
    chain = [base]
    for _ in range(4):
        chain.append(chain[-1] + rng.normal(0, 1.5, 300))
    apart = rng.normal(10, 3, (300, 4))
    m = np.abs(np.column_stack([*chain, apart]))
    layer, obs, var = long(spark, m)
    marked = var.withColumn("lateral_gene", F.col("var_id") == 0)
    corr = np.abs(np.corrcoef(m.T))
    want, added = {0}, {0}
    while added:
        added = {j for i in added for j in range(9) if corr[i, j] >= 0.5} - want
        want |= added
    found = {r.var_id: r.module for r in rare.related_variables(layer, obs, marked, 300, least_correlation=0.5, most=3).collect()}
    assert set(found) == want and len(want) >= 4
    sizes = np.bincount(list(found.values()))
    assert sizes.max() <= 3 and sizes.min() >= 1
    small = rare.related_variables(layer, obs, marked, 300, least_correlation=0.5, most=3, most_piece=2).collect()
    assert {r.var_id for r in small} == want and np.bincount([r.module for r in small]).max() <= 2


def test_components_of_a_long_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "var_id bigint")
    ends = [(i, i + 1, 1.0) for i in range(n - 1)]
    edges = spark.createDataFrame(ends + [(b, a, w) for a, b, w in ends], "src bigint, dst bigint, weight double")
    found = {r.var_id: r.component for r in rare.components(nodes, edges).collect()}
    assert found == {i: 0 if i < n else i for i in range(n + 2)}
    cut = rare.bounded_components(nodes, edges, 0.5, 15).collect()  # equal weights: in the order of ids
    sizes = {}
    for r in cut:
        sizes[r.component] = sizes.get(r.component, 0) + 1
    assert sorted(sizes.values()) == [1, 1, 10, 15, 15]


def test_layout_parts_two_cliques(spark):
    pairs = [(i, j, 1.0) for b in (0, 6) for i in range(b, b + 6) for j in range(b, b + 6) if i != j] + [(5, 6, 0.05), (6, 5, 0.05)]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint, weight double")
    nodes = spark.createDataFrame([(i,) for i in range(13)], "obs_id bigint")
    xy = {r.obs_id: (r.x, r.y) for r in graph.layout(edges, nodes, ["x", "y"]).collect()}
    left, right = [xy[i][0] for i in range(6)], [xy[i][0] for i in range(6, 12)]
    assert max(left) < min(right) or max(right) < min(left)
    assert xy[12] == (0.0, 0.0) and abs(np.mean(left + right)) < 0.2
    nothing = graph.layout(edges.limit(0), nodes.limit(2), ["x", "y"]).collect()
    assert [(r.x, r.y) for r in nothing] == [(0.0, 0.0)] * 2


def test_spread_points_do_not_overlap(spark):
    rng = np.random.default_rng(12)
    rows = [(i, *map(float, rng.uniform(0, 1, 2))) for i in range(12)]
    points = spark.createDataFrame(rows, "obs_id bigint, x double, y double")
    gap = lambda rows: min(np.hypot(a[1] - b[1], a[2] - b[2]) for a in rows for b in rows if a[0] < b[0])
    found = [tuple(r) for r in graph.spread(points, fraction=0.2, rounds=6).collect()]
    assert len(found) == 12 and gap(found) > gap(rows)
    assert graph.spread(points.limit(1)).count() == 1


def test_direct_deals_what_is_too_much_for_a_pile(spark):
    rng = np.random.default_rng(13)
    kinds = rng.integers(5, 60, (3, 8))
    layer, obs, var = long(spark, rng.poisson(kinds[np.arange(60) % 3]))
    data = tables.from_parts(obs, var, layer, "m")
    p = pipelines.Direct(target_size=6, least_size=2, target_umis=0, least_genes=4, top3=1, least_total=1, least_k=4, window=3)
    for most in (8000, 25):
        found = pipelines.direct(data, p, most=most).obs.select("obs_id", "cluster").collect()
        assert len(found) == 60 and max(r.cluster for r in found) >= 1
    whole = pipelines.divide_and_conquer(data, p, pipelines.Piles(least=10, most=20, groups=3), with_rare=False).obs.collect()
    assert len(whole) == 60 and max(r.cluster for r in whole) >= 1


def test_bins_of_each_row(spark):
    m = np.array([[8 * j + 1 for j in range(10)], [200.0] + [0.0] * 9])
    layer, _, _ = long(spark, m)
    rows = grouping.binned(layer, "obs_id", 106.0).collect()
    fills = {}
    for r in rows:
        fills[r.obs_id, r.bin] = fills.get((r.obs_id, r.bin), 0) + m[r.obs_id, r.var_id]
    assert len(rows) == 11 and fills[1, 0] == 200 and all(v <= 106 for k, v in fills.items() if k[0] == 0) and len(fills) == 5
    assert {r.bin for r in grouping.binned(layer, "obs_id", 106.0, fill=True).where("obs_id = 0").collect()} == {0, 1, 2}


def test_annealing_raises_the_whole_score():
    rng = np.random.default_rng(14)
    weights = rng.random((30, 30)) * (rng.random((30, 30)) < 0.4)
    np.fill_diagonal(weights, 0)
    weights /= np.maximum(weights.sum(axis=1, keepdims=True), 1e-300)
    umis, of = np.full(30, 10.0), rng.integers(0, 3, 30)
    cold = dense.anneal(weights, of, umis, 0, np.inf, 0, np.inf, rng, cooldown_pass=0.9, cooldown_node=1.0)
    assert dense.partition_score(weights, cold, umis, 0, 0) >= dense.partition_score(weights, of, umis, 0, 0)
