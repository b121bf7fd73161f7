"""Pairs by blocks of dense rows against numpy: all of them, the nearest across two tables, and their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import convey, projection, similarity
from lattica.plans import catalog


def tables(spark, n, m, width, seed):
    """Rows with copies of each other, so that there are ties, and one that does not vary; and a table for each side."""
    rng = np.random.default_rng(seed)
    kinds = rng.integers(0, 6, (n // 4, width)).astype(float) * (rng.random((n // 4, width)) < 0.6)
    x = np.vstack([kinds] * 4 + [np.full((1, width), 2.0)])
    frame = lambda rows: spark.createDataFrame([(i, f"v{j}", float(x[i, j])) for i in rows for j in range(width) if x[i, j]], "obs_id bigint, var_id string, value double")
    ids = lambda rows: spark.createDataFrame([(i,) for i in rows], "obs_id bigint")
    first, second = range(m), range(m, len(x))
    var = spark.createDataFrame([(f"v{j}",) for j in range(width)], "var_id string")
    return x, (frame(first), ids(first), first), (frame(second), ids(second), second), (frame(range(len(x))), ids(range(len(x)))), var


def brute(x):
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(np.round(np.corrcoef(x), 9))


@pytest.fixture
def small_blocks(monkeypatch):
    for name in ("ROWS", "MOST_ROWS", "PAIR_ROWS"):
        monkeypatch.setattr(similarity, name, 32)


def test_top_across_and_all_pairs(spark, small_blocks):
    x, (first, first_obs, mine), (second, second_obs, theirs), (layer, obs), var = tables(spark, 160, 70, 12, 3)
    r = brute(x)
    found = {}
    for row in similarity.top_across(first, first_obs, second, second_obs, var, 5).collect():
        found.setdefault(row.src, []).append((row.place, row.dst))
    for i in mine:
        assert [d for _, d in sorted(found[i])] == sorted(theirs, key=lambda j: (-r[i, j], j))[:5]
    pairs = similarity.pearson(layer, obs, "obs_id", 12).collect()
    assert len(pairs) == len(x) * (len(x) - 1) == len({(p.src, p.dst) for p in pairs})
    assert max(abs(p.weight - r[p.src, p.dst]) for p in pairs) < 1e-8


def test_candidates_make_no_row_for_each_pair(spark):
    _, (first, first_obs, _), (second, second_obs, _), _, var = tables(spark, 40, 10, 6, 4)
    plan = projection.candidates(second, second_obs, first, first_obs, var, 3)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Join Cross" not in plan


def test_all_pairs_are_not_summed_over_each_shared_variable(spark):
    _, _, _, (layer, obs), var = tables(spark, 40, 10, 6, 5)
    plan = similarity.similarity(layer, obs, "obs_id", var, "abs_pearson")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Join Cross" not in plan


def test_far_members_search_no_more_than_they_need(spark, monkeypatch):
    """Among many copies the last ones are no one's nearest: their pairs are found without ranking all of them."""
    from lattica.operators import graph

    n = 160
    kinds = np.random.default_rng(6).integers(1, 9, (n // 80, 6)).astype(float)
    layer = spark.createDataFrame([(i, f"v{j}", float(kinds[i % len(kinds), j])) for i in range(n) for j in range(6)], "obs_id bigint, var_id string, value double")
    obs = spark.range(n).withColumnRenamed("id", "obs_id")
    var = spark.createDataFrame([(f"v{j}",) for j in range(6)], "var_id string")
    asked = []
    top = similarity.top
    monkeypatch.setattr(similarity, "top", lambda first, second, sizes, k, *a, **b: asked.append(k) or top(first, second, sizes, k, *a, **b))
    near = graph.nearest_ranks(layer, obs, "obs_id", var, 1)
    plain = lambda df: sorted((r.src, r.dst, round(r.weight, 9)) for r in df.collect())
    ranks = graph.outgoing_ranks(similarity.pearson(layer, obs, "obs_id", 6).selectExpr("src", "dst", "abs(weight) AS weight"))
    for whole, found in zip(graph.balance(ranks, 1), graph.balance(near, 1), strict=True):
        assert plain(found) == plain(whole)
    assert len(asked) > 1 and max(asked) < n


def test_rows_go_to_few_blocks_in_plain_lists(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS", 32)
    rows = spark.range(2000).selectExpr("0 AS key", "id", "array(named_struct('v', 0, 'x', id / 7)) AS x")
    dealt = similarity._blocked(rows, rows, spark.createDataFrame([(0, 1)], "key int, n bigint"))[0]._df
    assert dealt.count() <= 8 * 2 * 2000  # each row went to 16 blocks
    assert not any("struct" in kind for _, kind in dealt.dtypes)


def test_all_pairs_send_a_row_to_few_blocks_and_come_in_batches(spark, monkeypatch):
    sent, real = [], similarity._blocked
    monkeypatch.setattr(similarity, "_blocked", lambda *a: sent.append(a[3] if len(a) > 3 else similarity.MOST_ROWS) or real(*a))
    monkeypatch.setattr(similarity, "PAIRS", 400)
    x, _, _, (layer, obs), var = tables(spark, 160, 70, 12, 9)
    pairs = similarity.pearson(layer, obs, "obs_id", 12).collect()
    r = brute(x)
    assert len({(p.src, p.dst) for p in pairs}) == len(pairs) == len(x) * (len(x) - 1)
    assert max(abs(p.weight - r[p.src, p.dst]) for p in pairs) < 1e-8
    weight = {(p.src, p.dst): p.weight for p in pairs}
    assert all(weight[d, s] == w for (s, d), w in weight.items())
    assert sent and min(sent) * similarity.BLOCKS >= 260_000  # 1024 rows a block sent each row of a large table to ever more blocks


def test_pairs_are_conveyed_to_groups_without_a_row_for_each(spark):
    x, _, _, (layer, obs), var = tables(spark, 80, 10, 7, 10)
    layer = layer.where("obs_id != 3")  # one without any value, and tables() has one that does not vary
    obs = obs.withColumn("cluster", F.when(F.col("obs_id") == 5, 9).when(F.col("obs_id") < 3, -1).otherwise(F.col("obs_id") % 4).cast("int"))
    plain = lambda df: {(r.src, r.dst): r.weight for r in df.collect()}
    want = plain(convey.pairs_to_group_pairs(similarity.similarity(layer, obs, "obs_id", var, "pearson"), obs, "cluster"))
    found = convey.pearson_to_group_pairs(layer, obs, "cluster", 7)
    assert plain(found) == pytest.approx(want, abs=1e-9) and (9, 9) not in want and len(want) == 24
    plan = catalog.QUERIES["convey_pairs_to_groups"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan  # all pairs were rows


def test_neighbours_grow_until_each_supplier_has_two(spark, tmp_path):
    """One supplier is unlike all others, so no one but its best is near it for a small k."""
    import duckdb

    n, rng = 330, np.random.default_rng(11)
    sums = np.hstack([rng.integers(30, 60, (n, 8)), np.ones((n, 4), dtype=int)])
    sums[7] = [1] * 8 + [50, 40, 30, 45]
    sums[:, 3] = 1 + np.arange(n) % 17
    frames = {
        "supplier": spark.createDataFrame([(i, f"s{i}", i % 3) for i in range(n)], "s_suppkey bigint, s_name string, s_nationkey int"),
        "nation": spark.createDataFrame([(i, i) for i in range(3)], "n_nationkey int, n_regionkey int"),
        "part": spark.createDataFrame([(j, f"b{j:02}") for j in range(12)], "p_partkey bigint, p_brand string"),
        "lineitem": spark.createDataFrame([(i, j, float(sums[i, j])) for i in range(n) for j in range(12)], "l_suppkey bigint, l_partkey bigint, l_quantity double"),
    }
    con = duckdb.connect()
    for name, df in frames.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = {(r.src, r.dst): r.weight for r in catalog.QUERIES["knn_graph"](spark, str(tmp_path)).collect()}
    want = {(s, d): w for s, d, w in con.execute(f"SELECT src, dst, weight FROM ({catalog.ORACLE_SQL['knn_graph']})").fetchall()}
    degrees = np.bincount([s for s, _ in found], minlength=n)
    assert degrees.min() >= 2 and np.median(degrees) > 5  # with k = 5 the odd one had one
    assert found == want


def test_weights_send_the_row_of_a_query_member_once(spark):
    cells = lambda rows: spark.createDataFrame([(i, v, float(x)) for i, row in rows.items() for v, x in row.items()], "obs_id bigint, var_id string, value double")
    ids = lambda rows: spark.createDataFrame([(i,) for i in rows], "obs_id bigint")
    atlas = {1: {"a": 300, "b": 100, "c": 50}, 2: {"a": 100, "b": 300}, 3: {"c": 400}}
    query = {7: {"a": 200, "b": 200, "c": 25}, 8: {"c": 80}, 9: {}}
    var = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "var_id string")
    found = projection.weights(cells(atlas), ids(atlas), cells(query), ids(query), var, log=False, most_fold=99.0)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()  # it went beside each candidate's row
    rows = {(r.src, r.dst): round(r.weight, 9) for r in found.collect()}
    assert {s for s, _ in rows} == {7, 8} and rows[8, 3] == 1.0 and abs(sum(w for (s, _), w in rows.items() if s == 7) - 1) < 1e-8


def test_types_read_written_candidates(spark):
    plan = catalog.QUERIES["projected_types"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan


def test_misfits_read_a_written_matrix(spark):
    plan = catalog.QUERIES["misfit_variables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan  # query and atlas joined the lines anew in each step
