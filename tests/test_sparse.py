"""Extremes over zeros that have no row, against dense numpy versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import deviants, quality, sparse
from tests.test_operators import long


@pytest.mark.parametrize("count", [1, 3])
def test_first_missing_equals_a_walk(spark, count):
    rng = np.random.default_rng(count)
    axis = [(k, int(rng.integers(0, 9)), rng.random()) for k in range(80)] + [(80, 5, 1.0), (81, 5, 0.0), (82, 0, 0.0)]
    held = {k: [p for p in range(n) if rng.random() < share] for k, n, share in axis}
    rows = spark.createDataFrame([(k, n) for k, n, _ in axis], "k int, n bigint")
    places = spark.createDataFrame([(k, p) for k, found in held.items() for p in found] + [(99, 0)], "k int, position bigint")
    found = sparse.first_missing(rows, places, ["k"], count)
    want = [(k, p) for k, n, _ in axis for p in [p for p in range(n) if p not in held[k]][:count]]
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.fixture(scope="module")
def grouped():
    """A matrix with many zeros, a full row, an empty row and an empty column; groups of different sizes and an outlier."""
    rng = np.random.default_rng(8)
    m = rng.poisson(6, (15, 9)) * (rng.random((15, 9)) < 0.45)
    m[0], m[3], m[:, 4] = rng.integers(1, 30, 9), 0, 0
    m[7] = m[8]
    return m.astype(float), np.array([0] * 7 + [1] * 5 + [2] * 2 + [-1])


@pytest.mark.parametrize("count", [1, 4, 20])
def test_top_distinct(spark, grouped, count):
    m, _ = grouped
    layer, obs, var = long(spark, m)
    f = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    e = m.sum(axis=0) / m.sum()
    dense = np.where(e == 0, 0, np.log2((f + 1e-3) / (e + 1e-3)))
    found = {(r.obs_id, r["rank"]): (r.var_id, r.value) for r in quality.top_distinct(layer, obs, var, 1e-3, count).collect()}
    assert len(found) == len(m) * min(count, m.shape[1])
    for i, row in enumerate(dense):
        order = sorted(range(len(row)), key=lambda j: (-round(abs(row[j]), 12), j))[:count]
        assert [found[i, k + 1][0] for k in range(len(order))] == order
        assert [found[i, k + 1][1] for k in range(len(order))] == pytest.approx(list(row[order]))


def test_top_distinct_makes_no_row_for_each_pair(spark, grouped):
    layer, obs, var = long(spark, grouped[0])
    plan = quality.top_distinct(layer, obs, var, 1e-3, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan


def test_inner_folds_equal_those_of_all_members(spark, grouped):
    m, g = grouped
    layer, obs, _ = long(spark, m)
    obs = obs.join(spark.createDataFrame([(i, int(x)) for i, x in enumerate(g)], "obs_id bigint, g int"), "obs_id")
    rng = np.random.default_rng(9)
    profile = rng.random((3, 9)) * (rng.random((3, 9)) < 0.8)
    profiles = spark.createDataFrame([(i, j, float(profile[i, j])) for i, j in zip(*map(lambda a: a.tolist(), np.nonzero(profile)), strict=True)], "group_id int, var_id bigint, value double")
    # a variable that no member has may still be expected of a group
    totals = spark.createDataFrame([(i, j, float(m[g == i, j].sum()) + 5 * (j == 4)) for i in range(3) for j in range(9)], "group_id int, var_id bigint, value double")
    found = {(r.group_id, r.var_id): r.value for r in quality.inner_folds(layer, obs, profiles, totals, "g", 5).collect()}
    want = {}
    for i in range(3):
        members = [k for k in np.flatnonzero(g == i) if m[k].sum()]
        for j in range(9):
            if m[g == i, j].sum() + 5 * (j == 4) >= 5 and members:
                want[i, j] = max((np.log2(m[k, j] + 1) - np.log2(m[k].sum() * profile[i, j] + 1) for k in members), key=lambda v: (round(abs(v), 12), v))
    assert found.keys() == want.keys()
    assert [found[k] for k in want] == pytest.approx(list(want.values()))
    dense = quality.deviant_folds(layer, obs, profiles, totals, "g", least=5).groupBy("group_id", "var_id").agg(F.max(F.abs("value")).alias("size"))
    assert {(r.group_id, r.var_id): pytest.approx(r["size"]) for r in dense.collect()} == {k: abs(v) for k, v in found.items()}


@pytest.mark.parametrize("noisy", [False, True])
def test_fold_factors_equal_the_dense_ones(spark, grouped, noisy):
    m, g = grouped
    layer, obs, var = long(spark, m)
    obs = obs.join(spark.createDataFrame([(i, int(x)) for i, x in enumerate(g)], "obs_id bigint, g int"), "obs_id")
    loud = var.where("var_id IN (1, 2)") if noisy else None
    found = {(r.obs_id, r.var_id): r.value for r in deviants.fold_factors(layer, obs, "g", 0.3, loud).collect()}
    want = {}
    for i in range(3):
        members = [k for k in np.flatnonzero(g == i) if m[k].sum()]
        u = m[members].sum(axis=1)
        for j in range(9):
            if noisy and j in (1, 2):
                continue
            middle = np.median(m[members, j] / u)
            for k, total in zip(members, u, strict=True):
                fold = abs(np.log2((m[k, j] + 1) / (total * middle + 1)))
                if fold >= 0.3:
                    want[k, j] = fold
    assert found.keys() == want.keys() and len(want) > 20
    assert any(m[k, j] == 0 for k, j in want)
    assert [found[k] for k in want] == pytest.approx(list(want.values()))


def test_dissolve_compares_groups_by_what_they_lack(spark):
    """Group 1 is small, holds nothing of the common variable and is convincing by that alone; group 2 is like the whole."""
    m = np.zeros((40, 3))
    m[:36, 0], m[:36, 1] = 90, 10
    m[36:38, 1] = 100
    m[38:, 0], m[38:, 1] = 87, 13
    layer, obs, var = long(spark, m)
    g = [0] * 36 + [1] * 2 + [2] * 2
    obs = obs.join(spark.createDataFrame(list(enumerate(g)), "obs_id bigint, g int"), "obs_id")
    none = spark.createDataFrame([], "obs_id bigint")
    left = {r.obs_id: r.g for r in deviants.dissolve(layer, obs, "g", none, least_size=2, convincing=6.0).collect()}
    assert left[0] == 0 and left[36] == 1 and left[38] == -1
