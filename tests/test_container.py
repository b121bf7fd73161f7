"""Slots of the container: names, optional annotations, pairs and arrays as rows and as frames; NaN over a whole matrix."""

from __future__ import annotations

import pytest

from lattica.dataset import MAIN
from lattica.operators import marginals
from lattica.sources import shared, tables


@pytest.fixture(scope="module")
def data(spark):
    obs = spark.createDataFrame([(0, "a", 1.5), (1, "b", 2.5), (2, "c", 3.5)], "obs_id bigint, obs_name string, age double")
    var = spark.createDataFrame([(0,), (1,)], "var_id bigint")
    layer = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (2, 1, 4.0)], "obs_id bigint, var_id bigint, value double")
    return tables.from_parts(obs, var, layer, "m")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_names_and_optional_annotations(data):
    assert rows(data.names("o")) == [(0, "a"), (1, "b"), (2, "c")] and rows(data.names("v")) == [(0, "0"), (1, "1")]
    assert rows(data.names("o", "age"))[0] == (0, "1.5")
    with pytest.raises(KeyError):
        data.names("v", "absent")
    assert data.maybe_obs_values(None) is None and data.maybe_var_values(None) is None
    assert rows(data.maybe_obs_values("age")) == [(0, 1.5), (1, 2.5), (2, 3.5)]
    assert rows(data.maybe_var_values(MAIN, total=True)) == [(0, 2.0), (1, 5.0)]
    with pytest.raises(KeyError):
        data.maybe_obs_values("absent")


def test_pairs_and_arrays(spark, data):
    edges = lambda *e: spark.createDataFrame(list(e), "src bigint, dst bigint, weight double")
    full = data.with_obs_pairs("near", edges((0, 2, 0.5), (2, 0, 0.25))).with_var_pairs("like", edges((1, 0, 1.0)))
    top = spark.createDataFrame([(0, 1, 9.0), (0, 2, 8.0), (2, 1, 7.0)], "obs_id bigint, rank int, value double")
    full = full.with_obs_array("top", top).with_var_array("top", top.withColumnRenamed("obs_id", "var_id").where("var_id = 0"))
    assert all(full.has(axis, name) for axis, name in (("oo", "near"), ("vv", "like"), ("oa", "top"), ("va", "top")))
    assert rows(full.annotation("oo", "near")) == [(0, 2, 0.5), (2, 0, 0.25)] and len(rows(full.annotation("va", "top"))) == 2
    near = full.annotation_frame("oo", "near")
    assert near.columns == ["obs_id", "0", "2"] and rows(near) == [(0, 0.0, 0.5), (1, 0.0, 0.0), (2, 0.25, 0.0)]
    assert rows(full.annotation_frame("vv", "like")) == [(0, 0.0), (1, 1.0)]
    frame = {r.obs_id: (r["1"], r["2"]) for r in full.annotation_frame("oa", "top").collect()}
    assert frame == {0: (9.0, 8.0), 1: (None, None), 2: (7.0, None)}
    assert {r.var_id: (r["1"], r["2"]) for r in full.annotation_frame("va", "top").collect()} == {0: (9.0, 8.0), 1: (None, None)}
    with pytest.raises(KeyError):
        data.annotation("oa", "top")
    kept = full.keep(obs=spark.createDataFrame([(0,), (1,)], "obs_id bigint"))
    assert rows(kept.annotation("oo", "near")) == [] and len(rows(kept.annotation("oa", "top"))) == 2


def test_nan_over_the_whole(spark):
    values = lambda *v: spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "obs_id bigint, var_id bigint, value double")
    assert tuple(marginals.nan_whole(values(1.0, float("nan"), None, 4.0)).first()) == (2.5, 4.0, 1.0)
    assert tuple(marginals.nan_whole(values(float("nan"))).first()) == (None, None, None)


def test_suppliers_lines_stay_where_they_are(spark, monkeypatch):
    path, found = "/root/testdata/sf0.001", []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (2_000_000, 10):
            monkeypatch.setattr(tables, "BROADCAST_ROWS", most, raising=False)
            layer = tables.supplier_brand(spark, path).layer()
            plan = layer._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning(l_partkey" in plan) == (most == 10)  # else each line was sent to its part
            found.append(rows(layer))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found[0] == found[1] and found[0]


def test_a_written_table_leaves_no_shuffle(spark):
    shuffles = lambda: {str(k) for k in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keySet())}
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = shuffles(), spark.conf.get(conf)
    cells = spark.range(1000).selectExpr("id % 7 AS k", "id AS x")
    summed = cells.groupBy("k").sum("x").repartition(3, "k")
    written = shared.checkpointed(summed)
    assert shuffles() <= before  # they stayed until the driver's garbage was collected
    assert spark.conf.get(conf) == held
    assert rows(written) == rows(summed) and len(rows(written)) == 7  # the plan itself can run again
