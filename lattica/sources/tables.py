"""Sources and sinks: datasets from relational tables, Parquet folders, CSV of projection weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.dataset import MAIN, Dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without_zeros(layer: DataFrame) -> DataFrame:
    """NaN and NULL are missing, zeros are implicit."""
    return layer.where("value IS NOT NULL AND NOT isnan(value) AND value != 0")


#: Rows of a table of keys and names that are broadcast at most: some 64 bytes each, in the driver and in each executor.
BROADCAST_ROWS = 2_000_000


def _sent_whole(names: DataFrame) -> DataFrame:
    """names, slim rows of a key and a name, marked for broadcast if they are few enough, so that the many rows that look
    them up stay where they are; else as it is, so that the join shuffles both."""
    return F.broadcast(names) if names.count() <= BROADCAST_ROWS else names


def from_parts(obs: DataFrame, var: DataFrame, layer: DataFrame, name: str = "") -> Dataset:
    return Dataset(obs, var, {MAIN: _without_zeros(layer)}, meta={"name": name})


def customer_brand(spark: SparkSession, sf_dir: str) -> Dataset:
    """Customers by brands, the quantity bought; nation, region and segment annotate the customers."""
    return _orders_by(spark, sf_dir, "p_brand", "customer.brand")


def customer_type(spark: SparkSession, sf_dir: str) -> Dataset:
    return _orders_by(spark, sf_dir, "p_type", "customer.type")


def _orders_by(spark: SparkSession, sf_dir: str, var: str, name: str) -> Dataset:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(var).alias("var_id"))
    layer = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("obs_id"), "var_id")
        .agg(F.sum("l_quantity").alias("value"))
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    obs = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("obs_id"),
            F.col("c_name").alias("obs_name"),
            F.col("c_nationkey").alias("cluster"),
            F.col("n_regionkey").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance"),
        )
    )
    return from_parts(obs, part.select("var_id").distinct(), layer, name)


def supplier_brand(spark: SparkSession, sf_dir: str) -> Dataset:
    """Suppliers by brands, the quantity delivered."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("var_id"))
    layer = (
        lines.join(_sent_whole(part), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("obs_id"), "var_id")
        .agg(F.sum("l_quantity").alias("value"))
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    obs = (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("s_suppkey").alias("obs_id"),
            F.col("s_name").alias("obs_name"),
            F.col("s_nationkey").alias("cluster"),
            F.col("n_regionkey").alias("type"),
        )
    )
    return from_parts(obs, part.select("var_id").distinct(), layer, "supplier.brand")


def embeddings(spark: SparkSession, sf_dir: str) -> Dataset:
    """Vectors by positions."""
    vectors = table(spark, sf_dir, "embeddings")
    layer = vectors.select(F.col("vec_id").alias("obs_id"), F.posexplode("embedding").alias("var_id", "value"))
    layer = layer.select("obs_id", F.col("var_id").cast("bigint"), F.col("value").cast("double"))
    obs = vectors.select(F.col("vec_id").alias("obs_id"), F.col("label").alias("cluster"))
    return from_parts(obs, layer.select("var_id").distinct(), layer, "embeddings")


def write(data: Dataset, path: str) -> None:
    """A folder of Parquet tables, one for each part."""
    data.obs.write.mode("overwrite").parquet(f"{path}/obs")
    data.var.write.mode("overwrite").parquet(f"{path}/var")
    for kind, parts in (("layer", data.layers), ("oo", data.obs_pairs), ("vv", data.var_pairs)):
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{path}/{kind}/{name}")


def read(spark: SparkSession, path: str, layers: list[str] | None = None) -> Dataset:
    return Dataset(
        spark.read.parquet(f"{path}/obs"),
        spark.read.parquet(f"{path}/var"),
        {name: spark.read.parquet(f"{path}/layer/{name}") for name in layers or [MAIN]},
    )


def write_weights(weights: DataFrame, atlas: DataFrame, query: DataFrame, path: str) -> None:
    """CSV with header query,atlas,weight of weights(src: query, dst: atlas, weight), by names, non-zeros only."""
    names = lambda d, key, name: d.select(F.col("obs_id").alias(key), F.col("obs_name").alias(name))
    (
        weights.where("weight != 0")
        .join(names(query, "src", "query"), "src")
        .join(names(atlas, "dst", "atlas"), "dst")
        .select("query", "atlas", "weight")
        .write.mode("overwrite")
        .csv(path, header=True)
    )
