"""Reference-shaped frames over the star-schema tables: what every query starts from.

A chain is a region (through supplier and nation), a product a part, an observation a line
item; lists are orders and their items line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """`frame` dealt out, for rows that are few bytes but much work: a small file is read by one task."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, retailer): a dimension; the planner broadcasts it by its size."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("retailer"))


def price_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").join(chains(spark, sf_dir), "l_suppkey").select(
        F.col("l_partkey").alias("product_id"), "retailer", F.col("l_shipdate").alias("observed_at"), price.alias("price"),
        F.when(F.col("l_discount") > 0, price / (1 - F.col("l_discount"))).alias("list_price"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("in_stock"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, brand, category, canonical_id): duplicates by name and brand point to the least id."""
    p = table(spark, sf_dir, "part")
    master = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("m"))
    return p.join(master, ["p_name", "p_brand"]).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.when(F.col("m") != F.col("p_partkey"), F.col("m")).alias("canonical_id"))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.nullif(F.col("o_custkey") % 10, F.lit(0)).alias("user_id"), F.col("o_orderdate").alias("updated_at"))


def candidate_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_id, product_a, product_b, score, status): orders as pairs of parts, one for each pair."""
    o = table(spark, sf_dir, "orders")
    pairs = o.select((1 + F.col("o_orderkey") % 101).alias("product_a"), (1 + F.col("o_orderkey") % 101 + 1 + F.col("o_custkey") % 7).alias("product_b"), F.col("o_orderkey"))
    one = pairs.groupBy("product_a", "product_b").agg(F.min("o_orderkey").alias("candidate_id"))
    score = (F.col("candidate_id") % 100).cast("double") / 100
    status = F.when(F.col("candidate_id") % 5 == 0, "approved").when(F.col("candidate_id") % 5 == 1, "rejected").otherwise("pending")
    return one.select("candidate_id", "product_a", "product_b", score.alias("score"), status.alias("status"))


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("qty"), F.col("l_shipdate").alias("added_at"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("added_price"))
