"""Latest and as-of prices, histories and movers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cents

OFFER = ["product_id", "retailer"]
#: Partitions of the changes of prices for each one of spark.sql.shuffle.partitions.
PARTS_EACH = 16


def latest(obs: DataFrame, keys: Sequence[str] = OFFER, upto: Column | None = None) -> DataFrame:
    """The newest observations per offer, all of those that tie; `upto` makes it as of a time.

    One shuffle by the offer; WindowGroupLimit drops the older rows before and after it.
    """
    rows = obs if upto is None else obs.where(F.col("observed_at") <= upto)
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("observed_at")))).where("_r = 1").drop("_r")


def now_of(obs: DataFrame) -> DataFrame:
    return obs.agg(F.max("observed_at").alias("now"))


def offer_changes(obs: DataFrame, days: int) -> DataFrame:
    """(product_id, retailer, old, new, pct, observed_at): the newest price of each offer against its price `days` before the newest observation of all.

    Baseline: the newest observation at or before the cutoff, if its price is over 0. Where
    several observations share a time, the change is between their extremes, for no other
    pair of theirs can be larger.
    """
    cut = obs.join(F.broadcast(now_of(obs)), how="cross").withColumn("past", F.col("observed_at") <= F.col("now") - F.expr(f"interval {int(days)} days"))
    price = F.col("price")
    above = F.when(price > 0, price)
    # by offer and time, by offer, and then by product, after one shuffle; a task holds what it has of all three, so there are many
    parts = PARTS_EACH * int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = cut.repartition(parts, "product_id").groupBy(*OFFER, "observed_at", "past").agg(F.max(price).alias("n1"), F.min(price).alias("n2"), F.max(above).alias("o1"), F.min(above).alias("o2"))
    newest, last_past = F.col("observed_at"), F.when(F.col("past"), F.col("observed_at"))
    ends = times.groupBy(*OFFER).agg(F.max("observed_at").alias("observed_at"), *[F.max_by(c, newest).alias(c) for c in ("n1", "n2")], *[F.max_by(c, last_past).alias(c) for c in ("o1", "o2")])
    pairs = ends.select(*OFFER, "observed_at", F.explode(F.array("n1", "n2")).alias("new"), F.array("o1", "o2").alias("_o"))
    pairs = pairs.select(*OFFER, "observed_at", "new", F.explode("_o").alias("old")).where("old is not null and new is not null and old <> new")
    return pairs.withColumn("pct", (F.col("new") - F.col("old")) / F.col("old") * 100)


def biggest_changes(obs: DataFrame, products: DataFrame, days: int = 30, limit: int | None = 40, product_ids: Sequence[int] | None = None) -> DataFrame:
    """Per product its offer with the largest change since `days` before the newest observation.

    Ties of |pct| go to the least retailer, then to the dearer price. Prices and change have
    two places and pct one; the order is by the rounded |pct|. An empty list of products means all.
    """
    rows = obs.where(F.col("product_id").isin(list(product_ids))) if product_ids else obs
    order = F.struct(-F.abs("pct"), "retailer", -F.col("new"), -F.col("old"))
    best = offer_changes(rows, days).groupBy("product_id").agg(F.min_by(F.struct("retailer", "old", "new", "pct", "observed_at"), order).alias("m")).select("product_id", "m.*")
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10
    named = best.join(products.select(F.col("id").alias("product_id"), "name", "brand", "category"), "product_id")
    out = named.select("product_id", "name", "brand", "category", "retailer", cents(F.col("old")).alias("old"), cents(F.col("new")).alias("new"), cents(F.col("new") - F.col("old")).alias("change"), tenth(F.col("pct")).alias("pct"), "observed_at")
    return out if limit is None else out.orderBy(F.desc(F.abs("pct")), "product_id").limit(limit)


def movers(changes: DataFrame, limit: int = 40) -> tuple[DataFrame, DataFrame]:
    """(up, down) of :func:`biggest_changes`: the 2 * limit largest, split by sign, at most `limit` of each."""
    top = changes.orderBy(F.desc(F.abs("pct")), "product_id").limit(2 * limit)
    pick = lambda where: top.where(where).orderBy(F.desc(F.abs("pct")), "product_id").limit(limit)
    return pick("pct > 0"), pick("pct < 0")


def price_history(obs: DataFrame, product_id: int, retailer: str) -> DataFrame:
    return obs.where((F.col("product_id") == product_id) & (F.col("retailer") == retailer)).select("observed_at", "price", "list_price", "in_stock")


def history_map(obs: DataFrame) -> DataFrame:
    """(product_id, history): map of retailer to its series (observed_at, price) in order of time."""
    series = obs.groupBy(*OFFER).agg(F.sort_array(F.collect_list(F.struct("observed_at", "price"))).alias("series"))
    return series.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("retailer", "series"))).alias("history"))


def stretches(obs: DataFrame, keys: Sequence[str] = OFFER) -> DataFrame:
    """(keys..., from_at, to_at, price, n): the stretches of equal prices of each series, in the order of time and price; null equals null.

    Windows and the grouping need one shuffle by the keys, and no row leaves the JVM; `tw_stretches` is the same as a table function.
    """
    parts = PARTS_EACH * int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy(*keys).orderBy("observed_at", "price")
    same = (F.row_number().over(w) > 1) & F.col("price").eqNullSafe(F.lag("price").over(w))
    cut = obs.select(*keys, "observed_at", "price").repartition(parts, *keys).withColumn("_fresh", F.when(same, 0).otherwise(1))
    cut = cut.withColumn("_k", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = cut.groupBy(*keys, "_k").agg(F.min("observed_at").alias("from_at"), F.max("observed_at").alias("to_at"), F.max("price").alias("price"), F.count("*").cast("int").alias("n"))
    return ends.drop("_k")


def discount_percent(obs: DataFrame) -> DataFrame:
    return obs.withColumn("discount_pct", F.when(F.col("list_price") > 0, 100 * (F.col("list_price") - F.col("price")) / F.col("list_price")))


def spread(latest_rows: DataFrame) -> DataFrame:
    """Per product the least and greatest price and the number of offer rows."""
    return latest_rows.groupBy("product_id").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.count("*").alias("retailer_count"))


def catalogue(latest_rows: DataFrame) -> DataFrame:
    """(product_id, prices): map of retailer to its price in cents' precision; of ties the dearest."""
    one = latest_rows.where("price is not null").groupBy(*OFFER).agg(F.max("price").alias("price"))
    return one.groupBy("product_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("retailer", cents(F.col("price")).alias("price"))))).alias("prices"))
