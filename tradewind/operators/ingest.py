"""The write path as folds: immutable frames in, immutable frames out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantity import extract_size
from ..functions.pairing import between, name_classes, with_class
from ..functions.similarity import AUTO_BLOCK
from ..functions.text import product_key
from ..session import kept
from .timeseries import latest


def fold_products(rows: DataFrame, at: str = "observed_at") -> DataFrame:
    """Products by product_key: newest name, newest known brand, category and image, first and last seen. Idempotent and order-free."""
    newest = lambda c: F.max_by(c, F.struct(at, c)).alias(c)
    known = lambda c: F.expr(f"max_by({c}, struct({at}, {c})) filter (where {c} is not null)").alias(c)
    return rows.groupBy("product_key").agg(newest("name"), *[known(c) for c in ("brand", "category", "image_url") if c in rows.columns], F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def fold_offers(rows: DataFrame, keys: Sequence[str] = ("product_key", "retailer"), at: str = "observed_at") -> DataFrame:
    known = lambda c: F.expr(f"max_by({c}, struct({at}, {c})) filter (where {c} is not null)").alias(c)
    return rows.groupBy(*keys).agg(*[known(c) for c in ("sku", "url") if c in rows.columns], F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def backfill_size(products: DataFrame) -> DataFrame:
    """size_dim and size_value, written once."""
    size = extract_size(F.col("name"))
    absent = F.col("size_value").isNull()
    return products.withColumn("size_dim", F.when(absent, size["dim"]).otherwise(F.col("size_dim"))).withColumn("size_value", F.when(absent, size["amount"]).otherwise(F.col("size_value")))


def purge(offers: DataFrame, history: DataFrame, retailer: str) -> tuple[DataFrame, DataFrame]:
    """Offers and history without one retailer; products stay."""
    gone = offers.where(F.col("retailer") == retailer)
    return offers.where(~F.col("retailer").eqNullSafe(F.lit(retailer))), history.join(gone.select(F.col("id").alias("offer_id")), "offer_id", "left_anti")


def shared_skus(rows: DataFrame) -> DataFrame:
    """SKUs that more than one retailer uses."""
    return rows.groupBy("sku").agg(F.count_distinct("retailer").alias("n_retailers")).where("n_retailers > 1")


def replay(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshot rows to (harvested, counts): rows without name, retailer or price are skipped; the name is the key."""
    name = F.coalesce("product", "name") if "name" in rows.columns else F.col("product")
    ok = (F.trim(F.coalesce(name, F.lit(""))) != "") & (F.trim(F.coalesce("retailer", F.lit(""))) != "") & F.col("price").isNotNull()
    counts = rows.agg(F.count_if(ok).alias("ingested"), F.count_if(~ok).alias("skipped"), F.lit(0).cast("long").alias("errors"))  # a fold has no row that fails
    return rows.where(ok).withColumn("product_key", F.concat(F.lit("sku:"), name)), counts


def upsert_rows(products: DataFrame, offers: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, offers) after harvested `rows`: both folds over what is stored and what is new, sizes filled in once.

    `rows`: name, brand, category, image_url, retailer, sku, url, shared_key, observed_at.
    Stored products have product_key, name, brand, category, image_url, first_seen, last_seen,
    size_dim, size_value; stored offers product_key, retailer, sku, url, first_seen, last_seen.
    A stored row counts as observed when last seen, so an older harvest changes no newer value.
    """
    keyed = rows.withColumn("product_key", product_key(F.col("shared_key"), F.col("name"), F.col("brand")))
    kept = ["product_key", "name", "brand", "category", "image_url"]
    both = products.select(*kept, F.col("last_seen").alias("observed_at"), F.col("first_seen").alias("_first")).unionByName(keyed.select(*kept, "observed_at", F.col("observed_at").alias("_first")))
    folded = fold_products(both).drop("first_seen").join(both.groupBy("product_key").agg(F.min("_first").alias("first_seen")), "product_key")
    sized = backfill_size(folded.join(products.select("product_key", "size_dim", "size_value"), "product_key", "left"))
    mine = ["product_key", "retailer", "sku", "url"]
    seen = offers.select(*mine, F.col("last_seen").alias("observed_at"), F.col("first_seen").alias("_first")).unionByName(keyed.select(*mine, "observed_at", F.col("observed_at").alias("_first")))
    sold = fold_offers(seen).drop("first_seen").join(seen.groupBy("product_key", "retailer").agg(F.min("_first").alias("first_seen")), ["product_key", "retailer"])
    return sized, sold


def record_prices(history: DataFrame, rows: DataFrame) -> DataFrame:
    """`history` with observations `rows` (offer_id, observed_at, price, list_price, unit_price, unit, in_stock boolean) appended; in_stock becomes 1 or 0."""
    return history.unionByName(rows.withColumn("in_stock", F.col("in_stock").cast("int")), allowMissingColumns=True)


def block_duplicates(fresh: DataFrame, products: DataFrame, least: float = AUTO_BLOCK) -> DataFrame:
    """(dup, master): new products (id, name, brand, category) that score `least` or more with a stored canonical product of their category.

    Candidates meet by the words that tell them apart, with brand and size, and not by each
    word of a category; a null category is one of its own.

    Names are compared once, however many products have them: of each class and category the two
    least stored ids are known, the second for a new product that has the first one's id.
    """
    stored = products.where("canonical_id is null and id is not null").select("id", "name", "brand", "category")
    names, known = name_classes(fresh.select("name", "brand").unionByName(stored.select("name", "brand")))
    new = with_class(fresh.where("id is not null").select("id", "name", "brand", "category"), names).select("id", "class", "category")
    old = kept(_least_two(with_class(stored, names), ["class", "category"], "id").select(F.col("class").alias("b"), "category", F.col("id").alias("candidate")))
    asked = kept(new.select("class", "category").distinct())
    of = lambda frame, c: known.join(frame.select(F.col(c).alias("id")).distinct(), "id", "left_semi")
    close = between(of(asked, "class"), of(old, "b"), least)
    theirs = old.withColumnRenamed("category", "_c")
    met = asked.join(close, asked["class"] == close["a"]).join(theirs, "b").where(F.col("category").eqNullSafe(F.col("_c"))).select("class", "category", "score", "candidate")
    best = _least_two(met, ["class", "category"], F.desc("score"), "candidate")
    two = best.groupBy("class", "category").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "candidate"))).alias("m"))
    told = two.select("class", F.col("category").alias("_c"), F.get("m.candidate", F.lit(0)).alias("one"), F.get("m.candidate", F.lit(1)).alias("two"))
    found = new.join(told, "class").where(F.col("category").eqNullSafe(F.col("_c"))).select(F.col("id").alias("dup"), F.when(F.col("one") != F.col("id"), F.col("one")).otherwise(F.col("two")).alias("master"))
    return found.where("master is not null")


def _least_two(rows: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The first two rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r <= 2").drop("_r")


def merge_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """The newest rows of each source's offers, put together: what is replayed when sources are merged. Sources may lack columns."""
    newest = [latest(f, ("product_key", "retailer")) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), newest)


def copy_with_ids(offers: DataFrame, history: DataFrame, target: DataFrame, key: Sequence[str] = ("product_key", "retailer")) -> DataFrame:
    """`history` under the offer ids of `target` (id, key...), matched to `offers` (id, key...) by key; what has no match stays behind."""
    ids = offers.select(F.col("id").alias("offer_id"), *key).join(target.select(F.col("id").alias("_new"), *key), list(key)).select("offer_id", "_new")
    return history.join(ids, "offer_id").withColumn("offer_id", F.col("_new")).drop("_new")


def best_match(rows: DataFrame, scored: DataFrame, least: float = 0.92) -> DataFrame:
    """(id, master): per new row the best scored (id, candidate, score) at or over `least`, ties to the least candidate."""
    best = scored.where(F.col("score") >= least).groupBy("id").agg(F.max_by("candidate", F.struct("score", -F.col("candidate"))).alias("master"))
    return rows.join(best, "id", "left")
