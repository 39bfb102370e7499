"""Catalogue queries over canonical groups: a duplicate counts for its master."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .timeseries import OFFER, latest


def with_master(products: DataFrame) -> DataFrame:
    return products.withColumn("master", F.coalesce("canonical_id", "id"))


def search(products: DataFrame, obs: DataFrame, query: str | None = None, category: str | None = None, retailer: str | None = None, on_offer: bool = False, in_stock_only: bool = False, limit: int = 500) -> DataFrame:
    """Offers of the first `limit` masters by (name, id) that match; offer filters come after the limit.

    The query is a folded substring in which % and _ are wildcards.
    """
    found = products.where("canonical_id is null")
    if query:
        found = found.where(F.like(fold(F.col("name")), F.concat(F.lit("%"), fold(F.lit(query)), F.lit("%"))))
    if category is not None:
        found = found.where(F.col("category") == category)
    top = found.orderBy("name", "id").limit(limit).select(F.col("id").alias("master"), F.col("name").alias("m_name"), F.col("brand").alias("m_brand"), F.col("category").alias("m_category"))
    return offers_of(with_master(products).select(F.col("id").alias("product_id"), "master").join(top, "master"), obs, retailer, on_offer, in_stock_only)


def offers_of(members: DataFrame, obs: DataFrame, retailer: str | None = None, on_offer: bool = False, in_stock_only: bool = False) -> DataFrame:
    """The newest offers of `members` (product_id, master, m_name, m_brand, m_category) that pass the filters."""
    offers = latest(obs.join(members.select("product_id"), "product_id", "left_semi"))
    if retailer is not None:
        offers = offers.where(F.col("retailer") == retailer)
    if on_offer:
        offers = offers.where("list_price is not null and list_price > price")
    if in_stock_only:
        offers = offers.where("in_stock = 1")
    return offers.join(members, "product_id").select(F.col("master").alias("product_id"), F.col("product_id").alias("member_id"), F.col("m_name").alias("name"), F.col("m_brand").alias("brand"), F.col("m_category").alias("category"), "retailer", "price", "list_price", "in_stock", "observed_at")


def product_offers(products: DataFrame, obs: DataFrame, product_id: int) -> DataFrame:
    """The newest offers of the product's whole group, cheapest first, missing prices last."""
    all_ = with_master(products)
    group = all_.join(all_.where(F.col("id") == product_id).select(F.col("master")), "master", "left_semi").select(F.col("id").alias("product_id"))
    return latest(obs.join(group, "product_id", "left_semi")).orderBy(F.asc_nulls_last("price"), "product_id", "retailer")


def group_offers(products: DataFrame, obs: DataFrame) -> DataFrame:
    """The newest offers of every group: `latest` plus master."""
    return latest(obs).join(with_master(products).select(F.col("id").alias("product_id"), "master"), "product_id")


def categories(products: DataFrame, limit: int = 200) -> DataFrame:
    named = products.where("category is not null and trim(category) <> ''")
    return named.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(limit)


def retailers(obs: DataFrame) -> DataFrame:
    return obs.select(*OFFER).distinct().groupBy("retailer").agg(F.count("*").alias("n_offers"))


def product_info(products: DataFrame, product_id: int) -> DataFrame:
    """The row of one product, none if there is no such."""
    return products.where(F.col("id") == product_id)


def multi_chain(products: DataFrame, obs: DataFrame) -> DataFrame:
    """Groups that more than one retailer offers."""
    return _multi_chain(products, obs.groupBy(*OFFER).agg(F.count("*").alias("n")))


def _multi_chain(products: DataFrame, offers: DataFrame) -> DataFrame:
    named = offers.join(with_master(products).select(F.col("id").alias("product_id"), "master"), "product_id")
    return named.groupBy("master").agg(F.count_distinct("retailer").alias("n_retailers")).where("n_retailers > 1")


def stats(products: DataFrame, obs: DataFrame) -> DataFrame:
    """One row: canonical products, offers, observations, retailers, groups at more than one retailer.

    Observations are read once, into their number per offer; all else is counted from these.
    """
    offers = obs.groupBy(*OFFER).agg(F.count("*").alias("n"))
    one = offers.agg(F.count("*").alias("offers"), F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.count_distinct("retailer").alias("retailers"))
    masters = products.where("canonical_id is null").agg(F.count("*").alias("products"))
    groups = _multi_chain(products, offers).agg(F.count("*").alias("multi_chain"))
    return masters.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(groups))  # rows of one each


def offer_sketches(obs: DataFrame, by: Sequence[str] = ("retailer",), lg: int = 12) -> DataFrame:
    """(by..., day, products, offers): sketches of the distinct products and offers of each day, to be kept and put together later.

    A sketch has 2**lg cells of one byte, whatever it counts; its estimate is off by 1.04 / sqrt(2**lg) in the mean.
    """
    offer = F.concat_ws("\u0000", F.col("product_id").cast("string"), "retailer")
    return obs.groupBy(*by, F.to_date("observed_at").alias("day")).agg(F.hll_sketch_agg("product_id", lg).alias("products"), F.hll_sketch_agg(offer, lg).alias("offers"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of several days, or tables of them, as one per `by`; a coarser `by` may be merged again."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("products").alias("products"), F.hll_union_agg("offers").alias("offers"))


def distinct_estimates(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_products, n_offers): estimated distinct counts over the rows of `sketches`, from their union."""
    return merge_sketches(sketches, by).select(*by, F.hll_sketch_estimate("products").alias("n_products"), F.hll_sketch_estimate("offers").alias("n_offers"))
