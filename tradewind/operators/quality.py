"""Data-quality gate over harvested rows, and score distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cents, fold

# Fixed value: what a price per unit looks like inside a name.
UNIT_IN_NAME = r"(?iu)(?U)(/\s*|αν[αά]\s+)(κιλ|λ[ίι]τρ|kg|kgr|lt|ltr|gr\b|ml\b)"


def price_mode(rows: DataFrame) -> DataFrame:
    """(retailer, modal_price, modal_n): the most frequent price in cents, ties to the least."""
    counts = rows.where("price is not null").groupBy("retailer", cents(F.col("price")).alias("p")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("retailer").orderBy(F.desc("n"), "p")
    return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("retailer", F.col("p").alias("modal_price"), F.col("n").alias("modal_n"))


def gate(rows: DataFrame, sources: DataFrame | None = None, blocked: Sequence[str] = ()) -> DataFrame:
    """Per retailer the counts behind the checks and a status of PASS, WARN or FAIL.

    `rows`: retailer, name, brand, category, image_url, price. A retailer of `sources`
    (retailer) without rows fails; one of `blocked` without rows is BLOCKED.
    """
    price, brand = F.col("price"), fold(F.col("brand"))
    leak = (brand != "") & F.startswith(fold(F.col("name")), brand)
    sums = rows.groupBy("retailer").agg(
        F.count("*").alias("n"), F.count("price").alias("priced"), F.count_if(~((price > 0) & (price < 1000))).alias("odd"), F.count_if(leak).alias("leaks"), F.count_if(F.col("name").rlike(UNIT_IN_NAME)).alias("unit_names"),
        *[F.count_if(F.coalesce(c, F.lit("")) != "").alias(f"have_{c}") for c in ("category", "brand", "image_url")],
    )
    if sources is not None:
        sums = sources.select("retailer").distinct().join(sums, "retailer", "full_outer").fillna(0)
    out = sums.join(price_mode(rows), "retailer", "left")
    shut = (F.col("n") == 0) & F.col("retailer").isin(list(blocked))
    fail = (F.col("priced") == 0) | (F.col("leaks") > 0.3 * F.col("n"))
    warn = (F.col("odd") > 0) | (F.col("n") - F.col("priced") > 0.25 * F.col("n")) | (F.col("leaks") > 0) | (F.col("unit_names") > 0) | ((F.col("modal_n") > 0.5 * F.col("priced")) & (F.col("priced") > 4)) | (F.col("have_category") == 0) | (F.col("have_brand") == 0) | (F.col("have_image_url") == 0)
    return out.withColumn("status", F.when(shut, "BLOCKED").when(fail, "FAIL").when(F.coalesce(warn, F.lit(False)), "WARN").otherwise("PASS"))


def score_histogram(scored: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """(bin, n): numbers of scores by tenths; with `obs` also how many pairs share a retailer, and how many share none."""
    at = (F.floor(F.col("score") * 10 + 0.5) / 10).alias("bin")
    if obs is None:
        return scored.groupBy(at).agg(F.count("*").alias("n"))
    shops = obs.groupBy("product_id").agg(F.collect_set("retailer").alias("r"))
    side = lambda s: shops.select(F.col("product_id").alias(f"product_{s}"), F.col("r").alias(f"r_{s}"))
    both = scored.join(side("a"), "product_a", "left").join(side("b"), "product_b", "left").withColumn("same", F.coalesce(F.arrays_overlap("r_a", "r_b"), F.lit(False)))
    return both.groupBy(at).agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"), F.count_if(~F.col("same")).alias("n_cross"))
