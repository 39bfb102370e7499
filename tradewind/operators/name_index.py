"""A folded-name index: substring search that reads postings and candidates instead of all products.

Postings have a row for each place of a folded name and the up to three letters from there, in the
order of these, so that a filter on them reaches only some row groups of the files.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from .catalog import offers_of, with_master

GRAM = 3


class NameIndex:
    """The index below `path`: postings (gram, id), names (id, folded, name, brand, category) of masters, and members (master, product_id)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, products: DataFrame, path: str) -> NameIndex:
        """Write the index of `products` (id, name, brand, category, canonical_id); a null name is an empty one, which '%' alone finds."""
        spark, index = products.sparkSession, cls(products.sparkSession, path)
        names = products.where("canonical_id is null").select("id", fold(F.col("name")).alias("folded"), "name", "brand", "category")
        names.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{index.path}/names")
        spots = F.transform(F.sequence(F.lit(1), F.length("folded")), lambda i: F.substring("folded", i, F.lit(GRAM)))
        grams = spark.read.parquet(f"{index.path}/names").where("folded <> ''").select(F.explode(F.array_distinct(spots)).alias("gram"), "id")
        grams.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{index.path}/postings")
        with_master(products).select("master", F.col("id").alias("product_id")).repartitionByRange("master").sortWithinPartitions("master").write.parquet(f"{index.path}/members")
        return index

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def find(self, query: str) -> DataFrame:
        """Rows of names that hold the folded `query`, in which % and _ are wildcards and a backslash takes their meaning away.

        Pieces between wildcards that are as long as a posting are looked up by all of their
        postings, of which a name must have each; shorter ones by postings that begin with
        them. What is found is checked against the whole pattern. A query of wildcards alone
        reads the names.
        """
        folded = self.spark.range(1).select(fold(F.lit(query)).alias("q")).first().q
        names, like = self.read("names"), F.like(F.col("folded"), F.lit(f"%{folded}%"))
        pieces = [p for p in re.split(r"[%_]|\\.?", folded) if p]
        if not pieces:
            return names.where(like)
        whole = sorted({p[k : k + GRAM] for p in pieces if len(p) >= GRAM for k in range(len(p) - GRAM + 1)})
        starts = sorted({p for p in pieces if len(p) < GRAM and not any(p in g for g in whole)})
        postings = self.read("postings")
        asks: list[Column] = [F.col("gram") == g for g in whole] + [F.startswith("gram", F.lit(p)) for p in starts]
        had = postings.where(reduce(Column.__or__, asks)).groupBy("id").agg(*[F.max(a.cast("int")).alias(f"g{k}") for k, a in enumerate(asks)])
        found = had.where(reduce(Column.__and__, [F.col(f"g{k}") == 1 for k in range(len(asks))])).select("id")
        return names.join(found, "id", "left_semi").where(like)

    def search(self, obs: DataFrame, query: str, category: str | None = None, retailer: str | None = None, on_offer: bool = False, in_stock_only: bool = False, limit: int = 500) -> DataFrame:
        """The rows of `catalog.search` for the same arguments, without a look at the products."""
        found = self.find(query)
        if category is not None:
            found = found.where(F.col("category") == category)
        top = found.orderBy("name", "id").limit(limit).select(F.col("id").alias("master"), F.col("name").alias("m_name"), F.col("brand").alias("m_brand"), F.col("category").alias("m_category"))
        return offers_of(self.read("members").join(top, "master"), obs, retailer, on_offer, in_stock_only)
