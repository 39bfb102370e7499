"""The write path on a stream: products, offers and prices kept in folders of Parquet, a batch of which may come twice.

A micro-batch is reduced to partial folds, one row per product and offer of the batch, and
written under its number; the same number again replaces the same folder, so a batch that is
replayed after a crash changes nothing. What is stored is the merge of the partial folds, for
newest and earliest values merge in any order. Compaction merges them into one base, which
remembers the last batch in it, and batches up to that are left alone when they come again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import product_key

#: Attributes whose newest known value counts; a product's newest name counts even if it is null.
PRODUCT, OFFER = ("brand", "category", "image_url"), ("sku", "url")
_FOLDED = {"products": (["product_key"], ("name", *PRODUCT)), "offers": (["product_key", "retailer"], OFFER)}
_PRICES = ["product_key", "retailer", "observed_at", "price", "list_price", "in_stock"]
_TYPES = {"observed_at": "timestamp", "first_seen": "timestamp", "last_seen": "timestamp", "price": "double", "list_price": "double", "in_stock": "int"}


def keyed(rows: DataFrame) -> DataFrame:
    """Harvested rows with their product_key."""
    return rows.withColumn("product_key", product_key(F.col("shared_key"), F.col("name"), F.col("brand")))


def _value(name: str) -> Column:
    return F.struct(F.col("observed_at").alias("at"), F.col(name).alias("value"))


def partial(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: of each value the newest struct(at, value), null where none is known (but for `name`), and the first and last time."""
    newest = [F.max(_value(c) if c == "name" else F.when(F.col(c).isNotNull(), _value(c))).alias(c) for c in values]
    return rows.groupBy(*keys).agg(*newest, F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))


def merged(parts: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Partial folds of the same keys as one."""
    return parts.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


class FoldedStore:
    """Products, offers and prices below `path`, fed by :meth:`run` or :meth:`apply`.

    `path` must be in a store that driver and executors share. One writer at a time feeds a
    store; readers see whole batches only. Layout: <table>/batch-<n> and <table>/base-<n>, in
    which batches up to n are.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def run(self, rows: DataFrame, checkpoint: str) -> None:
        """Fold what a stream of harvested rows has now; with the same `checkpoint`, a later call goes on."""
        rows.writeStream.foreachBatch(lambda batch, n: self.apply(batch, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def apply(self, rows: DataFrame, number: int) -> None:
        """Fold the harvested `rows` (name, brand, category, image_url, retailer, sku, url, shared_key, observed_at, price, list_price, in_stock) of one batch in."""
        if number <= self._base("prices")[0]:
            return
        made = keyed(rows)
        # products are the merge of their offers, so rows are folded once for both
        both = partial(made, _FOLDED["offers"][0], [v for _, values in _FOLDED.values() for v in values]).persist()
        try:
            for table, (keys, values) in _FOLDED.items():
                merged(both, keys, values).write.mode("overwrite").parquet(f"{self.path}/{table}/batch-{number}")
        finally:
            both.unpersist()
        # prices come last: a batch counts when it has them
        made.withColumn("in_stock", F.col("in_stock").cast("int")).select(*_PRICES).write.mode("overwrite").parquet(f"{self.path}/prices/batch-{number}")

    def compact(self) -> None:
        """Merge all batches into a new base; older folders go when it is written, those of batches first."""
        todo = self.pending()
        if not todo:
            return
        old, last = self._base("prices")[0], max(todo)
        whole = {**{t: merged(self._parts(t), *_FOLDED[t]) for t in _FOLDED}, "prices": self._parts("prices")}
        for table, rows in whole.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{table}/base-{last}")
        for table in whole:
            for n in todo:
                self._drop(f"{self.path}/{table}/batch-{n}")
            self._drop(f"{self.path}/{table}/base-{old}")

    def products(self) -> DataFrame:
        """product_key, name, brand, category, image_url, first_seen, last_seen."""
        return self._whole("products")

    def offers(self) -> DataFrame:
        """product_key, retailer, sku, url, first_seen, last_seen."""
        return self._whole("offers")

    def history(self) -> DataFrame:
        """product_key, retailer, observed_at, price, list_price, in_stock (1, 0 or null)."""
        return self._parts("prices")

    def pending(self) -> list[int]:
        """Numbers of whole batches that no base has."""
        base = self._base("prices")[0]
        return sorted(n for n in self._numbers("prices", "batch") if n > base)

    def _whole(self, table: str) -> DataFrame:
        keys, values = _FOLDED[table]
        return merged(self._parts(table), keys, values).select(*keys, *[F.col(f"{c}.value").alias(c) for c in values], "first_seen", "last_seen")

    def _parts(self, table: str) -> DataFrame:
        """The base and the batches after it."""
        paths = [p for _, p in [self._base(table)] if p] + [f"{self.path}/{table}/batch-{n}" for n in self.pending()]
        schema = ", ".join(f"{c} {self._kind(table, c)}" for c in self._columns(table))
        frames = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    @staticmethod
    def _columns(table: str) -> list[str]:
        if table == "prices":
            return _PRICES
        keys, values = _FOLDED[table]
        return [*keys, *values, "first_seen", "last_seen"]

    @staticmethod
    def _kind(table: str, column: str) -> str:
        if table != "prices" and column in _FOLDED[table][1]:
            return "struct<at: timestamp, value: string>"
        return _TYPES.get(column, "string")

    def _base(self, table: str) -> tuple[int, str | None]:
        """(the last batch of the newest whole base, its folder); -1 and none without one. Prices are written last, so a base counts when it has them."""
        whole = self._numbers("prices", "base")
        return (max(whole), f"{self.path}/{table}/base-{max(whole)}") if whole else (-1, None)

    def _numbers(self, table: str, kind: str) -> list[int]:
        """Numbers of the folders of `table` that were written to their end."""
        files, folder = self._files(f"{self.path}/{table}")
        if not files.exists(folder):
            return []
        names = [s.getPath() for s in files.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith(f"{kind}-")]
        jvm = self.spark.sparkContext._jvm
        return [int(p.getName().rpartition("-")[2]) for p in names if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _drop(self, path: str) -> None:
        files, folder = self._files(path)
        files.delete(folder, True)

    def _files(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target
