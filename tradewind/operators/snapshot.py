"""Publishable snapshots: rows, manifest and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of a published snapshot and of the candidates' review sheet, in order.
COLUMNS = ["product", "brand", "category", "retailer", "price", "list_price", "in_stock", "sku", "url", "observed_at"]
REVIEW = ["candidate_id", "score", "status", "decision", "product_a", "name_a", "brand_a", "category_a", "retailers_a", "product_b", "name_b", "brand_b", "category_b", "retailers_b"]


def rows(latest_rows: DataFrame, products: DataFrame) -> DataFrame:
    """Latest prices with product attributes, without folding duplicates; sku and url are null where offers have none."""
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product"), "brand", "category")
    known = latest_rows.withColumns({c: F.lit(None).cast("string") for c in ("sku", "url") if c not in latest_rows.columns})
    return known.join(p, "product_id").select(*COLUMNS)


def manifest(snapshot: DataFrame, at: str | None = None) -> DataFrame:
    """One row: rows, distinct products, the sorted retailers, and the time `at` if given."""
    out = snapshot.agg(F.count("*").alias("n_rows"), F.count_distinct("product").alias("n_products"), F.array_join(F.sort_array(F.collect_set("retailer")), ",").alias("retailers"))
    return out if at is None else out.withColumn("generated_at", F.lit(at))


def ordered(snapshot: DataFrame) -> DataFrame:
    return snapshot.orderBy(F.lower("product"), "retailer")


def write(snapshot: DataFrame, folder: str) -> None:
    """JSON lines, CSV and Parquet, each in the order of (lower(product), retailer)."""
    sorted_ = ordered(snapshot)
    sorted_.write.mode("overwrite").json(f"{folder}/json")
    write_csv(sorted_, f"{folder}/csv")
    sorted_.write.mode("overwrite").parquet(f"{folder}/parquet")


def write_csv(frame: DataFrame, path: str) -> None:
    """CSV files that begin with a byte-order mark, which stands before the first column's name."""
    frame.withColumnRenamed(frame.columns[0], "\ufeff" + frame.columns[0]).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json_array(frame: DataFrame, path: str) -> None:
    """One file with one JSON array, as a publisher wants it: the rows stream through one task in order, a row a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = "["
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out.append(sign + text if text is not None else "]" if sign == "," else "[]")
                sign = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    lines = frame.select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("value"))
    end = frame.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))
    lines.union(end).coalesce(1).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_review(candidates: DataFrame, path: str) -> None:
    """The candidates' review sheet as CSV, best score first."""
    write_csv(candidates.select(*REVIEW).orderBy(F.desc("score"), "candidate_id"), path)


def catalogue_json(catalogue: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, json): each product's name, brand, category and its price per retailer as a JSON object."""
    named = catalogue.join(products.select(F.col("id").alias("product_id"), "name", "brand", "category"), "product_id")
    return named.select("product_id", F.to_json(F.struct("product_id", "name", "brand", "category", "prices")).alias("json"))


def offline_page(catalogue: DataFrame, products: DataFrame, changes: DataFrame, list_items: DataFrame) -> DataFrame:
    """(part, json): what an offline page needs, a JSON object a row: catalogue entries, movers and one list's items."""
    parts = [catalogue_json(catalogue, products).select(F.lit("catalogue").alias("part"), "json"), changes.select(F.lit("movers").alias("part"), F.to_json(F.struct(*changes.columns)).alias("json")), list_items.select(F.lit("list").alias("part"), F.to_json(F.struct(*list_items.columns)).alias("json"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def newest(names: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` backup names; the others may go."""
    return names.orderBy(F.desc("name")).limit(keep)


def back_up(frames: dict[str, DataFrame], folder: str, name: str, keep: int) -> list[str]:
    """Write `frames` by name below `folder`/`name` as Parquet and remove all but the newest `keep` backups there, by name; the names that are left, newest first.

    A backup counts when its last table is written; one that broke off is overwritten by the next of its name.
    """
    if keep < 1:
        raise ValueError("the backup just made is kept")
    spark = next(iter(frames.values())).sparkSession
    for table, rows in frames.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/{table}")
    last = list(frames)[-1]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = [s.getPath().getName() for s in files.listStatus(path) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), f"{last}/_SUCCESS"))]
    left = sorted(whole, reverse=True)
    for old in left[keep:]:
        files.delete(jvm.org.apache.hadoop.fs.Path(path, old), True)
    return left[:keep]
