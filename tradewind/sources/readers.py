"""Files that other tools leave: snapshots, review decisions, per-retailer tables, url lists; and the ingest of pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_brand_prefix
from ..operators.ingest import upsert_rows
from ..session import kept
from .crawl import Fetch, fetch_sources, source_report
from .pages import extract_rows

_SNAPSHOT = "product string, name string, brand string, category string, retailer string, price double, list_price double, in_stock int, sku string, url string, observed_at string"


def snapshot_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a snapshot that is one JSON array (or JSON lines); what is absent is null."""
    return spark.read.schema(_SNAPSHOT).json(path, multiLine=True)


def decisions_csv(spark: SparkSession, path: str) -> DataFrame:
    """(candidate_id, decision) of a reviewed CSV: with or without a byte-order mark, the id under `candidate_id` or `id`; rows whose id is no integer are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True)
    rows = rows.toDF(*[c.lstrip("\ufeff").strip() for c in rows.columns])
    ids = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in ("candidate_id", "id") if c in rows.columns]
    told = F.col("decision") if "decision" in rows.columns else F.lit("")
    if not ids:
        return spark.createDataFrame([], "candidate_id long, decision string")
    return rows.select(F.coalesce(*ids).try_cast("long").alias("candidate_id"), F.coalesce(told, F.lit("")).alias("decision")).where("candidate_id is not null")


def union_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The tables at `paths` (Parquet), put together by column name; a path that is no table is left out. Raises if none is."""
    found = []
    for path in paths:
        try:
            found.append(spark.read.parquet(path))
        except (PySparkException, Py4JJavaError):  # absent or not Parquet
            continue
    if not found:
        raise ValueError("none of the paths is a Parquet table")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a text file with one url a line; blank lines are left out, repeats stay."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def write_urls(urls: DataFrame, path: str) -> None:
    urls.select("url").distinct().orderBy("url").write.mode("overwrite").text(path)


def harvested(pages: DataFrame, extractor: str, retailer: str, limit: int | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The rows of `pages` (id, html, observed_at) as the folds take them, of which each sku counts once.

    The row of a sku with the least page id counts; rows without a price or a name are left
    out, and a leading brand is taken off the name. `limit` is the most rows taken, in the order of pages.
    """
    rows = extract_rows(pages, extractor, id_col, html_col).where("price is not null and name is not null").withColumn("name", strip_brand_prefix(F.col("name"), F.col("brand")))
    first = rows.groupBy(F.coalesce("sku", "name").alias("_key")).agg(F.min_by(F.struct(*rows.columns), id_col).alias("m")).select("m.*")
    taken = first if limit is None else first.orderBy(id_col, "sku").limit(limit)
    told = taken.join(pages.select(id_col, "observed_at"), id_col)
    return told.withColumn("retailer", F.lit(retailer)).withColumn("shared_key", F.lit(None).cast("string")).withColumn("in_stock", F.col("in_stock").cast("boolean"))


def ingest_source(urls: DataFrame, fetch: Fetch, extractor: str, retailer: str, at: Column, products: DataFrame, offers: DataFrame, limit: int | None = None, pace: float = 3.0, tries: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(products, offers, observations, report) after one source was fetched, read and folded in.

    `urls` (seq, url) are what discovery found; `fetch` is asked in their order, and no more after
    eight failures in a row. `at` is the time of the observations. Fetched pages are kept, so no
    page is asked for twice. The report has fetched, failed, skipped and unpriced pages.
    """
    got = kept(fetch_sources(urls.withColumn("source", F.lit(retailer)), fetch, pace=pace, tries=tries))
    pages = got.where("outcome = 'fetched'").select(F.col("seq").alias("page_id"), "url", F.decode("content", "UTF-8").alias("html"), at.alias("observed_at"))
    rows = kept(harvested(pages, extractor, retailer, limit))
    sized, sold = upsert_rows(products, offers, rows)
    priced = pages.join(extract_rows(pages, extractor, "page_id", "html").where("price is not null").select("page_id").distinct(), "page_id", "left_semi").select("url")
    return sized, sold, rows.select("retailer", "sku", "name", "brand", "observed_at", "price", "list_price", "unit_price", "unit", "in_stock"), source_report(got, priced)


def ingest_pages(pages: DataFrame, extractor: str, retailer: str, products: DataFrame, offers: DataFrame, limit: int | None = None, id_col: str = "page_id", html_col: str = "html") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, offers, observations) after the rows of `pages`, see :func:`harvested`."""
    rows = harvested(pages, extractor, retailer, limit, id_col, html_col)
    sized, sold = upsert_rows(products, offers, rows)
    return sized, sold, rows.select("retailer", "sku", "name", "brand", "observed_at", "price", "list_price", "unit_price", "unit", "in_stock")
