"""python -m tradewind COMMAND: the engine over a folder of Parquet tables."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as v
from .operators import canonical, catalog, ingest, quality, snapshot, timeseries
from .plans import registry
from .sources import readers
from .streaming import folds


def _latest(spark: SparkSession, data: str, retailer: str | None = None) -> DataFrame:
    obs = v.price_obs(spark, data)
    return timeseries.latest(obs if retailer is None else obs.where(F.col("retailer") == retailer))


def run(spark: SparkSession, argv: Sequence[str]) -> DataFrame:
    """The table that a command answers with; commands that write return what they wrote."""
    parser = argparse.ArgumentParser(prog="tradewind", description=__doc__)
    parser.add_argument("--data", required=True, help="folder of the tables")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("query").add_argument("name")
    show = sub.add_parser("show")
    show.add_argument("--retailer")
    show.add_argument("--limit", type=int, default=20)
    sub.add_parser("stats")
    sub.add_parser("doctor")
    movers = sub.add_parser("changes")
    movers.add_argument("--days", type=int, default=30)
    movers.add_argument("--limit", type=int, default=40)
    search = sub.add_parser("search")
    search.add_argument("text")
    search.add_argument("--retailer")
    search.add_argument("--limit", type=int, default=500)
    dedup = sub.add_parser("dedup")
    dedup.add_argument("--prune", help="folder of a candidate queue (Parquet), whose pending rows are scored anew")
    sub.add_parser("export").add_argument("folder")
    purge = sub.add_parser("purge")
    purge.add_argument("retailer")
    purge.add_argument("--out", help="folder for the offers and prices that are left")
    backup = sub.add_parser("backup")
    backup.add_argument("folder")
    backup.add_argument("--name", required=True, help="a name that sorts by time")
    backup.add_argument("--keep", type=int, default=7)
    scrape = sub.add_parser("scrape")
    scrape.add_argument("pages", help="folder of fetched pages (Parquet): page_id, url, html, observed_at")
    scrape.add_argument("extractor")
    scrape.add_argument("retailer")
    scrape.add_argument("store", help="folder of the store that the rows are folded into")
    scrape.add_argument("--batch", type=int, required=True, help="number of the batch; the same number again changes nothing")
    sub.add_parser("sync").add_argument("path")
    a = parser.parse_args(argv)
    obs, products = v.price_obs(spark, a.data), v.products(spark, a.data)
    if a.command == "query":
        return registry.queries()[a.name](spark, a.data)
    if a.command == "show":
        return timeseries.discount_percent(_latest(spark, a.data, a.retailer)).orderBy("product_id", "retailer").limit(a.limit)
    if a.command == "stats":
        return catalog.stats(products, obs)
    if a.command == "doctor":
        named = products.select(F.col("id").alias("product_id"), "name", "brand", "category")
        return quality.gate(_latest(spark, a.data).join(named, "product_id").withColumn("image_url", F.lit(None).cast("string")))
    if a.command == "changes":
        return timeseries.biggest_changes(obs, products, a.days, min(200, a.limit))
    if a.command == "search":
        return catalog.search(products, obs, a.text, retailer=a.retailer, limit=min(1000, a.limit))
    if a.command == "dedup" and a.prune:
        queue = spark.read.parquet(a.prune)
        return canonical.prune(queue, canonical.rescored(queue, products))
    if a.command == "dedup":
        return canonical.candidates(canonical.apply_links(products, canonical.scan_exact(products, products.select("id").limit(0))))
    if a.command == "export":
        rows = snapshot.rows(_latest(spark, a.data), products)
        snapshot.write(rows, a.folder)
        snapshot.write_json_array(snapshot.ordered(rows), f"{a.folder}/array")
        return snapshot.manifest(rows)
    if a.command == "purge":
        left = obs.where(~F.col("retailer").eqNullSafe(F.lit(a.retailer)))
        if a.out:
            left.write.mode("overwrite").parquet(f"{a.out}/prices")
            ingest.fold_offers(left, timeseries.OFFER).write.mode("overwrite").parquet(f"{a.out}/offers")
        return left
    if a.command == "backup":
        names = snapshot.back_up({"products": products, "prices": obs}, a.folder, a.name, a.keep)
        return spark.createDataFrame([(n,) for n in names], "name string")
    if a.command == "scrape":
        store = folds.FoldedStore(spark, a.store)
        store.apply(readers.harvested(spark.read.parquet(a.pages), a.extractor, a.retailer), a.batch)
        return store.offers()
    return ingest.replay(readers.snapshot_json(spark, a.path))[1]


def main() -> None:
    import sys

    run(SparkSession.builder.getOrCreate(), sys.argv[1:]).show(50, truncate=60)


if __name__ == "__main__":
    main()
