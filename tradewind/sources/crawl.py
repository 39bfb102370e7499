"""Finding pages: sitemaps, category trees and paged listings, with the manners of a crawler.

What goes over a network is a function `fetch(url) -> (status, headers, body)` that is passed
in, so everything here runs against files as well.
"""

from __future__ import annotations

import gzip
import json
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import urlencode
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.hierarchy import first_reached
from ..session import kept

Fetch = Callable[[str], tuple[int, Mapping[str, str], bytes]]
#: Bytes of a response that is still taken.
RESPONSE_LIMIT = 50_000_000


# ---------------------------------------------------------------- fetching


def polite(fetch: Fetch, tries: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], bytes | None]:
    """`fetch` that asks again after 429, 5xx, and errors of the connection, waiting as Retry-After says or twice as long each time; any other failure, or too large a body, gives None."""

    def get(url: str) -> bytes | None:
        pause = wait
        for _ in range(tries):
            try:
                status, headers, body = fetch(url)
            except OSError:  # time-outs, resets and refusals, of sockets and of libraries on them
                status, headers, body = 503, {}, b""
            if status == 200:
                return body if len(body) <= RESPONSE_LIMIT else None
            if status != 429 and status < 500:
                return None
            after = headers.get("Retry-After", "")
            sleep(float(after) if after.isdigit() else pause)
            pause *= 2
        return None

    return get


def fetch_all(urls: DataFrame, fetch: Fetch, workers: int = 4, pace: float = 0.75, tries: int = 3) -> DataFrame:
    """(url, content): distinct `urls` fetched by `workers` tasks whose requests together are `pace` seconds apart; failures have null content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, due = polite(fetch, tries), time.monotonic()
        for batch in batches:
            out = []
            for url in batch["url"]:
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + pace * workers
                out.append(get(url))
            yield pd.DataFrame({"url": batch["url"], "content": out})

    return urls.select("url").distinct().repartition(workers).mapInPandas(run, "url string, content binary")


def robots_allow(urls: DataFrame, robots: str, agent: str = "*") -> DataFrame:
    """The `urls` that a robots.txt allows."""

    @F.pandas_udf("boolean")
    def may(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rules = RobotFileParser()
        rules.parse(robots.splitlines())
        for batch in batches:
            yield batch.map(lambda u: u is not None and rules.can_fetch(agent, u))

    return urls.where(may("url"))


def robots_facts(robots: str, agent: str = "*", floor: float = 3.0) -> tuple[float, list[str]]:
    """(seconds between requests, `floor` at least; sitemaps) of a robots.txt."""
    rules = RobotFileParser()
    rules.parse(robots.splitlines())
    return max(floor, float(rules.crawl_delay(agent) or 0)), list(rules.site_maps() or [])


def fetch_sources(urls: DataFrame, fetch: Fetch, most: int = 8, pace: float = 3.0, tries: int = 3, order: str = "seq") -> DataFrame:
    """(source, seq, url, content, outcome) of `urls` (source, seq, url): each source is fetched in order by one task, and left alone after `most` failures in a row.

    outcome is fetched, failed or skipped; a skipped url was never asked for. Sources are dealt
    to tasks whole, for their requests are to be `pace` seconds apart; a task remembers one
    streak at a time. A null source is one of its own. A task that is tried again asks again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, due = polite(fetch, tries), time.monotonic()
        now, streak = object(), 0
        for batch in batches:
            contents, outcomes = [], []
            for source, url in zip(batch["source"], batch["url"], strict=True):
                if source != now:
                    now, streak = source, 0
                if streak >= most:
                    contents.append(None)
                    outcomes.append("skipped")
                    continue
                time.sleep(max(0.0, due - time.monotonic()))
                due = time.monotonic() + pace
                body = None if url is None else get(url)
                streak = streak + 1 if body is None else 0
                contents.append(body)
                outcomes.append("failed" if body is None else "fetched")
            yield pd.DataFrame({"source": batch["source"], "seq": batch["seq"], "url": batch["url"], "content": contents, "outcome": outcomes})

    rows = urls.select("source", F.col(order).cast("long").alias("seq"), "url").repartition("source").sortWithinPartitions("source", "seq", "url")
    return rows.mapInPandas(run, "source string, seq long, url string, content binary, outcome string")


def source_report(fetched: DataFrame, priced: DataFrame) -> DataFrame:
    """(source, n_fetched, n_failed, n_skipped, n_unpriced, stopped) of :func:`fetch_sources`; `priced` (url) are the pages that gave a price."""
    told = fetched.join(priced.select("url").distinct().withColumn("_p", F.lit(True)), "url", "left")
    count = lambda name: F.count_if(F.col("outcome") == name)
    return told.groupBy("source").agg(count("fetched").alias("n_fetched"), count("failed").alias("n_failed"), count("skipped").alias("n_skipped"), F.count_if((F.col("outcome") == "fetched") & F.col("_p").isNull()).alias("n_unpriced"), (count("skipped") > 0).alias("stopped"))


def until_broken(attempts: DataFrame, most: int = 8, order: str = "seq", ok: str = "ok") -> DataFrame:
    """The `attempts` of a source up to the `most`-th failure in a row, which ends it; columns `source`, `order` and `ok`."""
    by = Window.partitionBy("source").orderBy(order)
    runs = attempts.withColumn("_run", F.sum(F.col(ok).cast("int")).over(by))
    failed = runs.withColumn("_n", F.when(~F.col(ok), F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy("source", "_run").orderBy(order))).otherwise(0))
    broken = F.max((F.col("_n") >= most).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return failed.withColumn("_b", F.coalesce(broken, F.lit(0))).where("_b = 0").drop("_run", "_n", "_b")


# ---------------------------------------------------------------- sitemaps


def parse_sitemap(content: bytes | None) -> tuple[list[str], list[str]]:
    """(sitemaps, pages) that a sitemap, packed or not, names; places without the usual names around them count as pages."""
    try:
        root = ET.fromstring(gzip.decompress(content) if content and content[:2] == b"\x1f\x8b" else content or b"")
    except (ET.ParseError, OSError):
        return [], []
    local = lambda e: e.tag.rpartition("}")[2]
    found: dict[str, list[str]] = {"sitemap": [], "url": []}
    for e in root.iter():
        if local(e) in found:
            found[local(e)] += [x.text.strip() for x in e if local(x) == "loc" and x.text]
    if not found["sitemap"] and not found["url"]:
        found["url"] = [e.text.strip() for e in root.iter() if local(e).endswith("loc") and e.text]
    return found["sitemap"], found["url"]


def sitemap_links(contents: DataFrame) -> DataFrame:
    """(parent, kind, child) of sitemaps (url, content): kind is sitemap or page. What is no sitemap has no links."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(at, k, u) for at, c in zip(batch["url"], batch["content"], strict=True) for k, us in zip(("sitemap", "page"), parse_sitemap(None if c is None else bytes(c)), strict=True) for u in us]
            yield pd.DataFrame(rows, columns=["parent", "kind", "child"])

    return contents.select("url", "content").mapInPandas(parse, "parent string, kind string, child string")


def sitemap_pages(contents: DataFrame, roots: list[str], hint: str, limit: int | None = None) -> DataFrame:
    """(url) of pages that match `hint` in the sitemaps reachable from `roots`; `contents` has (url, content).

    Sitemaps are parsed once; those that others name are found by a recursive query, which
    visits indexes only, and their pages by one semi-join. A sitemap that is not there, or is
    none, ends its branch, and one that names a sitemap above it is no loop.
    """
    links = kept(sitemap_links(contents))
    start = contents.sparkSession.createDataFrame([(r,) for r in roots], "node string")
    met = first_reached(links.where("kind = 'sitemap'").select("parent", "child"), start).select(F.col("node").alias("parent"))
    out = links.where(F.col("kind") == "page").join(met, "parent", "left_semi").where(F.col("child").rlike(hint)).select(F.col("child").alias("url")).distinct()
    return out if limit is None else out.orderBy("url").limit(limit)


def swap_locale(urls: DataFrame, old: str = "/en/eshop/", new: str = "/el/eshop/", only: str = "/p/") -> DataFrame:
    """Urls of one locale as those of another; those that are not of it, or lack `only`, are left out."""
    return urls.where(F.contains("url", F.lit(old)) & F.contains("url", F.lit(only))).select(F.replace("url", F.lit(old), F.lit(new)).alias("url"))


def rewrite_host(urls: DataFrame, old: str, new: str) -> DataFrame:
    """(pos, url) with one host for another, each url at its first place."""
    return urls.select("pos", F.replace("url", F.lit(old), F.lit(new)).alias("url")).groupBy("url").agg(F.min("pos").alias("pos")).select("pos", "url")


def until_nothing_new(rows: DataFrame, least: int = 1) -> DataFrame:
    """Rows (listing, page, sku, ...) of paged listings: each sku at its first page, up to the first page with under `least` new ones.

    That page's own new rows stay, but no later page's.
    """
    first = Window.partitionBy("listing", "sku").orderBy("page")
    new = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    counts = rows.select("listing", "page").distinct().join(new.groupBy("listing", "page").agg(F.count("*").alias("_n")), ["listing", "page"], "left")
    ends = counts.where(F.coalesce("_n", F.lit(0)) < least).groupBy("listing").agg(F.min("page").alias("_end"))
    return new.join(ends, "listing", "left").where("_end is null or page <= _end").drop("_end")


# ---------------------------------------------------------------- paged interface


def leaf_categories(tree: object) -> list[tuple[str, str | None]]:
    """(id, name) of the nodes without children in a category tree."""
    root = tree.get("tree", tree) if isinstance(tree, dict) else tree
    out, todo = [], list(reversed(root)) if isinstance(root, list) else [root]
    while todo:
        node = todo.pop()
        if not isinstance(node, dict):
            continue
        if node.get("children"):
            todo.extend(reversed(node["children"]))
        elif node.get("category_id"):
            out.append((str(node["category_id"]), node.get("name")))
    return out


def file_fetch(url: str) -> tuple[int, Mapping[str, str], bytes]:
    """A file in place of a server: the url is its path, and its query part of the file's name after an `@`."""
    try:
        with open(url.replace("?", "@"), "rb") as f:
            return 200, {}, f.read()
    except OSError:
        return 404, {}, b""


class _Category(InputPartition):
    def __init__(self, category: str) -> None:
        self.category = category


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.root, self.size = options["root"].rstrip("/"), int(options.get("page_size", "50"))
        self.get = polite(file_fetch)

    def _json(self, path: str, **params: object) -> dict | None:
        body = self.get(f"{self.root}{path}" + (f"?{urlencode(params)}" if params else ""))
        return None if body is None else json.loads(body)

    def partitions(self) -> list[_Category]:
        return [_Category(c) for c, _ in leaf_categories(self._json("/meta/categories/tree") or {})]

    def read(self, partition: _Category) -> Iterator[tuple]:
        page, more = 1, True
        while more:
            data = self._json("/products", page=page, page_size=self.size, category=partition.category) or {}
            for p in data.get("products", []):
                detail = self._json(f"/products/{p['product_id']}") or {}
                for r in detail.get("retailer_prices", []):
                    yield partition.category, str(p["product_id"]), p.get("name"), p.get("brand"), r.get("retailer"), r.get("price"), r.get("is_discount"), r.get("discount_percent")
            page, more = page + 1, bool(data.get("has_next"))


class PagedCatalogue(DataSource):
    """`spark.read.format("paged_catalogue").option("root", ...)`: a row per product and retailer, a task per leaf category, page by page."""

    @classmethod
    def name(cls) -> str:
        return "paged_catalogue"

    def schema(self) -> str:
        return "category string, product_id string, name string, brand string, retailer string, price double, is_discount boolean, discount_percent double"

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options)


def paged_catalogue(spark: SparkSession, root: str, retailers: list[str] | None = None) -> DataFrame:
    """The paged catalogue's prices, of `retailers` only if given, with list_price where a discount says what it was."""
    from .extract import list_price

    spark.dataSource.register(PagedCatalogue)
    rows = spark.read.format("paged_catalogue").option("root", root).load()
    rows = rows if retailers is None else rows.where(F.col("retailer").isin(retailers))
    return rows.withColumn("list_price", list_price(F.col("price"), F.col("is_discount"), F.col("discount_percent")))
