"""From pages and payloads to harvested rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tree


def availability(text: Column) -> Column:
    """1 in stock, 0 out of stock, null unknown."""
    t = F.lower(text)
    has = lambda *words: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in words])
    return F.when(has("instock", "in_stock"), 1).when(has("outofstock", "out_of_stock", "soldout"), 0)


def stock_rule(not_buyable: Column, available: Column, status: Column) -> Column:
    """1 or 0: what may not be bought is out of stock; else the number available decides, else a status of 0; null if nothing is known."""
    return F.when(F.coalesce(not_buyable, F.lit(False)), 0).when(available.isNotNull(), (available > 0).cast("int")).when(status.isNotNull(), (status == 0).cast("int"))


def list_price(price: Column, is_discount: Column, percent: Column) -> Column:
    """The price before a discount of 0 to 100 percent, both excluded."""
    return F.when(F.coalesce(is_discount, F.lit(False)) & (percent > 0) & (percent < 100), F.floor(price / (1 - percent / 100) * 100 + 0.5) / 100)


def slug_name(url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(url, r"/+$", ""), "/"), -1)
    return F.replace(F.regexp_replace(last, r"-\d+$", ""), F.lit("-"), F.lit(" "))


def url_sku(url: Column) -> Column:
    found = F.regexp_extract(url, r"/p/(\w+)", 1)
    return F.when(found != "", found)


def meta_price(description: Column) -> Column:
    """The figure before a euro sign as a double."""
    return F.replace(F.regexp_extract(description, r"(\d+(?:[.,]\d+)?)\s*€", 1), F.lit(","), F.lit(".")).try_cast("double")


def allowed(urls: DataFrame, banned: str, col: str = "url") -> DataFrame:
    return urls.where(~F.coalesce(F.col(col).rlike(banned), F.lit(False)))


def leaf_urls(urls: DataFrame, col: str = "url") -> DataFrame:
    """Urls that are no strict path prefix of another: prefixes are listed per url and removed by an equi-join."""
    parts = F.split(F.regexp_replace(F.col(col), r"/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    parents = urls.where(F.size(parts) > 1).select(F.explode(above).alias("_p")).distinct()
    return urls.join(parents, F.regexp_replace(F.col(col), r"/+$", "") == F.col("_p"), "left_anti")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def pair_on_sku(identity: DataFrame, prices: DataFrame) -> DataFrame:
    """Identity and price rows joined on sku, only what has a price; the brand Generic is none."""
    out = identity.join(prices, "sku", "full_outer").where("price is not null")
    return out.withColumn("brand", F.when(F.col("brand") != "Generic", F.col("brand")))


_LD = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def product_offers(raw: Column) -> Column:
    """array<struct(name, brand, sku, price, list_price, currency, in_stock)> of the products anywhere in the JSON-LD text `raw`: one per offer, and one without a price for a product that has no offers.

    The price is `price`, or `lowPrice` where that is absent or 0; what is no figure is null. Of
    several codes sku, gtin13, gtin the first that is there counts. Offers that are no objects are
    skipped, and text that is no JSON has no products: null.
    """

    def of_product(p: Column) -> Column:
        offers = tree.listed(p, "offers")
        sku = F.coalesce(*[F.nullif(tree.text(p, k), F.lit("")) for k in ("sku", "gtin13", "gtin")])
        row = lambda price, high, currency, stock: F.struct(tree.text(p, "name").alias("name"), tree.text(p, "brand").alias("brand"), sku.alias("sku"), price.alias("price"), high.alias("list_price"), currency.alias("currency"), stock.alias("in_stock"))
        none = F.lit(None).cast("double")
        hole = lambda o: F.coalesce(tree.text(o, "price"), F.lit("")).isin("", "0", "0.0")
        price = lambda o: F.when(hole(o), tree.figure(o, "lowPrice")).otherwise(tree.figure(o, "price"))
        of_offer = lambda o: row(price(o), tree.figure(o, "highPrice"), F.coalesce(tree.text(o, "priceCurrency"), F.lit("EUR")), availability(tree.text(o, "availability")))
        return F.when(F.size(offers) == 0, F.array(row(none, none, F.lit("EUR"), F.lit(None).cast("int")))).otherwise(F.transform(F.filter(offers, tree.is_object), of_offer))

    return F.flatten(F.transform(F.filter(tree.nodes(raw), lambda n: tree.has_type(n, "product")), of_product))


def jsonld_products(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, name, brand, sku, price, list_price, currency, in_stock): a row per offer of each product in the JSON-LD blocks of pages, see :func:`product_offers`.

    All native: blocks are parsed as VARIANT and walked within the row. Blocks that are no JSON are skipped.
    """
    blocks = pages.select(id_col, F.explode(F.regexp_extract_all(html_col, F.lit(_LD), F.lit(1))).alias("raw"))
    return blocks.select(id_col, F.inline(product_offers(F.trim("raw"))))
