"""Page extractors, readers, crawling and sinks over fixtures that the tests write."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tradewind.__main__ import run
from tradewind.operators import snapshot
from tradewind.sources import crawl, extract, pages, readers

LD = '<script type="application/ld+json">{}</script>'


def ld(node) -> str:
    return LD.format(json.dumps(node))


def test_nested_offer():
    offer = {"availability": "http://schema.org/OutOfStock", "highPrice": "3,50", "priceSpecification": [{"price": None}, {"price": "1.234,50", "priceCurrency": "USD"}]}
    node = {"@type": "Product", "name": " Γάλα ", "brand": {"name": "B"}, "mpn": 7, "gtin14": 12, "image": [{"url": "u"}], "category": {"name": "c"}, "offers": [offer]}
    (row,) = pages.nested_offer("<html><script type='application/ld+json'>{bad</script>" + ld([{"@type": "Thing"}, node]))
    assert row == {"name": "Γάλα", "brand": "B", "sku": "7", "ean": "12", "image_url": "u", "category": "c", "in_stock": 0, "price": 1234.5, "list_price": 3.5, "currency": "EUR"}
    single = {"@type": "product", "name": "x", "offers": {"price": 2, "priceSpecification": {"price": 9, "priceCurrency": "USD"}}}
    (row,) = pages.nested_offer(ld(single))
    assert (row["price"], row["currency"], row["in_stock"]) == (2.0, "USD", None)
    assert pages.nested_offer("<p>nothing</p>") == []


def test_meta_page():
    meta = '<meta name="description" content="Τυρί - 3,49 € από 12.05.2024">'
    (row,) = pages.meta_page(meta + ld({"@graph": [{"@type": "Product", "sku": "s", "offers": {"price": "9.9", "availability": "InStock"}}]}))
    assert (row["name"], row["price"], row["price_date"], row["sku"], row["in_stock"]) == ("Τυρί", 3.49, "12.05.2024", "s", 1)
    (row,) = pages.meta_page(ld({"@type": "Product", "name": "n", "offers": [{"price": "9,9"}]}))
    assert row["price"] == 9.9
    assert pages.meta_page("<meta name='x'>") == []


def test_thumb_cards():
    html = """<div class="product-thumb big" data-product-id="1"><a href="#">x</a><a href="/wishlist/1">w</a><a href="/p1"><img data-src="//cdn/i.png"></a><h4>Ντομάτα</h4>
      <span class="price-new">1,20€</span><span class="price-old">2,00 €</span><i class="priceperkg">18,00€/1 Κιλό</i></div>
      <div class="product-thumb" data-product-id="1"><span class="price_wrapper">9€</span></div>
      <div class="product-thumb" data-product-id="2"><b class="name">Μήλο</b><span class="price_wrapper">1.234,56€</span></div>
      <div class="product-thumb" data-product-id="3"><h4>no price</h4></div><div class="product-thumb"><span class="price_wrapper">1€</span></div>"""
    a, b = pages.thumb_cards(html)
    assert (a["name"], a["price"], a["list_price"], a["unit_price"], a["unit"], a["url"], a["image_url"]) == ("Ντομάτα", 1.2, 2.0, 18.0, "Κιλό", "/p1", "https://cdn/i.png")
    assert (b["sku"], b["name"], b["price"], b["list_price"]) == ("2", "Μήλο", 1234.56, None)


def test_teaser_cards_and_identities(spark):
    split = '<article><a href="/a">A</a><p class="sku">Κωδ: 11</p><span class="teaser-display-price-whole">2</span><span class="teaser-display-price-fraction">29</span><s class="was">3,00€</s><i>Τιμή κιλού 8,60€</i></article>'
    gone = '<article><p class="sku">Κωδικός 12</p><span class="teaser-display-price-whole">5</span> € εξαντλήθηκε</article>'
    text = '<article><p class="sku">Κωδ. 13</p><div><b>12,50€</b> <em>Τιμή κιλού</em></div><div class="unit-price">7,77 €</div><span>9,10 €/κιλό</span><s class="old">4,00 €</s><span>4,00 €</span><span>3,20 €</span></article>'
    rows = {r["sku"]: r for r in pages.teaser_cards(split + gone + text)}
    assert (rows["11"]["price"], rows["11"]["list_price"], rows["11"]["in_stock"], rows["11"]["url"]) == (2.29, 3.0, 1, "/a")
    assert (rows["12"]["price"], rows["12"]["in_stock"]) == (5.0, 0)
    assert (rows["13"]["price"], rows["13"]["list_price"], rows["13"].get("in_stock")) == (3.2, 4.0, None)
    who = ld({"@type": "ItemList", "itemListElement": [{"item": {"@type": "Product", "sku": "11", "name": "One", "brand": "Generic"}}, {"sku": "99", "name": "unpriced"}]})
    frame = spark.createDataFrame([(1, split + gone + who), (2, None)], "page_id long, html string")
    got = {r.sku: (r.name, r.brand, r.price) for r in pages.teaser_products(frame).collect()}
    assert got == {"11": ("One", None, 2.29), "12": (None, None, 5.0)}


def test_cards_do_not_borrow_prices(spark):
    """A card without a price takes none from its neighbour; labels and boxes around a figure decide; a list in a graph has names without their brand."""
    html = (
        '<ul><li><div><p class="sku">Κωδ: 1</p></div></li><li><div><p class="sku">Κωδ: 2</p><b>5,00 €</b></div></li>'
        '<li><p class="sku">Κωδ: 3</p><span>Τιμή κιλού</span> <div class="price-box"><i class="old-price">4,00€</i><b>4,00</b> <b>€</b><em>3,00 €</em></div></li>'
        '<li><p class="sku">Κωδ: 4</p><div><span>Τιμή κιλού</span><b>9,00€</b></div><p>2,00€</p></li></ul>'
    )
    rows = {r["sku"]: r["price"] for r in pages.teaser_cards(html)}
    assert rows == {"1": None, "2": 5.0, "3": 3.0, "4": 2.0}
    who = ld({"@graph": [{"@type": "Thing"}, {"@type": ["ItemList"], "itemListElement": [{"item": {"sku": "2", "name": "Acme Tea", "brand": "Acme", "url": "/tea"}}, "text"]}]}) + ld({"@type": "Other", "itemListElement": [{"sku": "4", "name": "not a list"}]})
    got = {r.sku: (r.name, r.url) for r in pages.teaser_products(spark.createDataFrame([(1, html + who)], "page_id long, html string")).collect()}
    assert got == {"2": ("Tea", "/tea"), "3": (None, None), "4": (None, None)}


def test_plugin_cards_and_datalayer():
    plugin = "data-plugin-product='{\"sku\": 5, \"stock\": {\"available\": \"3\"}}'"
    html = f'<div class="product x"><a href="/u" title="Name">t</a><div {plugin}></div><p class="priceKil">1,36 €/λίτρο</p><div class="previous"><b class="price" data-price="2,00">2</b></div><b class="price">1,80 €</b></div>'
    (row,) = pages.plugin_cards(html + "<div data-plugin-product='bad'></div><div data-plugin-product='{}'></div>")
    assert row == {"name": "Name", "sku": "5", "price": 1.8, "list_price": 2.0, "unit_price": 1.36, "unit": "λίτρο", "in_stock": 1, "url": "/u"}
    page = 'x "items": [] y "items" : [{"item_id": 5, "item_name": " N ", "price": "4.5", "item_category": "c"}] ' + f"<i {plugin}></i>"
    (row,) = pages.datalayer_page(page)
    assert (row["sku"], row["name"], row["price"], row["in_stock"], row["category"]) == ("5", "N", 4.5, 1, "c")
    assert pages.datalayer_page("none") == []


def test_stock_and_availability(spark):
    for told, want in [(None, None), ({"notBuyable": True, "status": 0}, 0), ({"stock": {"available": 0}, "status": 0}, 0), ({"stock": {"available": 2}}, 1), ({"status": 0}, 1), ({"status": 3}, 0), ({"x": 1}, None)]:
        assert pages.stock(told) == want
        t = told or {}
        row = spark.createDataFrame([(t.get("notBuyable"), t.get("stock", {}).get("available"), t.get("status"))], "a boolean, b int, c int")
        assert row.select(extract.stock_rule(F.col("a"), F.col("b"), F.col("c"))).first()[0] == want
    for word, want in [("http://schema.org/InStock", 1), ("in_stock", 1), ("OUT_OF_STOCK", 0), ("SoldOut", 0), ("PreOrder", None), (None, None)]:
        assert pages.availability(word) == want
        assert spark.createDataFrame([(word,)], "a string").select(extract.availability(F.col("a"))).first()[0] == want


def test_jsonld_walk(spark):
    node = {"@graph": {"x": [{"@type": ["Thing", "Product"], "name": "n", "offers": [{"price": "1"}, {"lowPrice": 2, "highPrice": 3}]}]}}
    frame = spark.createDataFrame([(1, ld(node) + LD.format("{")), (2, "")], "page_id long, html string")
    assert {(r.name, r.price, r.list_price) for r in extract.jsonld_products(frame).collect()} == {("n", 1.0, None), ("n", 2.0, 3.0)}


def test_sitemaps(spark):
    index = b'<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> s1 </loc></sitemap><sitemap><loc>s2</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>'
    one = gzip.compress(b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>/en/eshop/p/1</loc></url><url><loc>/other</loc></url></urlset>')
    assert crawl.parse_sitemap(index)[0] == ["s1", "s2", "root"] and crawl.parse_sitemap(one)[1] == ["/en/eshop/p/1", "/other"]
    assert crawl.parse_sitemap(b"<a><x:loc xmlns:x='u'>q</x:loc></a>") == ([], ["q"]) and crawl.parse_sitemap(b"junk") == ([], []) and crawl.parse_sitemap(None) == ([], [])
    contents = spark.createDataFrame([("root", index), ("s1", one), ("s2", b"junk"), ("s3", one)], "url string, content binary")
    found = crawl.sitemap_pages(contents, ["root", "absent"], "/p/")
    assert [r.url for r in found.collect()] == ["/en/eshop/p/1"]
    assert [r.url for r in crawl.swap_locale(found).collect()] == ["/el/eshop/p/1"]
    urls = spark.createDataFrame([(0, "a/x"), (1, "b/x"), (2, "a/y")], "pos int, url string")
    assert [tuple(r) for r in crawl.rewrite_host(urls, "b/", "a/").orderBy("pos").collect()] == [(0, "a/x"), (2, "a/y")]
    assert extract.leaf_urls(spark.createDataFrame([("h/a",), ("h/a/b",), ("h/ab",)], "url string")).count() == 2


def test_fetching(spark):
    slept, answers = [], {"u": [(503, {}, b""), (429, {"Retry-After": "7"}, b""), (200, {}, b"ok")], "gone": [(404, {}, b"")], "down": [(500, {}, b"")] * 3}
    get = crawl.polite(lambda u: answers[u].pop(0), sleep=slept.append)
    broken = iter([TimeoutError(), ConnectionResetError(), (200, {}, b"late")])

    def unsteady(_):
        told = next(broken)
        if isinstance(told, Exception):
            raise told
        return told

    assert crawl.polite(unsteady, sleep=lambda _: None)("u") == b"late"
    assert (get("u"), get("gone"), get("down")) == (b"ok", None, None) and slept == [2.0, 7.0, 2.0, 4.0, 8.0]
    urls = spark.createDataFrame([("a",), ("b",), ("a",)], "url string")
    got = {r.url: bytes(r.content) for r in crawl.fetch_all(urls, lambda u: (200, {}, u.encode()), workers=2, pace=0.0).collect()}
    assert got == {"a": b"a", "b": b"b"}
    robots = "User-agent: *\nDisallow: /x\nCrawl-delay: 5\nSitemap: http://h/s.xml"
    assert [r.url for r in crawl.robots_allow(spark.createDataFrame([("http://h/x/1",), ("http://h/y",), (None,)], "url string"), robots).collect()] == ["http://h/y"]
    assert crawl.robots_facts(robots) == (5.0, ["http://h/s.xml"]) and crawl.robots_facts("")[0] == 3.0
    tries = spark.createDataFrame([("s", k, k not in (2, 3, 5, 6, 7)) for k in range(10)] + [("t", k, False) for k in range(5)], "source string, seq int, ok boolean")
    kept = crawl.until_broken(tries, most=3)
    assert sorted((r.source, r.seq) for r in kept.collect()) == [("s", k) for k in range(8)] + [("t", k) for k in range(3)]


def test_paging(spark, tmp_path):
    rows = [("l", 1, "a"), ("l", 1, "b"), ("l", 2, "b"), ("l", 2, "c"), ("l", 3, "a"), ("l", 3, "c"), ("l", 4, "d"), ("m", 1, "a")]
    frame = spark.createDataFrame(rows, "listing string, page int, sku string")
    assert sorted(tuple(r) for r in crawl.until_nothing_new(frame).collect()) == [("l", 1, "a"), ("l", 1, "b"), ("l", 2, "c"), ("m", 1, "a")]
    assert sorted(tuple(r) for r in crawl.until_nothing_new(frame.where("listing = 'l'"), least=2).collect()) == [("l", 1, "a"), ("l", 1, "b"), ("l", 2, "c")]
    (tmp_path / "meta/categories").mkdir(parents=True)
    (tmp_path / "products").mkdir()
    (tmp_path / "meta/categories/tree").write_text(json.dumps({"tree": [{"category_id": 1, "children": [{"category_id": "c", "name": "C"}]}, {"category_id": "d"}]}))
    (tmp_path / "products@page=1&page_size=50&category=c").write_text(json.dumps({"products": [{"product_id": 1, "name": "n"}], "has_next": True}))
    (tmp_path / "products@page=2&page_size=50&category=c").write_text(json.dumps({"products": [{"product_id": 2}], "has_next": False}))
    (tmp_path / "products/1").write_text(json.dumps({"retailer_prices": [{"retailer": "x", "price": 9.0, "is_discount": True, "discount_percent": 10.0}, {"retailer": "far", "price": 1.0}]}))
    (tmp_path / "products/2").write_text(json.dumps({"retailer_prices": [{"retailer": "x", "price": 5.0}]}))
    got = sorted((r.product_id, r.retailer, r.price, r.list_price) for r in crawl.paged_catalogue(spark, str(tmp_path), ["x"]).collect())
    assert got == [("1", "x", 9.0, 10.0), ("2", "x", 5.0, None)]


def test_readers(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"product": "p", "retailer": "r", "price": 1.5}, {"name": "q"}]')
    assert [(r.product, r["name"], r.price) for r in readers.snapshot_json(spark, str(tmp_path / "s.json")).collect()] == [("p", None, 1.5), (None, "q", None)]
    (tmp_path / "d.csv").write_text("﻿id,decision\n1,yes\nx,no\n,merge\n3,\n")
    assert [tuple(r) for r in readers.decisions_csv(spark, str(tmp_path / "d.csv")).collect()] == [(1, "yes"), (3, "")]
    spark.range(2).write.parquet(str(tmp_path / "a"))
    spark.range(1).selectExpr("id", "'x' as more").write.parquet(str(tmp_path / "b"))
    (tmp_path / "bad").write_text("no table")
    assert readers.union_tables(spark, [str(tmp_path / x) for x in ("a", "b", "absent", "bad")]).count() == 3
    with pytest.raises(ValueError):
        readers.union_tables(spark, [str(tmp_path / "absent")])
    readers.write_urls(spark.createDataFrame([("u",), ("t",), ("u",)], "url string"), str(tmp_path / "urls"))
    assert sorted(r.url for r in readers.read_urls(spark, str(tmp_path / "urls")).collect()) == ["t", "u"]


def test_ingest_pages(spark):
    card = lambda sku, price: f'<div class="product-thumb" data-product-id="{sku}"><h4>Γάλα {sku} 1lt</h4><b class="price_wrapper">{price}€</b></div>'
    frame = spark.createDataFrame([(1, card(1, "1,50") + card(2, "2,50"), "2024-01-02"), (2, card(1, "9,99"), "2024-01-03")], "page_id long, html string, observed_at string")
    products = spark.createDataFrame([("nb:γαλα 1 1lt|", "old", "B", None, None, "2024-01-01", "2024-01-01", None, None)], "product_key string, name string, brand string, category string, image_url string, first_seen string, last_seen string, size_dim string, size_value double")
    offers = spark.createDataFrame([], "product_key string, retailer string, sku string, url string, first_seen string, last_seen string")
    p, o, seen = readers.ingest_pages(frame, "thumb_cards", "shop", products, offers)
    got = {r.product_key: (r.name, r.brand, r.first_seen, r.last_seen, r.size_value) for r in p.collect()}
    assert got == {"nb:γαλα 1 1lt|": ("Γάλα 1 1lt", "B", "2024-01-01", "2024-01-02", 1000.0), "nb:γαλα 2 1lt|": ("Γάλα 2 1lt", None, "2024-01-02", "2024-01-02", 1000.0)}
    assert sorted((r.sku, r.first_seen) for r in o.collect()) == [("1", "2024-01-02"), ("2", "2024-01-02")]
    assert sorted((r.sku, r.price) for r in seen.collect()) == [("1", 1.5), ("2", 2.5)]
    assert readers.ingest_pages(frame, "thumb_cards", "shop", products, offers, limit=1)[2].count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", None, "c", "y", 1.0, None, 1, None, None, "t"), ("A", "q\"r", "c", "x", None, None, 0, "s", "u", "t")], "product string, brand string, category string, retailer string, price double, list_price double, in_stock int, sku string, url string, observed_at string")
    snapshot.write(rows, str(tmp_path / "o"))
    (csv,) = [p.read_bytes() for p in (tmp_path / "o/csv").glob("part-*") if p.stat().st_size > 3][:1]
    assert csv.startswith("﻿product,brand".encode())
    snapshot.write_json_array(snapshot.ordered(rows), str(tmp_path / "array"))
    (text,) = [p.read_text() for p in (tmp_path / "array").glob("part-*")]
    assert [(r["product"], r["price"], r["brand"]) for r in json.loads(text)] == [("A", None, 'q"r'), ("b", 1.0, None)]
    snapshot.write_json_array(rows.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []
    assert [r.name for r in snapshot.newest(spark.createDataFrame([("b1",), ("b3",), ("b2",)], "name string"), 2).collect()] == ["b3", "b2"]
    back = readers.snapshot_json(spark, str(tmp_path / "array"))
    assert back.count() == 2


def test_commands(spark, tmp_path):
    data = ["--data", "/root/testdata/sf0.001"]
    assert run(spark, [*data, "stats"]).first().observations > 0
    assert run(spark, [*data, "show", "--retailer", "ASIA", "--limit", "3"]).count() == 3
    assert run(spark, [*data, "doctor"]).count() == 5
    assert run(spark, [*data, "changes", "--limit", "999"]).count() <= 200
    assert run(spark, [*data, "query", "retailers"]).count() == 5
    assert run(spark, [*data, "search", "a", "--limit", "2"]).count() > 0
    made = run(spark, [*data, "export", str(tmp_path / "out")]).first()
    assert run(spark, [*data, "sync", str(tmp_path / "out/array")]).first().ingested == made.n_rows
    assert run(spark, [*data, "purge", "ASIA"]).where("retailer = 'ASIA'").count() == 0


def test_writing_commands(spark, tmp_path):
    """purge and backup write, scrape folds a batch in once, dedup --prune scores a queue anew."""
    data = ["--data", "/root/testdata/sf0.001"]
    run(spark, [*data, "purge", "ASIA", "--out", str(tmp_path / "left")])
    offers, prices = (spark.read.parquet(str(tmp_path / "left" / t)) for t in ("offers", "prices"))
    assert offers.where("retailer = 'ASIA'").isEmpty() and offers.count() == prices.select("product_id", "retailer").distinct().count() > 0
    for name in ("b1", "b3", "b2"):
        left = [r.name for r in run(spark, [*data, "backup", str(tmp_path / "backups"), "--name", name, "--keep", "2"]).collect()]
    assert left == ["b3", "b2"] and {p.name for p in (tmp_path / "backups").iterdir() if not p.name.startswith(".")} == {"b3", "b2"}
    card = '<div class="product-thumb" data-product-id="7"><h4>Acme Tea 1lt</h4><b class="price_wrapper">2,00€</b></div>'
    spark.createDataFrame([(1, "/u", card, None)], "page_id long, url string, html string, observed_at timestamp").withColumn("observed_at", F.lit("2024-01-02").cast("timestamp")).write.parquet(str(tmp_path / "pages"))
    for _ in range(2):
        got = run(spark, [*data, "scrape", str(tmp_path / "pages"), "thumb_cards", "shop", str(tmp_path / "store"), "--batch", "0"])
        assert [(r.product_key, r.retailer, r.sku) for r in got.collect()] == [("nb:acme tea 1lt|", "shop", "7")]
    kinds = "candidate_id long, product_a long, product_b long, score double, status string"
    spark.createDataFrame([(1, 0, 10**9, 0.9, "pending"), (2, 0, 10**9, 0.9, "approved")], kinds).write.parquet(str(tmp_path / "queue"))
    assert [r.candidate_id for r in run(spark, [*data, "dedup", "--prune", str(tmp_path / "queue")]).collect()] == [2]


def test_ingest_of_a_source(spark):
    """From found urls to folded rows: failures, an unpriced page, a repeated sku, and a source that refuses."""
    from datetime import datetime

    card = lambda sku, price: f'<div class="product-thumb" data-product-id="{sku}"><h4>Tea {sku} 1lt</h4><b class="price_wrapper">{price}</b></div>'.encode()
    shop = {"/1": card(1, "1,50€"), "/2": b"<p>nothing</p>", "/3": card(1, "9,00€"), "/4": card(2, "2,50€")}

    def fetch(url):
        if url not in shop:
            raise ConnectionResetError
        return 200, {}, shop[url]

    urls = spark.createDataFrame([(k, f"/{n}") for k, n in enumerate([1, 2, 99, 3, 4, *range(100, 112)])], "seq long, url string")
    products = spark.createDataFrame([], "product_key string, name string, brand string, category string, image_url string, first_seen timestamp, last_seen timestamp, size_dim string, size_value double")
    offers = spark.createDataFrame([], "product_key string, retailer string, sku string, url string, first_seen timestamp, last_seen timestamp")
    p, o, seen, report = readers.ingest_source(urls, fetch, "thumb_cards", "shop", F.lit(datetime(2024, 1, 2)), products, offers, pace=0.0, tries=1)
    assert sorted((r.sku, r.price) for r in seen.collect()) == [("1", 1.5), ("2", 2.5)]
    assert p.count() == o.count() == 2
    assert [tuple(r) for r in report.collect()] == [("shop", 4, 9, 4, 1, True)]


def test_review_sheet_columns(spark, tmp_path):
    from tradewind.operators import canonical

    queue = spark.createDataFrame([(1, 5, 6, 0.8, "pending")], "candidate_id long, product_a long, product_b long, score double, status string")
    products = spark.createDataFrame([(5, "a", "B", "c"), (6, "d", None, "e")], "id long, name string, brand string, category string")
    obs = spark.createDataFrame([(5, "x"), (5, "y")], "product_id long, retailer string")
    snapshot.write_review(canonical.export_candidates(queue, products, obs), str(tmp_path / "sheet"))
    (row,) = spark.read.csv(str(tmp_path / "sheet"), header=True).collect()
    assert len(row) == 14 and (row.category_a, row.category_b, row.retailers_a) == ("c", "e", "x,y")
