"""JSON-LD by VARIANT, hierarchies by recursive queries, SQL functions, table functions and the circuit breaker."""

import gzip
import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tradewind.functions import sql as names
from tradewind.functions import tree
from tradewind.functions.quantity import extract_size, match_key
from tradewind.functions.text import fold
from tradewind.operators import hierarchy
from tradewind.sources import crawl, extract


def ld(node) -> str:
    return f'<script type="application/ld+json">{node if isinstance(node, str) else json.dumps(node)}</script>'


OFFERS = ["see shop", None, {"price": "1"}, {"lowPrice": 2, "highPrice": 3, "availability": "http://schema.org/OutOfStock", "priceCurrency": "USD"}, {"price": "1,5"}, {"price": 0, "lowPrice": "4.5"}, {"price": "", "lowPrice": 7, "availability": "InStock"}, {}]
PAGES = [
    (1, ld({"@graph": {"x": [{"@type": ["Thing", "Product"], "name": "n", "brand": {"name": "B"}, "gtin": 12, "offers": OFFERS}]}})),
    (2, ld("{bad") + ld({"@type": "PRODUCT", "name": "none", "sku": ""}) + ld({"@type": "product", "name": ["a", "b"], "offers": "text"}) + ld({"@type": "Product", "offers": []})),
    (3, None), (4, ""), (5, ld("3") + ld("null") + ld("[]") + ld('"@type"')),
    (6, ld({"@type": "Product", "name": "outer", "isRelatedTo": [[{"@type": "Product", "name": "inner", "offers": {"price": 5}}]], "offers": {"price": 6}})),
]
GOLDEN = {
    (1, "n", "B", "12", 1.0, None, "EUR", None), (1, "n", "B", "12", 2.0, 3.0, "USD", 0), (1, "n", "B", "12", None, None, "EUR", None), (1, "n", "B", "12", 4.5, None, "EUR", None), (1, "n", "B", "12", 7.0, None, "EUR", 1),
    (2, "none", None, None, None, None, "EUR", None), (2, None, None, None, None, None, "EUR", None), (6, "outer", None, None, 6.0, None, "EUR", None), (6, "inner", None, None, 5.0, None, "EUR", None),
}


def test_jsonld_offers_of_all_kinds(spark):
    """Textual, missing, listed and nested offers; bad JSON, other types and null pages are skipped."""
    pages = spark.createDataFrame(PAGES, "page_id long, html string")
    got = [tuple(r) for r in extract.jsonld_products(pages).collect()]
    assert set(got) == GOLDEN and len(got) == 10
    assert "Python" not in extract.jsonld_products(pages)._jdf.queryExecution().executedPlan().toString()


def test_walk_is_a_plain_walk(spark):
    """All values of random documents, at any depth, as a loop in Python finds them."""
    rng = random.Random(3)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([1, "x", None, True, [], {}, "[{"])
        return [make(depth - 1) for _ in range(rng.randint(0, 3))] if rng.random() < 0.5 else {f"k{k}": make(depth - 1) for k in range(rng.randint(0, 3))}

    def count(x):
        return 1 + sum(map(count, x if isinstance(x, list) else x.values() if isinstance(x, dict) else []))

    deep = "[" * 200 + "]" * 200
    docs = [json.dumps(make(6)) for _ in range(60)] + [deep, "{", "", None]
    got = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, d string").select("k", F.size(tree.nodes(F.col("d"))).alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == [*(count(json.loads(d)) for d in docs[:-3]), -1, -1, -1] or [r.n for r in got] == [*(count(json.loads(d)) for d in docs[:-3]), None, None, None]


def test_reachable_nodes(spark):
    """Trees, shared nodes, cycles, absent roots and repeated edges."""
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("c", "d"), ("d", "a"), ("b", "d"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("a",), ("a",), ("gone",)], "node string")
    assert {(r.node, r.depth) for r in hierarchy.first_reached(edges, roots).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("gone", 0)}
    assert sorted("".join(r.path) for r in hierarchy.reachable(edges, roots).where("node = 'd'").collect()) == ["abd", "acd"]
    assert {r.node for r in hierarchy.leaves(edges, spark.createDataFrame([("x",), ("gone",)], "node string")).collect()} == {"y", "gone"}


def test_a_tree_too_deep_is_an_error(spark):
    chain = spark.range(150).selectExpr("id AS parent", "id + 1 AS child")
    with pytest.raises(Py4JJavaError, match="RECURSION_LEVEL"):
        hierarchy.reachable(chain, spark.createDataFrame([(0,)], "node long")).count()


def test_category_trees(spark):
    one = {"tree": [{"category_id": 1, "name": "food", "children": [{"category_id": 2, "name": "milk", "children": []}, {"name": "no id", "children": [{"category_id": 3, "name": "tea"}]}]}]}
    docs = spark.createDataFrame([(7, json.dumps(one)), (8, json.dumps([{"category_id": "z"}])), (9, "{"), (10, None)], "id long, raw string")
    got = {(r.document, r.parent, r.node, r.name, r.depth) for r in hierarchy.tree_edges(docs).collect()}
    assert got == {(7, None, "1", "food", 0), (7, "1", "2", "milk", 1), (7, "1", "3", "tea", 2), (8, None, "z", None, 0)}


def test_sitemaps_that_name_each_other(spark):
    index = lambda *names: "".join(["<sitemapindex>", *(f"<sitemap><loc>{n}</loc></sitemap>" for n in names), "</sitemapindex>"]).encode()
    pages = lambda *names: gzip.compress("".join(["<urlset>", *(f"<url><loc>{n}</loc></url>" for n in names), "</urlset>"]).encode())
    contents = spark.createDataFrame([("r", index("s1", "s2", "r")), ("s1", index("s3", "r", "lost")), ("s2", pages("/p/1", "/p/2", "/x")), ("s3", pages("/p/2", "/p/3")), ("apart", pages("/p/9")), ("bad", None)], "url string, content binary")
    assert [r.url for r in crawl.sitemap_pages(contents, ["r", "absent"], "/p/").orderBy("url").collect()] == ["/p/1", "/p/2", "/p/3"]
    assert [r.url for r in crawl.sitemap_pages(contents, ["r"], "/p/", limit=2).collect()] == ["/p/1", "/p/2"]


NAMES = ["Γάλα ΔΕΛΤΑ 1,5 lt", "Coca-Cola 6x330ml", "Coca-Cola 6 x 330 ml", "Μπύρα 4+2 500ml", "No 5 χαρτί 12 ρολα", "Straße ﬁne ½ kg", "  Café   CRÈME  250 gr ", "Ελιές 12,50% 3 τεμ", "", None, "acme", "Acme Tea 20 tabs 1kg", "ﬂour 1.000 g", "spf 50 κρέμα 35"]


def test_sql_functions_are_their_columns(spark):
    """Through spark.sql as through DataFrames, without a Python worker."""
    names.register(spark)
    frame = spark.createDataFrame([(k, n, b) for k, n in enumerate(NAMES) for b in ("Acme", None, "Coca-Cola")], "id int, name string, brand string")
    frame.createOrReplaceTempView("sql_names")
    by_sql = spark.sql("SELECT id, brand, tw_fold(name) AS f, tw_size(name) AS s, tw_match_key(name, brand) AS k FROM sql_names")
    by_column = frame.select("id", "brand", fold(F.col("name")).alias("f"), extract_size(F.col("name")).alias("s"), match_key(F.col("name"), F.col("brand")).alias("k"))
    assert sorted(map(str, by_sql.collect())) == sorted(map(str, by_column.collect()))
    assert "Python" not in by_sql._jdf.queryExecution().executedPlan().toString()


def test_table_function_gives_offers(spark):
    """The same offers as the native walk, with the columns a query asks for, by a lateral join."""
    names.register(spark)
    rows = [(i, raw) for i, html in PAGES for raw in (html or "").replace("</script>", "\n").replace('<script type="application/ld+json">', "").split("\n") if raw]
    spark.createDataFrame([*rows, (99, None)], "page_id long, raw string").createOrReplaceTempView("sql_blocks")
    got = [tuple(r) for r in spark.sql("SELECT page_id, o.* FROM sql_blocks, LATERAL tw_offers(raw) o").collect()]
    assert set(got) == GOLDEN and len(got) == 10
    few = spark.sql("SELECT page_id, o.* FROM sql_blocks, LATERAL tw_offers(raw, keep => 'price, name') o WHERE page_id IN (6, 99)")
    assert few.columns == ["page_id", "price", "name"] and {tuple(r) for r in few.collect()} == {(6, 6.0, "outer"), (6, 5.0, "inner")}
    for wrong in ("tw_offers(raw, keep => 'nothing')", "tw_offers(page_id)", "tw_offers(raw, keep => raw)"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM sql_blocks, LATERAL {wrong}").collect()


def test_table_function_over_partitions(spark):
    names.register(spark)
    rows = [("a", 1, 2.0), ("a", 2, 2.0), ("a", 3, 3.0), ("a", 4, 2.0), ("b", 1, None), ("b", 2, None), (None, 1, 1.0)]
    spark.createDataFrame(rows, "key string, at int, price double").createOrReplaceTempView("sql_series")
    got = spark.sql("SELECT * FROM tw_stretches(TABLE(sql_series) PARTITION BY key ORDER BY at)").collect()
    assert {tuple(r) for r in got} == {("a", 1, 2, 2.0, 2), ("a", 3, 3, 3.0, 1), ("a", 4, 4, 2.0, 1), ("b", 1, 2, None, 2), (None, 1, 1, 1.0, 1)}


def test_a_source_that_refuses_is_left_alone(spark, tmp_path):
    """After eight failures in a row no further call is made; a success between starts the count again; other sources go on."""
    rows = [("down", k, f"down/{k}") for k in range(12)] + [("flaky", k, f"flaky/{k}") for k in range(20)] + [("up", 0, "up/0"), ("up", 1, None)]
    log = str(tmp_path)

    def fetch(url):
        open(f"{log}/{url.replace('/', '-')}", "a").write("x")
        if url.startswith("down") or (url.startswith("flaky") and int(url.split("/")[1]) % 8):
            raise TimeoutError
        return 200, {}, b"body"

    urls = spark.createDataFrame(rows, "source string, seq long, url string")
    got = crawl.fetch_sources(urls, fetch, most=8, pace=0.0, tries=1).collect()
    called = {p.name for p in tmp_path.iterdir()}
    assert called == {f"down-{k}" for k in range(8)} | {f"flaky-{k}" for k in range(20)} | {"up-0"}
    outcome = {(r.source, r.seq): r.outcome for r in got}
    assert [outcome["down", k] for k in (7, 8, 11)] == ["failed", "skipped", "skipped"] and outcome["flaky", 16] == "fetched" and outcome["up", 1] == "failed"
    report = crawl.source_report(spark.createDataFrame(got), spark.createDataFrame([("flaky/0",)], "url string"))
    assert {tuple(r) for r in report.collect()} == {("down", 0, 8, 4, 0, True), ("flaky", 3, 17, 0, 2, False), ("up", 1, 1, 0, 1, False)}
