"""Registered price queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as v
from ..functions.quantity import extract_size, name_tokens
from ..functions.similarity import token_blocks
from ..functions.text import cents
from ..operators import canonical, catalog, ingest, lists, quality, snapshot, timeseries
from ..sources import extract
from ..streaming import prices

Query = Callable[[SparkSession, str], DataFrame]

_OBS = """
chains AS (SELECT s_suppkey, r_name AS retailer FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
obs AS (SELECT l_partkey AS product_id, retailer, l_shipdate AS observed_at, l_extendedprice / l_quantity AS price,
  CASE WHEN l_discount > 0 THEN l_extendedprice / l_quantity / (1 - l_discount) END AS list_price, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS in_stock
  FROM lineitem JOIN chains ON l_suppkey = s_suppkey),
latest AS (SELECT * EXCLUDE (r) FROM (SELECT *, rank() OVER (PARTITION BY product_id, retailer ORDER BY observed_at DESC) AS r FROM obs) WHERE r = 1),
products AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS category, CASE WHEN m <> p_partkey THEN m END AS canonical_id
  FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS m FROM part)),
members AS (SELECT id AS product_id, coalesce(canonical_id, id) AS master FROM products),
best AS (SELECT product_id, retailer AS best_retailer, price AS best_price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, retailer) AS r FROM latest) WHERE r = 1),
items AS (SELECT l_orderkey AS list_id, l_partkey AS product_id, l_quantity::INT AS qty, l_extendedprice / l_quantity AS added_price FROM lineitem)
"""

_FOUND: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, sql: str | None = None, raw: bool = False):
    def keep(f: Query) -> Query:
        _FOUND[name] = (f, None if sql is None else sql if raw else f"WITH {_OBS} {sql}")
        return f

    return keep


def _changes_sql(days: int) -> str:
    return f""", cut AS (SELECT max(observed_at) - INTERVAL {days} DAY AS c FROM obs),
old AS (SELECT product_id, retailer, price AS old FROM (SELECT *, rank() OVER (PARTITION BY product_id, retailer ORDER BY observed_at DESC) AS r FROM obs, cut WHERE observed_at <= c) WHERE r = 1),
moved AS (SELECT l.product_id, l.retailer, old, price AS new, observed_at, (price - old) / old * 100 AS pct FROM latest l JOIN old USING (product_id, retailer) WHERE old > 0 AND old <> price),
top AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY abs(pct) DESC, retailer, new DESC, old DESC) AS r FROM moved),
changes AS (SELECT product_id, name, brand, category, retailer, floor(old * 100 + 0.5) / 100 AS old, floor(new * 100 + 0.5) / 100 AS new, floor((new - old) * 100 + 0.5) / 100 AS change, floor(pct * 10 + 0.5) / 10 AS pct, observed_at FROM top JOIN products ON id = product_id WHERE r = 1)
SELECT * FROM changes"""


def _movers_sql(sign: str) -> str:
    return _changes_sql(365).replace("SELECT * FROM changes", f", first AS (SELECT * FROM changes ORDER BY abs(pct) DESC, product_id LIMIT 2000) SELECT * FROM first WHERE pct {sign} 0 ORDER BY abs(pct) DESC, product_id LIMIT 1000")


@_add("latest_prices", "SELECT product_id, retailer, observed_at, price, list_price, in_stock FROM latest")
def _(s, d):
    return timeseries.latest(v.price_obs(s, d))


@_add("latest_by_retailer", "SELECT product_id, retailer, observed_at, price FROM latest WHERE retailer = 'ASIA'")
def _(s, d):
    return timeseries.latest(v.price_obs(s, d).where("retailer = 'ASIA'")).select("product_id", "retailer", "observed_at", "price")


@_add("latest_as_of", "SELECT product_id, retailer, observed_at, price FROM (SELECT *, rank() OVER (PARTITION BY product_id, retailer ORDER BY observed_at DESC) AS r FROM obs WHERE observed_at <= TIMESTAMP '1998-01-01') WHERE r = 1")
def _(s, d):
    return timeseries.latest(v.price_obs(s, d), upto=F.lit("1998-01-01").cast("timestamp_ntz")).select("product_id", "retailer", "observed_at", "price")


@_add("biggest_changes_30", _changes_sql(30))
def _(s, d):
    return timeseries.biggest_changes(v.price_obs(s, d), v.products(s, d), 30, None)


@_add("biggest_changes_365", _changes_sql(365))
def _(s, d):
    return timeseries.biggest_changes(v.price_obs(s, d), v.products(s, d), 365, None)


@_add("movers_up", _movers_sql(">"))
def _(s, d):
    return timeseries.movers(timeseries.biggest_changes(v.price_obs(s, d), v.products(s, d), 365, None), 1000)[0]


@_add("movers_down", _movers_sql("<"))
def _(s, d):
    return timeseries.movers(timeseries.biggest_changes(v.price_obs(s, d), v.products(s, d), 365, None), 1000)[1]


@_add("changes_for_products", _changes_sql(365) + " WHERE product_id IN (1, 2, 3, 5, 8, 13)")
def _(s, d):
    rows = v.price_obs(s, d)
    few = [1, 2, 3, 5, 8, 13]
    return timeseries.biggest_changes(rows, v.products(s, d), 365, None).where(F.col("product_id").isin(few))


@_add("price_history_offer", "SELECT observed_at, price, list_price, in_stock FROM obs WHERE product_id = 7 AND retailer = 'EUROPE'")
def _(s, d):
    return timeseries.price_history(v.price_obs(s, d), 7, "EUROPE")


@_add("product_history", "SELECT product_id, retailer, row_number() OVER (PARTITION BY product_id, retailer ORDER BY observed_at, price) - 1 AS at, observed_at, price FROM obs")
def _(s, d):
    series = timeseries.history_map(v.price_obs(s, d)).select("product_id", F.explode("history").alias("retailer", "h"))
    return series.select("product_id", "retailer", F.posexplode("h").alias("at", "x")).select("product_id", "retailer", F.col("at").cast("long").alias("at"), "x.observed_at", "x.price")


@_add("product_info", "SELECT * FROM products WHERE id = 7")
def _(s, d):
    return catalog.product_info(v.products(s, d), 7)


@_add("discount_pct", "SELECT product_id, retailer, observed_at, price, 100 * (list_price - price) / list_price AS discount_pct FROM obs WHERE list_price IS NOT NULL")
def _(s, d):
    return timeseries.discount_percent(v.price_obs(s, d)).where("list_price is not null").select("product_id", "retailer", "observed_at", "price", "discount_pct")


@_add("spread_min_max", "SELECT product_id, min(price) AS min_price, max(price) AS max_price, count(*) AS retailer_count FROM latest GROUP BY 1")
def _(s, d):
    return timeseries.spread(timeseries.latest(v.price_obs(s, d)))


@_add("export_catalog", "SELECT product_id, retailer, floor(max(price) * 100 + 0.5) / 100 AS price FROM latest GROUP BY 1, 2")
def _(s, d):
    return timeseries.catalogue(timeseries.latest(v.price_obs(s, d))).select("product_id", F.explode("prices").alias("retailer", "price"))


@_add("stats", "SELECT (SELECT count(*) FROM products WHERE canonical_id IS NULL) AS products, (SELECT count(*) FROM (SELECT DISTINCT product_id, retailer FROM obs)) AS offers, (SELECT count(*) FROM obs) AS observations, (SELECT count(DISTINCT retailer) FROM obs) AS retailers, (SELECT count(*) FROM (SELECT master FROM obs JOIN members USING (product_id) GROUP BY master HAVING count(DISTINCT retailer) > 1)) AS multi_chain")
def _(s, d):
    return catalog.stats(v.products(s, d), v.price_obs(s, d))


@_add("multi_chain", "SELECT master, count(DISTINCT retailer) AS n_retailers FROM obs JOIN members USING (product_id) GROUP BY master HAVING count(DISTINCT retailer) > 1")
def _(s, d):
    return catalog.multi_chain(v.products(s, d), v.price_obs(s, d))


@_add("categories", "SELECT category, count(*) AS n FROM products GROUP BY 1 ORDER BY n DESC, category LIMIT 200")
def _(s, d):
    return catalog.categories(v.products(s, d))


@_add("retailers", "SELECT retailer, count(*) AS n_offers FROM (SELECT DISTINCT product_id, retailer FROM obs) GROUP BY 1")
def _(s, d):
    return catalog.retailers(v.price_obs(s, d))


def _search_sql(first: str, then: str = "TRUE", limit: int = 500) -> str:
    return f""", m AS (SELECT * FROM products WHERE canonical_id IS NULL AND {first} ORDER BY name, id LIMIT {limit})
SELECT m.id AS product_id, l.product_id AS member_id, m.name, m.brand, m.category, retailer, price, list_price, in_stock, observed_at
FROM m JOIN members ON master = m.id JOIN latest l ON l.product_id = members.product_id WHERE {then}"""


@_add("search_basic", _search_sql("lower(name) LIKE '%re%'", limit=50))
def _(s, d):
    return catalog.search(v.products(s, d), v.price_obs(s, d), "RÉ", limit=50)


@_add("search_category", _search_sql("category = (SELECT min(category) FROM products)"))
def _(s, d):
    first = v.products(s, d).agg(F.min("category")).scalar()
    return catalog.search(v.products(s, d), v.price_obs(s, d), category=first)


@_add("search_on_offer", _search_sql("TRUE", "list_price > price AND retailer = 'AFRICA'", 100))
def _(s, d):
    return catalog.search(v.products(s, d), v.price_obs(s, d), retailer="AFRICA", on_offer=True, limit=100)


@_add("search_in_stock", _search_sql("TRUE", "in_stock = 1", 100))
def _(s, d):
    return catalog.search(v.products(s, d), v.price_obs(s, d), in_stock_only=True, limit=100)


@_add("product_offers", "SELECT product_id, retailer, price, observed_at FROM latest WHERE product_id IN (SELECT product_id FROM members WHERE master = (SELECT master FROM members WHERE product_id = 7)) ORDER BY price NULLS LAST, product_id, retailer")
def _(s, d):
    return catalog.product_offers(v.products(s, d), v.price_obs(s, d), 7).select("product_id", "retailer", "price", "observed_at")


@_add("group_offers", "SELECT master, product_id, retailer, price, observed_at FROM latest JOIN members USING (product_id)")
def _(s, d):
    return catalog.group_offers(v.products(s, d), v.price_obs(s, d)).select("master", "product_id", "retailer", "price", "observed_at")


@_add("snapshot_rows", "SELECT name AS product, brand, category, retailer, price, list_price, in_stock, NULL::VARCHAR AS sku, NULL::VARCHAR AS url, observed_at FROM latest JOIN products ON id = product_id")
def _(s, d):
    return snapshot.rows(timeseries.latest(v.price_obs(s, d)), v.products(s, d))


@_add("snapshot_manifest", "SELECT count(*) AS n_rows, count(DISTINCT name) AS n_products, string_agg(DISTINCT retailer, ',' ORDER BY retailer) AS retailers FROM latest JOIN products ON id = product_id")
def _(s, d):
    return snapshot.manifest(snapshot.rows(timeseries.latest(v.price_obs(s, d)), v.products(s, d)))


@_add("list_price_derivation", "SELECT product_id, retailer, observed_at, price, floor(price / (1 - 10 / 100.0::DOUBLE) * 100 + 0.5) / 100 AS list_price_10 FROM obs")
def _(s, d):
    return v.price_obs(s, d).select("product_id", "retailer", "observed_at", "price", extract.list_price(F.col("price"), F.lit(True), F.lit(10)).alias("list_price_10"))


@_add("all_lists", "SELECT o_orderkey AS id, nullif(o_custkey % 10, 0) AS user_id, o_orderdate AS updated_at, coalesce(n, 0) AS n_items FROM orders LEFT JOIN (SELECT list_id, count(*) AS n FROM items GROUP BY 1) ON list_id = o_orderkey WHERE nullif(o_custkey % 10, 0) IS NULL")
def _(s, d):
    return lists.overview(v.lists(s, d), v.list_items(s, d), None)


@_add("list_review", ", dear AS (SELECT product_id, min(p) AS current_min FROM (SELECT product_id, retailer, max(price) AS p FROM latest GROUP BY 1, 2) GROUP BY 1) SELECT list_id, product_id, qty, added_price, current_min, floor((current_min - nullif(added_price, 0)) * 100 + 0.5) / 100 AS since_added FROM items LEFT JOIN dear USING (product_id)")
def _(s, d):
    return lists.review(v.list_items(s, d).drop("added_at"), timeseries.latest(v.price_obs(s, d)))


@_add("list_plan", "SELECT list_id, product_id, qty, best_retailer AS planned_retailer, floor(best_price * 100 + 0.5) / 100 AS planned_price FROM items LEFT JOIN best USING (product_id)")
def _(s, d):
    return lists.plan(v.list_items(s, d).drop("added_at", "added_price"), timeseries.latest(v.price_obs(s, d)))


def _planned(s: SparkSession, d: str) -> DataFrame:
    """Items as planned at the beginning of 1998."""
    then = timeseries.latest(v.price_obs(s, d), upto=F.lit("1998-01-01").cast("timestamp_ntz"))
    return lists.plan(v.list_items(s, d).drop("added_at", "added_price"), then)


_PLANNED = """, past AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY product_id, retailer ORDER BY observed_at DESC) AS r FROM obs WHERE observed_at <= TIMESTAMP '1998-01-01') WHERE r = 1),
old AS (SELECT product_id, retailer AS planned_retailer, floor(price * 100 + 0.5) / 100 AS planned_price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, retailer) AS k FROM past) WHERE k = 1),
rev AS (SELECT list_id, product_id, qty, planned_retailer, planned_price, best_retailer, best_price, best_price - planned_price AS price_delta, coalesce(best_retailer <> planned_retailer, FALSE) AS store_changed FROM items LEFT JOIN old USING (product_id) LEFT JOIN best USING (product_id))"""


@_add("list_revaluate", _PLANNED + " SELECT * FROM rev")
def _(s, d):
    return lists.revalue(_planned(s, d), timeseries.latest(v.price_obs(s, d)))


@_add("list_totals", _PLANNED + """, sums AS (SELECT list_id, nullif(sum(floor(planned_price * qty * 10000 + 0.5)::BIGINT) FILTER (best_price IS NOT NULL), 0) AS p, nullif(sum(floor(best_price * qty * 10000 + 0.5)::BIGINT) FILTER (planned_price IS NOT NULL), 0) AS c, sum(store_changed::INT)::BIGINT AS n_store_changed FROM rev GROUP BY 1)
SELECT list_id, p / 10000 AS planned_total, floor(c / 10000 * 100 + 0.5) / 100 AS current_total, floor((c - p) / 10000 * 100 + 0.5) / 100 AS delta, n_store_changed FROM sums""")
def _(s, d):
    out = lists.totals(lists.revalue(_planned(s, d), timeseries.latest(v.price_obs(s, d))))
    return out.select("list_id", "planned_total", cents(F.col("current_total")).alias("current_total"), cents(F.col("delta")).alias("delta"), "n_store_changed")


_ITEMS = """, it AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'item ' || (l_partkey % 9) AS name, l_returnflag AS category, l_quantity::INT AS qty, l_orderkey AS k FROM lineitem WHERE l_orderkey % 10 = 1)"""


@_add("list_sync", _ITEMS + """, asked AS (SELECT CASE WHEN k % 20 = 1 THEN id END AS server_id, CASE WHEN k % 30 <> 1 THEN 'new ' || id END AS name, 'cat' AS category, CASE WHEN k % 40 <> 1 THEN 7 END AS qty FROM it WHERE k % 3 = 1),
want AS (SELECT DISTINCT * FROM asked WHERE server_id IS NOT NULL UNION ALL SELECT * FROM asked WHERE server_id IS NULL), -- rows of one id say the same here
kept AS (SELECT * FROM it WHERE k % 7 <> 3)
SELECT id, CASE WHEN server_id IS NULL THEN i.name ELSE coalesce(w.name, '(item)') END AS name, coalesce(w.category, i.category) AS category, CASE WHEN server_id IS NULL THEN i.qty ELSE coalesce(w.qty, 1) END AS qty FROM kept i LEFT JOIN want w ON server_id = id
UNION ALL SELECT NULL, coalesce(name, '(item)'), category, coalesce(qty, 1) FROM want WHERE server_id IS NULL OR server_id NOT IN (SELECT id FROM kept)""")
def _(s, d):
    k = F.col("l_orderkey")
    it = v.table(s, d, "lineitem").where(k % 10 == 1).select((k * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("item "), (F.col("l_partkey") % 9).cast("string")).alias("name"), F.col("l_returnflag").alias("category"), F.col("l_quantity").cast("int").alias("qty"), k.alias("k"))
    want = it.where("k % 3 = 1").select(F.when(F.col("k") % 20 == 1, F.col("id")).alias("server_id"), F.when(F.col("k") % 30 != 1, F.concat(F.lit("new "), F.col("id").cast("string"))).alias("name"), F.lit("cat").alias("cat"), F.lit(None).cast("string").alias("category"), F.when(F.col("k") % 40 != 1, 7).alias("qty"))
    return lists.sync(it.drop("k"), want, it.where("k % 7 = 3").select("id"))


@_add("owned_items", "SELECT list_id, product_id, qty FROM items WHERE list_id IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)")
def _(s, d):
    return lists.owned_items(v.lists(s, d), v.list_items(s, d), 3).select("list_id", "product_id", "qty")


@_add("list_item_history", "SELECT i.list_id, i.product_id, obs.retailer, count(*) AS n, max(obs.observed_at) AS last_at FROM (SELECT DISTINCT list_id, product_id FROM items WHERE list_id = 7) i JOIN obs USING (product_id) GROUP BY ALL")
def _(s, d):
    mine = v.list_items(s, d).where("list_id = 7").select("list_id", "product_id").distinct()
    got = lists.item_history(mine, v.price_obs(s, d)).select("list_id", "product_id", F.explode("history").alias("retailer", "h"))
    return got.select("list_id", "product_id", "retailer", F.size("h").cast("long").alias("n"), F.element_at("h", -1)["observed_at"].alias("last_at"))


_QUEUE = """, queue AS (SELECT candidate_id, product_a, product_b, (candidate_id % 100)::DOUBLE / 100 AS score, CASE candidate_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status
  FROM (SELECT 1 + o_orderkey % 101 AS product_a, 2 + o_orderkey % 101 + o_custkey % 7 AS product_b, min(o_orderkey) AS candidate_id FROM orders GROUP BY 1, 2))"""


@_add("review_queue", _QUEUE + "SELECT candidate_id, score, product_a, a.name AS name_a, a.brand AS brand_a, product_b, b.name AS name_b, b.brand AS brand_b FROM queue JOIN products a ON a.id = product_a JOIN products b ON b.id = product_b WHERE status = 'pending' ORDER BY score DESC, candidate_id LIMIT 200")
def _(s, d):
    return canonical.review_queue(v.candidate_queue(s, d), v.products(s, d))


@_add("candidate_resolve", _QUEUE + "SELECT candidate_id, product_a, product_b, score, CASE WHEN candidate_id % 3 = 0 THEN CASE WHEN candidate_id % 2 = 0 THEN 'approved' ELSE 'rejected' END ELSE status END AS status FROM queue")
def _(s, d):
    q = v.candidate_queue(s, d)
    answers = q.where("candidate_id % 3 = 0").select("candidate_id", (F.col("candidate_id") % 2 == 0).alias("approve"), F.col("product_b").alias("into"))
    return canonical.resolve(q, answers)[0]


@_add("candidate_upsert", _QUEUE + ", fresh AS (SELECT product_a, product_b, max(score) AS f FROM (SELECT product_a, product_b, 0.5 AS score FROM queue WHERE candidate_id % 2 = 0 UNION ALL SELECT product_a + 1000, product_b + 1000, 0.25 FROM queue) GROUP BY 1, 2) SELECT coalesce(q.product_a, n.product_a) AS product_a, coalesce(q.product_b, n.product_b) AS product_b, CASE WHEN status IS NULL THEN f WHEN status = 'pending' THEN coalesce(f, score) ELSE score END::DOUBLE AS score, coalesce(status, 'pending') AS status FROM queue q FULL JOIN fresh n ON q.product_a = n.product_a AND q.product_b = n.product_b")
def _(s, d):
    q = v.candidate_queue(s, d)
    found = q.where("candidate_id % 2 = 0").select(F.col("product_b").alias("product_a"), F.col("product_a").alias("product_b"), F.lit(0.5).cast("double").alias("score")).unionByName(q.select(F.col("product_a") + 1000, F.col("product_b") + 1000, F.lit(0.25).cast("double")).toDF("product_a", "product_b", "score"))
    return canonical.upsert_candidates(q.drop("candidate_id"), found)


@_add("candidate_prune", _QUEUE + "SELECT candidate_id, product_a, product_b, CASE WHEN status = 'pending' THEN score / 2 + 0.4 ELSE score END AS score, status FROM queue WHERE status <> 'pending' OR score / 2 + 0.4 >= 0.72")
def _(s, d):
    q = v.candidate_queue(s, d)
    return canonical.prune(q, q.select("product_a", "product_b", (F.col("score") / 2 + F.lit(0.4)).alias("score")))


@_add("candidate_export", _QUEUE + ", shops AS (SELECT product_id, string_agg(DISTINCT retailer, ',' ORDER BY retailer) AS r FROM obs GROUP BY 1) SELECT candidate_id, product_a, product_b, score, status, a.name AS name_a, b.name AS name_b, coalesce(x.r, '') AS retailers_a, coalesce(y.r, '') AS retailers_b, '' AS decision FROM queue JOIN products a ON a.id = product_a JOIN products b ON b.id = product_b LEFT JOIN shops x ON x.product_id = product_a LEFT JOIN shops y ON y.product_id = product_b WHERE status = 'approved'")
def _(s, d):
    return canonical.export_candidates(v.candidate_queue(s, d), v.products(s, d), v.price_obs(s, d), "approved").select("candidate_id", "product_a", "product_b", "score", "status", "name_a", "name_b", "retailers_a", "retailers_b", "decision")


@_add("merge_all_above", _QUEUE + "SELECT product_a + product_b - m AS dup, m AS master FROM (SELECT *, CASE WHEN product_b % 3 = 0 AND product_a % 3 <> 0 THEN product_b ELSE product_a END AS m FROM queue WHERE status = 'pending' AND score >= 0.8)")
def _(s, d):
    return canonical.merge_above(v.candidate_queue(s, d), 0.5, v.products(s, d).where("id % 3 = 0").select("id"))


@_add("canonical_roots", _QUEUE + "SELECT DISTINCT CASE WHEN id % 4 = 0 THEN id ELSE id END AS dup, 4 * (id // 4) AS master FROM products WHERE id % 4 <> 0 AND id > 4")
def _(s, d):
    p = v.products(s, d).where("id > 4 and id % 4 <> 0")  # chains of three: 4k+3 to 4k+2 to 4k+1 to 4k
    return canonical.roots(p.select(F.col("id").alias("dup"), (F.col("id") - 1).alias("master")))


@_add("score_histogram", _QUEUE + ", shops AS (SELECT product_id, list(DISTINCT retailer) AS r FROM obs GROUP BY 1), b AS (SELECT floor(score * 10 + 0.5) / 10 AS bin, coalesce(list_has_any(x.r, y.r), FALSE) AS same FROM queue LEFT JOIN shops x ON x.product_id = product_a LEFT JOIN shops y ON y.product_id = product_b) SELECT bin, count(*) AS n, count(*) FILTER (same) AS n_same, count(*) FILTER (NOT same) AS n_cross FROM b GROUP BY 1")
def _(s, d):
    return quality.score_histogram(v.candidate_queue(s, d), v.price_obs(s, d))


@_add("tier1_links", "SELECT id AS dup, canonical_id AS master FROM products WHERE canonical_id IS NOT NULL")
def _(s, d):
    p = v.products(s, d)
    return canonical.exact_links(p.select("id", F.concat_ws("|", "name", "brand").alias("key"), F.lit(False).alias("preferred")))


@_add("product_key_nb", "SELECT p_partkey AS id, 'nb:' || lower(p_name) || '|' || lower(p_brand) AS product_key FROM part", raw=True)
def _(s, d):
    from ..functions.text import product_key

    return v.products(s, d).select("id", product_key(F.lit(None).cast("string"), F.col("name"), F.col("brand")).alias("product_key"))


@_add("shared_sku", "SELECT product_id AS sku, count(DISTINCT retailer) AS n_retailers FROM obs GROUP BY 1 HAVING count(DISTINCT retailer) > 1")
def _(s, d):
    return ingest.shared_skus(v.price_obs(s, d).withColumnRenamed("product_id", "sku"))


@_add("upsert_product_fold", "SELECT p_name || p_brand AS product_key, max(p_name) AS name, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1", raw=True)
def _(s, d):
    rows = v.price_obs(s, d).join(v.products(s, d).withColumnRenamed("id", "product_id"), "product_id").withColumn("product_key", F.concat("name", "brand"))
    return ingest.fold_products(rows).select("product_key", "name", "first_seen", "last_seen")


@_add("upsert_offer_fold", "SELECT product_id, retailer, min(observed_at) AS first_seen, max(observed_at) AS last_seen FROM obs GROUP BY 1, 2")
def _(s, d):
    return ingest.fold_offers(v.price_obs(s, d), ("product_id", "retailer"))


@_add("purge_history", "SELECT product_id, retailer, observed_at, price FROM obs WHERE retailer <> 'ASIA'")
def _(s, d):
    obs = v.price_obs(s, d).withColumn("offer_id", F.concat_ws("@", F.col("product_id").cast("string"), "retailer"))
    offers = obs.select(F.col("offer_id").alias("id"), "retailer").distinct()
    return ingest.purge(offers, obs, "ASIA")[1].select("product_id", "retailer", "observed_at", "price")


@_add("decision_import", _QUEUE + """, d AS (SELECT doc_id + 1 AS candidate_id, ['merge', ' Approve', 'YES', 'y', '1', 'true', 'reject', 'No', 'n ', '0', 'false', 'notsame', 'not_same', 'skip', '', 'later'][1 + doc_id % 16] AS w FROM labels)
SELECT d.candidate_id, o AS outcome, CASE WHEN o = 'merged' THEN greatest(product_a, product_b) END AS dup, CASE WHEN o = 'merged' THEN least(product_a, product_b) END AS master
FROM (SELECT d.*, product_a, product_b, CASE WHEN lower(trim(w)) NOT IN ('merge', 'approve', 'yes', 'y', '1', 'true', 'reject', 'no', 'n', '0', 'false', 'notsame', 'not_same') THEN 'skipped' WHEN product_a IS NULL THEN 'missing' WHEN lower(trim(w)) IN ('merge', 'approve', 'yes', 'y', '1', 'true') THEN 'merged' ELSE 'rejected' END AS o FROM d LEFT JOIN queue USING (candidate_id)) d""")
def _(s, d):
    words = F.array(*[F.lit(w) for w in ("merge", " Approve", "YES", "y", "1", "true", "reject", "No", "n ", "0", "false", "notsame", "not_same", "skip", "", "later")])
    rows = v.table(s, d, "labels").select((F.col("doc_id") + 1).alias("candidate_id"), F.get(words, (F.col("doc_id") % 16).cast("int")).alias("decision"))
    return canonical.import_decisions(v.candidate_queue(s, d), rows)


@_add("price_mode", ", c AS (SELECT retailer, floor(price * 100 + 0.5) / 100 AS p, count(*) AS n FROM obs GROUP BY 1, 2) SELECT retailer, p AS modal_price, n AS modal_n FROM (SELECT *, row_number() OVER (PARTITION BY retailer ORDER BY n DESC, p) AS r FROM c) WHERE r = 1")
def _(s, d):
    return quality.price_mode(v.price_obs(s, d))


@_add("quality_report", """, q AS (SELECT retailer, name, brand, category, price FROM latest JOIN products ON id = product_id),
m AS (SELECT retailer, max(n) AS modal_n FROM (SELECT retailer, floor(price * 100 + 0.5) / 100 AS p, count(*) AS n FROM q GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT retailer, count(*) AS n, count(price) AS priced, count(*) FILTER (NOT (price > 0 AND price < 1000)) AS odd, count(*) FILTER (starts_with(lower(name), lower(brand))) AS leaks FROM q GROUP BY 1)
SELECT retailer, n, priced, odd, leaks, modal_n, CASE WHEN priced = 0 OR leaks > 0.3 * n THEN 'FAIL' ELSE 'WARN' END AS status FROM c JOIN m USING (retailer) UNION ALL SELECT 'NOWHERE', 0, 0, 0, 0, NULL, 'FAIL' UNION ALL SELECT 'SHUT', 0, 0, 0, 0, NULL, 'BLOCKED'""")
def _(s, d):
    rows = timeseries.latest(v.price_obs(s, d)).join(v.products(s, d).select(F.col("id").alias("product_id"), "name", "brand", "category"), "product_id").withColumn("image_url", F.lit(None).cast("string"))
    sources = v.chains(s, d).select("retailer").unionByName(s.createDataFrame([("NOWHERE",), ("SHUT",)], "retailer string"))
    return quality.gate(rows, sources, ["SHUT"]).select("retailer", "n", "priced", "odd", "leaks", "modal_n", "status")


@_add("size_extract", "SELECT p_partkey AS id, 'vol' AS dim, p_size::DOUBLE AS amount FROM part", raw=True)
def _(s, d):
    size = extract_size(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("ml")))
    return v.table(s, d, "part").select(F.col("p_partkey").alias("id"), size["dim"].alias("dim"), size["amount"].alias("amount"))


@_add("token_blocking_pairs", """, w AS (SELECT id, unnest(string_split(lower(name), ' ')) AS t FROM products WHERE canonical_id IS NULL),
k AS (SELECT id, t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(t) DESC, t) AS r FROM (SELECT DISTINCT id, t FROM w WHERE length(t) >= 3 AND t NOT IN ('the', 'and', 'for', 'with', 'gia', 'apo'))) WHERE r <= 2)
SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.t = y.t AND x.id < y.id""")
def _(s, d):
    return token_blocks(v.products(s, d).where("canonical_id is null").select("id", name_tokens(F.col("name")).alias("tokens")))


@_add("fuzzy_candidates")
def _(s, d):
    return canonical.candidates(v.products(s, d))


@_add("slug_category", r"SELECT page_id, replace(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '-\d+$', ''), '-', ' ') AS slug FROM pages", raw=True)
def _(s, d):
    return v.table(s, d, "pages").select("page_id", extract.slug_name(F.col("url")).alias("slug"))


@_add("page_title_extract", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages", raw=True)
def _(s, d):
    return v.table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@_add("leaf_prefix_anti", "WITH u AS (SELECT DISTINCT regexp_replace(url, '/+$', '') AS url FROM pages) SELECT url FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE starts_with(o.url, u.url || '/'))", raw=True)
def _(s, d):
    return extract.leaf_urls(v.table(s, d, "pages").select(F.regexp_replace("url", r"/+$", "").alias("url")).distinct())


@_add("url_exclusion", "SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '[?&](utm_source|ref)=')", raw=True)
def _(s, d):
    return extract.allowed(v.table(s, d, "pages").select("page_id", "url"), r"[?&](utm_source|ref)=")


@_add("event_latest", "SELECT user_id, event_type, observed_at, value FROM (SELECT user_id, event_type, ts AS observed_at, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) AS r FROM events) WHERE r = 1", raw=True)
def _(s, d):
    return prices.latest_per_offer(v.table(s, d, "events").withColumn("observed_at", F.col("ts")))


@_add("event_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY 1, 2", raw=True)
def _(s, d):
    return prices.windowed(v.table(s, d, "events").withColumn("observed_at", F.col("ts")))


@_add("sync_replay_counts", ", r AS (SELECT product_id, retailer, CASE WHEN product_id % 5 = 0 THEN NULL WHEN product_id % 7 = 0 THEN ' ' ELSE name END AS n, CASE WHEN product_id % 11 <> 0 THEN price END AS price FROM latest JOIN products ON id = product_id) SELECT count(*) FILTER (trim(coalesce(n, '')) <> '' AND price IS NOT NULL) AS ingested, count(*) FILTER (NOT (trim(coalesce(n, '')) <> '' AND price IS NOT NULL)) AS skipped, 0::BIGINT AS errors FROM r")
def _(s, d):
    rows = timeseries.latest(v.price_obs(s, d)).join(v.products(s, d).select(F.col("id").alias("product_id"), F.col("name").alias("product")), "product_id")
    holes = F.when(F.col("product_id") % 5 == 0, None).when(F.col("product_id") % 7 == 0, " ").otherwise(F.col("product"))
    return ingest.replay(rows.select("retailer", holes.alias("product"), F.when(F.col("product_id") % 11 != 0, F.col("price")).alias("price")))[1]


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _FOUND.items() if sql}


from . import extended  # noqa: E402, F401  (adds its queries to these)

__all__ = ["queries", "oracle_sql"]
