"""Lists, folds, movers and streams where the tables' data leave rules untried."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradewind.operators import canonical, ingest, lists, timeseries
from tradewind.streaming import prices

SF = "/root/testdata/sf0.001"


def at(day: int) -> dt.datetime:
    return dt.datetime(2024, 1, day)


def test_list_events(spark):
    old = spark.createDataFrame([(1, 5, "one", at(1)), (2, None, "two", at(1))], "id long, user_id long, name string, updated_at timestamp")
    items = spark.createDataFrame([(10, 1, 7, "milk", 1, at(1)), (11, 2, 8, "tea", 1, at(1)), (12, 1, 9, "oil", 2, at(1))], "id long, list_id long, product_id long, name string, qty int, added_at timestamp")
    rows = [(at(2), "create", 3, None, 5, "three", None, None), (at(3), "rename", 1, None, None, "uno", None, None), (at(4), "rename", 1, None, None, "eins", None, None), (at(5), "delete", 2, None, None, None, None, None), (at(6), "add", 3, 13, None, None, 9, None), (at(7), "remove", 1, 12, None, None, None, None)]
    events = spark.createDataFrame(rows, "at timestamp, kind string, list_id long, item_id long, user_id long, name string, product_id long, qty int")
    now, left = lists.apply_events(old, items, events)
    assert {(r.id, r.name, r.updated_at) for r in now.collect()} == {(1, "eins", at(7)), (3, "three", at(6))}
    assert {(r.id, r.list_id, r.name, r.qty) for r in left.collect()} == {(10, 1, "milk", 1), (13, 3, "(item)", 1)}
    assert [(r.id, r.n_items) for r in lists.overview(now, left, 5).collect()] == [(1, 1), (3, 1)]
    assert {r.id for r in lists.owned_items(now, left, None).collect()} == set()
    users = spark.createDataFrame([("s", "e", None, at(1))], "subject string, email string, name string, created_at timestamp")
    logins = spark.createDataFrame([("s", None, "N", at(2)), ("t", "x", None, at(3))], "subject string, email string, name string, at timestamp")
    assert {tuple(r) for r in lists.upsert_users(users, logins).collect()} == {("s", "e", "N", at(1)), ("t", "x", None, at(3))}


def test_review_takes_the_dearest_of_a_retailer(spark):
    offers = spark.createDataFrame([(1, "a", 2.0), (1, "a", 5.0), (1, "b", 4.0), (2, "a", None)], "product_id long, retailer string, price double")
    items = spark.createDataFrame([(1, 1, 3.0), (1, 2, 1.0), (1, 3, 0.0)], "list_id long, product_id long, added_price double")
    assert {(r.product_id, r.current_min, r.since_added) for r in lists.review(items, offers).collect()} == {(1, 4.0, 1.0), (2, None, None), (3, None, None)}
    assert [tuple(r) for r in lists.cheapest(offers).collect()] == [(1, "a", 2.0)]


def test_folds(spark):
    rows = spark.createDataFrame([("k", "old", "B", None, at(1)), ("k", "new", None, "c", at(3)), ("k", "mid", "A", "d", at(2))], "product_key string, name string, brand string, category string, observed_at timestamp")
    assert [tuple(r) for r in ingest.fold_products(rows).collect()] == [("k", "new", "A", "c", at(1), at(3))]
    sold = spark.createDataFrame([("k", "r", "s1", None, at(1)), ("k", "r", None, "u", at(2))], "product_key string, retailer string, sku string, url string, observed_at timestamp")
    assert [tuple(r) for r in ingest.fold_offers(sold).collect()] == [("k", "r", "s1", "u", at(1), at(2))]
    history = spark.createDataFrame([(1, 2.0, 1)], "offer_id long, price double, in_stock int")
    more = spark.createDataFrame([(1, 3.0, False)], "offer_id long, price double, in_stock boolean")
    assert {tuple(r) for r in ingest.record_prices(history, more).collect()} == {(1, 2.0, 1), (1, 3.0, 0)}
    a, b = sold.withColumn("price", F.lit(1.0)), sold.limit(1).drop("url")
    assert ingest.merge_sources([a, b]).count() == 2
    one = spark.createDataFrame([(1, "k", "r"), (2, "k", "q")], "id long, product_key string, retailer string")
    two = spark.createDataFrame([(71, "k", "r")], "id long, product_key string, retailer string")
    assert [tuple(r) for r in ingest.copy_with_ids(one, spark.createDataFrame([(1, 5.0), (2, 6.0)], "offer_id long, price double"), two).collect()] == [(71, 5.0)]


def test_changes_with_ties(spark):
    """Observations that share a time: the largest change between any two of them counts; a price of 0 is no baseline."""
    rows = [(1, "a", 1, 10.0), (1, "a", 1, 8.0), (1, "a", 20, 9.0), (1, "a", 20, 12.0), (1, "b", 1, 10.0), (1, "b", 20, 10.0), (2, "a", 1, 0.0), (2, "a", 20, 5.0), (3, "a", 1, 4.0), (3, "a", 20, None), (4, "b", 1, 2.0), (4, "b", 20, 1.0), (4, "a", 1, 4.0), (4, "a", 20, 2.0)]
    obs = spark.createDataFrame([(p, r, at(d), x) for p, r, d, x in rows], "product_id long, retailer string, observed_at timestamp, price double")
    products = spark.createDataFrame([(k, f"p{k}", "b", "c") for k in range(1, 5)], "id long, name string, brand string, category string")
    got = {(r.product_id, r.retailer, r.old, r.new, r.change, r.pct) for r in timeseries.biggest_changes(obs, products, 10, None).collect()}
    assert got == {(1, "a", 8.0, 12.0, 4.0, 50.0), (4, "a", 4.0, 2.0, -2.0, -50.0)}
    up, down = timeseries.movers(timeseries.biggest_changes(obs, products, 10, None), 1)
    assert [r.product_id for r in up.collect()] == [1] and [r.product_id for r in down.collect()] == [4]
    assert timeseries.biggest_changes(obs, products, 10, None, [4]).count() == 1 and timeseries.biggest_changes(obs, products, 10, None, []).count() == 2


@pytest.mark.parametrize("slide", [None, "12 hours"])
def test_stream_equals_batch(spark, slide):
    """Windows and newest values over the events read as a stream are those over the table."""
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("observed_at", F.col("ts").cast("timestamp"))
    stream = prices.event_stream(spark, SF)
    for k, f in enumerate((lambda e: prices.windowed(e, "1 day", slide), prices.latest_per_offer)):
        got = prices.run_available(f(stream), f"t{k}{'s' if slide else ''}")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, f(batch).collect()))
        assert got.count() > 0


def test_stream_drops_repeats(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.limit(50)).repartition(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events.parquet")).withColumn("observed_at", F.col("ts").cast("timestamp"))
    assert prices.run_available(prices.deduplicated(stream, "4000 days"), "once", "append").count() == events.count()


def test_sync_takes_the_last_of_repeated_rows(spark):
    items = spark.createDataFrame([(1, "a", "c", 1), (2, "b", "c", 2)], "id long, name string, category string, qty int")
    kinds = "server_id long, name string, cat string, category string, qty int"
    rows = [(1, "first", None, None, 5), (1, "last", None, None, 6), (None, "new", "x", None, None), (None, "new", "x", None, None)]
    gone = spark.createDataFrame([], "id long")
    got = sorted(tuple(r) for r in lists.sync(items, spark.createDataFrame(rows, kinds).coalesce(1), gone).where("id is not null").collect())
    assert got == [(1, "last", "c", 6), (2, "b", "c", 2)]
    placed = spark.createDataFrame([(*rows[1], 1), (*rows[0], 2)], f"{kinds}, pos int")
    assert [r.name for r in lists.sync(items, placed, gone).where("id = 1").collect()] == ["first"]
    assert lists.sync(items, spark.createDataFrame(rows, kinds), gone).where("id is null").count() == 2


def test_several_answers_are_taken_whole(spark):
    queue = spark.createDataFrame([(1, 10, 20, "pending"), (2, 30, 40, "pending")], "candidate_id long, product_a long, product_b long, status string")
    answers = spark.createDataFrame([(1, True, 10), (1, False, 20), (2, True, 40), (2, True, None)], "candidate_id long, approve boolean, into long")
    now, links = canonical.resolve(queue, answers)
    assert {(r.candidate_id, r.status) for r in now.collect()} == {(1, "rejected"), (2, "approved")}
    assert [tuple(r) for r in links.collect()] == [(30, 40)]


def test_preferred_product_wins_in_any_order(spark):
    queue = spark.createDataFrame([(9, 4, 0.9, "pending"), (4, 9, 0.9, "pending"), (5, 6, 0.9, "pending")], "product_a long, product_b long, score double, status string")
    got = canonical.merge_above(queue, 0.8, spark.createDataFrame([(9,)], "id long"))
    assert sorted(tuple(r) for r in got.collect()) == [(4, 9), (4, 9), (6, 5)]


def test_an_item_added_again_stays(spark):
    from datetime import datetime

    at = lambda h: datetime(2024, 1, 1, h)
    shelf = spark.createDataFrame([(1, 7, "l", at(0))], "id long, user_id long, name string, updated_at timestamp")
    items = spark.createDataFrame([], "id long, list_id long, product_id long, name string, qty int, added_at timestamp")
    kinds = "at timestamp, kind string, list_id long, item_id long, user_id long, name string, product_id long, qty int"
    events = [(at(1), "remove", 1, 5, None, None, None, None), (at(2), "add", 1, 5, None, "x", None, None), (at(2), "add", 1, 6, None, "y", None, None), (at(3), "remove", 1, 6, None, None, None, None)]
    _, now = lists.apply_events(shelf, items, spark.createDataFrame(events, kinds))
    assert [(r.id, r.name) for r in now.collect()] == [(5, "x")]


def test_changes_are_dealt_to_many_tasks(spark):
    """A task's memory is a small part of what one of spark.sql.shuffle.partitions would hold."""
    rows = [(k % 5, "a", dt.datetime(2024, 1, 1 + k % 9), float(k)) for k in range(40)]
    obs = spark.createDataFrame(rows, "product_id long, retailer string, observed_at timestamp, price double")
    assert timeseries.offer_changes(obs, 3).rdd.getNumPartitions() >= 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_stretches(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    rows = [(1, "a", day(1), 2.0), (1, "a", day(2), 2.0), (1, "a", day(3), None), (1, "a", day(4), None), (1, "a", day(5), 2.0), (1, "b", day(5), 2.0)]
    made = timeseries.stretches(spark.createDataFrame(rows, "product_id long, retailer string, observed_at timestamp, price double"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.product_id, r.retailer, r.from_at.day, r.to_at.day, r.price, r.n) for r in made.collect())
    assert got == [(1, "a", 1, 2, 2.0, 2), (1, "a", 3, 4, None, 2), (1, "a", 5, 5, 2.0, 1), (1, "b", 5, 5, 2.0, 1)]
