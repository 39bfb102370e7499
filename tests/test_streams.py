"""Streams against batch: alerts with keyed state, sessions with late rows, and folds that may be replayed."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tradewind.operators import ingest
from tradewind.streaming import alerts, folds, prices

SCHEMA = "shop string, seq long, observed_at timestamp, price double"
T0 = datetime(2024, 1, 1)


def put(spark, path, k, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{k:03d}")


def stream(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def run(frame, path):
    return prices.run_to_table(frame, f"{path}/out", f"{path}/check", {**alerts.SETTINGS, "spark.sql.shuffle.partitions": "2"})


def test_alerts_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Rows come up to a day late, in any order, with repeats; each batch is judged when the watermark has passed it."""
    rng = random.Random(2)
    rows = [(rng.choice("abcd"), k, T0 + timedelta(hours=rng.randint(0, 400), milliseconds=rng.randint(0, 999)), rng.choice([None, 0.0, 1.0, 1.04, 1.1, 2.0])) for k in range(300)]
    rows += rng.sample(rows, 20)
    rows.sort(key=lambda r: r[2] + timedelta(hours=rng.uniform(0, 20)))
    for k in range(0, len(rows), 80):
        put(spark, tmp_path, k, rows[k : k + 80])
    put(spark, tmp_path, 900, [("z", 999, T0 + timedelta(days=60), 1.0)])
    got = run(alerts.alert_stream(stream(spark, tmp_path), ["shop"], 5.0, 3), tmp_path)
    want = alerts.alerts(spark.createDataFrame(rows, SCHEMA), ["shop"], 5.0, 3)
    assert want.count() > 50
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_state_of_alerts_expires(spark, tmp_path):
    """An offer not seen for the time of forgetting gives no alert when it comes back, and its state is gone by then."""
    put(spark, tmp_path, 0, [("a", 1, T0, 1.0), ("b", 2, T0, 1.0)])
    put(spark, tmp_path, 1, [("b", 3, T0 + timedelta(days=2), 2.0)])
    frame = alerts.alert_stream(stream(spark, tmp_path), ["shop"], 5.0, 3)
    run(frame, tmp_path)
    assert alerts.remembered(spark, f"{tmp_path}/check") == 2
    put(spark, tmp_path, 2, [("c", 4, T0 + timedelta(days=30), 1.0)])
    run(frame, tmp_path)
    assert alerts.remembered(spark, f"{tmp_path}/check") == 0
    put(spark, tmp_path, 3, [("a", 5, T0 + timedelta(days=31), 9.0), ("a", 6, T0 + timedelta(days=32), 1.0), ("c", 7, T0 + timedelta(days=50), 1.0)])
    assert [tuple(r)[:2] for r in run(frame, tmp_path).orderBy("seq").collect()] == [("b", 3), ("a", 6)]


EVENTS = "user_id long, observed_at timestamp, value double"


def test_sessions_of_a_stream_merge_and_drop_late_rows(spark, tmp_path):
    """A late row within the watermark joins two sessions; one behind it is dropped; the rest is as in batch."""
    minute = lambda m: T0 + timedelta(minutes=m)
    put(spark, tmp_path, 0, [(1, minute(0), 1.0), (1, minute(50), 2.0), (2, minute(55), 5.0)], EVENTS)
    put(spark, tmp_path, 1, [(1, minute(25), 9.0), (2, minute(100), 1.0)], EVENTS)
    put(spark, tmp_path, 2, [(1, minute(20), 99.0), (2, minute(300), 7.0)], EVENTS)
    put(spark, tmp_path, 3, [(1, minute(10), 99.0), (3, minute(1000), 0.0)], EVENTS)
    frame = prices.sessions(stream(spark, tmp_path, EVENTS).withWatermark("observed_at", "1 hour"), gap="30 minutes")
    got = [tuple(r) for r in run(frame, tmp_path).orderBy("user_id", "start").collect()]
    # minute 20 comes when the watermark is at 40, but its session reaches to 50; minute 10 comes when it is at 240
    kept = [(1, minute(0), 1.0), (1, minute(50), 2.0), (2, minute(55), 5.0), (1, minute(25), 9.0), (2, minute(100), 1.0), (1, minute(20), 99.0), (2, minute(300), 7.0)]
    batch = [tuple(r) for r in prices.sessions(spark.createDataFrame(kept, EVENTS), gap="30 minutes").orderBy("user_id", "start").collect()]
    assert got == batch and got[0] == (1, minute(0), minute(80), 4, 99.0)


ROWS = "name string, brand string, category string, image_url string, retailer string, sku string, url string, shared_key string, observed_at timestamp, price double, list_price double, in_stock boolean"


def harvest(rng, n):
    pick = lambda *xs: rng.choice(xs)
    return [(f"Item {rng.randint(1, 12)}", pick("Acme", None), pick(None, "a", "b"), pick(None, "i1", "i2"), pick("x", "y"), pick(None, "s1", "s2"), pick(None, "u"), pick(None, None, "k"), T0 + timedelta(minutes=rng.randint(0, 500)), pick(1.0, 2.5, None), None, pick(True, False, None)) for _ in range(n)]


def tables(store):
    products, offers, history = store.products(), store.offers(), store.history()
    return [sorted(map(str, f.collect())) for f in (products, offers, history.drop("batch"))]


def test_stream_folds_as_a_batch_does(spark, tmp_path):
    """Products, offers and prices after a stream of harvests are the folds over all rows, before and after compaction."""
    rng = random.Random(6)
    batches = [harvest(rng, 40) for _ in range(4)]
    for k, rows in enumerate(batches):
        put(spark, tmp_path, k, rows, ROWS)
    store = folds.FoldedStore(spark, f"{tmp_path}/store")
    store.run(stream(spark, tmp_path, ROWS), f"{tmp_path}/check")
    every = folds.keyed(spark.createDataFrame([r for b in batches for r in b], ROWS))
    assert sorted(map(str, store.products().collect())) == sorted(map(str, ingest.fold_products(every).select(*store.products().columns).collect()))
    assert sorted(map(str, store.offers().collect())) == sorted(map(str, ingest.fold_offers(every).select(*store.offers().columns).collect()))
    assert store.history().count() == 160 and {r.in_stock for r in store.history().select("in_stock").distinct().collect()} == {0, 1, None}
    before = tables(store)
    store.compact()
    assert store.pending() == [] and tables(store) == before


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """A batch that comes again, after a crash or after compaction, replaces itself or is known."""
    rng = random.Random(8)
    first, second, third = (spark.createDataFrame(harvest(rng, 25), ROWS) for _ in range(3))
    store = folds.FoldedStore(spark, f"{tmp_path}/store")
    store.apply(first, 0)
    store.apply(second, 1)
    before = tables(store)
    store.apply(second, 1)
    store.apply(first, 0)
    assert tables(store) == before
    store.compact()
    store.apply(first, 0)
    store.apply(second, 1)
    assert tables(store) == before and store.pending() == []
    store.apply(third, 2)
    assert store.pending() == [2] and tables(store) != before
    again = folds.FoldedStore(spark, f"{tmp_path}/store")
    assert tables(again) == tables(store)


def test_a_store_without_batches_is_empty(spark, tmp_path):
    store = folds.FoldedStore(spark, f"{tmp_path}/none")
    assert [f.count() for f in (store.products(), store.offers(), store.history())] == [0, 0, 0]
    store.compact()
    assert store.products().count() == 0


def test_a_batch_is_folded_once_for_products_and_offers(spark, tmp_path):
    """The rows of a batch are read for their folds and for their prices, and no third time."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    rows = spark.createDataFrame(
        [(f"n{k % 3}", "b", "c", None, f"r{k % 2}", f"s{k}", None, f"k{k % 3}", f"2024-01-0{1 + k % 7}", 1.0 + k, None, True) for k in range(20)],
        "name string, brand string, category string, image_url string, retailer string, sku string, url string, shared_key string, observed_at string, price double, list_price double, in_stock boolean",
    ).withColumns({"observed_at": F.col("observed_at").cast("timestamp"), "shared_key": seen("shared_key")})
    store = folds.FoldedStore(spark, f"{tmp_path}/store")
    store.apply(rows, 0)
    assert read.value == 2 * 20
    assert (store.products().count(), store.offers().count(), store.history().count()) == (3, 6, 20)
