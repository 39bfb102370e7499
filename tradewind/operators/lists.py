"""Shopping lists: overview, review, plan and revaluation, each one left join instead of a query per item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cents
from .timeseries import history_map


def overview(lists: DataFrame, items: DataFrame, user_id: int | None) -> DataFrame:
    """Lists of one owner (null: lists without owner) and their item counts, newest first, without a time last."""
    mine = lists.where(F.col("user_id").eqNullSafe(F.lit(user_id).cast("long")))
    counts = items.groupBy("list_id").agg(F.count("*").alias("n"))
    out = mine.join(counts, mine.id == counts.list_id, "left").select(*lists.columns, F.coalesce("n", F.lit(0)).alias("n_items"))
    return out.orderBy(F.desc_nulls_last("updated_at"), "id")


def owned_items(lists: DataFrame, items: DataFrame, user_id: int | None) -> DataFrame:
    """Items on lists of one owner (null: on lists without owner)."""
    mine = lists.where(F.col("user_id").eqNullSafe(F.lit(user_id).cast("long"))).select(F.col("id").alias("list_id"))
    return items.join(mine, "list_id", "left_semi")


def item_history(items: DataFrame, obs: DataFrame) -> DataFrame:
    """The price history map of each item's product: `items` (product_id, ...) with history, null if nothing was observed."""
    wanted = items.select("product_id").distinct()
    return items.join(history_map(obs.join(wanted, "product_id", "left_semi")), "product_id", "left")


def upsert_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """`users` (subject, email, name, created_at) after `logins` (subject, email, name, at): the newest known email and name, the first time."""
    old = users.select("subject", "email", "name", F.col("created_at").alias("at"))
    known = lambda c: F.expr(f"max_by({c}, struct(at, {c})) filter (where {c} is not null)").alias(c)
    return old.unionByName(logins.select("subject", "email", "name", "at")).groupBy("subject").agg(known("email"), known("name"), F.min("at").alias("created_at"))


def apply_events(lists: DataFrame, items: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, items) after `events` (at, kind, list_id, item_id, user_id, name, product_id, qty).

    Kinds: create, rename and delete a list; add and remove an item. Of a list's names the
    newest counts, a deleted list goes with its items, and an item that is removed after it
    was added goes. Lists have (id, user_id, name, updated_at), items (id, list_id, product_id, name, qty, added_at).
    """
    made = events.where("kind = 'create'").select(F.col("list_id").alias("id"), "user_id", "name", F.col("at").alias("updated_at"))
    named = events.where("kind = 'rename'").groupBy(F.col("list_id").alias("id")).agg(F.max_by("name", "at").alias("_name"))
    touched = events.groupBy(F.col("list_id").alias("id")).agg(F.max("at").alias("_at"))
    dead = events.where("kind = 'delete'").select(F.col("list_id").alias("id")).distinct()
    all_ = lists.select("id", "user_id", "name", "updated_at").unionByName(made).join(dead, "id", "left_anti").join(named, "id", "left").join(touched, "id", "left")
    now = all_.select("id", "user_id", F.coalesce("_name", "name").alias("name"), F.greatest("updated_at", "_at").alias("updated_at"))
    added = events.where("kind = 'add'").select(F.col("item_id").alias("id"), "list_id", "product_id", F.coalesce("name", F.lit("(item)")).alias("name"), F.coalesce("qty", F.lit(1)).alias("qty"), F.col("at").alias("added_at"))
    gone = events.where("kind = 'remove'").groupBy(F.col("item_id").alias("id")).agg(F.max("at").alias("_gone"))
    every = items.select("id", "list_id", "product_id", "name", "qty", "added_at").unionByName(added).join(gone, "id", "left")
    kept = every.where("_gone is null or added_at > _gone").drop("_gone").join(now.select(F.col("id").alias("list_id")), "list_id", "left_semi")
    return now, kept.select("id", "list_id", "product_id", "name", "qty", "added_at")


def review(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Items with the least current price, where a retailer with several offers counts by its dearest, and the change since added.

    An added price of 0 or null has no change.
    """
    chain = offers.where("price is not null").groupBy("product_id", "retailer").agg(F.max("price").alias("price"))
    best = chain.groupBy("product_id").agg(F.min("price").alias("current_min"))
    return items.join(best, "product_id", "left").withColumn("since_added", cents(F.col("current_min") - F.nullif(F.col("added_price"), F.lit(0.0))))


def cheapest(offers: DataFrame) -> DataFrame:
    """(product_id, best_retailer, best_price): the least price, ties to the least retailer."""
    # by product and price, then by product: both hash aggregations, after one shuffle by product
    at_price = offers.where("price is not null").repartition("product_id").groupBy("product_id", "price").agg(F.min("retailer").alias("retailer"))
    return at_price.groupBy("product_id").agg(F.min_by("retailer", "price").alias("best_retailer"), F.min("price").alias("best_price"))


def plan(items: DataFrame, offers: DataFrame) -> DataFrame:
    return items.join(cheapest(offers), "product_id", "left").withColumn("planned_retailer", F.col("best_retailer")).withColumn("planned_price", cents(F.col("best_price"))).drop("best_retailer", "best_price")


def revalue(planned: DataFrame, offers: DataFrame) -> DataFrame:
    """Planned items with the current cheapest offer, price_delta and store_changed."""
    now = planned.join(cheapest(offers), "product_id", "left")
    changed = (F.coalesce("planned_retailer", F.lit("")) != "") & F.col("best_retailer").isNotNull() & (F.col("best_retailer") != F.col("planned_retailer"))
    return now.withColumn("price_delta", F.col("best_price") - F.col("planned_price")).withColumn("store_changed", F.coalesce(changed, F.lit(False)))


def totals(revalued: DataFrame) -> DataFrame:
    """Per list the planned and current totals over items that have both prices (0 counts as none), and store changes.

    Money is summed in whole ten-thousandths, so that totals do not depend on the order of the rows.
    """
    q = F.coalesce(F.nullif(F.col("qty"), F.lit(0)), F.lit(1))
    both = F.col("planned_price").isNotNull() & F.col("best_price").isNotNull()
    money = lambda c: F.nullif(F.sum(F.when(both, F.floor(F.col(c) * q * 10000 + 0.5))), F.lit(0).cast("long"))
    sums = revalued.groupBy("list_id").agg(money("planned_price").alias("p"), money("best_price").alias("c"), F.count_if("store_changed").alias("n_store_changed"))
    return sums.select("list_id", (F.col("p") / 10000).alias("planned_total"), (F.col("c") / 10000).alias("current_total"), "n_store_changed", ((F.col("c") - F.col("p")) / 10000).alias("delta"))


def sync(items: DataFrame, payload: DataFrame, deleted: DataFrame) -> DataFrame:
    """`items` (id, name, category, qty) after a client's sync: deletes, updates of known server_id, inserts of the rest.

    Inserts have a null id; a missing name is '(item)', a missing quantity 1. Of rows with one
    server_id the last counts: by their column `pos` if there is one, else in the order of the frame.
    """
    told = F.struct(F.coalesce("name", F.lit("(item)")).alias("n"), F.coalesce("cat", "category").alias("c"), F.coalesce("qty", F.lit(1)).alias("q"))
    order = F.col("pos") if "pos" in payload.columns else F.monotonically_increasing_id()
    rows = payload.select("server_id", told.alias("t"), order.alias("pos"))
    last = rows.where("server_id is not null").groupBy("server_id").agg(F.max_by("t", "pos").alias("t"))
    want = last.unionByName(rows.where("server_id is null").select("server_id", "t")).select("server_id", "t.*")
    left = items.join(deleted.select("id"), "id", "left_anti")
    kept = left.join(want, left.id == want.server_id, "left").select("id", F.coalesce("n", "name").alias("name"), F.coalesce("c", "category").alias("category"), F.coalesce("q", "qty").alias("qty"))
    new = want.join(left, want.server_id == left.id, "left_anti").select(F.lit(None).cast("long").alias("id"), F.col("n").alias("name"), F.col("c").alias("category"), F.col("q").alias("qty"))
    return kept.unionByName(new)
