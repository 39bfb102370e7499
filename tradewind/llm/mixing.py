"""Mixing sources to target weights by hierarchical budgeting (native).

A tree of domains, languages and sources carries integer weights. The token budget
goes down level by level. Among siblings it is shared by weight, no child gets more
than it can give (its tokens times the epochs allowed), and what a child cannot give
goes to its siblings first: only when all children of a node are used up does that
node's own capacity bind, and the shortage moves to the siblings of the ancestor.
Shares are integers that add up to the budget exactly.

Each leaf then reads its rows in seeded epochs: whole passes, then the prefix of one
more pass whose tokens fill the target. A row belongs to the prefix if it starts before
the target, so the last row is whole and a leaf may overshoot by less than one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, bucket_bits, n_words, seeded_hash, stage

_WIDE = "decimal(18,0)"


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1)).cast("long")


def _share(part: Column, whole: Column, amount: Column) -> Column:
    """floor(part * amount / whole), exact."""
    return F.call_function("div", part.cast(_WIDE) * amount.cast(_WIDE), whole.cast(_WIDE))


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: int | None, max_epochs: int, percent: int = 100) -> DataFrame:
    """(levels..., avail, target) for leaves (levels..., avail): the token target of each leaf.

    `leaves` has a row per leaf; siblings, not rows of documents, meet in one window.
    `budget` None asks for `percent` of the tokens there are. A budget over the capacity of the
    whole tree is cut to it.
    """
    caps = leaves.withColumn("cap", F.col("avail") * F.lit(max_epochs))
    top = caps.agg(F.sum("cap").alias("cap"), F.sum("avail").alias("avail")).select(F.least(F.col("cap"), F.call_function("div", F.col("avail") * percent, F.lit(100)) if budget is None else F.lit(budget)).alias("given"))
    given, keys = top, []
    for level in levels:
        path = [*keys, level]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap"))
        nodes = (nodes.join(given, keys) if keys else nodes.crossJoin(F.broadcast(given))).withColumn("w", _weight(level, weights.get(level, {})))
        siblings = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        order = siblings.orderBy(F.col("cap") / F.col("w"), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        zero = F.lit(0).cast("long")
        nodes = (
            nodes.withColumn("w_all", F.sum("w").over(siblings))
            .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), zero))
            .withColumn("w_before", F.coalesce(F.sum("w").over(before), zero))
            .withColumn("full", (F.col("given") - F.col("cap_before")).cast(_WIDE) * F.col("w").cast(_WIDE) >= F.col("cap").cast(_WIDE) * (F.col("w_all") - F.col("w_before")).cast(_WIDE))
            .withColumn("left", F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), zero))
            .withColumn("w_open", F.col("w_all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(siblings), zero))
            .withColumn("w_upto", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(upto), zero))
        )
        mine = _share(F.col("w_upto"), F.col("w_open"), F.col("left")) - _share(F.col("w_upto") - F.col("w"), F.col("w_open"), F.col("left"))
        given, keys = nodes.select(*path, F.when(F.col("full"), F.col("cap")).otherwise(mine).cast("long").alias("given")), path
    return leaves.join(given, list(levels)).withColumnRenamed("given", "target")


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], budget: int | None = None, max_epochs: int = 4, seed: int = 17, percent: int = 100, id_col: str = "doc_id", text_col: str = "text", prefix: str = "mix_") -> DataFrame:
    """`docs` as drawn: each row once per epoch it is read in, plus mix_<level>, mix_tokens, mix_epoch, mix_target.

    `levels` names the tree from root to leaf by column expressions; a null there is a
    node of its own, "(none)". Tokens are blank-separated words; a null or empty text has
    none, and a leaf without tokens gives nothing. Rows that share an id share a place in
    every epoch and come or stay together. An empty table gives an empty table. Columns of
    `docs` are passed on, and none may begin with `prefix`.

    Rows never meet per leaf: an epoch's order is cut into hash buckets, token sums per
    bucket find the one bucket where a leaf's prefix ends, and only that bucket is sorted.
    The rows themselves are then kept by comparing their hash with the leaf's last one, a
    join with a table of leaves, so texts are not shuffled.
    """
    if clash := [c for c in docs.columns if c.startswith(prefix)]:
        raise ValueError(f"columns begin with {prefix}: {clash}")
    names = [prefix + x for x in levels]
    node = {prefix + k: F.coalesce(c.cast("string"), F.lit("(none)")) for k, c in levels.items()}
    tagged = docs.withColumns(node)
    slim = stage(tagged.select(F.col(id_col).cast("string").alias("id"), *names, n_words(F.col(text_col)).alias("n")), "mix-rows")
    leaves = stage(slim.groupBy(*names).agg(F.sum("n").alias("avail")), "mix-leaves")
    plan = budgets(leaves, names, {prefix + k: v for k, v in weights.items()}, budget, max_epochs, percent)
    whole = F.when(F.col("avail") > 0, F.call_function("div", F.col("target"), F.col("avail"))).otherwise(F.lit(0)).cast("long")
    plan = stage(plan.withColumn("whole", whole).withColumn("rest", F.when(F.col("avail") > 0, F.col("target") - F.col("whole") * F.col("avail")).otherwise(F.lit(0)).cast("long")), "mix-plan")

    bits = bucket_bits(slim.count())
    h = seeded_hash(F.lit(str(seed)), F.col("whole").cast("string"), F.col("id"))
    open_rows = slim.join(plan.where("rest > 0").select(*names, "whole", "rest"), names).select(*names, "rest", "n", h.alias("h")).withColumn("b", bucket(F.col("h"), bits))
    sums = open_rows.groupBy(*names, "b").agg(F.sum("n").alias("s"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*names).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    edge = sums.withColumn("end", F.sum("s").over(run)).withColumn("start", F.col("end") - F.col("s")).where("start < rest and end >= rest").select(*names, "b", "start")
    inside = open_rows.join(edge, [*names, "b"]).groupBy(*names, "h").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("start").alias("start"))
    walk = Window.partitionBy(*names).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("at", F.col("start") + F.sum("n").over(walk) - F.col("n")).where("at < rest").groupBy(*names).agg(F.max("h").alias("last"))
    chosen = stage(plan.join(last, names, "left").select(*names, F.col("target").alias(prefix + "target"), F.col("whole").alias(prefix + "whole"), F.coalesce("last", F.lit(-1)).alias(prefix + "last")), "mix-leaf-plan")

    mine = seeded_hash(F.lit(str(seed)), F.col(prefix + "whole").cast("string"), F.col(id_col).cast("string"))
    times = F.col(prefix + "whole") + F.when(mine <= F.col(prefix + "last"), 1).otherwise(0)
    drawn = tagged.join(chosen, names).withColumn(prefix + "times", times).where(F.col(prefix + "times") > 0)
    return drawn.withColumn(prefix + "tokens", n_words(F.col(text_col))).withColumn(prefix + "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col(prefix + "times") - 1))).drop(prefix + "times", prefix + "whole", prefix + "last")
