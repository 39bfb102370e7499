"""Sharding by proportional stratified interleaving (native).

Rows are shuffled by a seeded hash and ranked within their source; row r of n has the
fractional rank (2r + 1) / 2n. In the order of fractional ranks any stretch holds every
source in proportion, so cutting that order into equal runs of rows gives shards that
all match the mixture, with counts at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, bucket_bits, seeded_hash


def _starts(sums: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Adds `out`, the sum of `value` over the rows before this one in `order` per `keys`."""
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return sums.withColumn(out, F.sum(value).over(window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))


def stratified_shards(docs: DataFrame, stratum: Column, shards: int, seed: int = 29, id_col: str = "doc_id", ties: tuple[Column, ...] = (), prefix: str = "_sh_") -> DataFrame:
    """`docs` with shard int and slot long (gapless from 0 in each shard, in interleaved order).

    A null stratum is a stratum of its own. Rows that share an id share a hash and follow
    one another, ordered by `ties`; rows that are equal there too are interchangeable. An
    empty table gives an empty table. Columns shard and slot of `docs` are replaced, and
    none may begin with `prefix`.

    Neither a source nor the whole table meets in one task: ranks are running sums over
    hash buckets of about 512 rows, and only rows of one bucket are sorted together, first
    by hash within the source, then by fractional rank. The counts of the second set of
    buckets follow from the sizes of the sources: bucket c of a source of n rows holds the
    ranks r with c <= (2r + 1) * cells / 2n < c + 1.
    """
    s, b, h, r, n, q = (prefix + x for x in "sbhrnq")
    div = lambda x, y: F.call_function("div", x, y)
    if clash := [c for c in docs.columns if c.startswith(prefix)]:
        raise ValueError(f"columns begin with {prefix}: {clash}")
    tagged = docs.drop("shard", "slot").withColumn(s, F.coalesce(stratum.cast("string"), F.lit("(none)"))).withColumn(h, seeded_hash(F.lit(str(seed)), F.col(id_col).cast("string")))
    total = docs.select(F.lit(1).alias("one")).count()
    bits = bucket_bits(total)
    cells = 1 << bits
    tagged = tagged.withColumn(b, bucket(F.col(h), bits))

    counts = tagged.groupBy(s, b).agg(F.count("*").alias(n))
    sizes = counts.groupBy(s).agg(F.sum(n).alias(n))
    starts = _starts(counts, [s], b, n, q).select(s, b, q).join(sizes, s)
    order = [F.col(id_col), *ties]
    local = F.row_number().over(Window.partitionBy(s, b).orderBy(F.col(h), *order))
    ranked = tagged.withColumn(r, local).join(starts, [s, b]).withColumn(r, F.col(r) - 1 + F.col(q))
    ranked = ranked.withColumn(b, div((2 * F.col(r) + 1) * cells, 2 * F.col(n))).withColumn(q, (2 * F.col(r) + 1) / (2 * F.col(n))).drop(h, r, n)

    # ranks below (2 n c / cells - 1) / 2 lie in buckets before c
    below = lambda c: F.greatest(F.lit(0).cast("long"), div(2 * F.col(n) * c + cells - 1, F.lit(2 * cells)))
    every = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
    grid = sizes.where(F.col(n) >= cells).withColumn(b, every(F.lit(cells - 1).cast("long"))).select(b, (below(F.col(b) + 1) - below(F.col(b))).alias(n))
    few = sizes.where(F.col(n) < cells).withColumn(r, every(F.col(n) - 1)).select(div((2 * F.col(r) + 1) * cells, 2 * F.col(n)).alias(b), F.lit(1).cast("long").alias(n))  # a source's rows, where it has fewer than cells
    held = grid.unionByName(few).groupBy(b).agg(F.sum(n).alias(n))
    cell_starts = _starts(held, [], b, n, h).select(b, h)
    place = F.row_number().over(Window.partitionBy(b).orderBy(F.col(q), F.col(s), *order))
    placed = ranked.withColumn(r, place).join(cell_starts, b).withColumn(r, F.col(r) - 1 + F.col(h))
    shard = div(F.col(r) * shards, F.lit(max(1, total))).cast("int")
    first = div(F.col("shard").cast("long") * total + (shards - 1), F.lit(shards))
    return placed.withColumn("shard", shard).withColumn("slot", F.col(r) - first).drop(s, b, h, r, q)


def sizes_and_sums(text: Column) -> dict[str, Column]:
    """size: UTF-8 bytes and one for the row's end; text_crc32: of the bytes. Null counts as empty."""
    return {"size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary"))}
