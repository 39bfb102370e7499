"""Chat formatting: collapse cumulative snapshots, then render.

Logs often hold a conversation again and again as it grows. Every turn gets a rolling
hash of the conversation up to it; a conversation whose last hash is an inner prefix
hash of another one is a snapshot of it and goes, as do repeats of the same
conversation. What is left is rendered to one text each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Turns of one conversation that are hashed in one go; longer ones are cut and carried over.
CHUNK = 4096


def _conv() -> Column:
    return F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("id"))


def _turn() -> Column:
    return F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))


def prefix_hashes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv, chunk, turn, pos, last, h1, h2, x1, x2): pos numbers a conversation's turns from 1,
    h1 and h2 are 2 x 64 bits over its first pos turns.

    A prefix hash is the exclusive or of the hashes of (position, role, text), so that the
    hashes of chunks can be combined: a conversation of any length is spread over tasks.
    """
    local = Window.partitionBy("conv", "chunk").orderBy("turn", "x1", "x2")
    sizes = turns.groupBy("conv", "chunk").agg(F.count("*").alias("rows"))
    run = Window.partitionBy("conv").orderBy("chunk")
    starts = sizes.withColumn("base", F.sum("rows").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).withColumn("last", F.sum("rows").over(Window.partitionBy("conv")))
    placed = turns.withColumn("pos", F.row_number().over(local)).join(starts.drop("rows"), ["conv", "chunk"]).withColumn("pos", F.col("pos") + F.col("base")).drop("base")
    placed = placed.withColumn("y1", F.xxhash64("pos", "x1", "x2")).withColumn("y2", F.xxhash64("x2", "pos", "x1", F.lit(1)))
    parts = placed.groupBy("conv", "chunk").agg(F.expr("bit_xor(y1)").alias("p1"), F.expr("bit_xor(y2)").alias("p2"))
    carry = run.rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("conv", "chunk", F.coalesce(F.expr("bit_xor(p1)").over(carry), F.lit(0)).alias("c1"), F.coalesce(F.expr("bit_xor(p2)").over(carry), F.lit(0)).alias("c2"))
    upto = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.withColumn("h1", F.expr("bit_xor(y1)").over(upto)).withColumn("h2", F.expr("bit_xor(y2)").over(upto)).join(before, ["conv", "chunk"])
    return rolled.withColumn("h1", F.col("h1").bitwiseXOR(F.col("c1"))).withColumn("h2", F.col("h2").bitwiseXOR(F.col("c2"))).drop("y1", "y2", "c1", "c2")


def collapse(conversations: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(kept, turns): kept (conv, n_turns, n_copies) has the maximal conversations, turns their positions.

    Turns are ordered by turn, ties by content; a row repeated exactly within its
    conversation counts once; a null role or text counts as empty; rows without conv_id
    belong to one conversation, null, which comes after all others; a null turn comes before
    all others. conv is a struct (none, id). Of equal conversations the least id stays, and
    n_copies says how many there were.
    """
    rows = conversations.select(
        _conv().alias("conv"), _turn().alias("turn"),
        F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("x1"),
        F.xxhash64(F.lit(7), F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))).alias("x2"),
    ).distinct().withColumn("chunk", F.floor(F.col("turn") / chunk))
    hashed = stage(prefix_hashes(rows, chunk), "chat-hashes")
    ends = hashed.where("pos = last").groupBy("pos", "h1", "h2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    inner = hashed.where("pos < last").select("pos", "h1", "h2").distinct()
    kept = ends.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv", F.col("pos").alias("n_turns"), "n_copies")
    return kept, hashed


def render(conversations: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) for each maximal conversation.

    A turn becomes begin, role, line feed, text, end, line feed. An empty table gives an
    empty table; other columns than conv_id, turn, role and text are not looked at.
    """
    kept, hashed = collapse(conversations, chunk)
    kept = stage(kept, "chat-kept")
    said = conversations.select(
        _conv().alias("conv"), _turn().alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    said = said.withColumn("x1", F.xxhash64("role", "text")).withColumn("x2", F.xxhash64(F.lit(7), "text", "role")).join(kept, "conv", "left_semi").dropDuplicates(["conv", "turn", "x1", "x2"])
    line = F.concat(F.lit(begin), "role", F.lit("\n"), "text", F.lit(end + "\n"))
    texts = said.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "x1", "x2", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return kept.join(texts.select("conv", text.alias("rendered")), "conv").select(F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"), "n_turns", "n_copies", "rendered")
