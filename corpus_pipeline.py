"""From raw documents to training shards: five stages, each a call of one corpus operator.

Every stage reads what the one before has written, so a lost executor costs one stage's
tasks and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import decontaminate, mixing, quality, sharding, simhash
from tradewind.llm.common import read_table, stage
from tradewind.llm.queries import SHARD_SEED, SHARDS, WEIGHTS, levels

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: sets of runs of five words with a Jaccard similarity of 0.8. Such are 39 of 256
#: bits apart on average, with a deviation of 6; candidates share one of 16 least shingle hashes, or two if these are common.
NEAR = {"width": 5, "lanes": 4, "radius": 56, "keys": 16, "similarity": 0.8}

#: With no document repeated, a budget of all tokens would leave weights no say.
MIX_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the weakly supervised rules call good.

    Null and empty texts have no words and go; repeated rows are judged alike; an empty table
    stays empty. Features are made once, beside the rows.
    """
    made = stage(quality.features(docs), "quality")
    return quality.verdict(made, quality.learn(made)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the row with the least id, null ids last, and of equal ids the first in place.

    Rows are told apart by their place in the files, so repeated and null ids lose nothing.
    Texts without words, or null, are one group.
    """
    placed = simhash.with_place(docs)
    gone = simhash.near_copies(placed, **NEAR).where("not first").select("file", "row")
    return placed.join(gone, ["file", "row"], "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs; each row for itself, whatever its id. An empty benchmark drops none."""
    placed = simhash.with_place(docs).withColumn("place", F.xxhash64("file", "row"))
    found = decontaminate.find_leaks(placed, read_table(spark, sf_dir, "benchmark"), id_col="place")
    gone = found.where("contaminated").select("place").distinct()
    return placed.join(gone, "place", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws each source to its share of a budget of MIX_PERCENT of the tokens, no document more than once.

    A null language or source is a node of its own; rows that share an id come or stay together.
    """
    return mixing.mix(docs, levels(), WEIGHTS, None, max_epochs=1, percent=MIX_PERCENT).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the mixture into shards that all match it; adds shard, slot, size and text_crc32 (a null text is empty). A null source is one of its own."""
    sized = docs.withColumns(sharding.sizes_and_sums(F.col("text")))
    placed = sharding.stratified_shards(sized, F.col("source"), SHARDS, SHARD_SEED, ties=(F.col("size"), F.col("text_crc32")))
    return placed.select(*COLUMNS, "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: The label model's floating-point fit and the fingerprints' hashes cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`."""
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
