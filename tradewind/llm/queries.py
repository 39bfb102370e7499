"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, language_model, line_dedup, mixing, quality, runs, sharding, simhash, tokens, url_filter, warc
from .common import let, new_path, read_table, stage, words

#: The mixture: sources belong to domains; a weight that is not named is 1.
DOMAIN_OF = {"web": [f"src{k}" for k in range(8)], "books": [f"src{k}" for k in range(8, 14)]}
WEIGHTS = {"domain": {"web": 5, "books": 3, "other": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
MIX_SEED, MAX_EPOCHS = 17, 4
SHARDS, SHARD_SEED = 16, 29
END_ID = 2
RULES = (
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
)


def domain() -> Column:
    out = F.when(F.lit(False), "")
    for name, sources in DOMAIN_OF.items():
        out = out.when(F.col("source").isin(sources), name)
    return out.otherwise("other")


def levels() -> dict[str, Column]:
    return {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    drawn = mixing.mix(docs, levels(), WEIGHTS, None, MAX_EPOCHS, MIX_SEED)
    return drawn.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"), F.col("mix_target").alias("leaf_target"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", *[c.alias(k) for k, c in sharding.sizes_and_sums(F.col("text")).items()])
    placed = sharding.stratified_shards(slim, F.col("source"), SHARDS, SHARD_SEED, ties=(F.col("size"), F.col("text_crc32")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    table = tokens.write_files(docs, new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return tokens.read_back(table)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(read_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("spans")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.features(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    made = stage(made, "quality")
    return quality.verdict(made, quality.learn(made)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read_table(spark, sf_dir, "conversations"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def planted(doc_id: Column, text: Column) -> Column:
    """`text` with a periodic end in one of ten documents, told by the checksum of the id; others, and those without an id, as they are.

    From word a on, word i becomes word a + (i - a) % p, where h is the crc32 of the id, g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8) of n words.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        return let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), lambda m: F.array_join(F.transform(w, lambda x, i: F.when(i < m["a"], x).otherwise(F.get(w, (m["a"] + (i - m["a"]) % m["p"]).cast("int")))), " "))

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words(text), repeat)).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = runs.find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), times=4, least=6)
    best = runs.longest_run(F.col("runs"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.n"), F.col("best.period")
    return told.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    if warc.write_archives(pages, path, min_bytes=0).isEmpty():
        return pages.limit(0).select("page_id", F.lit(0).cast("long").alias("payload_bytes"), F.lit("").alias("payload_digest"), F.lit("").alias("record_type"), F.lit(0).cast("long").alias("refers_to"))
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _sha256(groups: bytes) -> str:
    return hashlib.sha256(groups).hexdigest()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    made = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), link="end", groups_as=_sha256)
    return made.documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_mixing, op2_sharding, op3_token_files, op4_language_model, op5_decontaminate, op6_quality, op7_url_filter, op8_chat, op9_line_dedup, op10_simhash, op11_runs, op12_warc, op13_alignment, pipeline)
    return {f.__name__: f for f in named}


__all__ = ["queries"]
