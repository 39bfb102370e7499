"""Name similarity: the explainable score, and the joins that find its candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .quantity import core_tokens_in, plain_name, signature_in, signatures_conflict
from .text import DIFFERENCE_NOISE, STOP_WORDS, norm_brand

PREFILTER, SUGGEST, AUTO_BLOCK = 0.45, 0.72, 0.92


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


@F.pandas_udf(DoubleType())
def token_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """2 * LCS / (sum of lengths) of two strings; two empty ones are alike."""
    for a, b in batches:
        yield pd.Series([1.0 if not x and not y else 2 * lcs_length(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype=float)


#: What each telling word on one side only takes from the score, and the most that all of them do.
PENALTY = (0.13, 0.25)


def telling(tokens: Column) -> Column:
    """Those of `tokens` that tell variants apart."""
    return F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS, *DIFFERENCE_NOISE) & ~t.rlike(r"^[0-9.,]+$") & (F.length(t) > 1))


def variant_difference(a: Column, b: Column) -> Column:
    """Tokens on one side only that tell variants apart."""
    return telling(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def profile(products: DataFrame) -> DataFrame:
    """`products` (name, brand, ...) with tokens, core, folded_brand and sig, computed once before pairing."""
    plain = products.withColumns({"_plain": plain_name(F.col("name")), "folded_brand": norm_brand(F.col("brand"))})
    made = plain.withColumns({"tokens": core_tokens_in(F.col("_plain"), F.col("folded_brand")), "sig": signature_in(F.col("_plain"))}).withColumn("core", F.array_join("tokens", " "))
    return made.select(*products.columns, "tokens", "folded_brand", "sig", "core")


def score_pairs(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """`pairs` with columns a and b (structs of :func:`profile`) and their fuzzy score of at least `least`.

    Gates and Jaccard are native and bound the score from above, so the common-subsequence
    kernel runs only for pairs that can still reach `least`.
    """
    a, b = F.col("a"), F.col("b")
    penalty = F.when(a["sig"]["size"].isNull() != b["sig"]["size"].isNull(), 0.15).otherwise(0.0) + F.least(F.lit(PENALTY[1]), PENALTY[0] * F.size(variant_difference(a["tokens"], b["tokens"])))
    brand = F.when((a["folded_brand"] == "") | (b["folded_brand"] == ""), 0.5).when(a["folded_brand"] == b["folded_brand"], 1.0).otherwise(0.0)
    gated = pairs.withColumn("_conflict", signatures_conflict(a["sig"], b["sig"])).withColumn("_jaccard", jaccard(a["tokens"], b["tokens"])).withColumn("_fixed", 0.3 * brand - penalty)
    if least > 0:
        gated = gated.where(~F.col("_conflict") & (0.7 * (0.5 * F.col("_jaccard") + 0.5) + F.col("_fixed") >= least - 0.0005))
    raw = 0.7 * (0.5 * F.col("_jaccard") + 0.5 * token_ratio(a["core"], b["core"])) + F.col("_fixed")
    scored = gated.withColumn("score", F.when(F.col("_conflict"), 0.0).otherwise(F.greatest(F.lit(0.0), F.round(raw, 3))))
    return scored.where(F.col("score") >= least).drop("_conflict", "_jaccard", "_fixed")


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams within words that are padded by one blank on either side."""
    words = F.filter(F.split(text, " +"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    per = [F.flatten(F.transform(padded, _grams(n))) for n in range(low, high + 1)]
    return F.concat(*per)


def _grams(n: int):
    return lambda w: F.when(F.length(w) > n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substr(w, i, F.lit(n)))).otherwise(F.array(w))


def tfidf_units(texts: DataFrame) -> DataFrame:
    """(id, g, df, w, rest): the TF-IDF vectors of (id, text) with length 1, and the squared length from each gram on, rarest grams first.

    With a column n a text counts for so many texts.
    """
    texts = texts if "n" in texts.columns else texts.withColumn("n", F.lit(1).cast("long"))
    grams = texts.select("id", "n", F.explode(char_grams(F.col("text"))).alias("g")).groupBy("id", "g").agg(F.count("*").alias("tf"), F.first("n").alias("_n"))
    total = texts.agg(F.sum("n").alias("n"))
    weights = grams.join(grams.groupBy("g").agg(F.sum("_n").alias("df")), "g").drop("_n").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    whole = Window.partitionBy("id")
    onward = whole.orderBy("df", "g").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return weights.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole))).withColumn("rest", F.sum(F.col("w") * F.col("w")).over(onward))


def tfidf_pairs(texts: DataFrame, least: float = PREFILTER) -> DataFrame:
    """(a, b, cosine), a < b, of texts (id, text) with a cosine of TF-IDF vectors of `least` or more.

    Exact, by prefix filtering: the grams of a text stand in the order of their number of
    texts, and its prefix ends where the rest of the vector is shorter than `least`. Of two
    texts whose first common gram is in the rest of either one, the cosine is below `least`;
    so only prefixes are joined, which leaves the most common grams out, and the pairs found
    are computed in full.
    """
    unit = tfidf_units(texts)
    prefix = unit.where(F.col("rest") >= least * least - 1e-9).select("id", "g")
    pairs = prefix.withColumnRenamed("id", "a").join(prefix.withColumnRenamed("id", "b"), "g").where("a < b").select("a", "b").distinct()
    return pair_cosines(pairs, unit).where(F.col("cosine") >= least - 1e-12)


def pair_cosines(pairs: DataFrame, unit: DataFrame) -> DataFrame:
    """(a, b, cosine) of `pairs` (a, b) that share a gram; `unit` of :func:`tfidf_units`."""
    mine = unit.select(F.col("id").alias("a"), "g", F.col("w"))
    other = unit.select(F.col("id").alias("b"), "g", F.col("w").alias("v"))
    return pairs.join(mine, "a").join(other, ["b", "g"]).groupBy("a", "b").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))


def token_blocks(names: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of (id, tokens) that share one of their two longest tokens of 3 letters or more."""
    order = F.sort_array(F.transform(F.filter(F.array_distinct("tokens"), lambda t: F.length(t) >= 3), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    keys = names.select("id", F.explode(F.slice(order, 1, 2)).alias("k")).select("id", F.col("k.t").alias("k"))
    return keys.withColumnRenamed("id", "a").join(keys.withColumnRenamed("id", "b"), "k").where("a < b").select("a", "b").distinct()
