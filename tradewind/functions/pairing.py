"""Candidates of the fuzzy score without a block of all that share a word.

The score bounds what an accepted pair can look like: brands are equal or one is missing, sizes
are equal or one is missing, and the words that tell variants apart differ by one at most, unless
nearly all words are shared. So products meet under the set of their telling words, or that
set less one word, together with brand and size; a word that a third of all products
have is one of several in such a key, and pairs grow with the products that really are alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .similarity import PENALTY, SUGGEST, profile, score_pairs, telling

#: What the score takes for granted of a pair at best: half of 0.7 for the order of letters, 0.3 for the brand.
_BEST, _SLACK = 0.65, 0.0005


def shared_words(least: float, differing: int) -> float:
    """The Jaccard similarity of words that a pair needs for a score of `least` if that many telling words differ."""
    return (least - _SLACK - _BEST + min(PENALTY[1], PENALTY[0] * differing)) / 0.35


def _keys(known: DataFrame, sole: bool) -> DataFrame:
    """(id, kind, key): the keys of products as the side that lacks something (`sole`), or as the other side.

    kind tells what a key holds: brand and size, or only one of them, or none, where one of the
    sides lacks it; and whether the set of telling words is whole or less one.
    """
    tell = F.array_sort(telling(F.array_distinct("tokens")))
    less = F.transform(tell, lambda t: F.array_remove(tell, t))
    # a set without words stands for each of the other words, of which a pair must share one
    weak = F.array_except("tokens", tell)
    spelled = lambda s: F.when((F.size(s) == 0) & (F.size(weak) > 0), F.transform(weak, lambda w: F.concat(F.lit("~"), w))).otherwise(F.array(F.array_join(s, " ")))
    size = F.when(F.col("sig.size").isNotNull(), F.concat_ws(":", "sig.size.dim", F.col("sig.size.amount").cast("string")))
    rows = known.select("id", F.nullif("folded_brand", F.lit("")).alias("brand"), size.alias("size"), spelled(tell).alias("whole"), F.flatten(F.transform(less, spelled)).alias("less"))
    has_b, has_s = F.col("brand").isNotNull(), F.col("size").isNotNull()
    both, sized, branded, bare = (F.concat_ws("\t", F.lit(k), *c) for k, c in (("bs", ("brand", "size")), ("s", ("size",)), ("b", ("brand",)), ("-", ())))
    # a brand that one side lacks and a size that one side lacks leave 0.7 at most, which meeting() rules out
    if sole:
        kinds = F.array(F.when(has_b & has_s, both), F.when(~has_b & has_s, sized), F.when(has_b & ~has_s, branded), F.when(~has_b & ~has_s, bare))
    else:
        kinds = F.array(F.when(has_b & has_s, both), F.when(has_s, sized), F.when(has_b, branded), F.when(~(has_b & has_s), bare))
    words = lambda tag, of: F.transform(of, lambda w: F.concat(F.lit(f"{tag}\t"), w))
    sets = F.concat(words("w", F.col("whole")), words("l", F.col("less"))) if sole else F.concat(words("w", F.concat("whole", "less")), words("l", F.col("whole")))
    return rows.select("id", F.explode(F.array_compact(kinds)).alias("kind"), sets.alias("s")).select("id", "kind", F.explode(F.array_distinct("s")).alias("key"))


def _long(known: DataFrame, share: float) -> DataFrame:
    """(id, brand, key): of products with so many words that two may differ, the first ones in the order of their hashes, of which such a pair shares one."""
    words = F.array_distinct("tokens")
    n = F.size(words)
    order = F.transform(F.array_sort(F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), lambda x: x["w"])
    first = F.slice(order, F.lit(1), (n - F.ceil(F.lit(share) * n) + 1).cast("int"))
    return known.where((n >= 2 * share / (1 - share) - 1e-9) & (F.col("folded_brand") != "")).select("id", "folded_brand", F.explode(first).alias("key"))


def meeting(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b) with a of `left` and b of `right` (both of :func:`similarity.profile`, with id): pairs among which are all that score `least` or more, if each call with the sides changed is added; repeats stay."""
    if least - _SLACK <= 0.7:
        raise ValueError("products of different brands could score as much")
    two = shared_words(least, 2)
    met = _keys(left, True).withColumnRenamed("id", "a").join(_keys(right, False).withColumnRenamed("id", "b"), ["kind", "key"]).select("a", "b")
    if two < 1:
        met = met.unionByName(_long(left, two).withColumnRenamed("id", "a").join(_long(right, two).withColumnRenamed("id", "b"), ["folded_brand", "key"]).select("a", "b"))
    return met


def scored(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of pairs that score `least` or more."""
    side = lambda frame, name: frame.select(F.col("id").alias(name), F.struct("tokens", "core", "folded_brand", "sig").alias(f"_{name}"))
    both = pairs.join(side(left, "a"), "a").join(side(right, "b"), "b").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    return score_pairs(both, least).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "score")


def name_classes(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, known): the class of each name and brand, and the profile of each class, under its id.

    Products whose tokens, brands and signatures are equal score alike with everything, so a class
    stands for all of them. `names` has name, brand, class; known also has brand, of which the class has one.
    Nothing here grows with the copies of a name but the first aggregation.
    """
    parts = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # small rows that cost much: dealt out by a number, which is not coalesced
    each = kept(profile(products.select("name", "brand").distinct().repartition(parts, "name", "brand")).withColumn("alike", F.to_json("sig")))
    same = ["core", "folded_brand", "alike"]
    classes = kept(each.groupBy(*same).agg(F.first("tokens").alias("tokens"), F.first("sig").alias("sig")).withColumn("id", F.monotonically_increasing_id()))
    names = kept(each.select("name", "brand", *same).join(classes.select(*same, F.col("id").alias("class")), same).select("name", "brand", "class"))
    return names, classes.drop("alike")


def with_class(products: DataFrame, names: DataFrame) -> DataFrame:
    """`products` with their class of :func:`name_classes`."""
    known = names.select(F.col("name").alias("_name"), F.col("brand").alias("_brand"), "class")
    return products.join(known, F.col("name").eqNullSafe(F.col("_name")) & F.col("brand").eqNullSafe(F.col("_brand"))).drop("_name", "_brand")


def similar_classes(products: DataFrame, least: float = SUGGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, pairs, known): all links of products (id, name, brand) that score `least` or more, without the pairs of copies.

    members (id, rep): the least id of each product's class; rows of a null id are in none. pairs
    (a, b, score), a < b, joins the least ids of different classes, and (a, a, score) says that the
    copies of a class are linked with each other, and by which score. So two products are linked if
    the pair of their representatives is there. known has the profiles, by the id of a representative, and n, the products of each.
    """
    names, classes = name_classes(products)
    placed = with_class(products.where("id is not null").select("id", "name", "brand"), names).select("id", "class")
    least_ids = kept(placed.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    known = kept(classes.withColumnRenamed("id", "class").join(least_ids, "class").withColumnRenamed("rep", "id").drop("class"))
    own = scored(known.where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b")), known, known, least)
    return placed.join(least_ids, "class").select("id", "rep"), similar_pairs(known, least).unionByName(own), known


def star(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, score, copy): of :func:`similar_classes` the pairs of representatives, and each other member with its representative, where copies are linked."""
    own = pairs.where("a = b").select(F.col("a").alias("rep"), "score")
    of = members.where("id <> rep").join(own, "rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), "score", F.lit(True).alias("copy"))
    return pairs.where("a <> b").withColumn("copy", F.lit(False)).unionByName(of)


def similar_pairs(known: DataFrame, least: float = SUGGEST) -> DataFrame:
    """(a, b, score), a < b: all pairs of `known` (of :func:`similarity.profile`, with id) that score `least` or more. Exact; a null id pairs with none.

    The pairs of copies are among them, which grow with the square of these: see :func:`similar_classes`.
    """
    met = meeting(known, known, least).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return scored(met, known, known, least)


def similar_between(fresh: DataFrame, stored: DataFrame, least: float) -> DataFrame:
    """(a, b, score): all pairs of a product of `fresh` and one of `stored` that score `least` or more."""
    return between(fresh, stored, least, "a <> b")


def between(fresh: DataFrame, stored: DataFrame, least: float, where: str = "true") -> DataFrame:
    """:func:`similar_between` for ids that need not differ."""
    there = meeting(fresh, stored, least)
    back = meeting(stored, fresh, least).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return scored(there.unionByName(back).where(where).distinct(), fresh, stored, least)
