"""Candidates of the fuzzy score against all pairs."""

import random

from pyspark.sql import functions as F

from tradewind.functions import pairing
from tradewind.functions.similarity import profile, score_pairs
from tradewind.operators import canonical, ingest

NOUNS, MORE = ["milk", "tea", "oil", "rice", "soap"], ["red", "fresh", "light", "extra", "the", "gr", "x", "5", "1+1", "no 3", "με", "12%"]
LONG = " ".join(f"word{k}" for k in range(40))


def names(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = rng.sample(NOUNS, rng.randint(0, 2)) + rng.choices(MORE, k=rng.randint(0, 4)) + rng.choices(["", "500ml", "1lt", "2 x 250 ml", "3 tem"], k=1)
        rng.shuffle(words)
        out.append((k, " ".join(words), rng.choice(["Acme", "Acme", "Bold & Co", "", None])))
    for k in range(20):  # names of so many words that several may differ
        words = LONG.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(40)] = f"new{rng.randrange(99)}"
        out.append((1000 + k, " ".join(words), "Acme"))
    return [*out, (2000, "", ""), (2001, None, None), (2002, "500ml", "Acme"), (2003, "gr 500ml", "Acme"), (2004, "gr", None)]


def every(left, right, least):
    side = lambda f, n: f.select(F.col("id").alias(n), F.struct("tokens", "core", "folded_brand", "sig").alias(f"_{n}"))
    both = side(left, "a").crossJoin(side(right, "b")).where("a <> b").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    return {(r.id_a, r.id_b): r.score for r in score_pairs(both, least).collect()}


def test_no_pair_is_lost(spark):
    known = profile(spark.createDataFrame(names(1, 250), "id long, name string, brand string")).persist()
    for least in (0.72, 0.92, 0.8):
        want = {k: s for k, s in every(known, known, least).items() if k[0] < k[1]}
        assert {(r.a, r.b): r.score for r in pairing.similar_pairs(known, least).collect()} == want
        assert len(want) > 20


def test_no_pair_between_tables_is_lost(spark):
    left, right = (profile(spark.createDataFrame([(i + shift, n, b) for i, n, b in names(s, 200)], "id long, name string, brand string")).persist() for s, shift in ((2, 0), (3, 10_000)))
    assert {(r.a, r.b): r.score for r in pairing.similar_between(left, right, 0.72).collect()} == every(left, right, 0.72)


def test_pairs_grow_with_the_products(spark):
    """One word in all names and one brand: the pairs that meet are as many for each product in ten times the products."""

    def met(n):
        rows = [(k, f"milk kind{k // 3} {('plain', 'fresh', '')[k % 3]}", "Acme") for k in range(n)]
        known = profile(spark.createDataFrame(rows, "id long, name string, brand string"))
        return pairing.meeting(known, known, 0.72).where("a < b").distinct().count() / n

    few, many = met(300), met(3000)
    assert 0 < few < 3 and abs(many - few) < 0.1


def test_copies_are_one_class(spark):
    """Links of all products from those of representatives; what is made does not grow with the square of the copies."""
    few = [*names(4, 25)[:25], (90, "", ""), (91, None, None), (92, "500ml", "Acme")]
    rows = [(i + 10_000 * k, n.upper() if n and k == 1 else n, b) for k in range(2) for i, n, b in few]
    frame = spark.createDataFrame(rows, "id long, name string, brand string")
    members, pairs, _ = pairing.similar_classes(frame, 0.72)
    rep = {r.id: r.rep for r in members.collect()}
    score = {(r.a, r.b): r.score for r in pairs.collect()}
    ids = sorted(rep)
    told = {(x, y): score[k] for x in ids for y in ids if x < y and (k := tuple(sorted((rep[x], rep[y])))) in score}
    known = profile(frame)
    assert told == {k: s for k, s in every(known, known, 0.72).items() if k[0] < k[1]}
    once, _, _ = pairing.similar_classes(frame.where("id < 10000"), 0.72)
    assert len({*rep.values()}) == len({r.rep for r in once.collect()})
    assert pairing.star(members, pairs).count() <= len(score) + len(rep)
    got = {(r.product_a, r.product_b): r.score for r in canonical.candidates(frame.withColumn("canonical_id", F.lit(None).cast("long")), 0.72, 0.0).collect()}
    bare = {r.id for r in known.where("core = ''").collect()}  # no gram that vectors could share
    assert got == {k: s for k, s in told.items() if s < 1 and not {*k} & bare} and got


def test_blocking_with_many_copies(spark):
    """Against all pairs: copies on both sides, ids that are on both sides, and null categories."""
    few = names(5, 30)[:30]
    row = lambda k, i, n, b: (i + 10_000 * k, n, b, (None, "c", "d")[i % 3])
    kinds = "id long, name string, brand string, category string"
    fresh = [row(k, *x) for k in range(3) for x in few]
    stored = [row(k, *x) for k in (2, 3, 4) for x in few]
    left, right = spark.createDataFrame(fresh, kinds), spark.createDataFrame(stored, kinds)
    kind = {r[0]: r[3] for r in fresh + stored}
    best = {}
    for (a, b), s in every(profile(left), profile(right), 0.92).items():
        if kind[a] == kind[b]:
            best[a] = max(best.get(a, (0, 0)), (s, -b))
    want = {a: -b for a, (_, b) in best.items()}
    got = {r.dup: r.master for r in ingest.block_duplicates(left, right.withColumn("canonical_id", F.lit(None).cast("long"))).collect()}
    assert got == want and len(want) >= 30
