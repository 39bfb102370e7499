"""The findings of the third review: each test failed before its change."""

import random

import numpy as np
from pyspark.sql import functions as F
from tradewind.llm import line_dedup, simhash


def test_near_copies_are_found_in_trees():
    """A BK-tree links what a comparison of all pairs does: by fingerprints alone, and by sets where they are given."""
    rng = np.random.default_rng(5)
    sets = []
    for base in rng.integers(0, 1 << 63, (12, 300), dtype=np.uint64):
        for _ in range(8):
            copy = base[: rng.integers(8, 300)].copy()
            copy[: rng.integers(0, 1 + len(copy) // 8)] += np.uint64(1)
            sets.append(np.unique(copy))
    values, sizes = [int.from_bytes(simhash.fingerprint(x, 4), "big") for x in sets], [len(x) for x in sets]

    def groups(links):
        of = list(range(len(sets)))
        for a, b in links:
            of = [of[a] if x == of[b] else x for x in of]
        return {frozenset(i for i, x in enumerate(of) if x == k) for k in of}

    def candidate(i, j):
        low, high, far = min(sizes[i], sizes[j]), max(sizes[i], sizes[j]), (values[i] ^ values[j]).bit_count()
        return low >= 0.8 * high - 1e-9 and (far <= 56 or low < simhash.FEW_SHINGLES and far <= simhash.FEW_RADIUS)

    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9
    near = [(i, j) for i in range(len(sets)) for j in range(i) if candidate(i, j)]
    assert groups(simhash.copy_links(values, sizes, 56, 0.8)) == groups(near)
    found = simhash.copy_links(values, sizes, 56, 0.8, sets)
    assert all(alike(i, j) for i, j in found) and len(found) < len(sets)
    assert groups(found) == groups([p for p in near if alike(*p)]) != groups(near)


def test_shards_of_common_hashes_grow_with_the_rows(spark):
    """Near copies and texts with a passage in common are dealt a bounded number of times, whatever their number, and copies still meet."""

    def dealt(n):
        rng = random.Random(n)
        rows = [(k, rng.randbytes(32), 100, [*range(10), *(rng.randrange(1 << 40, 1 << 60) for _ in range(6))]) for k in range(n)]
        rows += [(n + k, rng.randbytes(32), 100, list(range(100, 116))) for k in range(n)]
        return simhash.copy_shards(spark.createDataFrame(rows, "rep long, fp binary, n int, least array<long>"), 16).collect()

    few, many = dealt(40), dealt(400)
    assert len(many) == 10 * len(few)
    assert sum(r.rep == 79 for r in few) == simhash.PAIRED * (simhash.PAIRED - 1) / 2
    shared = {r.key for r in many if r.rep == 400} & {r.key for r in many if r.rep == 799}
    assert shared and not {r.key for r in many if r.rep < 400}


def test_bits_of_small_sets_differ_within_their_radius():
    """Sets under FEW_SHINGLES of a similarity of 0.8 stay within FEW_RADIUS."""
    rng = np.random.default_rng(7)
    for n in range(4, simhash.FEW_SHINGLES):
        for _ in range(40):
            whole = rng.integers(0, 1 << 63, n + int(n * 0.25 + 1e-9), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n + int(n * 0.25 + 1e-9), dtype=np.uint64)
            a, b = (int.from_bytes(simhash.fingerprint(x, 4), "big") for x in (whole, whole[:n]))
            assert (a ^ b).bit_count() <= simhash.FEW_RADIUS


def test_lines_are_blocked_by_spark_alone(spark):
    """No Python on the executors; words known as frequent come later, yet lines of nothing else meet."""
    words = [f"frequent{k}" for k in range(20)]
    lines = [" ".join(words), " ".join([*words[:9], "other", *words[10:]]), " ".join(f"lonely{k}" for k in range(20))]
    frame = spark.createDataFrame(list(enumerate(lines)), "c long, norm string")
    known = [r.h for r in frame.selectExpr("explode(split(norm, ' ')) w").where("w like 'frequent%'").selectExpr("xxhash64(w) h").distinct().collect()]
    for frequent in ([], known):
        found = line_dedup.candidates(frame.select("c", line_dedup.sketches(F.col("norm"), frequent).alias("sk")), 0.8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
        assert [(r.a, r.b) for r in found.collect()] == [(0, 1)]
