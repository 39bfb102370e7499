"""The five stages, each on its own input, against plain Python; with null and repeated ids, odd texts and empty tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tradewind.llm import decontaminate, mixing, quality, simhash
from tradewind.llm.common import read_table
from tradewind.llm.queries import WEIGHTS, levels

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "same text " * 20, "en", "src1", 1), (None, "same text " * 20, None, None, 1), (7, "same text " * 20, "en", "src1", 1), (7, "same text " * 20, "en", "src1", 1), (8, None, "en", "src2", 0), (9, "", "en", "src2", 0), (10, "long " * 30_000, "de", "src9", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents").select(*cp.COLUMNS)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("row", F.lit(5)).withColumn("file", F.lit("x"))


def keys(frame):
    return Counter((r.doc_id, r.source) for r in frame.select("doc_id", "source").collect())


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_empty_tables_and_columns(spark, docs, name):
    step = dict(cp.STAGES)[name]
    out = step(spark, docs.limit(0), SF)
    assert out.collect() == [] and out.columns[:5] == list(cp.COLUMNS)


def test_quality_rules(spark, docs, odd):
    kept = keys(cp.quality_rules(spark, docs, SF))
    judged = quality.features(docs)
    want = Counter((r.doc_id, r.source) for r in quality.verdict(judged, quality.learn(judged)).where("kept").select("doc_id", "source").collect())
    assert kept == want and 0 < len(kept) < docs.count()
    some = cp.quality_rules(spark, odd.drop("row", "file"), SF).collect()
    assert all(r.text for r in some)


def test_near_duplicates(spark, docs, odd):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    by = defaultdict(set)
    for i, s in sets.items():
        for h in s or {None}:
            by[h].add(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for ids in by.values() for a in ids for b in ids if a < b}:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    kept = {r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i in sets if find(i) == i} and len(kept) < len(sets)
    some = cp.near_duplicates(spark, odd.drop("row", "file"), SF).collect()
    assert sorted((r.doc_id, (r.text or "")[:4]) for r in some) == [(7, "same"), (8, ""), (10, "long")]


def test_benchmark_decontamination(spark, docs, odd):
    kept = keys(cp.benchmark_decontamination(spark, docs, SF))
    found = decontaminate.find_leaks(docs, read_table(spark, SF, "benchmark"))
    hit = {r.doc_id for r in found.where("contaminated").collect()}
    assert hit and {k[0] for k in kept} == {r.doc_id for r in docs.collect()} - hit
    assert cp.benchmark_decontamination(spark, odd.drop("row", "file"), SF).count() == len(ODD)


def test_mix_sources(spark, docs, odd):
    drawn = cp.mix_sources(spark, docs, SF)
    assert max(keys(drawn).values()) == 1
    again = mixing.mix(docs, levels(), WEIGHTS, None, max_epochs=1, percent=cp.MIX_PERCENT)
    assert keys(drawn) == keys(again)
    total = sum(len((r.text or "").split()) for r in docs.collect())
    assert 0.7 * total < again.agg(F.sum("mix_tokens")).first()[0] < 0.9 * total
    assert cp.mix_sources(spark, odd, SF).count() <= len(ODD)


def test_shard(spark, docs, odd):
    for frame, n in ((docs, docs.count()), (odd, len(ODD))):
        got = Counter(r.shard for r in cp.shard(spark, frame, SF).collect())
        sizes = [got.get(k, 0) for k in range(16)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_run_applies_the_stages(spark):
    out = cp.run(spark, SF)
    assert out.columns == [*cp.COLUMNS, "size", "text_crc32", "shard", "slot"]
    assert 0 < out.count() < read_table(spark, SF, "documents").count()


def test_decontamination_by_windows(spark, docs):
    """What stays has no window of ten words of any item, and a shorter item nowhere; told by plain Python from the contract's words."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for item in read_table(spark, SF, "benchmark").collect():
        w = words(item.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in windows}

    def leaks(t):
        w = words(t)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    rows = docs.collect()
    want = Counter((r.doc_id, r.source) for r in rows if not leaks(r.text))
    assert keys(cp.benchmark_decontamination(spark, docs, SF)) == want and len(want) < len(rows)


def test_quality_by_base_rules(spark, docs):
    """No document that the base rules reject stays: under ten words, or over a fifth of its words in repeated windows of five."""

    def rejected(t):
        w = (t or "").encode().split()
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        repeated = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 5)}
        return len(w) < 10 or 100 * len(repeated) > 20 * len(w)

    bad = {r.doc_id for r in docs.collect() if rejected(r.text)}
    kept = {r.doc_id for r in cp.quality_rules(spark, docs, SF).collect()}
    assert bad and not bad & kept and len(kept) > docs.count() / 2
