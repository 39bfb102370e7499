"""The findings of the first review: each test failed before its change."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tradewind.llm import decontaminate, line_dedup, simhash, url_filter


def test_edited_copies_join_whatever_their_order(spark):
    """Copies that only the original links are one group, also if a copy has the least id."""
    rng = random.Random(3)
    rows = []
    for g in range(5):
        base = [f"g{g}w{k}" for k in range(400)]
        texts = [base]
        for c in range(12):
            copy = list(base)
            for k in rng.sample(range(400), 4):
                copy[k] = f"new{g}x{c}x{k}"
            texts.append(copy)
        ids = list(range(100 * g, 100 * g + 13))
        rng.shuffle(ids)
        rows += [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5, lanes=4, radius=42, keys=6)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, i - i % 100) for i, _ in rows}


def _pairs_of_similarity(low, high, first):
    """(id, text), (id + 1, text): 40 pairs of 300-word texts whose five-word runs have a Jaccard similarity in [low, high)."""
    rng = random.Random(first)
    rows = []
    while len(rows) < 80:
        base = [f"p{first + len(rows)}w{k}" for k in range(300)]
        copy = list(base)
        for k in rng.sample(range(300), rng.randint(4, 12)):
            copy[k] = f"x{first + len(rows)}x{k}"
        a, b = ({tuple(t[i : i + 5]) for i in range(296)} for t in (base, copy))
        if low <= len(a & b) / len(a | b) < high:
            rows += [(first + len(rows), " ".join(base)), (first + len(rows) + 1, " ".join(copy))]
    return rows


def test_near_copies_are_those_of_shingle_similarity(spark):
    """Pairs just over 0.8 are found and pairs just under it are left alone."""
    over, under = _pairs_of_similarity(0.8, 0.83, 0), _pairs_of_similarity(0.72, 0.8, 1000)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in over + under], "doc_id long, text string, lang string, source string, n_chars int")
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert left == {i for i, _ in over if i % 2 == 0} | {i for i, _ in under}


def test_cells_miss_few_pairs():
    """Pairs at the radius share no cell with a probability of 1e-4 at most."""
    for members in (300, 10_000, 1_000_000):
        tables, width = simhash.cells(members, 56, 256).shape
        assert (1 - (1 - 56 / 256) ** width) ** tables <= 1e-4


def test_near_copies_under_repeated_and_null_ids(spark):
    """Copies that share an id, or have none, leave one row each."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (None, b), (None, c), (None, c), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    left = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == [("1", a), ("1", b), ("7", None), ("None", c)]


def test_contaminated_rows_without_an_id_go(spark, tmp_path):
    """Of rows that share an id, or have none, only those with a passage of the benchmark go."""
    item = " ".join(f"q{k}" for k in range(12))
    spark.createDataFrame([("i1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "clean"), (1, f"a {item}"), (None, f"b {item}"), (None, "also clean")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    left = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == [("1", "clean"), ("None", "also clean")]


def test_benchmark_items_without_an_id_are_searched(spark):
    passage = " ".join(f"q{k}" for k in range(12))
    items = spark.createDataFrame([(None, passage), ("b", passage + " more words"), (None, "z1 z2 z3")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "some z1 z2 z3"), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {1: (12, 1, True), 2: (3, 0, True), 3: (0, 0, False)}


def test_lines_with_changed_letters_go(spark):
    """One changed letter in a line of a few words, and one in twelve letters of a longer one."""
    rng = random.Random(5)
    lines = [" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)) for n in (4, 6, 9, 14, 22, 40) for _ in range(10)]
    copies = []
    for line in lines:
        letters = list(line)
        for k in rng.sample([i for i, x in enumerate(line) if x != " "], max(1, len(line) // 12 if len(line) > 60 else 1)):
            letters[k] = "z"
        copies.append("".join(letters))
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(copies))], "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.report(docs).collect()}
    assert got[1] == [] and len(got[2]) >= 0.95 * len(lines)


def test_short_equal_lines_go(spark):
    docs = spark.createDataFrame([(1, "All rights reserved\n\nok\nok!"), (2, "all rights reserved.\n--\nal rights reserved")], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.report(docs).collect()} == {1: [3], 2: [0]}


def test_components_are_joined_by_links_alone():
    """Of two pairs between the same two groups, one just under the similarity and one over it, the second joins them."""
    a = np.arange(200, dtype=np.uint64)
    low, high = np.concatenate((a[:177], a[:23] + 1000)), np.concatenate((a[:190], a[:10] + 2000))
    jaccard = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    sets = [a, low, a.copy(), high]
    assert 0.79 < jaccard(a, low) < 0.8 < 0.9 < jaccard(a, high)
    assert simhash._alike([(0, 1), (2, 3)], [np.sort(x) for x in sets], [1, 2, 1, 2], 0.8) == [(2, 3)]


def test_ids_make_no_link(spark):
    """Rows without an id, or with the same one, are linked by their fingerprints only."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, a), (None, b), (5, a), (9, b), (-1, c), (7, c), (7, a), (None, "alone"), (None, None), (3, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, 5), (None, 9), (5, 5), (9, 9), (-1, -1), (7, -1), (7, 5), (None, None), (None, 3), (3, 3)]
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in got))) == sorted(map(str, want))
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rules_with_one_string_count_alike_at_every_size(spark, monkeypatch):
    """The last of them decides, whether the rules are mapped or joined."""
    rules = [url_filter.Rule("net", "/", "block"), url_filter.Rule("net", "/", "allow"), url_filter.Rule("org", "/", "allow"), url_filter.Rule("org", "/", "block")]
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://org/"), (3, None)], "page_id long, url string")
    mapped = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    monkeypatch.setattr(url_filter, "MAX_RULES", 1)
    joined = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert mapped == joined == {1: ("net/", "allow"), 2: ("org/", "block"), 3: (None, "allow")}


@pytest.mark.parametrize("edits", [2, 6])
def test_lines_of_one_prefix_meet_beyond_the_next_eight(spark, edits, monkeypatch):
    """Planted pairs of lines that all share a block: they are more than a block compared where it lies and, with small parts, more than one cell."""
    rng = random.Random(edits)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    prefix = " ".join(word() for _ in range(12))
    lines, copies = [], []
    for _ in range(300):
        line = f"{prefix} {' '.join(word() for _ in range(12))}"
        letters = list(line)
        for k in rng.sample([i for i in range(len(prefix) + 1, len(line)) if line[i] != " "], edits):
            letters[k] = "z"
        lines.append(line)
        copies.append("".join(letters))
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(copies))], "doc_id long, text string")
    assert len({r.doc_id: r.removed for r in line_dedup.report(docs).collect()}[2]) >= 285
    got = {}
    for hot, part in ((10_000, 10_000), (4, 10_000), (4, 50)):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "PART", part)
        frame = spark.createDataFrame(list(enumerate(lines + copies)), "c long, norm string").withColumn("sk", line_dedup.sketches(F.col("norm")))
        got[hot, part] = {(r.a, r.b) for r in line_dedup.candidates(frame.select("c", "sk"), 0.8).collect()}
    assert len(got[4, 50]) > 300 and len(set(map(frozenset, got.values()))) == 1
