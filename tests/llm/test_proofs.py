"""Corpus queries against SQL and plain Python: draws, interleaving, seating, collapse, shared stars; and odd rows."""

import glob
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import chat, decontaminate, graph, language_model, mixing, oracles, quality, sharding, tokens, url_filter
from tradewind.llm.queries import SHARD_SEED, SHARDS, queries

SF = "/root/testdata/sf0.001"


def seeded(*parts) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(oracles.oracle_sql()[name]).df()
    got = queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(tuple(None if x is None or x != x else str(x) for x in r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert rows(got) == rows(want) and len(got)


def test_mix_draws_prefixes_of_seeded_epochs(spark):
    rows = [(d, "w " * (1 + d % 7), f"s{d % 3}") for d in range(300)] + [(301, None, "s0"), (302, "", None), (303, "x " * 40, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = mixing.mix(docs, {"source": F.col("source")}, {"source": {"s0": 8}}, 3000, 4, 5).collect()
    times = Counter((r.doc_id, r.mix_source) for r in drawn)
    targets = {r.mix_source: r.mix_target for r in drawn}
    by = defaultdict(list)
    for d, text, source in rows:
        by[source or "(none)"].append((d, len((text or "").split())))
    for leaf, docs_ in by.items():
        avail = sum(n for _, n in docs_)
        if not avail:
            assert leaf not in targets or not any(k[1] == leaf for k in times)
            continue
        whole, rest = divmod(targets[leaf], avail)
        start = 0
        for d, n in sorted(docs_, key=lambda x: seeded(5, whole, x[0])):
            assert times[(d, leaf)] == whole + (start < rest), (leaf, d)
            start += n
    assert sum(targets.values()) == 3000
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("mix_x", F.lit(1)), {"source": F.col("source")}, {})


def test_shards_interleave_by_fractional_rank(spark):
    rows = [(d, "t" * (d % 5), f"s{d % 2}" if d % 10 else None) for d in range(2000)] + [(5000 + d, "x", f"only{d}") for d in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.stratified_shards(docs, F.col("source"), 7, 3).collect()}
    by = defaultdict(list)
    for d, _, s in rows:
        by[s or "(none)"].append(d)
    order = []
    for s, ids in by.items():
        for r, d in enumerate(sorted(ids, key=lambda d: (seeded(3, d), d))):
            order.append(((2 * r + 1) / (2 * len(ids)), s, d))
    n, want = len(rows), {}
    for k, (_, _, d) in enumerate(sorted(order)):
        shard = k * 7 // n
        want[d] = (shard, k - (shard * n + 6) // 7)
    assert got == want
    assert SHARDS == 16 and SHARD_SEED == 29
    with pytest.raises(ValueError):
        sharding.stratified_shards(docs.withColumn("_sh_x", F.lit(1)), F.col("source"), 7)


def test_seats_follow_the_chinese_restaurant():
    """The number of tables has the mean that seating one by one has."""
    rng = np.random.default_rng(1)
    for customers, base, discount in ((2, 0.5, 0.8), (9, 3.0, 0.5), (400, 1.0, 0.7), (400, 1e-9, 0.7)):
        got = language_model.seat(np.full(4000, customers), np.full(4000, base), np.full(4000, 0.1), discount, rng)
        few = [int(language_model.seat(np.array([customers]), np.array([base]), np.array([0.1]), discount, rng)[0]) for _ in range(600)]
        plain = []
        for _ in range(600):
            t = 1
            for i in range(1, customers):
                w = base + 0.1 * t
                t += rng.random() < w / (w + i - discount * t)
            plain.append(t)
        error = 5 * np.std(plain) / np.sqrt(600) + 0.05
        assert abs(got.mean() - np.mean(plain)) < error and abs(np.mean(few) - np.mean(plain)) < error
        assert got.min() >= 1 and got.max() <= customers
    assert language_model.seat(np.array([0, 1]), np.ones(2), np.ones(2), 0.5, rng).tolist() == [0, 1]


def test_language_model_is_a_distribution(spark):
    """After each context the probabilities of all words and of an unknown one add up to one; contexts count."""
    text = ["a b c", "a b d", "a b c", "b a c", "c c c a", "d a b c", "zz a b"]
    train = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "doc_id long, text string")
    words = sorted({w for t in text for w in t.split()})
    probes = [(100 + k, f"a {w}") for k, w in enumerate([*words, "never"])] + [(200, "a"), (300, ""), (301, None), (302, "never seen words"), (None, "a b")]
    both = train.unionByName(spark.createDataFrame(probes, "doc_id long, text string")).withColumn("id", F.lit(1)).withColumn("block", F.lit("x"))
    held = (F.col("doc_id") >= 100) | F.col("doc_id").isNull()
    rows = {r.doc_id: r for r in language_model.score_texts(both, held=held).collect()}
    assert len(rows) == len(text) + len(probes) and rows[-1].held_out and not rows[0].held_out
    # P(begin, a, w, end) / P(end after w) differs by w only in P(w after a); the ends are taken from one-word texts
    ends = {r.doc_id: r for r in language_model.score_texts(train.unionByName(spark.createDataFrame([(400 + k, w) for k, w in enumerate([*words, "never"])], "doc_id long, text string")), held=F.col("doc_id") >= 100).collect()}
    assert rows[300].score == rows[301].score and rows[300].n_tokens == 1 and rows[302].n_known == 1
    assert rows[100 + words.index("b")].score > rows[100 + words.index("zz")].score
    assert all(r.score < 0 and r.perplexity > 1 for r in rows.values()) and len(ends) == len(text) + len(words) + 1
    nobody = language_model.score_texts(train, held=F.lit(True)).collect()
    assert {r.n_known for r in nobody} == {0} and all(abs(r.score) < 1e-6 for r in nobody)
    assert language_model.score_texts(train.limit(0)).collect() == []


def test_restaurants_keep_their_totals():
    rng = np.random.default_rng(2)
    u, n = np.array([0, 0, 0, 2, 2]), np.array([5, 2, 9, 3, 2])
    tables, total = language_model.sweep_restaurants(u, n, np.ones(5, dtype=np.int64), np.array([4.0, 1.0, 2.0]), np.full(5, 0.1), rng)
    assert total.tolist() == [1 + tables[:3].sum(), 1.0, tables[3:].sum()] and (tables >= 1).all() and (tables <= n).all()
    root = language_model.sweep_root(np.array([4, 1, 7]), np.ones(3, dtype=np.int64), 3.0, 0.1, rng)
    assert (root >= 1).all() and (root <= [4, 1, 7]).all()


def test_chat_collapse_is_brute_force(spark):
    rng = np.random.default_rng(4)
    talks = {k: [(("user", "bot")[j % 2], f"t{rng.integers(3)}") for j in range(rng.integers(1, 6))] for k in range(80)}
    talks |= {900: [("user", "long")] * 30, 901: [("user", "long")] * 20, -1: [("a", "b")], None: [("a", "c")]}
    rows = [(k, j, *t) for k, ts in talks.items() for j, t in enumerate(ts)] + [(950, None, None, "x"), (950, 0, "user", None)]
    talks[950] = [("", "x"), ("user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(0)).withColumn("pos", F.lit(0))
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.render(frame, chunk=4).collect()}
    want = {}
    for k, ts in talks.items():
        same = [o for o, x in talks.items() if x == ts]
        if any(len(x) > len(ts) and x[: len(ts)] == ts for x in talks.values()) or k != min(same, key=lambda o: (o is None, o or 0)):
            continue
        want[k] = (len(ts), len(same), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in ts))
    assert got == want
    assert chat.render(frame.limit(0)).collect() == []


def test_components_of_stars_and_paths(spark):
    edges = [(1, k) for k in range(2, 400)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (2000, 1999), (1999, 2000)] + [(399, 1050)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 1 for k in [*range(2, 400), *range(1000, 1101)]} | {2000: 1999}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_joined_rules_are_shipped_rules(spark):
    rules = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"), url_filter.Rule("a.b", "", "block"), url_filter.Rule("b", "/long/path", "block")]
    urls = [None, "", "no scheme", "http://X.net", "http://x.net/", "https://www.example.net/en/q?x", "http://example.net/en", "ftp://z.a.b", "http://a.b/long/path#x", "http://c.b/long/pat", "http:///x"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(0, None)], "page_id long, url string").withColumn("rule", F.lit("old")).withColumn("_judged", F.lit(1))
    frame = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    pick = lambda f: sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in f.collect())
    key = lambda rows: sorted(map(str, rows))
    assert key(pick(url_filter.filter_urls(pages.drop("_judged"), rules))) == key(pick(url_filter.join_rules(pages, frame)))
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0 and url_filter.filter_urls(pages, []).where("verdict <> 'allow'").count() == 0


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "_key", lambda text: 7)
    index = url_filter.DigestArray(url_filter.DigestArray.write([url_filter.Rule("a", "/", "block"), url_filter.Rule("b", "/", "allow")], str(tmp_path), "t"))
    assert index.judge(["a", "b", "c"], ["/", "/x", "/"]) == (["a/", "b/", None], ["block", "allow", "allow"])


def test_spans_are_cut_out():
    text = "One two, THREE four; five six."
    assert decontaminate.remove_spans(text, [(1, 3), (4, 5)]) == "One  four;  six."
    assert decontaminate.remove_spans(text, []) == text and decontaminate.remove_spans("a b", [(0, 2)]) == ""


def test_label_model_prefers_what_rules_agree_on():
    """Posterior of planted classes: rules of known accuracy, of which one is a coin."""
    rng = np.random.default_rng(9)
    good = rng.random(20_000) < 0.8
    votes = []
    for right in (0.9, 0.8, 0.5):
        hit = rng.random(20_000) < right
        says = np.where(hit, good, ~good)
        votes.append(np.where(rng.random(20_000) < 0.2, 0, np.where(says, 1, -1)))
    patterns = Counter(map(tuple, np.stack(votes, axis=1).tolist()))
    model = quality.fit(sorted(patterns.items()), ("a", "b", "c"), good=0.8)
    assert model.accuracy("a") == pytest.approx(0.9, abs=0.05) and model.accuracy("b") == pytest.approx(0.8, abs=0.06) and model.accuracy("c") < 0.75
    verdict = np.array([model.logit(dict(zip("abc", v, strict=True))) > 0 for v in np.stack(votes, axis=1).tolist()])
    assert (verdict == good).mean() > 0.88


def test_odd_rows_of_token_files(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(3, None), (1, "b b"), (1, "a"), (None, "x"), (2, "")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("part", F.lit(1))
    rows = tokens.read_back(tokens.write_files(docs, f"file://{tmp_path}/t", path, 2)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [-1, 1, 1, 2, 3] and [r.n_tokens for r in rows][-2:] == [1, 1]
    assert rows[-1].ids_crc32 == zlib.crc32(np.array([2], dtype="<u4").tobytes())
    assert tokens.read_back(tokens.write_files(docs.limit(0), f"file://{tmp_path}/e", path, 2)).collect() == []


def test_staged_tables_can_be_cleared():
    from types import SimpleNamespace

    from tradewind.llm import common

    assert common.staged_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "file:///shared/"}, sparkContext=SimpleNamespace(applicationId="app-1"))) == "file:///shared/tradewind-app-1"
