"""The corpus operators against brute force on small inputs, with nulls, empties and repeats."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tradewind.llm import chat, decontaminate, language_model, line_dedup, mixing, quality, sharding, simhash, tokens, url_filter
from tradewind.llm.queries import RULES, queries

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c d e f g h i j k l"), (2, None), (3, ""), (4, "x " * 3000), (1, "a b c d e f g h i j k l"), (5, "One\ttwo\x0bthree four é\nfive")]


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'s' as source", "'x' as h", "1 as n")


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def test_sharding(spark, texts, odd):
    rows = queries()["op2_sharding"](spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys())
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1 and len(per) == 16
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert sharding.stratified_shards(odd, F.col("source"), 4).count() == len(ODD)
    assert sharding.stratified_shards(_empty(spark), F.col("source"), 4).count() == 0


def test_mixing_budget(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 100), ("b", "z", 20)], "d string, s string, avail long")
    got = {r.s: r.target for r in mixing.budgets(leaves, ["d", "s"], {"d": {"a": 1, "b": 1}}, 60, 1).collect()}
    assert got == {"x": 10, "y": 30, "z": 20}  # b is short by 10, x by 10: y takes both
    assert mixing.mix(_empty(spark), {"source": F.col("source")}, {}).count() == 0


def test_quality_counts(spark, texts, odd):
    def brute(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [y for y in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(hit)

    for r in queries()["op6_quality"](spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    for r in quality.features(odd).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


def test_decontamination(spark, texts):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    windows = {}
    for i, t in items:
        w = decontaminate.split_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    for r in queries()["op5_decontaminate"](spark, SF).collect():
        w, hit, found = decontaminate.split_words(texts[r.doc_id]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    seq = rng.integers(1, 5, 500)
    index = decontaminate.FMIndex(seq, 6)
    for n in (1, 2, 4):
        p = [rng.integers(1, 5, n) for _ in range(20)]
        lo, hi = index.search(p)
        for q, a, b in zip(p, lo, hi, strict=True):
            want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == q).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_url_rules():
    hosts, paths = ["a.example.net", "example.net", "net", "xnet", "u.example.com", "", "a.org"], ["/en/1", "/fr", "", "/", "/de/x", "", "/fr/2"]
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        rule, verdict = url_filter.DigestArray(url_filter.DigestArray.write(RULES, d, "t")).judge(hosts, paths)
    assert rule == ["example.net/en/", "net/", None, None, "example.com/de/", None, "org/fr/"]
    assert verdict == ["allow", "block", "allow", "allow", "block", "allow", "allow"]


def test_simhash(spark, texts, odd):
    rows = {r.doc_id: r for r in queries()["op10_simhash"](spark, SF).collect()}
    prints = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        runs = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}
    some = simhash.near_duplicates(odd).collect()
    assert len(some) == len(ODD) and {r.component_id for r in some if r.doc_id in (2, 3)} == {2}


def test_token_codes():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, 7], dtype=np.uint32)
    for counts in ([7], [0, 1, 4, 0, 2], [3, 4, 0]):
        n = np.array(counts)
        control, data, controls, sizes = tokens.pack(ranks, n)
        assert (tokens.unpack(control, data, n) == ranks).all()
        assert controls.tolist() == [(x + 3) // 4 for x in counts] and sizes.sum() == len(data)


def test_token_pieces_give_the_ids_of_whole_texts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, own = Tokenizer.from_file(path), tokens.PieceTokenizer(path)
    odd = ["", "a", " a", "a ", "a  b", "\n\nx  y\tz", "don't stop  'tis we'll", "x <|endoftext|> y", "<|endoftext|>", "日本語 テキスト です", "naïve Größe — 3.5% of $5", "a\u00a0b c", "\x1c x \x85 y", "  ", "a\r\n b", "😀 😀😀 ok"]
    some = odd + list(texts.values())
    for _ in range(2):  # the second time every piece is known
        ids, n = own.encode(some)
        ends = np.cumsum(n)
        for t, e, k in zip(some, ends, n, strict=True):
            assert ids[e - k : e].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_token_files(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    rows = {r.doc_id: r for r in queries()["op3_token_files"](spark, SF).collect()}
    for i in sorted(texts):
        ids = tok.encode(texts[i], add_special_tokens=False).ids + [2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    tricky = "a  b c <|endoftext|> it's\n\n 12 x \t y z  "
    raw = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode([tricky])[0]
    assert np.frombuffer(raw, "<u4").tolist() == tok.encode(tricky, add_special_tokens=False).ids


def test_language_model(spark, texts):
    rows = queries()["op4_language_model"](spark, SF).collect()
    train = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(language_model.tokens(t))
    n, v = sum(train.values()), len(train)
    for r in rows:
        toks = language_model.tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(toks), sum(t in train for t in toks), n)
        assert r.base_score == pytest.approx(sum(np.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", None), (5, 0, "user", "b"), (5, 0, "user", "b")]
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {2: (2, 2), 4: (1, 1), 5: (1, 1)}


def test_fuzzy_lines(spark):
    base = " ".join(f"word{k}" for k in range(40))
    rows = [(1, base + "\nshort"), (2, base.upper() + "!\nother line that is long enough to count"), (3, None), (4, "")]
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, []), 2: (2, [0]), 3: (1, []), 4: (1, [])}


def test_near_duplicates_sharing_a_passage(spark):
    """Over-full shards: a passage in all documents neither joins them nor hides the near copies."""
    passage = " ".join(f"common{k}" for k in range(30))
    rows = []
    for d in range(60):
        own = [f"d{d}w{k}" for k in range(80)]
        rows += [(2 * d, f"{' '.join(own)} {passage}"), (2 * d + 1, f"{' '.join(own[:-1])} other {passage}")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5, lanes=4, radius=42, keys=6, limit=4)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(d, d - d % 2) for d, _ in rows}


def _close_pairs(lines: list[str], similarity: float = 0.8) -> list[tuple[int, int]]:
    """All pairs of lines of that edit similarity: by length and counts of letter pairs, both of which bound edits, then by DuckDB."""
    lines = sorted(lines, key=len)
    size = np.array([len(x) for x in lines])
    counts = np.zeros((len(lines), 256), dtype=np.int16)
    for i, x in enumerate(lines):
        np.add.at(counts[i], [zlib.crc32(x[k : k + 2].encode()) % 256 for k in range(len(x) - 1)], 1)
    some = []
    for i in range(len(lines)):
        stop = np.searchsorted(size, size[i] / similarity + 1e-9, side="right")
        far = np.abs(counts[i + 1 : stop] - counts[i]).sum(axis=1)
        some += [(i, i + 1 + int(k)) for k in np.flatnonzero(far <= 4 * np.floor(size[i + 1 : stop] * (1 - similarity) + 1e-9))]
    frame = pd.DataFrame([(i, j, lines[i], lines[j]) for i, j in some], columns=["i", "j", "s", "t"])  # noqa: F841
    found = duckdb.sql("select i, j from frame where levenshtein(s, t) <= floor(0.2 * greatest(length(s), length(t)) + 1e-9)").fetchall()
    return [(lines[i], lines[j]) for i, j in found]


def test_line_links_find_close_lines(spark, texts):
    """Brute force over all pairs, which knows nothing of sketches."""
    lines = {regex.sub(r"[^\p{L}\p{N}]+", " ", y.lower()).strip() for x in texts.values() for y in (x or "").split("\n")}
    lines = sorted(y for y in lines if 20 <= len(y) <= 2000)
    pairs = _close_pairs(lines)
    assert len(pairs) > 30
    frame = spark.createDataFrame(list(enumerate(lines)), "c long, norm string").withColumn("sk", line_dedup.sketches(F.col("norm")))
    got = {(lines[r.a], lines[r.b]) for r in line_dedup.candidates(frame.selectExpr("c", "length(norm) len", "sk"), 0.8).collect()}
    both = sum((a, b) in got or (b, a) in got for a, b in pairs)
    assert both >= 0.95 * len(pairs)
    at = {y: k for k, y in enumerate(lines)}
    linked = {r["node"]: r["component"] for r in line_dedup.line_links(frame.selectExpr("c", "length(norm) len", "sk"), frame.select("c", "norm"), 0.8).collect()}
    joined = sum(linked.get(at[a], at[a]) == linked.get(at[b], at[b]) for a, b in pairs)
    assert joined >= 0.95 * len(pairs)
    close = {at[x] for p in pairs for x in p}
    assert set(linked) <= close  # no line goes that has no like


def test_copies_in_large_groups_are_joined(spark):
    """Blocks that more classes share than are compared each with each."""
    base = [f"word{k:03d}" for k in range(60)]
    lines = [" ".join([*base[: k % 55], f"other{k}", *base[k % 55 + 1 :]]) for k in range(150)]
    lines += [" ".join(["common", "words", "ahead", *(f"u{k}x{j}" for j in range(20))]) for k in range(100)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.report(docs).collect() if r.removed}
    assert gone == set(range(1, 150))


def test_report_and_dropped_lines(spark):
    docs = spark.createDataFrame([(1, "A b\n\nc"), (2, "a B!\nnew\nc."), (None, "c\n--"), (3, None), (4, "")], "doc_id long, text string").selectExpr("*", "1 as id", "2 as c", "'x' as norm")
    told = line_dedup.report(docs)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in told.collect()}
    assert got == {None: (2, 0, []), 1: (3, 1, [2]), 2: (3, 2, [0, 2]), 3: (1, 0, []), 4: (1, 0, [])}
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(docs.where("doc_id is not null"), told).collect()}
    assert kept == {1: "A b\n", 2: "new", 3: None, 4: ""}
    assert line_dedup.report(docs.limit(0)).collect() == []
