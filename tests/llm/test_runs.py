"""Periodic runs against a brute-force search, their query against plain Python, and the cost of periodic texts."""

import hashlib
import random
import zlib

import pytest
from tradewind.llm import runs
from tradewind.llm.queries import op11_runs


def brute(words, times=4, least=6):
    """Every longest stretch of each period, without those that have a smaller one."""
    n, out = len(words), []
    for p in range(1, n // times + 1):
        at = 0
        while at + p < n:
            begin = at
            while at + p < n and words[at] == words[at + p]:
                at += 1
            length = at + p - begin
            if at > begin and length >= max(least, times * p) and not any(all(words[begin + k] == words[begin + k + q] for k in range(length - q)) for q in range(1, p)):
                out.append((begin, length, p))
            at = max(at, begin + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("times", "least"), [(4, 6), (3, 1), (2, 2)])
def test_runs_are_all_and_only_those(times, least):
    rng = random.Random(times)
    for _ in range(2000):
        n, letters = rng.randint(0, 60), rng.randint(1, 3)
        w = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        assert runs.word_runs(w, times, least) == brute(w, times, least)


def test_comparisons_grow_with_the_words():
    """Eleven comparisons of words a word at most, under both orders, however periodic the text is."""

    class Word:
        made = 0

        def __init__(self, name):
            self.name = name

        def _told(op):
            def compare(self, other):
                Word.made += 1
                return getattr(self.name, op)(other.name)

            return compare

        __eq__, __ne__, __lt__, __gt__, __hash__ = _told("__eq__"), _told("__ne__"), _told("__lt__"), _told("__gt__"), None

    fib = ["a", "ab"]
    while len(fib[-1]) < 30_000:
        fib.append(fib[-1] + fib[-2])
    texts = ["a" * 30_000, "ab" * 15_000, fib[-1], (("aaab" * 3 + "c") * 3 + "d") * 700, "".join("ab"[i.bit_count() & 1] for i in range(30_000)), [str(i % 777) for i in range(30_000)]]
    for text in texts:
        Word.made = 0
        runs.word_runs([Word(x) for x in text])
        assert Word.made <= 11 * len(text)


def plain(doc_id, text):
    """The row of the query by its definition."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {k for s, length, p in found for k in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return (doc_id, len(found), *best, None if best[1] is None else 1000 * best[1] // best[2], sha(lines.encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_is_its_definition(spark, tmp_path):
    """Ids with and without a planted end, null ids and texts, blanks of all kinds, repeated rows, long texts."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    texts += [None, "", " \t\n", "x y x y x y x y", "ha\x0bha\x0cha\rha\nha\tha", "é " * 40, "one", " ".join(str(i % 50) for i in range(700))]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "z " * 9, "x"), (None, None, "x"), (3, texts[3], "y")]
    spark.createDataFrame(rows, "doc_id long, text string, best string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op11_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain(i, t) for i, t, _ in rows), key=str)


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert runs.find_runs(docs).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs.withColumnRenamed("doc_id", "runs"))


def test_collapsed_text_keeps_one_period(spark):
    docs = spark.createDataFrame([("say ha ha ha ha ha ha now",), ("a b a b a b a b c",), ("no no",)], "text string")
    assert [(r.collapsed, [tuple(x) for x in r.runs]) for r in runs.find_runs(docs).collect()] == [("say ha now", [(1, 6, 1)]), ("a b c", [(0, 8, 2)]), ("no no", [])]
