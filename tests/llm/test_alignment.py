"""Alignment against its definition in plain Python with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tradewind.llm import alignment
from tradewind.llm.queries import op13_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _tokens(text):
    """(id, start, stop) by either tokenizer; none where the bytes do not spell the text."""
    side = Tokenizer.from_file(A)
    side.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in printed)}
    ids = side.encode(" " + text, add_special_tokens=False).ids if text else []
    a = [(i, bytes(names[c] for c in side.id_to_token(i))) for i in ids]
    b = []
    for i in model.encode(text) if text else []:
        name = model.id_to_piece(i)
        b.append((i, bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()))
    if not text or any(b"".join(p for _, p in side_) != (" " + text).encode() for side_ in (a, b)):
        return [], []
    out = []
    for side_ in (a, b):
        at, rows = 0, []
        for i, piece in side_:
            rows.append((i, at, at + len(piece)))
            at += len(piece)
        out.append(rows)
    return out


def _brute(rows, link):
    told = {k: _tokens(t) for k, (_, t) in enumerate(rows)}
    meets = (lambda x, y: x[2] == y[2]) if link == "end" else (lambda x, y: x[1] < y[2] and y[1] < x[2])
    links = {k: [(x[0], y[0]) for x in a for y in b if meets(x, y)] for k, (a, b) in told.items()}
    count = Counter(p for ps in links.values() for p in ps)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for k, (i, _) in enumerate(rows):
        a, b = told[k]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        parts, low = [], 0
        for cut in cuts:
            parts.append("|".join(",".join(str(x[0]) for x in side if low < x[2] <= cut) for side in (a, b)))
            low = cut
        groups = ";".join(parts)
        out.append((i, len(a), len(b), len(cuts), len(links[k]), sum(count[p] == most[p[1]] for p in links[k]), sum(count[p] for p in links[k]), groups))
    return out, count, most


TEXTS = [
    "the cat sat on the mat", "The  double  blank", " leading", "trailing ", "", None, "a", " ", "\n", "été où naïve Straße", "日本語 text 🙂 emoji", "<|endoftext|> <s> </s> <unk> <0x41>",
    "under▁score", "ﬁne ½ ligature", "tab\there\r\nline", "x" * 300, "don't we'll I'd they're", "1234567 89.5%", "\x00nul \x7f", "the cat sat on the mat", "क़ \U0001e900 ᠎ mongol", "é combining",
]


@pytest.mark.parametrize("link", ["end", "overlap"])
def test_alignment_is_its_definition(spark, link, monkeypatch):
    rng = random.Random(7)
    words = ["the", "of", "wörter", "extraordinary", "zzyzx", "Ελλάδα", "don't", "42", "—", "ok."]
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for k in range(60)] + [(None, "no id"), (None, None), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS n_a", "1 AS block").repartition(3)
    made = alignment.align(docs, A, B, link=link)
    want, count, most = _brute(rows, link)
    got = [tuple(r) for r in made.documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    pairs = {(r.a_id, r.b_id): (r.n_links, r.best) for r in made.pairs.collect()}
    assert pairs == {p: (n, n == most[p[1]]) for p, n in count.items()}


def test_units_are_the_texts():
    """Texts aligned by their units, in one block or alone, are as they are when aligned whole."""
    rng = random.Random(9)
    marks = ["a", "the", "é", "\u0301x", "\u0301", "日本", "▁", "½", "\n", "\t", "", " ", "'s", "x\ny", "🙂", "\x85", "\x1c", "\u00a0", "<s>", "0", "..", "\u200b", "ﬁ"]
    texts = [" ".join(rng.choices(marks, k=rng.randint(1, 6))) for _ in range(300)] + [t for t in TEXTS if t]
    sides = alignment._sides(A, B)
    known = alignment._Known(sides, "end")
    cut = known.cut(texts)
    for text, units in zip(texts, cut, strict=True):
        got = alignment.align_units([text], sides)
        assert (got["groups"][0] or b"") == b";".join(known.groups[u] for u in units), text
        assert [int(got[k][0]) for k in alignment.FACTS] == known.facts[units].sum(axis=0).tolist()


def test_query_hashes_groups(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, _, _ = _brute(rows, "end")
    got = {r.doc_id: tuple(r) for r in op13_alignment(spark, str(tmp_path)).collect()}
    assert got == {w[0]: (*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in want}


def test_empty_table(spark):
    made = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert made.documents.count() == 0 and made.pairs.count() == 0


def test_fast_ids_are_the_library_s():
    """Random texts of all planes, blanks and long pieces."""
    rng = random.Random(11)
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    side = alignment.byte_side(A)
    pools = ["abc ", "aé  \u0085\t\n", "'stdml ", "".join(map(chr, range(0x20, 0x250))), "αβγ 中文字 ١٢٣ ", "".join(chr(c) for c in range(0x250, 0x3000)), "🙂𝒜𐐀 ᠎​ "]
    texts = ["".join(rng.choices(rng.choice(pools), k=rng.randint(1, 60))) for _ in range(3000)] + [" " * 50_000, "a" * 5_000, "ab" * 4_000 + " x", "\n" * 30_000 + "x"]
    assert side.encode(texts) == [x.ids for x in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]
