"""Two tokenizers side by side: where their tokens end together, and which tokens stand for which.

Texts are cut into units where neither tokenizer joins characters, and a block of texts has each
of its units tokenized and aligned once. Their tokens are interval tables of byte offsets in DuckDB,
inside the Arrow task: a join of ends gives the cuts, a window sum numbers the groups between
cuts, ASOF joins put each token into its group, and links are ends that meet or, by two ASOF
joins and the range between them, ranges that overlap. A block counts its pairs of ids; Spark adds
the counts of all blocks, and answers each block with the counts of just the pairs it has. So
no row of a shuffle stands for one token or one link, and a pair that every text has is one row
a block.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of units and their groups that a worker remembers from block to block, each counted with 300 more.
REMEMBERED = 112 << 20
#: The pattern by which byte-level BPE cuts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHIFT = 32
FACTS = ("n_a", "n_b", "n_groups", "n_links")


#: A single space between two characters that are no blanks, the second of which joins none before it.
_UNITS = regex.compile(r"(?<=\S) (?=[^\s\p{M}])").split
#: Spaces beside other blanks, blanks of rare kinds, and spaces before what may be a combining mark: a text with none of these, and none at its ends, is cut at each space.
_BESIDE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_RARE = re.compile(r"[^\S \n\t\r]| [\u0300-\u1fff\u20d0-\u20ff\u2cef-\U0010ffff]").search
#: Units that may be encoded in one text, with single spaces between them.
_JOINED = re.compile(r"[^\s\u0250-\U0010ffff](?:[^\u0250-\U0010ffff]{0,2000}[^\s\u0250-\U0010ffff])?").fullmatch
_JOIN = 8192


def cut_units(text: str) -> list[str]:
    """`text` without the single spaces between its words; blanks of other kinds, or in other places, stay in the units."""
    return _UNITS(text) if text[:1] == " " or text[-1:] == " " or any(x in text for x in _BESIDE) or _RARE(text) else text.split(" ")


class Side(NamedTuple):
    """One tokenizer in a worker: `encode` gives ids of texts, `pieces` the bytes of each id; `apart` tells whether units can be encoded one by one."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: list[bytes]
    apart: bool
    widths: np.ndarray


def _side(encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes], apart: bool) -> Side:
    return Side(encode, pieces, apart, np.array(list(map(len, pieces)), dtype=np.int64))


@cache
def _settled() -> np.ndarray:
    """Whether a character of the first plane has the same category in Unicode 3.2 as now, so that all libraries cut alike there."""
    old = unicodedata.ucd_3_2_0.category
    return np.array([old(c) == unicodedata.category(c) != "Cn" for c in map(chr, range(1 << 16))])


def _byte_names() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printed ones as they are, others from U+0100 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printed]
    return {**{chr(b): b for b in printed}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


def byte_side(path: str) -> Side:
    """A byte-level BPE file of the tokenizers library; its special tokens are plain text, and a space is put before the text.

    Where merges are in the order of their ids and the usual pattern cuts, ids are the ranks of
    tiktoken, which makes the same ids in a fraction of the time; texts with characters on which
    versions of Unicode differ, and long ones, go to the library itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    names, model = _byte_names(), told["model"]
    pieces = [b""] * (1 + max(model["vocab"].values()))
    for piece, i in model["vocab"].items():
        pieces[i] = bytes(names[c] for c in piece)

    def slow(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in library.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]

    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    cut = told.get("pre_tokenizer") or {}
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and told.get("normalizer") is None
    if not usual or merged != sorted(set(merged)) or len(set(pieces)) != len(pieces) or model.get("ignore_merges"):
        return _side(slow, pieces, usual)
    import tiktoken

    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})

    def settled(text: str) -> bool:
        if len(text) > 2 * _JOIN:
            return False
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        return text.isascii() or int(codes.max()) < 1 << 16 and bool(_settled()[codes].all())

    def encode(texts: list[str]) -> list[list[int]]:
        return [fast.encode_ordinary(f" {t}") if settled(t) else slow([t])[0] for t in texts]

    return _side(encode, pieces, True)


def piece_side(path: str) -> Side:
    """A sentencepiece model, which puts the space itself; control and unknown pieces have no bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def piece(i: int) -> bytes:
        name = model.id_to_piece(i)
        if model.is_byte(i):
            return bytes([int(name[3:5], 16)])
        return b"" if model.is_control(i) or model.is_unknown(i) else name.replace("▁", " ").encode()

    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    return _side(lambda texts: model.encode(texts, num_threads=1), [piece(i) for i in range(len(names))], all("▁" not in x.lstrip("▁") for x in names))


@cache
def _sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    """Both tokenizers, read once a worker."""
    return byte_side(a_path), piece_side(b_path)


def _flat(coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, the text of each)."""
    counts = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    return np.fromiter(chain.from_iterable(coded), dtype=np.int32, count=int(counts.sum())), np.repeat(np.arange(len(coded), dtype=np.int32), counts)


def _intervals(ids: np.ndarray, widths: np.ndarray, ends: np.ndarray) -> pa.Table:
    """(doc, pos, id, start, stop): tokens with their byte offsets in texts put together, which end at `ends`."""
    stop = np.cumsum(widths[ids])
    return pa.table({"doc": np.searchsorted(ends, stop).astype(np.int32), "pos": np.arange(len(ids), dtype=np.int64), "id": ids, "start": stop - widths[ids], "stop": stop})


def _encoded(texts: list[str], sides: tuple[Side, Side]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(places of the texts that both sides spell, in some order; their ids by side, put together; their bytes).

    Short texts of common letters are encoded some at a time, with spaces between, and apart
    only if the tokens do not spell them so or do not end where they do.
    """
    places, parts, sizes = [], ([], []), []

    def add(some: list[int]) -> None:
        joined = " ".join([texts[k] for k in some])
        want = f" {joined}".encode()
        coded = [side.encode([joined])[0] for side in sides]
        if all(b"".join(map(side.pieces.__getitem__, c)) == want for side, c in zip(sides, coded, strict=True)):
            ids = [np.array(c, dtype=np.int32) for c in coded]
            bytes_ = [len(texts[k].encode()) + 1 for k in some]
            ends = np.cumsum(bytes_)
            if len(some) == 1 or all(np.isin(ends, np.cumsum(side.widths[i])).all() for side, i in zip(sides, ids, strict=True)):
                places.extend(some)
                sizes.extend(bytes_)
                for part, i in zip(parts, ids, strict=True):
                    part.append(i)
                return
        if len(some) > 1:
            add(some[: len(some) // 2])
            add(some[len(some) // 2 :])

    together = all(side.apart for side in sides)
    short = [k for k, t in enumerate(texts) if together and _JOINED(t)]
    for begin, end in _spans([len(texts[k]) for k in short], _JOIN):
        add(short[begin:end])
    for k in sorted(set(range(len(texts))).difference(short)):
        if texts[k]:
            add([k])
    return np.array(places, dtype=np.int64), [np.concatenate(part) if part else np.empty(0, dtype=np.int32) for part in parts], np.array(sizes, dtype=np.int64)


#: The links of a block as (doc, x, y): tokens whose ranges end together, or share a byte.
_LINKS = {
    "end": "SELECT doc, ia AS x, ib AS y FROM meet",
    "overlap": """WITH lo AS (SELECT a.doc, a.id, a.stop, b.pos AS first FROM a ASOF JOIN b ON a.start < b.stop),
  span AS (SELECT lo.doc, lo.id, first, b.pos AS last FROM lo ASOF JOIN b ON lo.stop > b.start)
  SELECT span.doc, span.id AS x, b.id AS y FROM (SELECT doc, id, unnest(range(first, last + 1)) AS at FROM span) span JOIN b ON b.pos = span.at""",
}


def _groups_text(a: pa.Table, b: pa.Table, ga: np.ndarray, gb: np.ndarray) -> list[bytes]:
    """The groups of each text that has some, as in `a1,a2|b1;a3|b2`, in the order of the texts; `ga` and `gb` number the groups of all tokens from 0."""
    n = int(ga[-1]) + 1
    of_a, of_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    last = lambda g: np.append(g[1:] != g[:-1], True).astype(np.int64)
    out = np.empty(len(ga) + len(gb), dtype=object)
    out[np.arange(len(ga)) + (np.cumsum(of_b) - of_b)[ga]] = _names(a["id"].to_numpy(), last(ga), b",", b"|")
    out[np.arange(len(gb)) + np.cumsum(of_a)[gb]] = _names(b["id"].to_numpy(), last(gb), b",", b";")
    stops = np.bincount(a["doc"].to_numpy()) + np.bincount(b["doc"].to_numpy())
    ends = np.cumsum(stops[stops > 0])
    return [b"".join(out[i:j].tolist())[:-1] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


@cache
def _written(n: int, mark: bytes) -> np.ndarray:
    return np.array([b"%d%s" % (i, mark) for i in range(n)], dtype=object)


def _names(ids: np.ndarray, last: np.ndarray, between: bytes, after: bytes) -> np.ndarray:
    """Ids in decimal, each with the mark that follows it."""
    n = 1 << int(ids.max()).bit_length()
    return np.where(last == 1, _written(n, after)[ids], _written(n, between)[ids])


def align_units(texts: list[str], sides: tuple[Side, Side], link: str = "end") -> dict:
    """The alignment of some texts: facts (n_a, n_b, n_groups, n_links by text), groups (bytes by text or None), and links (doc, pair, n) counted by text, in the order of texts.

    A text that is empty, or that the tokens of either side do not spell with a space before it,
    has no tokens.
    """
    import duckdb

    place, ids, sizes = _encoded(texts, sides)
    ends = np.cumsum(sizes)
    a, b = (_intervals(i, side.widths, ends) for i, side in zip(ids, sides, strict=True))
    n = len(texts)
    out = {k: np.zeros(n, dtype=np.int64) for k in FACTS}
    out |= {"groups": [None] * n, "links": pa.table({"doc": np.empty(0, dtype=np.int32), "pair": np.empty(0, dtype=np.int64), "n": np.empty(0, dtype=np.int64)})}
    if not len(place):
        return out
    with duckdb.connect(config={"threads": 1}) as con:
        con.register("a", a)
        con.register("b", b)
        con.execute("CREATE TEMP TABLE meet AS SELECT a.doc, a.stop, a.id AS ia, b.id AS ib FROM a JOIN b ON a.stop = b.stop")
        con.execute("CREATE TEMP TABLE cuts AS SELECT doc, stop, (sum(1) OVER (ORDER BY stop ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS g FROM meet")
        group_of = []
        for side, rows in (("a", a), ("b", b)):
            placed = con.sql(f"SELECT {side}.pos, cuts.g FROM {side} ASOF JOIN cuts ON {side}.stop <= cuts.stop").fetchnumpy()
            g = np.empty(len(rows), dtype=np.int64)
            g[placed["pos"]] = placed["g"]
            group_of.append(g)
        n_groups = con.sql("SELECT doc, count(*) AS n FROM cuts GROUP BY doc").fetchnumpy()
        links = con.sql(f"SELECT doc, (x::BIGINT << {_SHIFT}) | y AS pair, count(*) AS n FROM ({_LINKS[link]}) GROUP BY ALL").to_arrow_table()
    for name, rows in (("n_a", a), ("n_b", b)):
        out[name][place] = np.bincount(rows["doc"].to_numpy(), minlength=len(place))
    out["n_groups"][place[n_groups["doc"]]] = n_groups["n"]
    of = place[links["doc"].to_numpy()]
    order = np.argsort(of, kind="stable")
    out["n_links"] += np.bincount(of, weights=links["n"].to_numpy(), minlength=n).astype(np.int64)
    for k, text in zip(place.tolist(), _groups_text(a, b, *group_of), strict=True):
        out["groups"][k] = text
    out["links"] = pa.table({"doc": of[order].astype(np.int32), "pair": links["pair"].to_numpy()[order], "n": links["n"].to_numpy()[order]})
    return out


class _Known:
    """Units that a worker has met, numbered, with what their alignment gave."""

    def __init__(self, sides: tuple[Side, Side], link: str) -> None:
        self.sides, self.link = sides, link
        self.apart = all(side.apart for side in sides)
        self.forget()

    def forget(self) -> None:
        self.held = 0
        self.odd: set[int] = set()  # units without tokens
        self.number: dict[str, int] = {}
        self.groups: list[bytes | None] = []
        self.facts = np.empty((0, len(FACTS)), dtype=np.int64)
        self.starts, self.pair, self.times = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def meet(self, units: set[str]) -> None:
        """Align those of `units` that are new."""
        fresh = list(units - self.number.keys())
        for begin, end in _spans([len(u) for u in fresh], BLOCK_BYTES):
            some = fresh[begin:end]
            got = align_units(some, self.sides, self.link)
            self.number.update(zip(some, range(len(self.groups), len(self.groups) + len(some)), strict=True))
            self.odd.update(len(self.groups) + n for n, g in enumerate(got["groups"]) if g is None)
            self.groups += got["groups"]
            self.held += sum(300 + len(u) + len(g or b"") for u, g in zip(some, got["groups"], strict=True))
            self.facts = np.concatenate((self.facts, np.stack([got[k] for k in FACTS], axis=1)))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.bincount(got["links"]["doc"].to_numpy(), minlength=len(some)))))
            self.pair = np.concatenate((self.pair, got["links"]["pair"].to_numpy()))
            self.times = np.concatenate((self.times, got["links"]["n"].to_numpy()))

    def cut(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of the units of each text; none for a text without tokens.

        A text of which a unit is not spelled is aligned whole.
        """
        if self.held > REMEMBERED:
            self.forget()
        cut = [[] if not t else cut_units(t) if self.apart else [t] for t in texts]
        self.meet(set(chain.from_iterable(cut)))
        out = [list(map(self.number.__getitem__, us)) for us in cut]
        bad = [k for k, us in enumerate(out) if not self.odd.isdisjoint(us)] if self.odd else []
        self.meet({texts[k] for k in bad})
        for k in bad:
            n = self.number[texts[k]]
            out[k] = [] if self.groups[n] is None else [n]
        return out

    def links(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `units`, pair, n) of their links."""
        counts = self.starts[units + 1] - self.starts[units]
        stop = np.cumsum(counts)
        at = np.repeat(self.starts[units] - (stop - counts), counts) + np.arange(int(stop[-1]) if len(stop) else 0)
        return np.repeat(np.arange(len(units)), counts), self.pair[at], self.times[at]


def _spans(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches of `sizes` that sum up to `most` at most, or are a single one."""
    begin = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, k
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _small(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the greatest needs, after a byte that tells how many."""
    kind = np.min_scalar_type(int(numbers.max()) if len(numbers) else 0).newbyteorder("<")
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


class Alignment(NamedTuple):
    """`documents` (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) and `pairs` (a_id, b_id, n_links, best)."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", link: str = "end", groups_as: Callable[[bytes], str] = bytes.decode) -> Alignment:
    """Align the tokens of file `a_path` (byte-level BPE, a space put before the text) and `b_path` (sentencepiece) in each text.

    Groups lie between byte offsets where tokens of both sides end; `groups` has them as
    `groups_as` makes them of `a1,a2|b1;a3|b2`, and '' for a text without tokens: a null or empty
    one, or one that a side's tokens do not spell. Links join tokens that end together, or with
    `link` 'overlap' those that share a byte. A pair's count is the number of its links in all
    texts; `best` and n_best tell the links whose count is the greatest of their B id, ties
    included, and count_sum adds counts over links. Each row of `docs` is one of the result,
    whatever its id, null ids included; no other column is looked at; an empty table gives
    empty tables. The result is staged: blocks are tokenized once.
    """
    if link not in _LINKS:
        raise ValueError(f"link is one of {sorted(_LINKS)}")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, made = _Known(_sides(a_path, b_path), link), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for begin, end in _spans([x or 0 for x in pc.binary_length(batch.column("text")).to_pylist()], BLOCK_BYTES):
                block = batch.slice(begin, end - begin)
                cut = known.cut(block.column("text").to_pylist())
                words, of = _flat(cut)
                unit, word = np.unique(words, return_inverse=True)
                upto = np.concatenate((np.zeros((1, len(FACTS)), dtype=np.int64), np.cumsum(known.facts[words], axis=0)))
                stop = np.cumsum(np.bincount(of, minlength=len(cut)))
                facts = upto[stop] - upto[np.concatenate(([0], stop[:-1]))]
                groups = [groups_as(b";".join(map(known.groups.__getitem__, us))) if us else "" for us in cut]
                told = pa.table({"id": block.column("id"), **{k: facts[:, n] for n, k in enumerate(FACTS)}, "groups": pa.array(groups, pa.string()), "units": np.diff(stop, prepend=0)})
                place, pair, n = known.links(unit)
                pairs, k = np.unique(pair, return_inverse=True)
                times = np.bincount(k, weights=n * np.bincount(word, minlength=len(unit))[place], minlength=len(pairs)).astype(np.int64)
                spots = {"words": word, "per_unit": np.bincount(place, minlength=len(unit)), "k": k, "n": n}
                yield pa.RecordBatch.from_pydict({"block": [base + made], "docs": [_packed(told)], **{c: [_small(x)] for c, x in spots.items()}, "pairs": pa.array([pairs], pa.list_(pa.int64())), "times": pa.array([times], pa.list_(pa.int64()))})
                made += 1

    blocks = stage(slim.mapInArrow(first, "block long, docs binary, words binary, per_unit binary, k binary, n binary, pairs array<long>, times array<long>"), "token-blocks")
    said = blocks.select("block", F.explode(F.arrays_zip("pairs", "times")).alias("m")).select("block", F.col("m.pairs").alias("pair"), F.col("m.times").alias("n"))
    counts = stage(said.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND((1 << _SHIFT) - 1)
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("b_id", b_id).join(most, "b_id").select("pair", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))
    # answers repeat a block's pairs in their order, so numbers of pairs stand for them
    fact = F.struct("pair", F.col("n").alias("count"), "best")
    answers = said.select("block", "pair").join(judged.drop("b_id"), "pair").groupBy("block").agg(F.array_sort(F.collect_list(fact)).alias("m")).select("block", F.col("m.count").alias("counts"), F.col("m.best").alias("best"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        for batch in batches:
            for k in range(batch.num_rows):
                told = pa.ipc.open_stream(batch.column("docs")[k].as_buffer()).read_all()
                words, per_unit, pair, n = (_large(batch.column(c)[k].as_py()) for c in ("words", "per_unit", "k", "n"))
                n_best, count_sum = np.zeros(len(told), dtype=np.int64), np.zeros(len(told), dtype=np.int64)
                if len(pair):
                    words = pa.table({"doc": np.repeat(np.arange(len(told), dtype=np.int32), told["units"].to_numpy()), "unit": words})
                    links = pa.table({"unit": np.repeat(np.arange(len(per_unit)), per_unit), "k": pair, "n": n})
                    answer = pa.table({"k": np.arange(len(batch.column("counts")[k])), "count": batch.column("counts")[k].values, "best": batch.column("best")[k].values})
                    with duckdb.connect(config={"threads": 1}) as con:
                        for name, rows in (("words", words), ("links", links), ("answer", answer)):
                            con.register(name, rows)
                        sums = con.sql("""WITH u AS (SELECT unit, coalesce(sum(n) FILTER (best), 0)::BIGINT AS b, sum(n * count)::BIGINT AS c FROM links JOIN answer USING (k) GROUP BY unit)
                          SELECT doc, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c FROM words JOIN u USING (unit) GROUP BY doc""").fetchnumpy()
                    n_best[sums["doc"]], count_sum[sums["doc"]] = sums["b"], sums["c"]
                whole = told.drop_columns("units").append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
                yield from whole.combine_chunks().to_batches()

    both = blocks.drop("pairs", "times").join(answers, "block", "left")
    documents = both.mapInArrow(second, "id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    pairs = judged.select(F.shiftright("pair", _SHIFT).alias("a_id"), "b_id", F.col("n").alias("n_links"), "best")
    return Alignment(documents.withColumnRenamed("id", id_col), pairs)
