"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A file holds documents in ascending order of their ids. Token ids are replaced by their
rank of frequency over the whole corpus, so that the most frequent 256 take one byte;
a rank takes 1 to 4 bytes, little-endian, and the numbers of bytes stand apart as two
bits each in control bytes. A reader expands the control bytes by a numpy table of 256
rows into byte counts and gathers the ranks without a loop.

File layout, little-endian: magic "TWTK", u32 documents d, u64 control bytes c, u32 ranked
ids v, u64 data bytes; then v u32 ids in order of rank, d i64 document ids, d u32 token
counts, c control bytes, data bytes. The control bytes of a document start at a byte of
their own, so that coded documents are put together as they are. Only ids that occur in
the corpus have a rank.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import drop_path, new_path, stage

MAGIC = b"TWTK"
_HEAD = struct.Struct("<4sIQIQ")
#: Row b: how many bytes each of the four ranks described by control byte b takes.
WIDTHS = np.array([[(b >> s & 3) + 1 for s in (0, 2, 4, 6)] for b in range(256)], dtype=np.uint8)
#: A file is closed at the end of the document that fills it.
FILE_TOKENS = 4_000_000
#: Pieces whose ids one Python worker remembers.
CACHE = 850_000
#: Documents that are handled as one array.
BATCH = 512
#: Pairs of blanks that make a text one to be cut with care, and other blanks that may.
_DOUBLE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_RARE = re.compile(r"[^\S \n\t\r]").search
_SPLIT = re.compile(r"(?<=\S) (?=\S)").split
#: The pattern by which byte-level BPE cuts a text, and its names of bytes.
_PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _PRINTED]
_BYTE_NAMES = {**{b: b for b in _PRINTED}, **{b: 256 + k for k, b in enumerate(_HIDDEN)}}
#: No blank, and only characters on which all versions of Unicode agree.
_PLAIN = re.compile(r"[^\s\u0250-\U0010ffff]+").fullmatch


def _cut(text: str) -> list[str]:
    """`text` between its single blanks; the pieces after the first one lack the blank before them."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or any(d in text for d in _DOUBLE) or _RARE(text):
        return _SPLIT(text)
    return text.split(" ")


class _Numbers(dict):
    """Strings to numbers from 0; a new one gets the next and is noted in `fresh`."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, name: str) -> int:
        self[name] = n = len(self)
        self.fresh.append(name)
        return n


class _Runs:
    """Numbered runs of ids in one array that grows."""

    def __init__(self) -> None:
        self.ids, self.starts, self.lens = np.empty(1 << 16, dtype=np.uint32), np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        used = int(self.starts[-1])
        if used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[:used], np.empty(used + 2 * len(flat), dtype=np.uint32)))
        self.ids[used : used + len(flat)] = flat
        self.starts = np.concatenate((self.starts, used + np.cumsum(lens)))
        self.lens = np.concatenate((self.lens, lens))

    def take(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of these runs, put together, how many each has)."""
        lens = self.lens[number]
        stop = np.cumsum(lens)
        at = np.repeat(self.starts[number] - (stop - lens), lens) + np.arange(int(stop[-1]) if len(stop) else 0)
        return self.ids[at], lens


def _flatten(coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    return np.fromiter(chain.from_iterable(coded), dtype=np.uint32, count=int(lens.sum())), lens


class PieceTokenizer:
    """A byte-level BPE tokenizer that meets each distinct piece once.

    Texts are cut before single spaces between two non-blank characters. The tokenizer's own
    pattern never joins characters across such a place and its pieces are encoded one by
    one, so the ids of a text are those of its parts, put together. New pieces of common
    letters are cut by the pattern here and go to the library's BPE model part by part; others
    go to the library whole. A tokenizer that does anything but byte-level BPE by that pattern
    gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        cut, model = told.get("pre_tokenizer") or {}, told["model"]
        self.by_piece = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True) and told.get("normalizer") is None and all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told["added_tokens"])
        self.plain = self.by_piece and model["type"] == "BPE" and not model.get("dropout")
        self.marks = [t["content"] for t in told["added_tokens"]]
        self.part_numbers, self.parts = _Numbers(), _Runs()
        self.clear()

    def clear(self) -> None:
        self.numbers, self.pieces = (_Numbers(), _Numbers()), (_Runs(), _Runs())  # of the first pieces of texts, and of the others
        if len(self.part_numbers) > CACHE:
            self.part_numbers, self.parts = _Numbers(), _Runs()

    def _learn(self, k: int) -> None:
        fresh, self.numbers[k].fresh = self.numbers[k].fresh, []
        if not fresh:
            return
        told = [" " + p for p in fresh] if k else fresh
        # put together, pieces that begin with their only blank are cut at these again
        odd = [] if k and self.plain else list(range(len(told)))
        if not odd:
            odd = [i for i, p in enumerate(fresh) if not _PLAIN(p)]
            if any(m in "".join(told) for m in self.marks):
                odd = sorted({*odd, *(i for i, p in enumerate(fresh) if any(m in p for m in self.marks))})
        skip = set(odd)
        good = [p for i, p in enumerate(told) if i not in skip] if skip else told
        cut = _PATTERN("".join(good))
        number = np.fromiter(map(self.part_numbers.__getitem__, cut), dtype=np.int64, count=len(cut))
        new, self.part_numbers.fresh = self.part_numbers.fresh, []
        tokenize = self.tokenizer.model.tokenize
        names = [p.replace(" ", "\u0120") if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_BYTE_NAMES) for p in new]
        self.parts.add(*_flatten([[t.id for t in tokenize(n)] for n in names]))
        flat, per_part = self.parts.take(number)
        ends = np.searchsorted(np.cumsum(np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))), np.cumsum(np.fromiter(map(len, good), dtype=np.int64, count=len(good)))) + 1
        total = np.concatenate(([0], np.cumsum(per_part)))[ends]
        lens = np.diff(total, prepend=0)
        if odd:  # put the others in between
            other, of = _flatten([self.tokenizer.encode(told[i], add_special_tokens=False).ids for i in odd])
            mine = np.ones(len(told), dtype=bool)
            mine[odd] = False
            both = np.empty(len(told), dtype=np.int64)
            both[mine], both[~mine] = lens, of
            from_good, out = np.repeat(mine, both), np.empty(int(both.sum()), dtype=np.uint32)
            out[from_good], out[~from_good] = flat, other
            flat, lens = out, both
        self.pieces[k].add(flat, lens)

    def _number(self, k: int, pieces, n: int) -> np.ndarray:
        out = np.fromiter(map(self.numbers[k].__getitem__, pieces), dtype=np.int64, count=n)
        self._learn(k)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        if not self.by_piece:
            coded = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            return np.fromiter(chain.from_iterable(coded), dtype=np.uint32), np.fromiter(map(len, coded), dtype=np.int64)
        if len(self.numbers[1]) > CACHE:
            self.clear()
        cut = [_cut(t) for t in texts]
        n = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        heads = self._number(0, (c[0] for c in cut if c), int((n > 0).sum()))
        tails = self._number(1, chain.from_iterable(c[1:] for c in cut), int(np.maximum(n - 1, 0).sum()))
        ends = np.cumsum(n)
        lead = np.zeros(int(n.sum()), dtype=bool)
        lead[(ends - n)[n > 0]] = True
        (ids0, len0), (ids1, len1) = self.pieces[0].take(heads), self.pieces[1].take(tails)
        lens = np.empty(len(lead), dtype=np.int64)
        lens[lead], lens[~lead] = len0, len1
        from_lead, out = np.repeat(lead, lens), np.empty(int(lens.sum()), dtype=np.uint32)
        out[from_lead], out[~from_lead] = ids0, ids1
        return out, _sums(lens, n)


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


def _sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of `counts` elements each."""
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of the u32 ranks of documents of `counts` tokens, and how many of each a document has."""
    width = (1 + (ranks > 0xFF).view(np.uint8) + (ranks > 0xFFFF).view(np.uint8) + (ranks > 0xFFFFFF).view(np.uint8)).astype(np.uint8)
    controls = (counts + 3) // 4
    ends = np.cumsum(counts)
    shift = np.repeat(4 * (np.cumsum(controls) - controls) - (ends - counts), counts)
    code = np.zeros(4 * int(controls.sum()), dtype=np.uint8)
    code[np.arange(len(ranks)) + shift] = width - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control, raw[np.arange(4) < width[:, None]], controls, _sums(width, counts)


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks that :func:`pack` coded."""
    controls = (counts + 3) // 4
    real = np.ones(4 * len(control), dtype=bool)
    over, pad = 4 * np.cumsum(controls), 4 * controls - counts
    for k in (1, 2, 3):
        real[over[pad >= k] - k] = False
    width = WIDTHS[control].reshape(-1)[real].astype(np.int64)
    start = np.cumsum(width) - width
    out = np.zeros(len(width), dtype=np.uint32)
    for k in range(4):
        has = np.flatnonzero(width > k)
        if not len(has):
            break
        out[has] |= data[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_file(order: np.ndarray, doc_ids: list[int], counts: list[int], control: bytes, data: bytes) -> bytes:
    """One file of coded documents; `order` has the ids in order of rank."""
    head = _HEAD.pack(MAGIC, len(doc_ids), len(control), len(order), len(data))
    return b"".join((head, order.astype("<u4").tobytes(), np.array(doc_ids, dtype="<i8").tobytes(), np.array(counts, dtype="<u4").tobytes(), control, data))


def read_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, token counts, all token ids) of a file."""
    magic, d, c, v, size = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, dtype=dtype, count=n, offset=at)
        at += out.nbytes
        return out

    order, doc_ids, counts = take("<u4", v), take("<i8", d), take("<u4", d)
    control, data = take("u1", c), take("u1", size)
    return doc_ids, counts, order[unpack(control, data, counts.astype(np.int64))] if len(data) else np.empty(0, dtype=np.uint32)


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column: `data` cut into runs of `sizes` bytes."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    if ends[-1] > 2**31 - 1:
        raise ValueError("a batch of documents over 2 GB of ids")
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8).tobytes())])


def _flat(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values, number of each row's) of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], dtype="<i4", count=len(column) + 1, offset=4 * column.offset).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return np.frombuffer(raw.tobytes(), dtype=dtype), np.diff(offsets) // np.dtype(dtype).itemsize


def id_type(path: str) -> str:
    """Bytes of a token id between the steps: two if the vocabulary allows."""
    return "<u2" if max(tokenizer(path).tokenizer.get_vocab(with_added_tokens=True).values(), default=0) < 65536 else "<u4"


def encode_texts(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, counts): each whole text's token ids with `end_id` after them, as integers of :func:`id_type`; null is empty.

    The last row of a task has null ids, and in counts how often each id occurred in the task.
    """
    kind = id_type(path) if end_id < 65536 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, total = tokenizer(path), np.zeros(end_id + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                ids, n = tok.encode([t or "" for t in some.column(1).to_pylist()])
                ended = np.insert(ids.astype(kind), np.cumsum(n), np.array(end_id, dtype=kind))
                more = np.bincount(ended, minlength=len(total))
                more[: len(total)] += total
                total = more
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), _binaries(ended, (n + 1) * ended.itemsize), pa.nulls(len(some), pa.binary())], ["id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["id", "ids", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, ids binary, counts binary")


def frequency_order(coded: DataFrame) -> np.ndarray:
    """The ids that occur, most frequent first, ties by id, from the counts of all tasks; as long as the vocabulary at most."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                n = np.frombuffer(x.as_py(), dtype="<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["token", "n"])

    counts = coded.where("counts is not null").select("counts").mapInArrow(spread, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = sorted(counts.collect(), key=lambda r: (-r.n, r.token))
    return np.array([r.token for r in rows], dtype=np.uint32)


def write_files(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the token files of `docs` and return their table: (part int, file int, uri, first long, docs long, tokens long).

    In the order of (part, file) documents ascend by id; rows with the same id stand side by
    side, in the order of their coded ids. A null id counts as -1. An empty table writes no file.
    Documents are tokenized once and dealt out by ranges of ids that hold about as many
    tokens each; the tables in between are in the shared folder, and a lost task writes its
    files again under the same names.
    """
    spark = docs.sparkSession
    staged = new_path(spark, "token-ids")
    encode_texts(docs, path, end_id, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(-1).cast("long"))).write.option("compression", "snappy").parquet(staged)
    written = spark.read.schema("id long, ids binary, counts binary").parquet(staged)
    kind = id_type(path) if end_id < 65536 else "<u4"
    order = frequency_order(written)
    coded = written.where("ids is not null").select("id", "ids")
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    ranks, orders = spark.sparkContext.broadcast(rank), spark.sparkContext.broadcast(order)  # as long as the vocabulary at most

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = coded.select(F.percentile_approx("id", [k / (4 * parts) for k in range(1, 4 * parts)], F.lit(100_000))).first()[0] or []
    bounds = spark.sparkContext.broadcast(np.array(sorted(set(cuts)), dtype=np.int64))

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                ids, n = _flat(batch.column(1), kind)
                control, data, controls, sizes = pack(ranks.value[ids], n)
                part = np.searchsorted(bounds.value, batch.column(0).to_numpy(zero_copy_only=False), side="left")
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), pa.array(n, pa.int64()), _binaries(control, controls), _binaries(data, sizes)], ["part", "id", "n", "control", "data"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = str(TaskContext.get().taskAttemptId())
        names = ["part", "file", "uri", "first", "docs", "tokens"]
        part, number, ids, counts, controls, kept, size = None, 0, [], [], [], [], 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/part-{part:06d}-{number:06d}.tok"
            files.write_whole(uri, write_file(orders.value, ids, counts, b"".join(controls), b"".join(kept)), attempt)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((part, pa.int32()), (number, pa.int32()), (uri, pa.string()), (ids[0], pa.int64()), (len(ids), pa.int64()), (size, pa.int64()))], names)

        for batch in batches:
            for p, i, n, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (p != part or size >= file_tokens):
                    yield close()
                    number, ids, counts, controls, kept, size = number + 1 if p == part else 0, [], [], [], [], 0
                elif p != part:
                    number = 0
                part = p
                ids.append(i)
                counts.append(n)
                controls.append(control)
                kept.append(data)
                size += n
        if ids:
            yield close()

    dealt = coded.mapInArrow(recode, "part int, id long, n long, control binary, data binary").repartition(4 * parts, "part").sortWithinPartitions("part", "id", "n", "control", "data")
    table = stage(dealt.mapInArrow(save, "part int, file int, uri string, first long, docs long, tokens long"), "token-files")
    drop_path(spark, staged)
    return table


def read_back(table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of `table`, read from them."""
    parts = table.groupBy("part").agg(F.sum("tokens").alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of ids
    base = parts.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, 0)
    placed = table.join(base, "part").select("uri", (F.col("base") + F.sum("tokens").over(inner) - F.col("tokens")).alias("start"))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, start in zip(batch["uri"], batch["start"], strict=True):
                ids, counts, tokens = read_file(files.read_whole(uri))
                ends = np.cumsum(counts.astype(np.int64))
                crc = [zlib.crc32(tokens[e - c : e].astype("<u4").tobytes()) for e, c in zip(ends, counts.astype(np.int64), strict=True)]
                yield pd.DataFrame({"doc_id": ids, "start": start + ends - counts, "n_tokens": counts.astype(np.int64), "ids_crc32": np.array(crc, dtype=np.int64)})

    spread = max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(spread, "uri").mapInPandas(load, "doc_id long, start long, n_tokens long, ids_crc32 long")
