"""Benchmark decontamination with an FM-index per training shard.

Each task turns its documents into shards of about a million words. A shard's text is the
words that the benchmark knows; stretches of other words become one separator, and
stretches too short to hold any window are left out, since an occurrence lies within a
stretch of known words. Over that text an FM-index is built: suffix order, the
Burrows-Wheeler transform in a wavelet tree, and every 16th suffix position. All windows
search backwards together, and their occurrences are located by walking to the next
sampled position. Spans of hit words are merged by document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: A word: digits, a-z and all beyond ASCII, after A-Z are lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
SHARD_WORDS = 1_000_000
SAMPLE = 16
#: Bytes of benchmark text that are searched for at once; a longer benchmark is searched for in blocks.
BLOCK_BYTES = 8_000_000


def split_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


class WaveletTree:
    """Rank queries over a sequence of small integers: a bit vector per level, stably sorted by bit from the top."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.levels, self.n = [], len(seq)
        self.bits = max(1, int(sigma - 1).bit_length())
        for k in reversed(range(self.bits)):
            bit = (seq >> k & 1).astype(np.uint8)
            zeros = len(bit) - int(bit.sum())
            words = np.frombuffer(np.packbits(np.pad(bit, (0, 64 - len(bit) % 64)), bitorder="little").tobytes(), dtype="<u8")
            self.levels.append((words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))), zeros))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        w, b = at >> 6, (at & 63).astype(np.uint64)
        return before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros_like(at), at.copy()
        for i in range(self.bits):
            one = (symbol >> (self.bits - 1 - i) & 1).astype(bool)
            a, b, zeros = self._ones(i, lo), self._ones(i, hi), self.levels[i][2]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for i in range(self.bits):
            words, _, zeros = self.levels[i]
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(i, at)
            out, at = out << 1 | bit, np.where(bit == 1, zeros + ones, at - ones)
        return out


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """The suffix array of `seq` by prefix doubling; a suffix that ends comes first."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while n:
        follow = np.zeros(n, dtype=np.int64)
        follow[: n - step if step < n else 0] = rank[step:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        there = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], there[1:] != there[:-1])))
        if rank[order[-1]] == n - 1 or step >= n:
            break
        step *= 2
    return order


class FMIndex:
    """Symbols 1..sigma-1; 0 is kept for the end of the text."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        text = np.concatenate((seq, [0])).astype(np.int64)
        order = suffix_order(text)
        self.tree = WaveletTree(text[order - 1], sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        held = order % sample == 0
        self.rows, self.places = np.flatnonzero(held), order[held]

    def search(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Per pattern the rows [first, last) of the suffixes that begin with it."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.tree.n, dtype=np.int64)
        longest = max(map(len, patterns), default=0)
        table = np.zeros((len(patterns), longest), dtype=np.int64)  # right-aligned: all begin at their last symbol
        for i, p in enumerate(patterns):
            table[i, longest - len(p) :] = p
        for k in reversed(range(longest)):
            live = np.flatnonzero((table[:, k] > 0) & (lo < hi))
            if len(live):
                c = table[live, k]
                lo[live] = self.before[c] + self.tree.rank(c, lo[live])
                hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows, by steps to the left until a sampled one."""
        out, at, row, steps = np.empty(len(rows), dtype=np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(row):
            k = np.minimum(np.searchsorted(self.rows, row), len(self.rows) - 1)
            here = self.rows[k] == row
            out[at[here]] = self.places[k[here]] + steps
            at, row = at[~here], row[~here]
            if len(row):
                c = self.tree.access(row)
                row = self.before[c] + self.tree.rank(c, row)
            steps += 1
        return out


class Windows:
    """The windows of benchmark items: symbol 1 separates, known words have symbols from 2."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        self.symbols: dict[str, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 2) for w in split_words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).update([] if item is None else [str(item)])
        self.patterns = [np.array(p, dtype=np.int64) for p in found]
        self.owners = list(found.values())
        self.shortest = min(map(len, self.patterns), default=0)
        self.sigma = len(self.symbols) + 2

    def hits(self, docs: list[list[str]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Per document (as words) the merged spans [from, to) of hit words, and the items found."""
        seqs, places, owner = [], [], []
        for d, words in enumerate(docs):
            ids = np.fromiter((self.symbols.get(w, 1) for w in words), dtype=np.int64, count=len(words))
            edge = np.diff(np.concatenate(([0], (ids > 1).astype(np.int8), [0])))
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                if b - a >= self.shortest:
                    seqs += [ids[a:b], np.array([1])]
                    places.append(np.arange(a, b + 1))
                    owner.append(np.full(b - a + 1, d))
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        items: list[set[str]] = [set() for _ in docs]
        if seqs and self.patterns:
            place, of = np.concatenate(places), np.concatenate(owner)
            index = FMIndex(np.concatenate(seqs), self.sigma)
            lo, hi = index.search(self.patterns)
            which = np.repeat(np.arange(len(lo)), hi - lo)
            rows = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True) if a < b] or [np.empty(0, dtype=np.int64)])
            at = index.locate(rows)
            for w, p in zip(which.tolist(), at.tolist(), strict=True):
                d, start = int(of[p]), int(place[p])
                spans[d].append((start, start + len(self.patterns[w])))
                items[d] |= self.owners[w]
        return [(merge(s), i) for s, i in zip(spans, items, strict=True)]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:int,last:int>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row of `docs`: its id, n_words, n_hit, n_items, items_sha256, contaminated, spans (first word, word after the last).

    A window is `window` consecutive words of an item, or all words of a shorter one; an item
    without words has none. Windows of items with a null id are hits like any others, for n_hit, contaminated
    and spans; having no id, such items count neither in n_items nor in the digest. Null texts have no words. Each row counts for itself, repeated or
    not; an empty benchmark leaves everything clean; an empty table gives an empty table.
    Nothing is shuffled, so frequent passages gather nowhere. The benchmark is the query set:
    its size is measured, and beyond BLOCK_BYTES it is searched for in blocks, one after the
    other over the same shard.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    asked = []
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else items
        asked.append(spark.sparkContext.broadcast(sorted(((r.item, r.text or "") for r in some.collect()), key=lambda x: (x[0] or "", x[1]))))  # of BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [Windows(asked[0].value, window)] if blocks == 1 else None

        def flush(ids: list, docs: list[list[str]]) -> pa.RecordBatch:
            spans: list[list[tuple[int, int]]] = [[] for _ in docs]
            found: list[set[str]] = [set() for _ in docs]
            for k in range(blocks):
                for d, (s, i) in enumerate((loaded[0] if loaded else Windows(asked[k].value, window)).hits(docs)):
                    spans[d], found[d] = merge(spans[d] + s) if k else s, found[d] | i
            hit = [sum(b - a for a, b in s) for s in spans]
            digest = [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(w) for w in docs], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(digest), pa.array([h > 0 for h in hit]), pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], kind)],
                ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

        ids: list = []
        held: list[list[str]] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = split_words(text.as_py())
                ids.append(i)
                held.append(words)
                size += len(words)
                if size >= shard_words or len(ids) >= 20_000:
                    yield flush(ids, held)
                    ids, held, size = [], [], 0
        if ids:
            yield flush(ids, held)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id long, {_REPORT}").withColumnRenamed("id", id_col)


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of `spans` (merged, over :func:`split_words`) and what stands between them."""
    out, at = [], 0
    ends = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    for a, b in spans:
        out.append(text[at : ends[a][0]])
        at = ends[b - 1][1]
    return "".join([*out, text[at:]])
