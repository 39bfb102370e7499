"""Language-model scoring with a hierarchical Pitman-Yor model.

Every distinct word has a restaurant whose customers are the words that follow it, and the
beginnings of texts have one more; their common parent is the restaurant of words without
context. Its base measure gives one half to the event of a word never learnt from, and the
other half to the words learnt from in equal parts.

Seating is sampled by Gibbs. In a sweep the customers of each dish leave and are seated
again one by one, each at a new table with probability w / (w + i - d t), where i are
seated at t tables and w is (concentration + d * tables of the restaurant) * the parent's
probability. The dishes of a restaurant take turns in TURNS groups, and each turn sees the
tables as the turn before has left them. What other tasks hold (the parent's probabilities,
and the rest of a restaurant that is cut into slices) is as the sweep before has left it.
Random numbers are a function of seed, sweep and part, so a lost task repeats its seating.
Predictive probabilities are averaged over the sweeps after burn-in; a context's share for
its parent and the parent's probability are averaged each by itself.

Data flow. Texts are tokenized once and kept as blocks of block-local word numbers, in files
of the shared folder. A block asks for its words, by hash, in the part of the vocabulary
that holds them, and for its pairs of neighbouring words in the part of the restaurants;
what it asks for carries its counts. Parts are files too. All that one block, or part, has
to say to another part travels as one row, so rows are few, and no row is a word. Frequent
contexts are cut into slices by the word that follows, so that no part gets more than its
share. Words are told apart by 64-bit hashes; as followers in `score` by the upper 40 bits.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files
from .common import new_path, stage

SWEEPS, BURN_IN = 6, 2
#: Groups of dishes that are seated in turn.
TURNS = 2
#: Discounts and concentrations of the contexts and of their parent.
D_CONTEXT, T_CONTEXT = 0.8, 2.0
D_WORD, T_WORD = 0.7, 10.0
#: Tokens of a block, about.
BLOCK_TOKENS = 3_000_000
#: Tokens of the corpus for which there is a part of the vocabulary and of the restaurants.
PART_TOKENS = 2_500_000
#: So few dishes are seated one after the other, which is the same but faster.
FEW = 12
END = b""
#: The key of the context at the beginning of a text.
BEGIN = np.uint64(0x9E3779B97F4A7C15)
#: A context over this share of a part is cut into slices.
SLICE = 4
_SHIFT = np.uint64(24)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93))
_ROW = "kind int, dest long, origin long, data binary"


def tokens(text: str | None) -> list[bytes]:
    """Words between the six ASCII blanks with A-Z in lower case, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


# ---------------------------------------------------------------- arrays as bytes


def dump(*arrays: np.ndarray, packed: bool = False) -> bytes:
    """Arrays as bytes; `packed` for files, while rows are compressed by Spark."""
    head = json.dumps([(a.dtype.str, len(a)) for a in arrays]).encode()
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    body = pa.compress(raw, codec="zstd", asbytes=True) if packed else raw
    return struct.pack("<IQ?", len(head), len(raw), packed) + head + body


def load(data: bytes) -> list[np.ndarray]:
    n, size, packed = struct.unpack_from("<IQ?", data)
    at = struct.calcsize("<IQ?")
    told, body = json.loads(data[at : at + n]), memoryview(data)[at + n :]
    raw = pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True) if packed and size else body
    out, at = [], 0
    for kind, count in told:
        out.append(np.frombuffer(raw, dtype=kind, count=count, offset=at))
        at += out[-1].nbytes
    return out


def _five(x: np.ndarray) -> np.ndarray:
    """The lower five bytes of 64-bit integers."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].reshape(-1)


def _unfive(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _rows(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], ["kind", "dest", "origin", "data"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(dest, [(kind, origin, data)]) of rows that stand together by dest."""

    def each() -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True)

    for dest, group in groupby(each(), key=lambda r: r[1]):
        yield dest, [(r[0], r[2], r[3]) for r in group]


def _to_dest(rows: DataFrame, parts: int) -> DataFrame:
    return rows.select("kind", "dest", "origin", "data").repartition(parts, "dest").sortWithinPartitions("dest", "kind", "origin")


def _save(uri: str, *arrays: np.ndarray) -> None:
    files.write_whole(uri, dump(*arrays, packed=True), str(TaskContext.get().taskAttemptId()))


def _read(uri: str) -> list[np.ndarray]:
    return load(files.read_whole(uri))


# ---------------------------------------------------------------- seating


def seat(customers: np.ndarray, base: np.ndarray, slope: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating the `customers` of each dish one by one, with w = base + slope * tables of the dish.

    The customers that sit down until one opens a table are drawn at once: as long as i - d t
    grows by joining only, their number is geometric with a chance of Beta(w, i - d t).
    """
    tables = (customers > 0).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    seated = np.ones(len(live))
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        while len(live) > FEW:
            t = tables[live]
            chance = rng.beta(np.maximum(base[live] + slope[live] * t, 1e-300), seated - discount * t)
            joined = np.where(chance > 0, np.floor(np.log(rng.random(len(live))) / np.log1p(-chance)), np.inf)
            seated = seated + np.where(chance >= 1, 0, joined) + 1
            tables[live] += seated <= customers[live]
            more = seated < customers[live]
            live, seated = live[more], seated[more]
    beta, uniform = rng.beta, rng.random
    for k, i in zip(live.tolist(), seated.tolist(), strict=True):
        t, most, b, s = int(tables[k]), int(customers[k]), float(base[k]), float(slope[k])
        while i < most:
            chance = beta(max(b + s * t, 1e-300), i - discount * t)
            if chance <= 0:
                break
            i += 1 + (math.floor(math.log(uniform() or 1e-300) / math.log1p(-chance)) if chance < 1 else 0)
            t += i <= most
        tables[k] = t
    return tables


def sweep_restaurants(u: np.ndarray, n: np.ndarray, tables: np.ndarray, total: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(tables, total) after a sweep over dishes with `n` customers in restaurants `u` of `total` tables; u is sorted."""
    tables, total = tables.copy(), total.copy()
    first = np.searchsorted(u, u)
    turn = (np.arange(len(u)) - first) % TURNS
    for k in range(TURNS):
        mine = np.flatnonzero(turn == k)
        rest = total[u[mine]] - tables[mine]
        new = seat(n[mine], (T_CONTEXT + D_CONTEXT * rest) * p[mine], D_CONTEXT * p[mine], D_CONTEXT, rng)
        total = total + np.bincount(u[mine], weights=new - tables[mine], minlength=len(total))
        tables[mine] = new
    return tables, total


def sweep_root(n: np.ndarray, tables: np.ndarray, total: float, h: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of the parent's dishes after a sweep; `total` are the tables of all its dishes."""
    tables = tables.copy()
    for k in range(TURNS):
        rest = total - tables[k::TURNS]
        new = seat(n[k::TURNS], (T_WORD + D_WORD * rest) * h, np.full(len(rest), D_WORD * h), D_WORD, rng)
        total += float((new - tables[k::TURNS]).sum())
        tables[k::TURNS] = new
    return tables


# ---------------------------------------------------------------- blocks


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _write_blocks(folder: str):
    """(id, held, text) to (uri, rows to learn from, tokens) per block of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        index, ids, held, sizes, toks, size = _Index(), [], [], [], [], 0

        def close() -> pa.RecordBatch:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, index), dtype=np.uint64, count=len(index))
            all_ = np.concatenate(toks)
            uri = f"{folder}/block-{task}-{made}"
            low, high = (all_ & 0xFFFF).astype(np.uint16), (all_ >> 16).astype(np.uint16)
            _save(uri, np.array(ids, dtype=np.int64), np.array(held, dtype=np.uint8), np.array(sizes, dtype=np.int64), low, high, keys)
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(held) - sum(held)], pa.int64()), pa.array([size], pa.int64())], ["uri", "n", "tokens"])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for i, h, text in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                    words = tokens(text)
                    toks.append(np.fromiter(map(index.__getitem__, words), dtype=np.uint32, count=len(words)))
                    ids.append(i)
                    held.append(h)
                    sizes.append(len(words))
                    size += len(words)
                    if size >= BLOCK_TOKENS:
                        yield close()
                        made += 1
                        index, ids, held, sizes, toks, size = _Index(), [], [], [], [], 0
        if ids:
            yield close()

    return run


class Block:
    """Rows of a block; its words are numbered in the order of their keys."""

    def __init__(self, uri: str) -> None:
        self.ids, self.held, self.sizes, low, high, keys = _read(uri)
        order = np.argsort(keys)
        rank = np.empty(len(keys), dtype=np.int64)
        rank[order] = np.arange(len(keys))
        self.keys = keys[order]
        self.toks = rank[low.astype(np.uint32) | high.astype(np.uint32) << np.uint32(16)]
        self.learnt = np.repeat(self.held == 0, self.sizes)

    def words(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(the words in the order of their parts, where parts begin)."""
        part = (self.keys >> _SHIFT) % np.uint64(parts)
        return _by_part(part, parts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, word, number of the pair of each token) of the distinct pairs; the last context is BEGIN."""
        n = len(self.keys)
        before = np.empty(len(self.toks), dtype=np.int64)
        before[1:] = self.toks[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = n
        code, number = np.unique(before * (n + 1) + self.toks, return_inverse=True)
        return code // (n + 1), code % (n + 1), number

    def pair_parts(self, u: np.ndarray, w: np.ndarray, hot: tuple[np.ndarray, np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(the pairs in the order of their parts, where parts begin)."""
        keys = np.append(self.keys, BEGIN)
        slices = np.ones(len(keys), dtype=np.uint64)
        if len(hot[0]):
            at = np.minimum(np.searchsorted(hot[0], keys), len(hot[0]) - 1)
            slices = np.where(hot[0][at] == keys, hot[1][at], np.uint64(1))
        with np.errstate(over="ignore"):
            piece = (keys[w] >> _SHIFT) % slices[u]
            part = (((keys[u] ^ piece * _MIX[0]) * _MIX[1]) >> np.uint64(32)) % np.uint64(parts)
        return _by_part(part, parts)


def _by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    part = part.astype(np.uint16 if parts < 65536 else np.uint32)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _ask_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = Block(uri)
                n = np.bincount(b.toks[b.learnt], minlength=len(b.keys)).astype("<u4")
                order, at = b.words(parts)
                yield _rows([(0, p, number, dump(b.keys[order[at[p] : at[p + 1]]], n[order[at[p] : at[p + 1]]])) for p in range(parts) if at[p] < at[p + 1]])

    return run


def _ask_pairs(parts: int, hot: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = Block(uri)
                u, w, pair = b.pairs()
                n = np.bincount(pair[b.learnt], minlength=len(u))
                order, at = b.pair_parts(u, w, hot, parts)
                u, w, n, keys = u[order], b.keys[w[order]] >> _SHIFT, n[order], np.append(b.keys, BEGIN)
                for p in range(parts):
                    span = slice(at[p], at[p + 1])
                    if at[p] == at[p + 1]:
                        continue
                    start = np.flatnonzero(np.diff(u[span], prepend=-1))
                    many = np.flatnonzero(n[span] > 254)
                    yield _rows([(0, p, number, dump(keys[u[span][start]], np.diff(start, append=at[p + 1] - at[p]).astype("<u4"), _five(w[span]), np.minimum(n[span], 255).astype(np.uint8), n[span][many].astype("<i8")))])

    return run


# ---------------------------------------------------------------- parts of the vocabulary


def _merge_words(folder: str):
    """Asks of blocks to files words-p: keys, counts, then the blocks and what each asks for; rows of (learnt tokens, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            asked = [load(data) for _, _, data in rows]
            keys, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([a[1] for a in asked]), minlength=len(keys)).astype(np.int64)
            sizes = np.array([len(a[0]) for a in asked], dtype=np.int64)
            _save(f"{folder}/words-{part}", keys, n, np.array([r[1] for r in rows], dtype=np.int64), sizes, place.astype(np.uint32))
            yield _rows([(0, part, -1, dump(np.array([n.sum(), np.count_nonzero(n)], dtype=np.int64)))])

    return run


def _hot_words(folder: str, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                keys, n, *_ = _read(f"{folder}/words-{part}")
                some = n >= limit
                yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some])], ["key", "n"])

    return run


def _seat_words(folder: str, sweep: int, seed: int, h: float, tables_before: float | None):
    """Tables that the contexts report, to the parent's seating; its customers less discounts go back to those who asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            out = []
            told = [(origin, load(data)) for kind, origin, data in rows if kind == 0]
            for kind, origin, data in rows:
                if kind == 2:  # partial tables of a sliced context, on their way to the driver
                    out.append((2, part, origin, data))
            if not any(kind < 2 for kind, _, _ in rows):
                yield _rows(out)
                continue
            link = f"{folder}/links-{part}"
            if sweep == 0:
                every = np.concatenate([x for _, a in told for x in (_unfive(a[0]), _unfive(a[2]))]) if told else np.empty(0, dtype=np.uint64)
                names = np.unique(every)
                single = np.zeros(len(names), dtype=np.int64)
                for _, a in told:
                    single[np.searchsorted(names, _unfive(a[0]))] += a[1]
                asked = [np.searchsorted(names, _unfive(a[2])).astype(np.uint32) for _, a in told]
                counts = [a[3] for _, a in told]
                origins, sizes = np.array([o for o, _ in told], dtype=np.int64), np.array([len(a) for a in asked], dtype=np.int64)
                _save(link, names, single, origins, sizes, np.concatenate([*asked, np.empty(0, dtype=np.uint32)]))
                tables = np.ones(len(names), dtype=np.int64)
                total = float(len(names)) if tables_before is None else tables_before
            else:
                names, single, origins, sizes, flat = _read(link)
                asked = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
                by_origin = {o: a[0] for o, a in told}
                counts = [by_origin[o] for o in origins.tolist() if o in by_origin]
                asked = [a for o, a in zip(origins.tolist(), asked, strict=True) if o in by_origin]
                origins = [o for o in origins.tolist() if o in by_origin]
                tables, total = _read(f"{folder}/root-{sweep - 1}-{part}")[0], tables_before
            customers = single.copy()
            for a, t in zip(asked, counts, strict=True):
                customers[a] += t
            new = sweep_root(customers, tables, total, h, np.random.default_rng([seed, sweep, part, 1]))
            left = (customers - D_WORD * new).astype("<f8")
            _save(f"{folder}/root-{sweep}-{part}", new, left)
            out += [(1, o, part, dump(left[a])) for o, a in zip(origins, asked, strict=True) if len(a)]
            out.append((3, part, -1, dump(np.array([customers.sum(), new.sum()], dtype=np.int64))))
            yield _rows([(k, int(d), int(o), x) for k, d, o, x in out])

    return run


# ---------------------------------------------------------------- parts of the restaurants


def _merge_pairs(folder: str, parts: int):
    """Asks of blocks to files pairs-p (restaurants and dishes) and asks-p; rows for the vocabulary: (single dishes, others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            asked = [load(data) for _, _, data in rows]
            contexts, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
            if len(contexts) >= 1 << 24:
                raise ValueError("a part holds over 2**24 contexts; raise spark.sql.shuffle.partitions")
            per = np.concatenate([a[1] for a in asked])
            n = []
            for a in asked:
                x = a[3].astype(np.int64)
                x[x == 255] = a[4]
                n.append(x)
            code = np.repeat(at.astype(np.uint64), per) << np.uint64(40) | _unfive(np.concatenate([a[2] for a in asked]))
            code, place = np.unique(code, return_inverse=True)
            n = np.bincount(place, weights=np.concatenate(n), minlength=len(code)).astype(np.int64)
            u, w = (code >> np.uint64(40)).astype(np.int64), code & np.uint64((1 << 40) - 1)
            multi, single = np.flatnonzero(n > 1), np.flatnonzero(n == 1)
            per_u = np.bincount(u, weights=n, minlength=len(contexts)).astype(np.int64)
            alone = np.bincount(u[single], minlength=len(contexts)).astype(np.int64)
            goal = (w % np.uint64(parts)).astype(np.int64)
            names = np.unique(w[multi])
            name_goal = (names % np.uint64(parts)).astype(np.int64)
            order, starts = _by_part(name_goal, parts)  # links stand by the part they go to
            link = np.empty(len(names), dtype=np.uint32)
            link[order] = np.arange(len(names))
            _save(f"{folder}/pairs-{part}", contexts, per_u, alone, u[multi].astype(np.uint32), n[multi], link[np.searchsorted(names, w[multi])], starts.astype(np.int64))
            _save(f"{folder}/asks-{part}", np.minimum(n, 2).astype(np.uint8), np.array([r[1] for r in rows], dtype=np.int64), np.array([len(a[0]) for a in asked], dtype=np.int64), np.array([len(a[3]) for a in asked], dtype=np.int64), at.astype(np.uint32), np.concatenate([np.diff(x, prepend=0) for x in np.split(place, np.cumsum([len(a[3]) for a in asked])[:-1])]).astype(np.uint32))
            out = []
            times = np.bincount(np.searchsorted(names, w[multi]), minlength=len(names)).astype("<u4")[order]
            s_order, s_at = _by_part(goal[single], parts)
            alone_w = w[single][s_order]
            for p in range(parts):
                one, m = np.unique(alone_w[s_at[p] : s_at[p + 1]], return_counts=True)
                some = order[starts[p] : starts[p + 1]]
                if len(one) or len(some):
                    out.append((0, p, part, dump(_five(one), m.astype("<u4"), _five(names[some]), times[starts[p] : starts[p + 1]])))
            out.append((4, part, -1, b""))
            yield _rows(out)

    return run


def _seat_pairs(folder: str, sweep: int, seed: int, root: tuple[float, float], h: float, hot: dict[int, float], sliced: np.ndarray):
    """One sweep over the restaurants of a part; the tables of each word go to the vocabulary.

    root: customers and tables of the parent. hot: tables of the sliced contexts, of all slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            contexts, _, alone, u, n, link, starts = _read(f"{folder}/pairs-{part}")
            left = [load(data)[0] for kind, _, data in rows if kind == 1]
            u, link = u.astype(np.int64), link.astype(np.int64)
            left = np.concatenate(left) if left else np.empty(0)
            p = ((left + (T_WORD + D_WORD * root[1]) * h) / (T_WORD + root[0]))[link]
            tables, summed, total_sum = (np.ones(len(u), dtype=np.int64), np.zeros(len(u)), np.zeros(len(contexts))) if sweep == 1 else _read(f"{folder}/seats-{sweep - 1}-{part}")
            total = alone + np.bincount(u, weights=tables, minlength=len(contexts))
            mine = np.flatnonzero(np.isin(contexts, sliced)) if len(sliced) else np.empty(0, dtype=np.int64)
            other = np.zeros(len(contexts))
            for i in mine.tolist():
                other[i] = hot.get(int(contexts[i]), total[i]) - total[i]
            new, total = sweep_restaurants(u, n, tables, total + other, p, np.random.default_rng([seed, sweep, part, 0]))
            if sweep > BURN_IN:
                summed, total_sum = summed + new, total_sum + total
            _save(f"{folder}/seats-{sweep}-{part}", new.astype(np.int64), summed, total_sum)
            each = np.bincount(link, weights=new, minlength=int(starts[-1])).astype("<u4")
            out = [(0, k, part, dump(each[starts[k] : starts[k + 1]])) for k in range(len(starts) - 1) if starts[k] < starts[k + 1]]
            out += [(2, part, int(contexts[i].view(np.int64)), struct.pack("<q", int(round(total[i] - other[i])))) for i in mine.tolist()]
            yield _rows(out)

    return run


# ---------------------------------------------------------------- answers


def _tell_words(folder: str, samples: list[int], roots: list[tuple[float, float]], h: float):
    """Per block that asked: counts and averaged probabilities without context of its words, in the order it asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                keys, n, blocks, sizes, place = _read(f"{folder}/words-{part}")
                p = np.zeros(len(keys))
                names = _read(f"{folder}/links-{part}")[0]
                at = np.minimum(np.searchsorted(names, keys >> _SHIFT), max(0, len(names) - 1))
                for s in samples:
                    customers, tables = roots[s]
                    left = _read(f"{folder}/root-{s}-{part}")[1]
                    p += (np.where(n > 0, left[at] if len(names) else 0, 0) + (T_WORD + D_WORD * tables) * h) / (T_WORD + customers) / len(samples)
                for b, x in zip(blocks.tolist(), np.split(place, np.cumsum(sizes)[:-1]), strict=True):
                    yield _rows([(0, b, part, dump(n[x], p[x].astype("<f4")))])

    return run


def _tell_pairs(folder: str, samples: list[int], hot_customers: dict[int, int]):
    """Per block that asked: customers and averaged tables of contexts, and customers less discounts of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                contexts, per_u, alone, u, n, _, _ = _read(f"{folder}/pairs-{part}")
                kind, blocks, n_u, n_pairs, at, steps = _read(f"{folder}/asks-{part}")
                _, summed, total = _read(f"{folder}/seats-{max(samples)}-{part}")
                left = np.where(kind == 1, 1 - D_CONTEXT, 0.0)
                left[kind == 2] = n - D_CONTEXT * summed / len(samples)
                customers = per_u.copy()
                for i in np.flatnonzero(np.isin(contexts, np.array(list(hot_customers), dtype=np.uint64))).tolist():
                    customers[i] = hot_customers[int(contexts[i])]
                back = (T_CONTEXT + D_CONTEXT * total / len(samples)) / (T_CONTEXT + customers)
                for b, x, d in zip(blocks.tolist(), np.split(at, np.cumsum(n_u)[:-1]), np.split(steps, np.cumsum(n_pairs)[:-1]), strict=True):
                    yield _rows([(1, b, part, dump(customers[x], back[x].astype("<f4"), left[np.cumsum(d, dtype=np.uint32)].astype("<f4")))])

    return run


def _score(parts: int, hot: tuple[np.ndarray, np.ndarray], n: int, v: int, unknown: float):
    """Answers to (id, ...) per row of each block; its file is named by a row of kind -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            b = Block(next(data for kind, _, data in rows if kind == -1).decode())
            count, p = np.zeros(len(b.keys), dtype=np.int64), np.zeros(len(b.keys))
            order, at = b.words(parts)
            for kind, part, data in rows:
                if kind == 0:
                    count[order[at[part] : at[part + 1]]], p[order[at[part] : at[part + 1]]] = load(data)
            u, w, pair = b.pairs()
            order, at = b.pair_parts(u, w, hot, parts)
            left, back, customers = np.zeros(len(u)), np.ones(len(u)), np.zeros(len(u))
            for kind, part, data in rows:
                if kind == 1:
                    span = order[at[part] : at[part + 1]]
                    c, share, x = load(data)
                    of = np.cumsum(np.diff(u[span], prepend=-1) != 0) - 1
                    left[span], back[span], customers[span] = x, share[of], c[of]
            log = np.log10(left / (T_CONTEXT + customers) + back * np.where(count > 0, p, unknown)[w])[pair]
            base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))[b.toks]
            ends = np.cumsum(b.sizes)
            sums = lambda x: (lambda t: t[ends] - t[ends - b.sizes])(np.concatenate(([0], np.cumsum(x))))  # noqa: E731, B023
            starts = ends - b.sizes
            known = sums((count > 0)[b.toks].astype(np.int64))
            score, plain = np.add.reduceat(log, starts), np.add.reduceat(base, starts)
            columns = [pa.array(b.ids), pa.array(b.held == 1), pa.array(b.sizes), pa.array(known), pa.array(np.full(len(b.ids), n)), pa.array(plain), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, sweeps: int = SWEEPS, seed: int = 11) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Rows for which `held` is true are not learnt from. Scores are log10 probabilities of the
    whole text, words and end: `base_score` by smoothed word frequencies, `score` by the
    model, and `perplexity` is that of the model per token. In both the words never learnt
    from are one event. A null text is empty: its end only. Each row counts and is scored for
    itself, repeated or not; a null id counts as -1, and as the text '' for the split. An
    empty table gives an empty table; other columns are not looked at. Without any row to
    learn from all words are unknown, with a probability of one.
    """
    if sweeps <= BURN_IN:
        raise ValueError("no sweep after burn-in")
    spark = docs.sparkSession
    held = held_out(F.col(id_col)) if held is None else held
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    folder = new_path(spark, "lm")

    blocks = stage(slim.mapInArrow(_write_blocks(folder), "uri string, n long, tokens long"), "lm-blocks")
    blocks = blocks.withColumn("block", F.xxhash64("uri"))
    rows_learnt, size, number = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    parts = 1 + size // PART_TOKENS
    spread = blocks.select("block", "uri").repartition(max(1, number), "block")

    words = stage(_to_dest(spread.mapInArrow(_ask_words(parts), _ROW), parts).mapInArrow(_merge_words(folder), _ROW), "lm-words")
    counted = [load(r.data)[0] for r in words.select("data").collect()]  # two numbers a part
    n, v = (int(sum(int(c[k]) for c in counted)) for k in (0, 1))
    word_parts = words.select(F.col("dest").alias("part"))

    limit = max(1.0, n / (SLICE * parts))
    often = word_parts.repartition(parts, "part").mapInArrow(_hot_words(folder, limit), "key long, n long").collect()  # SLICE * parts at most
    customers = {r.key & (1 << 64) - 1: r.n for r in often if r.key & (1 << 64) - 1 != xxhash.xxh64_intdigest(END)}
    if rows_learnt >= limit:
        customers[int(BEGIN)] = rows_learnt
    sliced = np.array(sorted(customers), dtype=np.uint64)
    hot = (sliced, np.array([min(parts, -(-customers[int(k)] // max(1, int(limit)))) for k in sliced], dtype=np.uint64))

    told = stage(_to_dest(spread.mapInArrow(_ask_pairs(parts, hot), _ROW), parts).mapInArrow(_merge_pairs(folder, parts), _ROW), "lm-told")
    pair_parts = told.where("kind = 4").select(F.col("dest").alias("part"))
    everyone = lambda frame: frame.select(F.lit(-1).alias("kind"), F.col("part").alias("dest"), F.lit(-1).cast("long").alias("origin"), F.lit(b"").alias("data"))

    h = 0.5 / max(1, v)
    ours = everyone(word_parts)
    state = stage(_to_dest(told.where("kind = 0").unionByName(ours), parts).mapInArrow(_seat_words(folder, 0, seed, h, float(v)), _ROW), "lm-root")

    def totals(frame: DataFrame) -> tuple[tuple[float, float], dict[int, float]]:
        got = frame.where("kind in (2, 3)").select("kind", "origin", "data").collect()  # a row a part and slice
        both = [load(r.data)[0] for r in got if r.kind == 3]
        tables: dict[int, float] = {}
        for r in got:
            if r.kind == 2:
                key = r.origin & (1 << 64) - 1
                tables[key] = tables.get(key, 0) + struct.unpack("<q", r.data)[0]
        return (float(sum(int(b[0]) for b in both)), float(sum(int(b[1]) for b in both))), tables

    roots, tables = [], {}
    for s in range(1, sweeps + 1):
        root, found = totals(state)
        roots.append(root)
        tables = found or tables
        seated = _to_dest(state.where("kind = 1").unionByName(everyone(pair_parts)), parts).mapInArrow(_seat_pairs(folder, s, seed, root, h, tables, sliced), _ROW)
        state = stage(_to_dest(seated.unionByName(ours), parts).mapInArrow(_seat_words(folder, s, seed, h, root[1]), _ROW), "lm-root")
    roots.append(totals(state)[0])

    samples = list(range(BURN_IN + 1, sweeps + 1))
    unknown = float(np.mean([(T_WORD + D_WORD * roots[s][1]) / (T_WORD + roots[s][0]) for s in samples])) * (0.5 if v else 1.0)
    from_words = word_parts.repartition(parts, "part").mapInArrow(_tell_words(folder, samples, roots, h), _ROW)
    from_pairs = pair_parts.repartition(parts, "part").mapInArrow(_tell_pairs(folder, samples, customers), _ROW)
    named = blocks.select(F.lit(-1).alias("kind"), F.col("block").alias("dest"), F.lit(-1).cast("long").alias("origin"), F.col("uri").cast("binary").alias("data"))
    answers = _to_dest(from_words.unionByName(from_pairs).unionByName(named), max(1, number))
    report = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = answers.mapInArrow(_score(parts, hot, n, v, unknown), report)
    return scored.withColumn("perplexity", perplexity(F.col("score"), F.col("n_tokens"))).withColumnRenamed("id", id_col)


def perplexity(score: Column, n_tokens: Column) -> Column:
    """Per token, from a log10 probability; of a corpus, from the sums of both."""
    return F.pow(F.lit(10.0), -score / F.nullif(n_tokens, F.lit(0)))
