"""SimHash near-duplicates found with BK-trees.

Each document has a fingerprint of 64 bits or a multiple; a bit is set if it is set in over
half of the hashes of its word shingles. Distinct fingerprints are dealt into shards, and
each shard is a BK-tree: children are keyed by their Hamming distance to the parent, and a
search follows only the edges within the radius of the distance at hand.

Shards travel by key rather than by broadcast, because the fingerprints of all documents
have no size bound. Two ways of dealing are offered:

* ``blocks`` (exact): the 64 bits are cut into radius + 1 blocks. Fingerprints within the
  radius agree on at least one block, so they meet in the shard of that block's value. A
  shard over SHARD_LIMIT is dealt again by the blocks of its remaining bits, up to two
  times, which is exact for the same reason.
* ``sketch`` (for radii too wide for blocks): a document joins the shards of its least
  distinct shingle hashes. Documents of Jaccard similarity j share none of k least hashes
  with a probability of about (1 - j)**k. The members of shards over SHARD_LIMIT
  are dealt by sampled bits instead (see :func:`cells`).

Shards give the links that connect them, at most one less than they have members, and
connected components join them up. :func:`near_copies` takes what is within the radius for
candidates only and counts the shingles of both documents; its shards are those of
:func:`copy_shards`, which need no samples.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .graph import components

SEED = 42
SHARD_LIMIT = 256
#: Members of shards over the limit are cut by sampled bits into cells of about CELL.
CELL, CELL_MISS = 512, 1e-4
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, repeats included; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.empty(0, dtype=np.uint64)
    runs = zip(*(words[i:] for i in range(width)), strict=False) if len(words) > width else [words]
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), dtype=np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """Big-endian bytes of 64 * lanes bits; lane 0 takes the hashes as they are, further lanes remix them."""
    ones = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096]
        if lanes > 1:
            rest = (h[:, None] ^ (h[:, None] >> np.uint64(31))) * _MIX[: lanes - 1]
            h = np.concatenate((h[:, None], rest ^ (rest >> np.uint64(29))), axis=1)
        ones += np.unpackbits(h.astype(">u8").reshape(len(h), -1).view(np.uint8).reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(text: Column, width: int = 3, lanes: int = 1, least: int = 0) -> Column:
    """struct(fp binary, least array<long>): the fingerprint, and the `least` smallest distinct shingle hashes."""

    @F.pandas_udf("fp binary, least array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps, small = [], []
            for x in batch:
                h = shingle_hashes(x, width)
                fps.append(fingerprint(h, lanes))
                small.append(np.unique(h)[:least].view(np.int64).tolist() if least else [])
            yield pd.DataFrame({"fp": fps, "least": small})

    return run(text)


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The place of `value`, new or not."""
        at = 0
        while self.values:
            d = (value ^ self.values[at]).bit_count()
            if not d:
                return at
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def search(self, value: int, radius: int) -> list[int]:
        """The places of all values within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (as places in `values`) that connect what the radius connects."""
    tree, links = BKTree(), []
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    where = []
    for i, v in enumerate(values):
        for hit in tree.search(v, radius):
            a, b = root(where[hit]), root(i)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((where[hit], i))
        if tree.add(v) == len(where):
            where.append(i)
    return links


def _link_shards(members: DataFrame, radius: int) -> DataFrame:
    """(u, v) for members (key long, fp binary, rep long), a BK-tree per key."""
    keys = members.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    full = members.join(keys, "key").select("key", "fp", "rep")
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values, reps = None, [], []

        def close() -> list[tuple[int, int]]:
            return [(reps[a], reps[b]) for a, b in shard_links(values, radius)] if len(values) > 1 else []

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            links: list[tuple[int, int]] = []
            for k, fp, rep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    links += close()
                    key, values, reps = k, [], []
                values.append(int.from_bytes(fp, "big"))
                reps.append(rep)
            yield out(links)
        yield out(close())

    return full.repartition(parts, "key").sortWithinPartitions("key", "rep").mapInArrow(run, "u long, v long").distinct()


def _cut(mask: int, parts: int) -> list[int]:
    """`mask` as `parts` masks of neighbouring set bits, as equal as can be."""
    bits = [i for i in range(64) if mask >> i & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_shards(prints: DataFrame, radius: int, limit: int = SHARD_LIMIT) -> DataFrame:
    """(key, fp, rep) for prints (fp binary of 8 bytes, rep): see ``blocks`` above."""
    parts = radius + 1
    value = F.conv(F.hex("fp"), 16, -10).cast("long")
    rows = prints.withColumn("x", value).withColumn("key", F.lit(0).cast("long")).withColumn("node", F.lit(0))
    free = [[(1 << 64) - 1]]
    done = None
    for depth in range(3):
        masks = [m for node in free[-1] for m in _cut(node, parts)]
        table = F.array(*[F.lit(_signed(m)) for m in masks])
        dealt = rows.withColumn("node", F.explode(F.sequence(F.col("node") * parts, F.col("node") * parts + (parts - 1))))
        dealt = dealt.withColumn("key", F.xxhash64("key", "node", F.col("x").bitwiseAND(F.get(table, F.col("node")))))
        free.append([whole & ~m for whole in free[-1] for m in _cut(whole, parts)])
        if depth < 2:
            hot = dealt.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("key")
            rows, dealt = dealt.join(hot, "key", "left_semi"), dealt.join(hot, "key", "left_anti")
        ready = dealt.select("key", "fp", "rep")
        done = ready if done is None else done.unionByName(ready)
    return done


def cells(members: int, radius: int, bits: int) -> np.ndarray:
    """(tables, bits of a table): places of the bits that cut so many fingerprints into cells of about CELL.

    There are so many tables that two fingerprints at the radius itself share no cell with a
    probability of CELL_MISS at most; nearer ones miss far more rarely.
    """
    width = min(32, max(4, math.ceil(math.log2(max(members, 1) / CELL))))
    tables = math.ceil(math.log(CELL_MISS) / math.log(1 - (1 - radius / bits) ** width))
    rng = np.random.default_rng(width)
    return np.stack([rng.permutation(bits)[:width] for _ in range(tables)])


def _deal_cells(rows: DataFrame, places: np.ndarray) -> DataFrame:
    """(key, fp, rep) for rows (fp, rep): a row for each table of `places`, keyed by the table and its bits."""
    tables, width = places.shape
    powers, salt = 1 << np.arange(width, dtype=np.uint64), np.arange(tables, dtype=np.uint64) << np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                fps, reps = whole.slice(at, 1024).columns
                bits = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), dtype=np.uint8).reshape(len(fps), -1), axis=1)
                # no least hash is likely to be as small as these keys, and a clash would add a candidate, not lose one
                keys = ((bits[:, places] * powers).sum(axis=2, dtype=np.uint64) | salt).reshape(-1)
                each = pa.array(np.repeat(np.arange(len(fps)), tables))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), fps.take(each), reps.take(each)], ["key", "fp", "rep"])

    return rows.select("fp", "rep").mapInArrow(run, "key long, fp binary, rep long")


def sketch_shards(prints: DataFrame, keys: int, radius: int, limit: int = SHARD_LIMIT) -> DataFrame:
    """(key, fp, rep) for prints (fp, rep, least): see ``sketch`` above.

    A shard over the limit holds a passage that many documents share, or near copies. Its
    members are dealt by samples of their fingerprints' bits instead, once each however many
    such shards they are in, or every member would meet every leader.
    """
    rows = prints.select("fp", "rep", F.explode(F.slice("least", 1, keys)).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    met = stage(rows.join(counts, "key").select("key", "fp", "rep", "_n"), "sketch-shards")
    cool = met.where(F.col("_n") <= limit).select("key", "fp", "rep")
    hot = met.where(F.col("_n") > limit).groupBy("rep").agg(F.first("fp").alias("fp"))
    size, width = hot.agg(F.count("*"), F.max(F.octet_length("fp"))).first()
    return cool.unionByName(_deal_cells(hot, cells(size, radius, 8 * width))) if size else cool


# ---------------------------------------------------------------- confirmed by their shingles


#: Sets under this many shingles have too few votes for the radius to hold. At a similarity of 0.8 each bit of theirs
#: differs with a probability of 0.1875 at most (sets of four and five), so FEW_RADIUS of 256 is over seven deviations away.
FEW_SHINGLES, FEW_RADIUS = 32, 96
#: Least hashes that near copies are dealt by; so many that are not common are enough, as one of them is shared at 0.8
#: but for a probability of 1e-4; else pairs are made of the common ones of so many first (fewer than two of eight are shared with 1e-4).
COPY_KEYS, ENOUGH, PAIRED = 16, 6, 8
#: Candidates of so few of 256 bits apart are compared when the tree meets them, others after it is searched.
CLOSE = 24


def _sketch(docs: DataFrame, width: int, lanes: int, keys: int) -> DataFrame:
    """(file, row, id, rep, n, fp, least) for docs (file, row, id, text), of the set of shingles; rep stands for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rep, n, fps, least = [], [], [], []
                for x in batch.column(3):
                    h = np.unique(shingle_hashes(x.as_py(), width))
                    rep.append(int.from_bytes(hashlib.md5(h.tobytes()).digest()[:8], "big", signed=True))
                    n.append(len(h))
                    fps.append(fingerprint(h, lanes))
                    least.append(h[:keys].view(np.int64))
                made = [pa.array(rep, pa.int64()), pa.array(n, pa.int32()), pa.array(fps, pa.binary()), pa.array(least, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["file", "row", "id", "rep", "n", "fp", "least"])

    return docs.select("file", "row", "id", "text").mapInArrow(run, "file long, row long, id long, rep long, n int, fp binary, least array<long>")


def copy_shards(nodes: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """(key, fp, rep, n) for nodes (rep, fp, n, least): a shard for each least hash that several share.

    A hash that over `limit` share is that of a common passage or of many near copies, and is no
    shard by itself. A text with fewer than ENOUGH others meets those with which it shares two
    such hashes of its PAIRED least; these shards have no limit. So a row is dealt a bounded
    number of times, whatever the table.
    """
    rows = nodes.select("rep", F.posexplode("least").alias("at", "h"))
    counts = rows.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h", (F.col("_n") > limit).alias("hot"))
    cool, hot = F.when(~F.col("hot"), F.col("h")), F.when(F.col("hot") & (F.col("at") < PAIRED), F.col("h"))
    met = rows.join(counts, "h").groupBy("rep").agg(F.collect_list(cool).alias("cool"), F.sort_array(F.collect_list(hot)).alias("hot"), F.count_if("hot").alias("common"))
    both = F.flatten(F.transform("hot", lambda a, i: F.transform(F.slice("hot", i + 2, F.size("hot")), lambda b: F.xxhash64(a, b))))
    few = F.size("least") - F.col("common") < ENOUGH
    dealt = nodes.select("rep", "fp", "n", "least").join(met, "rep")
    return dealt.select(F.explode(F.when(few, F.concat("cool", both)).otherwise(F.col("cool"))).alias("key"), "fp", "rep", "n")


def copy_links(values: list[int], sizes: list[int], radius: int, similarity: float, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links (as places in `values`) that connect what is within the radius and of like size, found with a BK-tree.

    With `sets` those alone are links whose sets are similar. A part of the tree that is joined
    with a value already, or will be, is not searched: near copies cost little, however many.
    """
    children: list[dict[int, int]] = [{} for _ in values]
    parent, only = list(range(len(values))), list(range(len(values)))  # only: a place of the one component below, or -1
    links: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(i: int, j: int) -> None:
        if root(i) != root(j) and (sets is None or _alike([(0, 1)], [sets[i], sets[j]], [0, 1], similarity)):
            parent[root(i)] = root(j)
            links.append((j, i))

    for i, v in enumerate(values):
        few = sizes[i] * similarity < FEW_SHINGLES
        reach, hits, todo = max(radius, FEW_RADIUS) if few else radius, [], [0] if i else []
        while todo:
            at = todo.pop()
            if only[at] >= 0 and root(only[at]) == root(i):
                continue
            d = (v ^ values[at]).bit_count()
            if d <= reach:
                low, high = (sizes[i], sizes[at]) if sizes[i] < sizes[at] else (sizes[at], sizes[i])
                if low >= similarity * high - 1e-9 and (d <= radius or low < FEW_SHINGLES):
                    if sets is None or d <= CLOSE:
                        join(i, at)
                    else:
                        hits.append((d, at))
            todo += [c for e, c in children[at].items() if d - reach <= e <= d + reach]
        for _, at in sorted(hits):
            join(i, at)
        at = 0
        while at != i:
            if only[at] >= 0 and root(only[at]) != root(i):
                only[at] = -1
            at = children[at].setdefault((v ^ values[at]).bit_count(), i)
    return links


def _alike(pairs: list[tuple[int, int]], sets: list[np.ndarray], comps: list[int], similarity: float) -> list[tuple[int, int]]:
    """Those of `pairs` (places in `sets`) whose sets are similar, but for such as other ones of these have joined by then."""
    root = {c: c for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in pairs:
        x, y = find(comps[i]), find(comps[j])
        if x == y:
            continue
        a, b = sets[i], sets[j]
        small, large = (a, b) if len(a) < len(b) else (b, a)
        at = np.minimum(np.searchsorted(large, small), max(0, len(large) - 1))
        shared = int((large[at] == small).sum()) if len(large) else 0
        if shared >= similarity * (len(a) + len(b) - shared) - 1e-9:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _tree_links(members: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(u, v) for members (key, fp, rep, n), a BK-tree per key; with `sets` (the shingles' hashes), links that all shingles confirm."""
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = ["key", "fp", "rep", "n", *(["sets"] if "sets" in members.columns else [])]

    def close(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        _, fps, reps, sizes, *sets = zip(*rows, strict=True)
        links = copy_links([int.from_bytes(x, "big") for x in fps], list(sizes), radius, similarity, [np.frombuffer(x, dtype="<u8") for x in sets[0]] if sets else None)
        return [(reps[a], reps[b]) for a, b in links]

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                found = []
                for row in zip(*(c.to_pylist() for c in whole.slice(at, 1024).columns), strict=True):
                    if held and held[0][0] != row[0]:
                        found += close(held)
                        held = []
                    held.append(row)
                yield out(found)
        yield out(close(held))

    return members.select(*columns).repartition(parts, "key").sortWithinPartitions("key", "rep").mapInArrow(run, "u long, v long")


def _with_sets(rows: DataFrame, width: int) -> DataFrame:
    """`rows` (key, fp, rep, n, text) with `sets`, the sorted shingle hashes, for the text."""

    @F.pandas_udf("binary")
    def low(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(shingle_hashes(x, width)).astype("<u8").tobytes() for x in batch])

    return rows.select("key", "fp", "rep", "n", low("text").alias("sets"))


def with_place(docs: DataFrame) -> DataFrame:
    """`docs` with (file, row), which tell its rows apart and are the same in every scan of the same files."""
    place = (F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select("*", *place)
    except AnalysisException:  # not rows of a table as it is written
        return stage(docs, "placed").select("*", *place)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, lanes: int = 4, radius: int = 56, keys: int = COPY_KEYS, similarity: float = 0.8, limit: int = SHARD_LIMIT) -> DataFrame:
    """(file, row, component): each row of `docs`, which :func:`with_place` made, with the group of near copies it is in, and `first`.

    A link joins texts whose sets of shingles have a Jaccard similarity of `similarity` or more,
    counted exactly; components are those of all links among the candidates. BK-trees of the shards
    (see :func:`copy_shards`) tell which texts the radius connects; each group so connected is
    searched again in a tree of its own, with the sets of its members at hand. Texts without words,
    or null, are one set. `first` is true for the row of the least id in each group, null ids last;
    among rows of equal id for the first in place.
    """
    slim = stage(_sketch(docs.select("file", "row", F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), width, lanes, keys), "prints")
    at = F.struct("file", "row")
    nodes = stage(slim.groupBy("rep").agg(F.min(at).alias("at"), F.min_by("fp", at).alias("fp"), F.min_by("least", at).alias("least"), F.min("n").alias("n")), "distinct-prints")
    near = components(_tree_links(copy_shards(nodes, limit), radius, similarity))
    near = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct())  # with the least nodes themselves
    asked = stage(near.select(F.col("node").alias("rep"), F.col("component").alias("key")).join(nodes.select("rep", "fp", "n", "at.file", "at.row"), "rep"), "copy-groups")
    texts = docs.select("file", "row", F.col(text_col).cast("string").alias("text"))
    linked = components(_tree_links(_with_sets(texts.join(asked, ["file", "row"]), width), radius, similarity))
    named = slim.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("file", "row", "id", F.coalesce("component", "rep").alias("component"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "file", "row")
    kept = named.groupBy("component").agg(F.min(order).alias("keep"))
    return named.join(kept, "component").select("file", "row", "component", ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, lanes: int = 1, keys: int = 0, limit: int = SHARD_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs`.

    component_id is the least id that links reach, through fingerprints that differ in at
    most `radius` bits. With `keys` 0 and one lane this is exact; with `keys`, candidates come
    from shards of that many least shingle hashes, and all within the radius link. A text without
    words, or null, has fingerprint zero and links like any other. Ids make no link: rows may
    share one, or have none, which stays null and counts for no component_id; that is null where
    no row of the component has an id. An empty table gives an empty table, and other columns are
    not looked at. Equal fingerprints are one node, whatever their number.
    """
    made = fingerprints(F.col(text_col), width, lanes, keys)
    slim = stage(docs.select(F.col(id_col).cast("long").alias("id"), made.alias("m")).select("id", F.col("m.fp").alias("fp"), F.col("m.least").alias("least")), "prints")
    prints = slim.groupBy("fp").agg(F.min("id").alias("low"), *([F.min("least").alias("least")] if keys else []))
    prints = stage(prints.withColumn("rep", F.monotonically_increasing_id()), "distinct-prints")
    members = sketch_shards(prints, keys, radius, limit) if keys else block_shards(prints, radius, limit)
    linked = components(_link_shards(members, radius)).withColumnRenamed("node", "rep")
    linked = linked.unionByName(linked.select(F.col("component").alias("rep"), "component").distinct())  # with the least nodes themselves
    joined = stage(linked.join(prints.select("rep", "low"), "rep"), "components")
    least = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    named = prints.select("rep", "fp", "low").join(joined.join(least, "component").select("rep", "component_id", F.lit(True).alias("met")), "rep", "left")
    named = named.select("fp", F.when(F.col("met"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))  # one that has no link is alone
    return slim.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
