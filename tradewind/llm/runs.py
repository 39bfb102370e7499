"""Periodic runs of words: maximal repetitions found by Lyndon arrays over ordered words.

A run is a longest stretch with a smallest period; its leftmost Lyndon root is an edge from a
word to the next smaller suffix, under the order of the words or under the reverse of it. Edges
come from one pass with a stack. What a comparison of two suffixes has matched is kept: a
later comparison inside the stretch that was matched furthest takes its result from the copy
of itself in the earlier occurrence, and one that leaves the stretch goes on where it ends. So
no word is read twice in vain, words are only compared (never ranked or hashed), and no suffix
structure is built: time and memory are linear in the words of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import gt, lt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

#: Bytes of text that are handled at once, but for a longer text, which is handled alone.
BATCH_BYTES = 1 << 22
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_edges(words: list, less=lt) -> list[tuple[int, int, int]]:
    """(l, r, m): each place l, the next place r whose suffix is smaller, and how many words m > 0 they have in common; edges without are left out.

    The end of the text is smaller than any word. `less` is the order of words.
    """
    n = len(words)
    before = [-1] * n  # the previous place with a smaller suffix
    after = [n] * n  # the next one
    common_before, common_after = [0] * n, [0] * n  # words in common along these edges
    left = right = reach = 0  # the words at left and right match up to reach, which no comparison has passed
    edges = []
    for r in range(1, n):
        word = words[r]
        l = r - 1  # noqa: E741
        seen = 0
        popped = -1
        while l >= 0:
            other = words[l]
            if other != word:
                m = 0
                smaller = less(other, word)
            else:
                m, known = 0, False
                if popped >= 0:  # before[popped] is l: two matches with the popped place give the third
                    step = common_before[popped]
                    m, known = (step, False) if step == seen else (min(step, seen), True)
                if not known and right < r < reach and l >= right:
                    a, b = l - right + left, r - right + left
                    copied = common_after[a] if after[a] == b else common_before[b] if before[b] == a else -1
                    if copied >= 0:
                        m, known = (copied, True) if r + copied < reach else (max(m, reach - r), False)
                if not known:
                    while r + m < n and words[l + m] == words[r + m]:
                        m += 1
                    if r + m >= reach:
                        left, right, reach = l, r, r + m
                smaller = r + m < n and less(words[l + m], words[r + m])
            if smaller:
                before[r], common_before[r] = l, m
                break
            after[l], common_after[l] = r, m
            if m:
                edges.append((l, r, m))
            popped, seen, l = l, m, before[l]  # noqa: E741
    return edges


def word_runs(words: list, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """All (start, length, period) in order of start and period: runs of at least `least` words and `times` (2 or more) periods.

    To the left of a root at most one period is read; once per run, which has `times` of them.
    """
    found = set()
    for less in (lt, gt):
        done: dict[int, int] = {}  # places of roots to their periods, in runs that a root before has told
        for l, r, m in sorted(lyndon_edges(words, less)):  # noqa: E741
            p = r - l
            if m <= (times - 2) * p:
                continue
            told = done.pop(l, None) == p
            if m >= p:  # the next root lies in the same run
                done[r] = p
            if told:
                continue
            back = 0
            while back < p and l > back and words[l - 1 - back] == words[r - 1 - back]:
                back += 1
            if back < p and back + p + m >= max(least, times * p):
                found.add((l - back, back + p + m, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """`words` without those that a run holds after its first period."""
    out, gone_to = [], 0
    for start, stop in sorted((s + p, s + n) for s, n, p in runs):
        if start > gone_to:
            out += words[gone_to:start]
        gone_to = max(gone_to, stop)
    return out + words[gone_to:]


def _slices(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """`batch` in pieces of about BATCH_BYTES of text, so that what Python makes of one piece bounds its memory."""
    begin = held = 0
    for k, n in enumerate(pc.binary_length(batch.column(text_col)).to_pylist()):
        held += n or 0
        if held >= BATCH_BYTES:
            yield batch.slice(begin, k + 1 - begin)
            begin, held = k + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def find_runs(docs: DataFrame, text_col: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """`docs` with `runs` array<struct(start, length, period)> and `collapsed` of its text.

    Words are the stretches between the six ASCII blanks; a run has at least `least` words and
    `times` periods, its smallest period counts, and starts are numbered from 0. `collapsed` has
    the words that no run holds after its first period, with single blanks. A null text, like an
    empty one, has no runs and collapses to ''. Repeated rows are judged alike; an empty table
    gives an empty table. Columns named runs or collapsed are an error, others stay.

    No shuffle. A text is one value, so it is one task's work, in time linear in its length.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    taken = {"runs", "collapsed"} & set(docs.columns)
    if taken:
        raise ValueError(f"documents have columns {sorted(taken)} of their own")

    def one(text: str | None) -> tuple[list[dict], str]:
        words = (text or "").encode().split()
        found = word_runs(words, times, least)
        kept = kept_words(words, found) if found else words
        return [{"start": s, "length": n, "period": p} for s, n, p in found], b" ".join(kept).decode()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch, text_col):
                made = [one(x) for x in piece.column(text_col).to_pylist()]
                columns = [*piece.columns, pa.array([a for a, _ in made], _RUNS), pa.array([b for _, b in made], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names, "runs", "collapsed"])

    names = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return names.mapInArrow(judge, StructType([*names.schema.fields, StructField("runs", DataType.fromDDL(RUNS)), StructField("collapsed", StringType())]))


def longest_run(runs: Column) -> Column:
    """The run of greatest length, ties to the smallest start, then period; null without runs."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(order)
