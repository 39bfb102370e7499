"""URL filtering by a sorted digest array.

The rules' strings (host + path) become a sorted array of 64-bit xxhash keys beside the
strings themselves, written to one file that executors map into memory. A batch of urls
is probed with one vectorised binary search per number of host labels and rule path
length, and a key that is found counts only if the stored string is the same.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Rules that one shipped index may hold; more are joined, see :func:`join_rules`.
MAX_RULES = 4_000_000
_BLOCK, _ALLOW = 0, 1


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class DigestArray:
    """Sorted 64-bit keys, and per key the verdict and the place of the full string."""

    PARTS = ("keys", "verdicts", "ends", "text", "lengths")

    def __init__(self, paths: Sequence[str]) -> None:
        """Maps the files of PARTS into memory."""
        self.keys, self.verdicts, self.ends, self.text, self.lengths = (np.load(p, mmap_mode="r" if os.path.getsize(p) > 128 else None) for p in paths)  # an empty array cannot be mapped

    @staticmethod
    def write(rules: Sequence[Rule], folder: str, tag: str) -> list[str]:
        """The paths of the files of PARTS. Of rules with the same string the last one counts."""
        last = {r.text: r for r in rules}
        found = sorted((_key(t), t.encode(), r) for t, r in last.items())
        save = lambda name, data: np.save(os.path.join(folder, f"{tag}-{name}.npy"), data)
        save("keys", np.array([k for k, _, _ in found], dtype=np.uint64))
        save("verdicts", np.array([_ALLOW if r.verdict == "allow" else _BLOCK for _, _, r in found], dtype=np.uint8))
        save("ends", np.cumsum([0, *(len(t) for _, t, _ in found)], dtype=np.int64))
        save("text", np.frombuffer(b"".join(t for _, t, _ in found), dtype=np.uint8))
        save("lengths", np.array(sorted({len(r.path) for r in last.values()}), dtype=np.int64))
        return [os.path.join(folder, f"{tag}-{name}.npy") for name in DigestArray.PARTS]

    def find(self, texts: list[str]) -> np.ndarray:
        """The place of each text among the rules, or -1."""
        if not len(self.keys) or not texts:
            return np.full(len(texts), -1, dtype=np.int64)
        probe = np.fromiter(map(_key, texts), dtype=np.uint64, count=len(texts))
        out = np.full(len(texts), -1, dtype=np.int64)
        at = np.searchsorted(self.keys, probe)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probe):
            k, want = int(at[i]), texts[i].encode("utf-8", "surrogatepass")
            while k < len(self.keys) and self.keys[k] == probe[i]:  # keys that collide stand side by side
                if self.string(k) == want:
                    out[i] = k
                    break
                k += 1
        return out

    def string(self, k: int) -> bytes:
        return bytes(self.text[self.ends[k] : self.ends[k + 1]])

    def judge(self, hosts: Sequence[str], paths: Sequence[str]) -> tuple[list[str | None], list[str]]:
        """Per url the longest fitting rule and its verdict (allow without a rule)."""
        texts, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            at = 0
            while host:
                tail = host[at:]
                for n in self.lengths:
                    if n <= len(path):
                        texts.append(tail + path[:n])
                        owner.append(i)
                at = host.find(".", at) + 1
                if not at:
                    break
        found = self.find(texts)
        best: dict[int, int] = {}
        for j in np.flatnonzero(found >= 0):
            i, k = owner[j], int(found[j])
            size = int(self.ends[k + 1] - self.ends[k])
            if i not in best or size > int(self.ends[best[i] + 1] - self.ends[best[i]]):  # longer hosts are tried first
                best[i] = k
        rule = [self.string(best[i]).decode("utf-8", "surrogatepass") if i in best else None for i in range(len(hosts))]
        return rule, ["block" if i in best and self.verdicts[best[i]] == _BLOCK else "allow" for i in range(len(hosts))]


@lru_cache(maxsize=4)
def _opened(tag: str) -> DigestArray:
    return DigestArray([SparkFiles.get(f"{tag}-{name}.npy") for name in DigestArray.PARTS])


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> DataFrame:
    """`pages` with host, path, rule (the longest that fits, host and path together, or null) and verdict.

    A rule fits its host and all subdomains if the path begins with the rule's path. A null
    url, or one without ://, has an empty host and path, fits no rule and is allowed.
    Repeated rows are judged alike; columns host, path, rule and verdict are replaced; an
    empty table gives an empty table. Of fitting rules of equal length the one with the longer
    host counts. The index is shipped to every executor as files and mapped there, so its
    size is bounded: more than MAX_RULES rules are joined with the urls instead.
    """
    if len(rules) > MAX_RULES:
        return join_rules(pages, pages.sparkSession.createDataFrame([(r.host, r.path, r.verdict, k) for k, r in enumerate(rules)], "host string, path string, verdict string, seq long"), url_col)
    tag = f"urlrules-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="urlrules-")  # executors fetch the files from the driver when they first need them
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    for path in DigestArray.write(rules, folder, tag):
        pages.sparkSession.sparkContext.addFile(path)

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = _opened(tag)
        for host, path in batches:
            rule, verdict = index.judge(list(host), list(path))
            yield pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": verdict})

    out = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col))).withColumn("_judged", judged("host", "path"))
    return out.withColumn("rule", F.col("_judged.rule")).withColumn("verdict", F.col("_judged.verdict")).drop("_judged")


def join_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """:func:`filter_urls` for any number of `rules` (host, path, verdict), which are joined by their strings and not shipped.

    Each distinct host and path is looked up under every tail of the host and every length
    of path that a rule has; of rules with the same string that of the greatest `seq` counts, as
    the last one does there, or without such a column the greater verdict.
    """
    order = F.col("seq") if "seq" in rules.columns else F.col("verdict")
    known = rules.groupBy(F.concat("host", "path").alias("_text")).agg(F.max_by("verdict", order).alias("_verdict"), F.max(F.length("path")).alias("_path"))
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("path"))).alias("_lengths"))
    out = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    asked = out.where("host <> ''").select("host", "path").distinct().crossJoin(F.broadcast(lengths))  # one row
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter("_lengths", lambda n: n <= F.length("path"))
    tried = asked.select("host", "path", F.explode(tails).alias("_tail"), fits.alias("_n")).select("host", "path", "_tail", F.explode("_n").alias("_n"))
    tried = tried.withColumn("_text", F.concat("_tail", F.substr("path", F.lit(1), F.col("_n")))).join(known, "_text").where("_n = _path")
    best = tried.groupBy("host", "path").agg(F.max_by(F.struct(F.col("_text").alias("rule"), F.col("_verdict").alias("verdict")), F.struct(F.length("_text"), F.length("_tail"))).alias("_b"))
    return out.join(best, ["host", "path"], "left").withColumn("rule", F.col("_b.rule")).withColumn("verdict", F.coalesce("_b.verdict", F.lit("allow"))).drop("_b")
