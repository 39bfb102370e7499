"""Quality rules as weak supervision (native).

Each rule votes +1 (looks good), -1 (looks bad) or 0 (abstains). A two-class label model
(rules independent given the class) is fitted by expectation-maximisation, and the
posterior probability of the good class replaces all-must-pass filtering.

The votes of a document are one of at most 3**rules patterns, so what the fit needs from
the corpus is a table of pattern counts, made by one aggregation over all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, UPPER, let, words

SYMBOLS = "#*$%&|<>"
NGRAM = 5
_Q = "_q_"


def _marked(h: Column) -> Column:
    """How many positions lie in a window of NGRAM words whose hash in `h` occurs more than once."""
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def seen_twice(s: Column) -> Column:
        far = F.size(s) - 1
        same = lambda e, j: F.get(s, j)["h"].eqNullSafe(e["h"])
        return F.filter(s, lambda e, j: F.when(j > 0, same(e, j - 1)).otherwise(False) | F.when(j < far, same(e, j + 1)).otherwise(False))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, j: F.least(F.lit(NGRAM), F.coalesce(F.get(at, j + 1) - p, F.lit(NGRAM))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(pairs, lambda s: let(F.sort_array(F.transform(seen_twice(s), lambda e: e["i"])), covered))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters.

    Whole texts, in one narrow pass. Words are runs of characters other than the six ASCII
    blanks; windows of five words are compared by the 64-bit hash of their words. A null
    text counts as empty: all features 0. Columns of these names in `docs` are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    w, h, lines = (F.col(_Q + x) for x in ("w", "h", "l"))
    step = docs.withColumn(_Q + "w", words(F.col(text_col)))
    grams = F.when(F.size(w) >= NGRAM, F.transform(F.sequence(F.lit(0), F.size(w) - NGRAM), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(NGRAM)])))
    step = step.withColumn(_Q + "h", F.coalesce(grams, F.array().cast("array<bigint>")))
    step = step.withColumn(_Q + "l", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0))
    letters = UPPER + UPPER.lower()
    made = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(text, BLANK_CHARS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_marked(h)),
        "n_upper": (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long"),
        "n_letters": (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long"),
    }
    # as the output of a generator the features are computed once: no filter on them is moved below it
    packed = F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()])))
    kept = [c for c in docs.columns if c not in made]
    return step.select(*[F.col(c) for c in kept], packed.alias(_Q + "f")).select(*kept, *[F.col(f"{_Q}f.{k}").alias(k) for k in made])


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def votes() -> dict[str, Column]:
    """The rules over the columns of :func:`features`; each abstains between its two bounds."""
    n, chars, sym = F.col("n_words"), F.col("word_chars"), F.col("n_symbols")
    return {
        "length": _vote(n < 10, n >= 30),
        "symbols": _vote(10 * sym > n, 100 * sym <= n),
        "word_length": _vote((chars > 9 * n) | (chars < 3 * n), (10 * chars <= 65 * n) & (10 * chars >= 40 * n)),
        "repeated_lines": _vote(10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), (F.col("n_lines") > 1) & (20 * F.col("n_dup_lines") <= F.col("n_lines"))),
        "repeated_words": _vote(5 * F.col("n_repeat_words") > n, 20 * F.col("n_repeat_words") <= n),
        "shouting": _vote(2 * F.col("n_upper") > F.col("n_letters"), 5 * F.col("n_upper") <= F.col("n_letters")),
    }


@dataclass(frozen=True)
class LabelModel:
    """log P(good), log P(bad) and per rule {vote: (log P(vote | good), log P(vote | bad))}."""

    rules: tuple[str, ...]
    prior: tuple[float, float]
    tables: dict[str, dict[int, tuple[float, float]]] = field(default_factory=dict)

    def logit(self, vote: dict[str, int]) -> float:
        return self.prior[0] - self.prior[1] + sum(self.tables[r][vote[r]][0] - self.tables[r][vote[r]][1] for r in self.rules)

    def posterior(self, vote: dict[str, Column]) -> Column:
        logit = F.lit(self.prior[0] - self.prior[1])
        for r in self.rules:
            part = {v: self.tables[r][v][0] - self.tables[r][v][1] for v in (-1, 0, 1)}
            logit = logit + F.when(vote[r] == -1, part[-1]).when(vote[r] == 1, part[1]).otherwise(part[0])
        return 1 / (1 + F.exp(-logit))

    def accuracy(self, rule: str) -> float:
        """P(vote is right | it votes), over both classes."""
        (pg, pb), t = (math.exp(x) for x in self.prior), self.tables[rule]
        right = pg * math.exp(t[1][0]) + pb * math.exp(t[-1][1])
        return right / (right + pg * math.exp(t[-1][0]) + pb * math.exp(t[1][1]))


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: tuple[str, ...], rounds: int = 60, good: float = 0.85, trust: float = 0.8, strength: float = 0.02) -> LabelModel:
    """Expectation-maximisation over pattern counts; plain arithmetic on at most 3**rules numbers.

    It starts from rules that are right with probability `trust`; pseudo-counts of that
    start, `strength` times the number of documents, keep the classes from changing sides.
    No patterns (an empty table) leave the start as it is.
    """
    total = sum(c for _, c in patterns)
    start = {1: (trust * 0.75, (1 - trust) * 0.75), -1: ((1 - trust) * 0.75, trust * 0.75), 0: (0.25, 0.25)}
    prior = (good, 1 - good)
    tables = {r: dict(start) for r in rules}
    pseudo = max(1.0, strength * total)
    for _ in range(rounds if total else 0):
        mass = [pseudo * good, pseudo * (1 - good)]
        sums = {r: {v: [pseudo * good * start[v][0], pseudo * (1 - good) * start[v][1]] for v in start} for r in rules}
        for vote, count in patterns:
            a, b = prior
            for r, v in zip(rules, vote, strict=True):
                a, b = a * tables[r][v][0], b * tables[r][v][1]
            p = a / (a + b)
            for k, share in ((0, p * count), (1, (1 - p) * count)):
                mass[k] += share
                for r, v in zip(rules, vote, strict=True):
                    sums[r][v][k] += share
        prior = (mass[0] / sum(mass), mass[1] / sum(mass))
        tables = {r: {v: (sums[r][v][0] / mass[0], sums[r][v][1] / mass[1]) for v in start} for r in rules}
    log = lambda pair: (math.log(pair[0]), math.log(pair[1]))
    return LabelModel(rules, log(prior), {r: {v: log(pair) for v, pair in t.items()} for r, t in tables.items()})


def learn(featured: DataFrame) -> LabelModel:
    """The label model of all rows of `featured` (columns of :func:`features`)."""
    rule = votes()
    counts = featured.select(*[c.alias(_Q + k) for k, c in rule.items()]).groupBy(*[_Q + k for k in rule]).count()
    rows = sorted((tuple(r[:-1]), r[-1]) for r in counts.collect())  # at most 3**6 rows
    return fit(rows, tuple(rule))


def verdict(featured: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """`featured` with base_failed, quality (the posterior) and kept.

    base_failed: under ten words, or over a fifth of the words in repeated windows. kept is
    false for those; for the others it says whether the posterior reaches `threshold`.
    """
    n = F.col("n_words")
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    return featured.withColumn("base_failed", failed).withColumn("quality", model.posterior(votes())).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
