"""Folding and name normalisation as native column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without identity, and words that are noise as a difference.
STOP_WORDS = ["the", "and", "με", "και", "του", "της", "το", "η", "ο", "σε", "για", "gia", "apo", "από", "στο", "στη", "των", "ένα", "ενα", "of", "for", "with"]
DIFFERENCE_NOISE = ["gr", "g", "ml", "lt", "l", "kg", "tem", "τεμ", "pcs", "pc", "x", "συσκευασια", "πακετο", "τμχ"]


@cache
def _plain() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters whose compatibility decomposition without marks is one character, and the others."""
    one, to, many = [], [], []
    for c in map(chr, [*range(0x80, 0x2000), *range(0x2000, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base == c:
            continue
        if len(base) == 1:
            one.append(c)
            to.append(base)
        elif base:
            many.append((c, base))
    marks = [chr(x) for x in range(0x300, 0x10000) if unicodedata.combining(chr(x))]
    return "".join([*one, *marks]), "".join(to), tuple(many)


#: What a text has if the map may change it: all characters of the map are beyond ASCII.
ACCENTED = r"[^\x00-\x7F]"


def accent_map() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, the characters they become (marks: none), characters that become several)."""
    plain, to, many = _plain()
    return plain, to, tuple(m for m in many if 0xA0 <= ord(m[0]) <= 0x17F or 0xFB00 <= ord(m[0]) <= 0xFB06)


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; null becomes ''."""
    plain, to, many = accent_map()
    text = F.coalesce(c, F.lit(""))
    one = F.translate(text, plain, to)
    pairs = F.array(*[F.struct(F.lit(char).alias("char"), F.lit(base).alias("base")) for char, base in many])
    out = F.aggregate(pairs, one, lambda acc, p: F.replace(acc, p["char"], p["base"]))
    # a chain of calls for each row costs more than the whole rest, and few texts need it
    return F.when(text.rlike(ACCENTED), out).otherwise(text)


def fold(c: Column) -> Column:
    """Accents off, lower case, blanks trimmed and collapsed."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"(?U)\s+", " "))


def norm_brand(c: Column) -> Column:
    """`fold` with everything but letters a-z, α-ω and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z0-9α-ω]+", " "))


def product_key(shared_key: Column, name: Column, brand: Column) -> Column:
    return F.when(F.length(F.coalesce(shared_key, F.lit(""))) > 0, F.concat(F.lit("sku:"), shared_key)).otherwise(F.concat(F.lit("nb:"), fold(name), F.lit("|"), fold(brand)))


def strip_brand_prefix(name: Column, brand: Column) -> Column:
    """`name` without a leading brand, unless nothing would be left; other names stay as they are."""
    n, b = F.lower(strip_accents(name)), F.lower(strip_accents(brand))
    fn, fb = F.trim(n), F.trim(b)
    exact = F.lower(F.substr(name, F.lit(1), F.length(brand))) == F.lower(brand)
    tokens, mine = F.split(F.trim(name), r"\s+"), F.split(F.trim(brand), r"\s+")
    head = F.lower(strip_accents(F.array_join(F.slice(tokens, F.lit(1), F.size(mine)), " ")))
    by_token = (F.size(tokens) > F.size(mine)) & (head == fb)
    tail = F.array_join(F.slice(tokens, F.size(mine) + 1, F.greatest(F.size(tokens) - F.size(mine), F.lit(0))), " ")
    rest = F.when(exact, F.substr(name, F.length(brand) + 1)).when(by_token, tail)
    rest = F.trim(F.regexp_replace(rest, r"^[ \-–—·•|]+", ""))
    hit = name.isNotNull() & brand.isNotNull() & (fb != "") & F.startswith(fn, fb)
    return F.when(hit & (F.length(F.coalesce(rest, F.lit(""))) > 0), rest).otherwise(name)


# What a figure looks like in the price texts of two shops.
FIGURE = r"(\d{1,3}(?:\.\d{3})*,\d{1,2}|\d+,\d{1,2}|\d+)"
FIGURE_WITH_POINT = r"(\d{1,3}(?:\.\d{3})*,\d{1,2}|\d+,\d{1,2}|\d+\.\d{1,2}|\d+)"


def _comma_decimal(raw: Column) -> Column:
    return F.when(F.contains(raw, F.lit(",")), F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(raw)


def number(c: Column, pattern: str = FIGURE_WITH_POINT) -> Column:
    """The first figure of a price text as a double, a comma being decimal; null without one."""
    return _comma_decimal(F.regexp_extract(F.replace(c, F.lit("\u00a0"), F.lit(" ")), pattern, 1)).try_cast("double")


def number_by_last(c: Column) -> Column:
    """A whole figure as a double: of a comma and a point the later one is decimal; null if it is none."""
    t = F.trim(c)
    comma, point = F.instr(F.reverse(t), ","), F.instr(F.reverse(t), ".")
    thousands = F.when((comma > 0) & (point > 0) & (point < comma), F.replace(t, F.lit(","), F.lit("")))
    return F.coalesce(thousands, _comma_decimal(t)).try_cast("double")


def number_stripped(c: Column) -> Column:
    """A price as a double, a comma being decimal; signs that are no figure go if it is none with them."""
    t = _comma_decimal(F.trim(F.regexp_replace(F.trim(c), "[\u00a0€]", "")))
    return F.coalesce(t.try_cast("double"), F.regexp_replace(t, r"[^0-9.]", "").try_cast("double"))


def cents(c: Column) -> Column:
    """Half up to two places by the same arithmetic in every engine."""
    return F.floor(c * 100 + 0.5) / 100


# The words that reviewers use.
APPROVE = ["merge", "approve", "yes", "y", "1", "true"]
REJECT = ["reject", "no", "n", "0", "false", "notsame", "not_same"]


def decision(c: Column) -> Column:
    """approve, reject or skip."""
    word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(word.isin(*APPROVE), "approve").when(word.isin(*REJECT), "reject").otherwise("skip")
