"""Sizes and quantity signatures of product names, all native."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOP_WORDS, norm_brand, strip_accents

# Units by what they measure, with the amount of base units (ml, g, pieces).
UNITS = {
    ("vol", 1000.0): ["l", "lt", "ltr", "liter", "litre", "liters", "litres", "λ", "λιτ", "λιτρο", "λιτρα", "λτ"],
    ("vol", 1.0): ["ml", "milliliter", "milliliters", "μλ"],
    ("vol", 10.0): ["cl"],
    ("mass", 1000.0): ["kg", "kgr", "kilo", "kilos", "κg", "κιλο", "κιλα", "κ"],
    ("mass", 1.0): ["g", "gr", "gram", "grams", "grammar", "γρ", "γραμ", "γραμμαρια", "γραμμαριο"],
    ("pc", 1.0): [
        "tem", "τεμ", "τεμαχ", "τεμαχια", "τεμαχιο", "τμχ", "τμ", "pcs", "pc", "piece", "pieces", "φακ", "φακελα", "φακελακια", "ρολα", "ρολο", "φυλλα",
        "μεζ", "μεζουρες", "μεζουρα", "δοσεις", "πλυσεις", "πλυση", "washes", "wash", "καψουλες", "καψουλα", "tabs", "tab",
    ],
}
COUNTED_NOUNS = ["αστερων", "αστερια", "αστερι", "φρουτα", "φρουτων", "δημητριακα", "λαχανικα", "βοτανα", "γευσεις", "στρωσεις", "φυλλα"]

_ANY_UNIT = "|".join(re.escape(u) for u in sorted((u for us in UNITS.values() for u in us), key=len, reverse=True))
# What the quantities of a name look like. A shade is no number before the beginning of a unit
# ("35 κ..." is none, but "12,50%" has the shade 12); a dimension needs a blank or the end after it ("6x330 ml" has one, "6x330ml" has none).
_FLAGS, _NUM = "(?iu)(?U)", r"\d+(?:[.,]\d+)?"
SIZE = rf"{_FLAGS}({_NUM})\s*({_ANY_UNIT})\b"
MULTIPACK = rf"{_FLAGS}(\d+)\s*[x×]\s*({_NUM})\s*({_ANY_UNIT})\b"
PROMO = rf"{_FLAGS}\b(\d+)\s*\+\s*(\d+)\b"
NUMBERED = rf"{_FLAGS}\b(?:no|νο)\s*[.:]?\s*(\d+)\b"
SPF = rf"{_FLAGS}\bspf\s*(\d+)\b"
PERCENT = rf"{_FLAGS}({_NUM})\s*%"
SHADE = rf"{_FLAGS}\b(\d{{2,3}})\b(?!\s*(?:%|{_ANY_UNIT}|[x×]))"
DIMENSION = rf"{_FLAGS}\b(\d+)\s*[x×]\s*(\d+)\s*(?:cm|εκ)?\b"


def plain_name(name: Column) -> Column:
    """What sizes and words are read from: lower case, without accents."""
    return F.lower(strip_accents(name))


_text = plain_name


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _double(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).cast("double")


def _lookup(unit: Column) -> Column:
    pairs = [x for (dim, factor), units in UNITS.items() for u in units for x in (F.lit(u), F.struct(F.lit(dim).alias("dim"), F.lit(factor).alias("factor")))]
    return F.try_element_at(F.create_map(*pairs), F.lower(unit))


def _sizes(text: Column) -> Column:
    """All (dim, amount) in the text, left to right."""
    return F.zip_with(_all(text, SIZE, 1), _all(text, SIZE, 2), lambda n, u: F.struct(_lookup(u)["dim"].alias("dim"), F.round(_double(n) * _lookup(u)["factor"], 3).alias("amount")))


def extract_size(name: Column) -> Column:
    """struct(dim, amount): the first multipack, else the last volume or mass, else the last count; null without any."""
    return _size(_text(name))


def _size(text: Column) -> Column:
    count, each, unit = (F.regexp_extract(text, MULTIPACK, k) for k in (1, 2, 3))
    multi = F.when(count != "", F.struct(_lookup(unit)["dim"].alias("dim"), F.round(count.cast("double") * _double(each) * _lookup(unit)["factor"], 3).alias("amount")))
    sizes = _sizes(text)
    bulk, pieces = F.filter(sizes, lambda s: s["dim"] != "pc"), F.filter(sizes, lambda s: s["dim"] == "pc")
    return F.coalesce(multi, F.try_element_at(bulk, F.lit(-1)), F.try_element_at(pieces, F.lit(-1)))


def _pair(text: Column, pattern: str) -> Column:
    a, b = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(a != "", F.sort_array(F.array(a.cast("int"), b.cast("int"))))


def signature(name: Column) -> Column:
    """struct of the quantities that tell variants apart; a component that is absent is null."""
    return signature_in(_text(name))


def signature_in(text: Column) -> Column:
    """:func:`signature` of a name that :func:`plain_name` has made; as a column of its own it is computed once."""
    first = lambda pattern: F.when(F.regexp_extract(text, pattern, 1) != "", F.regexp_extract(text, pattern, 1).cast("int"))
    size = _size(text)
    shades = F.array_distinct(F.transform(_all(text, SHADE, 1), lambda x: x.cast("int")))
    shades = F.sort_array(F.filter(shades, lambda x: ~x.cast("double").eqNullSafe(size["amount"])))
    percents = F.sort_array(F.transform(_all(text, PERCENT, 1), _double))
    nouns = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.try_element_at(_all(text, rf"{_FLAGS}\b(\d+)\s+{n}\b", 1), F.lit(-1)).cast("int")) for n in COUNTED_NOUNS]))
    some = lambda a: F.when(F.size(a) > 0, a)
    return F.struct(
        size.alias("size"), _pair(text, PROMO).alias("promo"), F.array_max(F.transform(F.filter(_sizes(text), lambda s: s["dim"] == "pc"), lambda s: s["amount"])).alias("pieces"),
        first(NUMBERED).alias("no"), F.map_filter(nouns, lambda k, v: v.isNotNull()).alias("counts"), first(SPF).alias("spf"), some(percents).alias("pct"), some(shades).alias("shade"), _pair(text, DIMENSION).alias("dim"),
    )


def signatures_conflict(a: Column, b: Column) -> Column:
    """Whether any component is on both sides and differs."""
    out = F.lit(False)
    for k in ("size", "promo", "pieces", "no", "spf", "pct", "shade", "dim"):
        out = out | F.coalesce(a[k] != b[k], F.lit(False))
    return out | F.exists(F.map_keys(a["counts"]), lambda k: F.coalesce(F.try_element_at(a["counts"], k) != F.try_element_at(b["counts"], k), F.lit(False)))


def sizes_compatible(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def name_tokens(name: Column) -> Column:
    """Sorted tokens of a name without sizes, punctuation and stop words; repeats stay."""
    return _tokens(_text(name))


def _tokens(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, MULTIPACK, " "), SIZE, " ")
    tokens = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9α-ω ]", " "), " +", " ")), " ")
    return F.array_sort(F.filter(tokens, lambda t: (t != "") & ~t.isin(*STOP_WORDS)))


def core_tokens(name: Column, brand: Column) -> Column:
    """`name_tokens` without the brand's, unless nothing would be left."""
    return core_tokens_in(_text(name), norm_brand(brand))


def core_tokens_in(text: Column, brand: Column) -> Column:
    """:func:`core_tokens` of a name that :func:`plain_name` and a brand that `norm_brand` has made."""
    mine = F.split(brand, " ")
    left = F.filter(_tokens(text), lambda t: ~F.array_contains(mine, t))
    return F.when(F.size(left) > 0, left).otherwise(_tokens(text))


def match_key(name: Column, brand: Column) -> Column:
    sig = signature(name)
    size = F.coalesce(F.concat(sig["size"]["dim"], F.lit(":"), sig["size"]["amount"].cast("string")), F.lit("none"))
    bulk = sig["size"]["dim"].isin("vol", "mass")
    promo = F.coalesce(F.array_join(sig["promo"], "+"), F.lit(""))
    return F.concat_ws("|", F.array_join(core_tokens(name, brand), " "), norm_brand(brand), size, F.concat_ws("/", promo, F.coalesce(sig["no"].cast("string"), F.lit("")), F.when(bulk, F.coalesce(sig["pieces"].cast("string"), F.lit(""))).otherwise(F.lit(""))))
