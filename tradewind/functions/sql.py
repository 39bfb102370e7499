"""The library by its SQL names: temporary functions and table functions of a session.

`register(spark)` makes tw_fold, tw_size, tw_tokens, tw_brand, tw_promo and tw_match_key, which are native SQL
(a query that calls them has no Python worker), and the table functions tw_offers and
tw_stretches: the offers in a JSON-LD text, and the stretches of equal prices in a series.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from .quantity import MULTIPACK, NUMBERED, PROMO, SIZE, UNITS
from .text import ACCENTED, STOP_WORDS, accent_map


def _quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions() -> dict[str, str]:
    """The CREATE statements of the temporary functions, by name; each may call those before it."""
    plain, to, many = accent_map()
    pairs = ", ".join(f"named_struct('char', {_quoted(char)}, 'base', {_quoted(base)})" for char, base in many)
    bare = f"CASE WHEN x RLIKE {_quoted(ACCENTED)} THEN aggregate(array({pairs}), translate(x, {_quoted(plain)}, {_quoted(to)}), (acc, p) -> replace(acc, p.char, p.base)) ELSE coalesce(x, '') END"
    units = ", ".join(f"{_quoted(u)}, named_struct('dim', '{dim}', 'factor', {factor}D)" for (dim, factor), names in UNITS.items() for u in names)
    size, pack, promo, numbered = map(_quoted, (SIZE, MULTIPACK, PROMO, NUMBERED))
    stop = ", ".join(map(_quoted, STOP_WORDS))
    blank = _quoted(r"(?U)\s+")
    kind = "STRUCT<dim: STRING, amount: DOUBLE>"
    # a function cannot be called with the variable of a lambda, so these two are put in as text there
    unit, number = (lambda x: f"try_element_at(map({units}), lower({x}))"), (lambda x: f"cast(replace({x}, ',', '.') AS DOUBLE)")
    # what is called twice in a body is given to a function of its own, whose arguments are computed once
    bodies = {
        "tw_bare(x STRING) RETURNS STRING": f"lower({bare})",
        "tw_fold(x STRING) RETURNS STRING": f"trim(regexp_replace(tw_bare(x), {blank}, ' '))",
        "tw_brand(x STRING) RETURNS STRING": "trim(regexp_replace(tw_bare(x), '[^a-z0-9α-ω]+', ' '))",
        "tw_unit(x STRING) RETURNS STRUCT<dim: STRING, factor: DOUBLE>": unit("x"),
        "tw_number(x STRING) RETURNS DOUBLE": number("x"),
        f"tw_sizes_in(t STRING) RETURNS ARRAY<{kind}>": f"zip_with(regexp_extract_all(t, {size}, 1), regexp_extract_all(t, {size}, 2), (n, u) -> named_struct('dim', {unit('u')}.dim, 'amount', round({number('n')} * {unit('u')}.factor, 3)))",
        f"tw_sizes(x STRING) RETURNS ARRAY<{kind}>": "tw_sizes_in(tw_bare(x))",
        f"tw_pack_in(t STRING) RETURNS {kind}": f"CASE WHEN regexp_extract(t, {pack}, 1) <> '' THEN named_struct('dim', tw_unit(regexp_extract(t, {pack}, 3)).dim, 'amount', round(tw_number(regexp_extract(t, {pack}, 1)) * tw_number(regexp_extract(t, {pack}, 2)) * tw_unit(regexp_extract(t, {pack}, 3)).factor, 3)) END",
        f"tw_pack(x STRING) RETURNS {kind}": "tw_pack_in(tw_bare(x))",
        f"tw_size_of(p {kind}, s ARRAY<{kind}>) RETURNS {kind}": "coalesce(p, try_element_at(filter(s, y -> y.dim <> 'pc'), -1), try_element_at(filter(s, y -> y.dim = 'pc'), -1))",
        f"tw_size_in(t STRING) RETURNS {kind}": "tw_size_of(tw_pack_in(t), tw_sizes_in(t))",
        f"tw_size(x STRING) RETURNS {kind}": "tw_size_in(tw_bare(x))",
        "tw_tokens_in(t STRING) RETURNS ARRAY<STRING>": f"array_sort(filter(split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {pack}, ' '), {size}, ' '), '[^a-z0-9α-ω ]', ' '), ' +', ' ')), ' '), t -> t <> '' AND t NOT IN ({stop})))",
        "tw_tokens(x STRING) RETURNS ARRAY<STRING>": "tw_tokens_in(tw_bare(x))",
        "tw_without(t ARRAY<STRING>, m ARRAY<STRING>) RETURNS ARRAY<STRING>": "CASE WHEN exists(t, w -> NOT array_contains(m, w)) THEN filter(t, w -> NOT array_contains(m, w)) ELSE t END",
        "tw_core(x STRING, b STRING) RETURNS ARRAY<STRING>": "tw_without(tw_tokens(x), split(tw_brand(b), ' '))",
        "tw_promo_in(t STRING) RETURNS STRING": f"CASE WHEN regexp_extract(t, {promo}, 1) <> '' THEN array_join(sort_array(array(cast(regexp_extract(t, {promo}, 1) AS INT), cast(regexp_extract(t, {promo}, 2) AS INT))), '+') ELSE '' END",
        "tw_promo(x STRING) RETURNS STRING": "tw_promo_in(tw_bare(x))",
        f"tw_key_of(t STRING, core ARRAY<STRING>, brand STRING, size {kind}, sizes ARRAY<{kind}>) RETURNS STRING": "concat_ws('|', array_join(core, ' '), brand, coalesce(concat(size.dim, ':', cast(size.amount AS STRING)), 'none'), concat_ws('/', tw_promo_in(t), "
        f"CASE WHEN regexp_extract(t, {numbered}, 1) <> '' THEN cast(cast(regexp_extract(t, {numbered}, 1) AS INT) AS STRING) ELSE '' END, "
        "CASE WHEN size.dim IN ('vol', 'mass') THEN coalesce(cast(array_max(transform(filter(sizes, s -> s.dim = 'pc'), s -> s.amount)) AS STRING), '') ELSE '' END))",
        f"tw_key_with(t STRING, brand STRING, sizes ARRAY<{kind}>) RETURNS STRING": "tw_key_of(t, tw_without(tw_tokens_in(t), split(brand, ' ')), brand, tw_size_of(tw_pack_in(t), sizes), sizes)",
        "tw_key_in(t STRING, brand STRING) RETURNS STRING": "tw_key_with(t, brand, tw_sizes_in(t))",
        "tw_match_key(x STRING, b STRING) RETURNS STRING": "tw_key_in(tw_bare(x), tw_brand(b))",
    }
    return {head.split("(")[0]: f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}" for head, body in bodies.items()}


_OFFER = StructType().add("name", StringType()).add("brand", StringType()).add("sku", StringType()).add("price", DoubleType()).add("list_price", DoubleType()).add("currency", StringType()).add("in_stock", IntegerType())


def _offers(tree: object) -> Iterator[tuple]:
    """A row per offer of each product in a decoded JSON-LD document, as `sources.extract.product_offers` makes them."""
    level = [tree]
    while level:
        below = []
        for node in level:
            below += node if isinstance(node, list) else node.values() if isinstance(node, dict) else []
            if isinstance(node, dict) and "product" in [str(k).lower() for k in _list(node.get("@type"))]:
                who = (_text(node, "name"), _text(node, "brand"), next((t for t in (_text(node, k) for k in ("sku", "gtin13", "gtin")) if t), None))
                offers = _list(node.get("offers"))
                yield from [(*who, *_price(o)) for o in offers if isinstance(o, dict)] if offers else [(*who, None, None, "EUR", None)]
        level = below


def _list(x: object) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _text(node: dict, key: str) -> str | None:
    first = next(iter(_list(node.get(key))), None)
    first = first.get("name") if isinstance(first, dict) else first
    return None if first is None else str(first)


def _figure(node: dict, key: str) -> float | None:
    try:
        return float(_text(node, key) or "")
    except ValueError:
        return None


def _price(offer: dict) -> tuple:
    price = _figure(offer, "lowPrice" if (_text(offer, "price") or "") in ("", "0", "0.0") else "price")
    told = (_text(offer, "availability") or "").lower()
    stock = 1 if any(w in told for w in ("instock", "in_stock")) else 0 if any(w in told for w in ("outofstock", "out_of_stock", "soldout")) else None
    return price, _figure(offer, "highPrice"), _text(offer, "priceCurrency") or "EUR", stock


class Offers:
    """tw_offers(raw [, keep => 'a, b']): the offers in a JSON-LD text; `keep` names the columns wanted, all without it.

    The columns depend on a constant argument, so they are told when the query is analysed.
    Called with LATERAL it gives a row per offer and outer row; null, or no JSON, gives none.
    """

    def __init__(self) -> None:
        self.places: list[int] | None = None

    @staticmethod
    def analyze(raw: AnalyzeArgument, keep: AnalyzeArgument | None = None) -> AnalyzeResult:
        if raw.dataType != StringType():
            raise ValueError("tw_offers takes a text")
        if keep is None:
            return AnalyzeResult(schema=_OFFER)
        if not keep.isConstantExpression or not isinstance(keep.value, str):
            raise ValueError("keep is a constant text")
        names = [n.strip() for n in keep.value.split(",")]
        unknown = [n for n in names if n not in _OFFER.names]
        if unknown:
            raise ValueError(f"no such columns: {unknown}")
        return AnalyzeResult(schema=StructType([_OFFER[n] for n in names]))

    def eval(self, raw: str | None, keep: str | None = None) -> Iterator[tuple]:
        import json

        if self.places is None:
            self.places = list(range(len(_OFFER.names))) if keep is None else [_OFFER.names.index(n.strip()) for n in keep.split(",")]
        try:
            tree = json.loads(raw) if raw else None
        except ValueError:
            return
        for row in _offers(tree):
            yield tuple(row[k] for k in self.places)


class Stretches:
    """tw_stretches(TABLE(t) PARTITION BY k ORDER BY at): the changes of a price along a series, one row per stretch of equal prices.

    Takes a table with the columns at and price and gives from_at, to_at, price, n; a partition is
    read row by row, so none is held in memory.
    """

    def __init__(self) -> None:
        self.row: list | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("tw_stretches takes a table")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        if not {"key", "at", "price"} <= kinds.keys():
            raise ValueError("the table has the columns key, at and price")
        return AnalyzeResult(schema=StructType().add("key", kinds["key"]).add("from_at", kinds["at"]).add("to_at", kinds["at"]).add("price", kinds["price"]).add("n", IntegerType()))

    def eval(self, rows) -> Iterator[tuple]:
        key, at, price = rows["key"], rows["at"], rows["price"]
        if self.row is not None and (self.row[0], self.row[3]) == (key, price):
            self.row[2], self.row[4] = at, self.row[4] + 1
            return
        if self.row is not None:
            yield tuple(self.row)
        self.row = [key, at, at, price, 1]

    def terminate(self) -> Iterator[tuple]:
        if self.row is not None:
            yield tuple(self.row)


def register(spark: SparkSession) -> None:
    """Make all of them known to the session, under their SQL names."""
    for statement in definitions().values():
        spark.sql(statement)
    spark.udtf.register("tw_offers", udtf(Offers))
    spark.udtf.register("tw_stretches", udtf(Stretches))
