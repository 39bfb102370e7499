"""Trees and link graphs: what is reachable from where, by recursive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels that a recursive query may have.
LEVELS = 100


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth, path): every way from the nodes of `roots` (node) down `edges` (parent, child); a root reaches itself at depth 0.

    A way that comes back to a node of its own ends there, so cycles do no harm; repeated edges
    count once. A node that several ways reach has a row for each: right for trees, and to be
    reduced by :func:`first_reached` for graphs. Deeper than LEVELS, or more rows than
    spark.sql.cteRecursionRowLimit, is an error and not a part of the result.
    """
    return edges.sparkSession.sql(
        f"""
        WITH RECURSIVE walk(root, node, depth, path) MAX RECURSION LEVEL {LEVELS} AS (
          SELECT node, node, 0, array(node) FROM (SELECT DISTINCT node FROM {{roots}})
          UNION ALL
          SELECT w.root, e.child, w.depth + 1, array_append(w.path, e.child)
          FROM walk w JOIN (SELECT DISTINCT parent, child FROM {{edges}}) e ON e.parent = w.node AND NOT array_contains(w.path, e.child))
        SELECT root, node, depth, path FROM walk""",
        edges=edges,
        roots=roots,
    )


def first_reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): each node that some root reaches, at its least depth."""
    return reachable(edges, roots).groupBy("node").agg(F.min("depth").alias("depth"))


def leaves(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of :func:`reachable` whose node has no child."""
    return reachable(edges, roots).join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def tree_edges(documents: DataFrame, id_col: str = "id", raw_col: str = "raw", key: str = "category_id", below: str = "children") -> DataFrame:
    """(document, parent, node, name, depth) of the trees in JSON texts: nodes with a `key`, and the key of the node above (null at the top).

    The tree is an array, or an object, or an object with the tree in its field `tree`; text that
    is no JSON has no nodes. A level at a time by a recursive query over the VARIANT.
    """
    return documents.sparkSession.sql(
        f"""
        WITH RECURSIVE walk(document, parent, node, depth) MAX RECURSION LEVEL {LEVELS} AS (
          SELECT d.{id_col}, CAST(NULL AS STRING), t.value, 0
          FROM (SELECT {id_col}, try_parse_json({raw_col}) AS v FROM {{documents}}) d, LATERAL variant_explode(coalesce(try_variant_get(d.v, '$.tree', 'variant'), d.v)) t
          UNION ALL
          SELECT w.document, coalesce(try_variant_get(w.node, '$.{key}', 'string'), w.parent), t.value, w.depth + 1
          FROM walk w, LATERAL variant_explode(try_variant_get(w.node, '$.{below}', 'variant')) t)
        SELECT document, parent, try_variant_get(node, '$.{key}', 'string') AS node, try_variant_get(node, '$.name', 'string') AS name, depth
        FROM walk WHERE try_variant_get(node, '$.{key}', 'string') IS NOT NULL""",
        documents=documents,
    )
