"""SQL counterparts of the corpus queries that SQL can express."""

from __future__ import annotations

_OP7 = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS r
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE r = 1) f ON f.page_id = parts.page_id
"""


_OP5 = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, low),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, low),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS t FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(s) WHERE len(w) > 0),
spots AS (SELECT k, s, n, array_to_string(w[s : s + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM wins) x, unnest(range(1, len(w) - n + 2)) AS r(s)),
hits AS (SELECT DISTINCT k, s, wins.n, item_id FROM spots JOIN wins ON spots.n = wins.n AND spots.t = wins.t),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) AS r(p) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS sha FROM (SELECT DISTINCT k, item_id::VARCHAR AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN named USING (k)
"""

_OP8 = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST) AS rendered, min_by(role || chr(0) || text, coalesce(turn, -1)) AS head FROM t GROUP BY conv_id),
d AS (SELECT min(conv_id) AS conv_id, n, rendered, head, count(*) AS n_copies FROM c GROUP BY n, rendered, head)
SELECT conv_id, n AS n_turns, n_copies, rendered FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.head = d.head AND o.n > d.n AND starts_with(o.rendered, d.rendered))
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": _OP5, "op7_url_filter": _OP7, "op8_chat": _OP8}
