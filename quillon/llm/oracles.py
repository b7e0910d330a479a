"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quillon.llm import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def license_scan() -> str:
    found = licenses.index()
    at = lambda p, w: f"coalesce(w[o + {p + 1}] = '{w}' AND o + {p} >= 0, false)"
    lists = []
    for x in found:
        rare = " + ".join(f"CASE WHEN {at(p, w)} THEN 1 ELSE 0 END" for p, w, _ in x["rare"])
        keys = " AND ".join(at(p, w) for p, w in x["keys"])
        share = " + ".join(f"CASE WHEN {at(p, w)} THEN {s!r}::DOUBLE ELSE 0.0::DOUBLE END" for p, w, s in x["rare"])
        total = float(sum(s for _, _, s in x["rare"]))
        places = f"list_filter(range(-{max(p for p, _ in x['keys'])}, len(w)), lambda o: ({keys}) AND 2 * ({rare}) >= {len(x['rare'])})"
        lists.append(f"list_transform({places}, lambda o: {{'o': o, 'l': '{x['label']}', 's': ({share}) / {total!r}::DOUBLE}})")
    base, more = " || ".join(lists[: licenses.BASE]), " || ".join(lists[licenses.BASE :])
    names = lambda c: f"array_to_string(list_sort(list_distinct(list_transform({c}, lambda x: x.l))), ',')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
f AS (SELECT doc_id, w, {base} AS b, {more} AS m FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, len(b)::BIGINT AS n_base,
  list_min(list_transform(b, lambda x: x.o))::BIGINT AS first_word, list_max(list_transform(b, lambda x: x.o))::BIGINT AS last_word,
  {names("b")} AS base_labels, {names("(b || m)")} AS labels,
  coalesce(list_max(list_transform(b || m, lambda x: least(1.0::DOUBLE, x.s))), 0.0::DOUBLE) AS score
FROM f"""


JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL"""

CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda k: w[k:k + 9])) AS x FROM i WHERE len(w) > 0),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
z AS (SELECT DISTINCT len(x) AS z FROM v),
q AS (SELECT doc_id, k, z, w[k:k + z - 1] AS x FROM p, z WHERE k + z - 1 <= len(w)),
h AS (SELECT doc_id, k, z, item_id FROM q JOIN v USING (x)),
t AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(k, k + z)) AS word FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(t.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(m.s, '')) AS items_sha256, coalesce(t.n, 0) > 0 AS contaminated
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)"""
