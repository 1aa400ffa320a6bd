"""DuckDB SQL of the training-data queries that SQL can express, by plain comparison of everything with everything."""

from __future__ import annotations

from .decontamination import MIN_TOKENS, RUN, SHARE
from .jaccard_join import SIMILARITY, WORDS

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '0' AS h FROM pages),
d AS (SELECT page_id, html, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((strpos('0123456789abcdef', substr(h, (5 * i // 4 + 1)::INT, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, (5 * i // 4 + 2)::INT, 1)) - 1) // (8 >> (5 * i % 4)::INT) % 32 + 1)::INT, 1)), '') AS digest,
  min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH i AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
items AS (SELECT item_id, len(w) AS n, unnest(w) AS t, unnest(range(0, len(w))) AS ip FROM i WHERE len(w) >= {MIN_TOKENS}),
d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
docs AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS dp FROM d),
agree AS (SELECT DISTINCT doc_id, item_id, n, dp - ip AS shift, ip FROM docs JOIN items USING (t)),
enough AS (SELECT doc_id, item_id, n, shift FROM agree GROUP BY ALL HAVING count(*) >= least({SHARE} * n, {SHARE} * {RUN})),
runs AS (SELECT a.*, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY ip RANGE BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING) AS r FROM agree a JOIN enough USING (doc_id, item_id, n, shift)),
best AS (SELECT doc_id, item_id, n, shift, count(*) AS n_agree, max(r) AS best_run FROM runs GROUP BY ALL)
SELECT doc_id, item_id, max(n_agree) AS n_agree, n AS n_item, max(best_run) AS best_run FROM best GROUP BY doc_id, item_id, n
HAVING max(n_agree) >= {SHARE} * n OR (n >= {RUN} AND max(best_run) >= {SHARE} * {RUN})
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= {SIMILARITY} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
classes AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM documents JOIN classes ON a = doc_id LEFT JOIN links ON links.a = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_archive": WARC, "op4_decontamination": DECONTAMINATION, "op7_jaccard_join": JACCARD}
