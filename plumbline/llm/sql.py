"""SQL (DuckDB) for the queries that SQL can express."""

from __future__ import annotations

import re

from plumbline.llm.licenses import PHRASES, TEMPLATES

OP1 = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
h AS (
  SELECT doc_id, i, md5(array_to_string(list(w) OVER win, ' ')) AS k, count(*) OVER win AS c
  FROM w WINDOW win AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT k, min(doc_id) AS lo FROM h WHERE c = 50 GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM (SELECT h.doc_id, h.i FROM h JOIN m USING (k) WHERE h.c = 50 AND h.doc_id > m.lo)),
k AS (
  SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(w.w, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS kept
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP3 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i // 8 * 10 + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM d JOIN m USING (payload_digest)
"""

OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""


def _pattern(template: str) -> str:
    """A template as a regular expression over words, each after a space; a space follows."""
    out = ""
    for part in re.split(r"(<<opt>>|<</opt>>|<<var:\d+>>)", template):
        if part == "<<opt>>":
            out += "("
        elif part == "<</opt>>":
            out += ")?"
        elif m := re.fullmatch(r"<<var:(\d+)>>", part):
            out += f"( [^ ]+){{0,{m[1]}}}"
        else:
            out += "".join(f" {w}" for w in part.split())
    return out + " "


def op9() -> str:
    places = {label: f"list_filter(range(1, len(ws) + 1), lambda i: {' AND '.join(f'''ws[i + {k}] = '{w}' ''' for k, w in enumerate(phrase.split()))})" for phrase, label in PHRASES.items()}
    base = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for label, p in places.items())
    more = ", ".join(f"CASE WHEN regexp_matches(j, '{_pattern(t)}') THEN '{name.partition(':')[0]}' END" for name, t in TEMPLATES.items())
    every = "list_concat(" + ", ".join(places.values()) + ")"
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
u AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS j FROM t),
p AS (SELECT doc_id, len(ws) AS n_words, {every} AS starts, list_filter([{base}], lambda x: x IS NOT NULL) AS b, list_filter([{more}], lambda x: x IS NOT NULL) AS m FROM u)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, list_min(starts) - 1 AS first_word, list_max(starts) - 1 AS last_word, array_to_string(list_sort(list_distinct(b)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(b, m))), ',') AS labels, CASE WHEN len(m) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM p
"""
