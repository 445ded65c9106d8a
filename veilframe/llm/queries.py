"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, licences, near_dup, pii, quality, substring_dedup, token_files, warc

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_warc": warc.op3_warc,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_licences": licences.op7_licences,
    "op8_html_text": html_text.op8_html_text,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_pii": pii.op10_pii,
}

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WORDS3 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_near_dup": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS3} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p:p + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id AND r.c < l.y)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, min(c) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op3_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), h AS (SELECT *, sha1(b) AS x, max(page_id) OVER (PARTITION BY b) AS last FROM p),
v AS (SELECT *, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', x[i]) - 1) AS q FROM h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((q[5 * i // 4 + 1] * 16 + coalesce(q[5 * i // 4 + 2], 0)) >> (3 - 5 * i % 4)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM v""",
    "op4_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM g JOIN f USING (h) WHERE least < doc_id)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept FROM x ANTI JOIN c USING (doc_id, q) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op5_decontaminate": f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), i AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM v),
t AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN s ON len(w) >= n)),
h AS (SELECT doc_id, p, n, item_id FROM t JOIN v USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
