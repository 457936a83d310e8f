"""One query for each operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import (
    decontaminate, html_text, importance, language_id, lexical_search, near, pii, quality, sentencepiece, substrings, toxicity,
    url_filter, warc)

QUERIES = {f.__name__: f for f in (
    language_id.op1_language_id, toxicity.op2_toxicity, html_text.op3_html_text, quality.op4_quality_rules, pii.op5_pii,
    sentencepiece.op6_sentencepiece, near.op7_jaccard_join, substrings.op8_substring_dedup, warc.op9_warc, decontaminate.op10_decontaminate,
    lexical_search.op11_lexical_search, url_filter.op12_url_filter, importance.op13_importance_resampling)}

_LOWER = f"translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}')"
_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in url_filter.RULES)
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_FEATURE = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE_SQL = {
    "op11_lexical_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_TERM}) AS w FROM documents),
nd AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
tot AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM nd),
q AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) AS term FROM benchmark)
      GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY term, nn),
s AS (SELECT item_id, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN nd USING (doc_id), tot GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op12_url_filter": f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
best AS (SELECT page_id, arg_max({{'rule': rule_host || rule_path, 'verdict': verdict}}, length(rule_host || rule_path)) AS b
         FROM h JOIN r ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM h LEFT JOIN best USING (page_id)""",
    "op13_importance_resampling": f"""
WITH steps AS (SELECT [list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                       FOR i IN range(256)] AS st),
d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, {_FEATURE})) AS f FROM documents),
b AS (SELECT unnest(regexp_extract_all({_LOWER}, {_FEATURE})) AS f FROM benchmark),
bytes AS (SELECT f, [CAST('0x' || substr(hex(encode(f)), 2 * k - 1, 2) AS BIGINT) FOR k IN range(1, strlen(f) + 1)] AS bs
          FROM (SELECT f FROM d UNION SELECT f FROM b)),
crc AS (SELECT f, xor(list_reduce(list_prepend(4294967295, bs), lambda c, x: xor(c >> 8, st[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
        FROM bytes, steps),
docs AS (SELECT doc_id, bucket, count(*) AS n FROM d JOIN crc USING (f) GROUP BY ALL),
s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM docs GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (f) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)
                / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM t) + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM docs JOIN gain USING (bucket) GROUP BY doc_id),
z AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
             + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM documents LEFT JOIN w USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20
          QUALIFY rank <= (SELECT 10 * count(*) // 100 FROM z WHERE n_features >= 20))
SELECT doc_id, n_features, weight, score, rank FROM z LEFT JOIN drawn USING (doc_id)""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT x, min(doc_id) AS f FROM win GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (x) WHERE f < doc_id),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
              [w[p] FOR p IN range(1, len(w) + 1) IF NOT list_contains(ps, p)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
             max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to FROM q""",
}
