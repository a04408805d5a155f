"""The thin queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.llm import ann, decontaminate, html_text, jaccard_join, license_scan, masked_lm, segment_sampling, substring_dedup, toxicity, url_filter
from ruleloom.llm.common import table


def op1_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages, url_filter.host_of(F.col("url"))).select("page_id", "url", "text", "n_chars")


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op6_segment_sampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return segment_sampling.sample_segmentations(docs).drop("text")


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.join_documents(table(spark, sf_dir, "documents"))


def op4_license_scans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).drop("text", "spans")


def op8_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search_documents(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest().alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
        F.size("matches").cast("long").alias("n_matches"), F.coalesce(F.array_max(F.col("matches.size")), F.lit(0)).cast("long").alias("longest"), decontaminate.matches_digest().alias("matches_sha256"),
    )


def op9_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs).drop("text")


def op10_masked_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return masked_lm.score_documents(docs, masked_lm.fit(docs)).drop("text")


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op5_html_extraction": op5_html_extraction,
    "op3_toxicity": op3_toxicity,
    "op6_segment_sampling": op6_segment_sampling,
    "op7_jaccard_join": op7_jaccard_join,
    "op4_license_scans": op4_license_scans,
    "op10_masked_lm": op10_masked_lm,
    "op9_substring_dedup": op9_substring_dedup,
    "op8_decontamination": op8_decontamination,
}

_LISTED = ", ".join(f"('{h}')" for h, _, _ in url_filter.LISTED)

ORACLE_SQL = {
    "op1_url_filters": f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
l(h) AS (VALUES {_LISTED}),
best AS (
  SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p) * 1000 + length(r.h)) AS rule, arg_max(r.v, length(r.h || r.p) * 1000 + length(r.h)) AS v
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY page_id),
listed AS (SELECT DISTINCT page_id FROM p JOIN l ON p.host = l.h OR ends_with(p.host, '.' || l.h))
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.v, CASE WHEN listed.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id) LEFT JOIN listed USING (page_id)""",
    "op7_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
linked AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b USING (g) WHERE a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s LEFT JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON s.doc_id = m.x""",
    "op8_decontamination": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest(list_transform(generate_series(1, greatest(len(w) - 12, 1)), lambda i: array_to_string(w[i:i + 12], ' '))) AS k
  FROM b WHERE len(w) > 0),
dw AS (
  SELECT doc_id, size, unnest(generate_series(1, len(w) - size + 1)) AS pos, unnest(list_transform(generate_series(1, len(w) - size + 1), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS k
  FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
hit AS (SELECT doc_id, item_id, pos, size FROM dw JOIN bw USING (size, k)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS i FROM hit GROUP BY doc_id),
starts AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS j, unnest(list_transform(generate_series(1, greatest(len(w) - 12, 1)), lambda i: array_to_string(w[i:i + 12], ' '))) AS k
  FROM b WHERE len(w) > 0),
island AS (
  SELECT doc_id, item_id, size, j, pos, pos - row_number() OVER (PARTITION BY doc_id, item_id, pos - j ORDER BY pos) AS run
  FROM (SELECT DISTINCT doc_id, item_id, size, j, pos FROM dw JOIN starts USING (size, k))),
found AS (SELECT doc_id, item_id, min(j) - 1 AS j, min(pos) - 1 AS pos, max(pos) - min(pos) + max(size) AS words FROM island GROUP BY doc_id, item_id, pos - j, run),
matches AS (SELECT doc_id, count(*) AS n, max(words) AS longest, list_sort(list(concat_ws(':', item_id, j, pos, words))) AS m FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit.n, 0) AS n_hit, CAST(coalesce(len(items.i), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items.i, ','), '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(d.w) AS contaminated,
       CAST(coalesce(matches.n, 0) AS BIGINT) AS n_matches, CAST(coalesce(matches.longest, 0) AS BIGINT) AS longest, sha256(coalesce(array_to_string(matches.m, ','), '')) AS matches_sha256
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN matches USING (doc_id)""",
    "op9_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i, unnest(list_transform(generate_series(1, len(w) - 49), lambda i: array_to_string(w[i:i + 49], ' '))) AS k
  FROM d WHERE len(w) >= 50),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(generate_series(i, i + 49)) AS p FROM win JOIN first USING (k) WHERE doc_id > m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone.p), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone.p IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda x: NOT list_contains(gone.p, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
}
