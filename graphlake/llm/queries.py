"""The operators' queries over the whole test tables, and the SQL that gives the same rows where SQL can.

Sharding has none, since a CRC-32 byte by byte takes SQL a minute at the smallest size; the tests hold it, and
the operators that learn or tokenize, against brute force and held-out rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.decontaminate import find_contamination, words_hit
from graphlake.llm.exact_dedup import exact_duplicates, normalised
from graphlake.llm.jaccard_join import near_duplicates
from graphlake.llm.language_id import fit_languages, identify_languages
from graphlake.llm.line_dedup import drop_boilerplate
from graphlake.llm.packing import pack_documents
from graphlake.llm.quality import fit_quality, score_quality
from graphlake.llm.sharding import assign_shards
from graphlake.llm.url_filter import filter_urls
from graphlake.llm.warc import archive_pages

#: The rules of the query: host, path, verdict (fixed values).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), 24)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
),
s AS (
  SELECT DISTINCT uid, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle
  FROM w, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS t(i) WHERE len(ws) > 0
),
n AS (SELECT uid, count(*) AS n FROM s GROUP BY uid),
common AS (SELECT a.uid AS x, b.uid AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.uid < b.uid GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.uid = x JOIN n ny ON ny.uid = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(uid, other) AS (SELECT uid, uid FROM w UNION SELECT r.uid, y FROM reached r JOIN edges ON x = r.other),
least AS (SELECT r.uid, min(o.doc_id) AS component_id FROM reached r JOIN w o ON o.uid = r.other GROUP BY r.uid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w JOIN least USING (uid) LEFT JOIN n USING (uid)
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = words_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP4_SQL = """
WITH b AS (SELECT item_id, regexp_extract_all(lower_az, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM
  (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark WHERE text IS NOT NULL)),
iw AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(win) AS n FROM iw),
d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
dw AS (SELECT uid, i, n, list_slice(w, i, i + n - 1) AS win FROM d, lens, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT uid, i, n, item_id FROM dw JOIN iw USING (win)),
words AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT uid, i, n FROM hits), unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY uid),
its AS (SELECT uid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY uid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (uid) LEFT JOIN its USING (uid)
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify_languages(docs, fit_languages(docs))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source as the site."""
    out = drop_boilerplate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "site", "n_lines", "n_dropped", F.length("clean_text").cast("long").alias("clean_chars"), F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source AS site, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT uid, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
seen AS (SELECT site, trim(line) AS line, count(DISTINCT uid) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL),
totals AS (SELECT site, count(*) AS pages FROM d GROUP BY ALL),
marks AS (SELECT s.site, s.line FROM seen s JOIN totals t ON s.site IS NOT DISTINCT FROM t.site WHERE n >= 3 AND n * 100 > pages * 5),
judged AS (SELECT uid, i, l.line, m.line IS NOT NULL AS dropped FROM l LEFT JOIN marks m ON l.site IS NOT DISTINCT FROM m.site AND trim(l.line) = m.line),
clean AS (SELECT uid, count(*) FILTER (dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS clean FROM judged GROUP BY uid)
SELECT doc_id, site, coalesce(len(ls), 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(clean) AS clean_chars, sha256(clean) AS clean_sha256
FROM d LEFT JOIN clean USING (uid)
"""


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(_table(spark, sf_dir, "pages"), rules).drop("url")


OP7_SQL = """
WITH rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (
  SELECT page_id, row_number() OVER () AS uid, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS raw,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
),
h AS (SELECT page_id, uid, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p)
SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule, coalesce(max_by(rv, length(rh || rp)), 'allow') AS verdict
FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY uid, page_id, host, path
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((instr('0123456789abcdef', x[5 * g // 4 + 1]) - 1) * 16 + instr('0123456789abcdef', x[5 * g // 4 + 2]) - 1) >> (3 - 5 * g % 4)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    return exact_duplicates(_table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


OP8_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents
),
g AS (SELECT text_sha256, count(*) AS group_size, (min((-points, doc_id)))[2] AS keep_id FROM d GROUP BY ALL)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_packing, op3_jaccard_join, op4_decontamination, op5_language_id, op6_line_dedup, op7_url_filters, op8_exact_dedup, op9_warc, op10_quality_classifier)}


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": OP3_SQL, "op4_decontamination": OP4_SQL, "op6_line_dedup": OP6_SQL, "op7_url_filters": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op9_warc": OP9_SQL}
