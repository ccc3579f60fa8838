"""The operators as queries over the tables of a folder: ``QUERIES`` and, where SQL says the same, ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, jaccard_join, license_scan, lm_scoring, mixing, pii, toxicity, url_filters, warc

#: (host, path, action) of the URL rules (fixed values).
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("url")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    fields = "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return warc.round_trip(pages, fields).withColumnRenamed("record_id", "page_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.judge(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.judge(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_warc, op3_toxicity, op4_license_scan, op5_jaccard_join, op6_embedding_dedup, op7_decontamination, op8_mixing, op9_pii, op10_lm_scoring)
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "substr({0}, strpos({0}, '://') + 3)"


def _sql_host(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN {_LOW.format(f"regexp_extract({_REST.format(url)}, '^[^/?#]*')")} ELSE '' END"


def _sql_path(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN regexp_extract({_REST.format(url)}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"


def _sql_node(url: str) -> str:
    query = f"regexp_replace(regexp_replace('&' || regexp_extract({_REST.format(url)}, '^[^?#]*\\?([^#]*)', 1), '&(?:{url_filters.TRACKING})=[^&]*', '', 'g'), '^&+|&+$', '', 'g')"
    host = f"regexp_replace(host, '^(?:www|m|amp)\\.([^.]+\\.)', '\\1')"
    return f"CASE WHEN strpos({url}, '://') > 0 THEN {host} || regexp_replace(path, '/$', '') || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"


def _sql_decoded(text: str) -> str:
    for pattern, char in url_filters.REFERENCES:
        text = f"regexp_replace({text}, '(?i){pattern}', '{char.replace("'", "''")}', 'g')"
    return text


ORACLE_SQL = {
    "op1_url_filters": f"""
WITH RECURSIVE rules(rhost, rpath, action) AS (VALUES {", ".join(map(str, URL_RULES))}),
tags AS (
  SELECT url, unnest(list_transform(regexp_extract_all(html, '(?i)<link\\s[^>]*>'), lambda t: {{'t': t, 'a': 'href'}})
                  || list_transform(regexp_extract_all(html, '(?i)<meta\\s[^>]*>'), lambda t: {{'t': t, 'a': 'content'}})) AS tag
  FROM pages WHERE strpos(url, '://') > 0),
values_ AS (
  SELECT url, tag.a AS kind, regexp_extract(tag.t, '(?i)\\s' || tag.a || '\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 0) AS raw FROM tags
  WHERE regexp_matches(tag.t, CASE tag.a WHEN 'href' THEN '(?i)\\brel\\s*=\\s*["'']?canonical\\b' ELSE '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b' END)),
plain AS (SELECT url, kind, {_sql_decoded("regexp_replace(regexp_replace(raw, '(?i)^\\s[a-z]+\\s*=\\s*', ''), '^[\"'']|[\"'']$', '', 'g')")} AS v FROM values_),
targets AS (SELECT url, trim(CASE kind WHEN 'href' THEN v ELSE regexp_extract(v, '(?i)url\\s*=\\s*["'']?([^"''\\s]+)', 1) END) AS target FROM plain),
split AS (
  SELECT url, target, split_part(url, '://', 1) || '://' || regexp_extract({_REST.format("url")}, '^[^/?#]*') AS root, {_sql_path("url")} AS path,
         regexp_extract(target, '^[^?#]*') AS own, regexp_extract(target, '[?#].*$') AS tail FROM targets WHERE target <> ''),
relative AS (SELECT *, string_split(CASE WHEN starts_with(target, '/') THEN own ELSE '/' || regexp_extract(path, '^/?(.*/)?[^/]*$', 1) || own END, '/') AS parts FROM split),
resolved AS (
  SELECT *, array_to_string(list_reduce(list_transform(parts, lambda x: [x]), lambda o, x: CASE WHEN x[1] = '.' THEN o WHEN x[1] = '..' THEN CASE WHEN len(o) > 1 THEN o[1:len(o) - 1] ELSE o END ELSE o || x END), '/')
         || CASE WHEN parts[-1] IN ('.', '..') THEN '/' ELSE '' END AS place FROM relative),
links AS (
  SELECT url AS src, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
       WHEN starts_with(target, '//') THEN split_part(url, '://', 1) || ':' || target
       WHEN starts_with(target, '#') OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
       WHEN starts_with(target, '?') THEN root || path || target ELSE root || place || tail END AS dst FROM resolved),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT src FROM links UNION SELECT dst FROM links WHERE dst IS NOT NULL),
parts AS (SELECT url, {_sql_host("url")} AS host, {_sql_path("url")} AS path FROM urls),
judged AS (
  SELECT url, host, path, {_sql_node("url")} AS node,
    (SELECT {{'rule': rhost || rpath, 'action': action}} FROM rules
     WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
     ORDER BY length(rhost || rpath) DESC, rhost || rpath LIMIT 1) AS best FROM parts),
edges AS (SELECT DISTINCT a.node AS u, b.node AS v FROM links JOIN judged a ON src = a.url JOIN judged b ON dst = b.url WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(node, other) AS (SELECT DISTINCT node, node FROM judged WHERE node IS NOT NULL UNION SELECT r.node, e.v FROM reach r JOIN both_ways e ON r.other = e.u),
flags AS (SELECT r.node, bool_or(j.best.action = 'allow') AS allows, bool_or(j.best.action = 'block') AS blocks FROM reach r JOIN judged j ON j.node = r.other GROUP BY 1)
SELECT p.page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.best.rule AS rule,
       coalesce(j.best.action, CASE WHEN f.allows THEN 'allow' WHEN f.blocks THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN judged j ON p.url = j.url LEFT JOIN flags f ON j.node = f.node
""",
    "op2_warc": """
WITH r AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM r),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
""",
    "op5_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {jaccard_join.WORDS} THEN [array_to_string(words, ' ')]
       ELSE list_transform(range(1, len(words) - {jaccard_join.WORDS - 2}), lambda i: array_to_string(words[i : i + {jaccard_join.WORDS - 1}], ' ')) END)) AS grams FROM w),
class AS (SELECT md5(array_to_string(grams, '|')) AS k, min(doc_id) AS rep, count(*) AS n, any_value(grams) AS grams FROM g WHERE len(grams) > 0 GROUP BY 1),
flat AS (SELECT rep, len(grams) AS size, unnest(grams) AS gram FROM class),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.size) AS sa, any_value(b.size) AS sb FROM flat a JOIN flat b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE c >= {jaccard_join.THRESHOLD} * (sa + sb - c) - 1e-9),
reach(node, other) AS (SELECT rep, rep FROM class UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
part AS (SELECT node, min(other) AS component FROM reach GROUP BY 1),
degree AS (SELECT l.a AS rep, sum(c.n) AS links FROM links l JOIN class c ON l.b = c.rep GROUP BY 1)
SELECT g.doc_id, coalesce(c.rep, g.doc_id) AS class_id, coalesce(p.component, g.doc_id) AS component_id,
       coalesce(c.n - 1 + coalesce(d.links, 0), 0)::BIGINT AS n_links, coalesce(p.component, g.doc_id) = g.doc_id AS kept
FROM g LEFT JOIN class c ON len(g.grams) > 0 AND md5(array_to_string(g.grams, '|')) = c.k LEFT JOIN part p ON c.rep = p.node LEFT JOIN degree d ON c.rep = d.rep
""",
    "op6_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {embedding_dedup.THRESHOLD}),
reach(node, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
part AS (SELECT node, min(other) AS component FROM reach GROUP BY 1),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, p.component AS component_id, v.vec_id = p.component AS kept
FROM v JOIN part p ON v.vec_id = p.node LEFT JOIN degree d ON v.vec_id = d.a
""",
}
