"""Functions in the session's catalogue, for users of SQL.

All are SQL functions: Spark inlines their bodies into the query, so what they
compute stays in Catalyst, with any number of arguments and in any clause.
``install`` registers them for the session, ``install(spark, prefix="nw_")``
under other names.  Times are given, never read from a clock.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text, urls


def _quoted(value: str) -> str:
    """A plain SQL string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: name: (parameters, type of the result, body); a body may call functions above it as {name}.
SCALARS: dict[str, tuple[str, str, str]] = {
    "url_host": ("url STRING", "STRING", "nullif(regexp_replace(lower(regexp_extract(url, r'^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)), r'^www\\.', ''), '')"),
    "url_path": ("url STRING", "STRING", "coalesce(nullif(regexp_extract(url, r'^[^:/?#]+://[^/?#]*([^?#]*)', 1), ''), if(url IS NULL, NULL, '/'))"),
    "url_on_domain": ("url STRING, domain STRING", "BOOLEAN", "coalesce({url_host}(url) = lower(domain) OR endswith({url_host}(url), concat('.', lower(domain))), false)"),
    "is_placeholder_url": ("url STRING", "BOOLEAN", f"coalesce({{url_host}}(url) RLIKE {_quoted(urls.PLACEHOLDER_HOST)}, false)"),
    "short_id": ("prefix STRING, value STRING, length INT", "STRING", "concat(prefix, left(sha2(value, 256), length))"),
    "article_id": ("given STRING, canonical STRING, url STRING", "STRING", "coalesce(nullif(given, ''), {short_id}('', coalesce(canonical, url), 16))"),
    "idempotency_key": ("platform STRING, story_id STRING, content STRING", "STRING", "sha2(concat(coalesce(platform, ''), chr(0), coalesce(story_id, ''), chr(0), coalesce(content, '')), 256)"),
    "age_minutes": ("at TIMESTAMP, as_of TIMESTAMP", "BIGINT", "coalesce(floor((unix_timestamp(as_of) - unix_timestamp(at)) / 60), 999)"),
    "is_current": ("at TIMESTAMP, as_of TIMESTAMP, max_age_days INT", "BOOLEAN", "coalesce(at <= as_of + INTERVAL 1 DAY AND at >= as_of - make_interval(0, 0, 0, max_age_days), false)"),
    "is_stale": ("started TIMESTAMP, as_of TIMESTAMP, minutes INT", "BOOLEAN", "coalesce(started <= as_of - make_interval(0, 0, 0, 0, 0, greatest(5, minutes)), false)"),
    "normalized_title": ("title STRING", "STRING", "trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]+', ' '), ' +', ' '))"),
    "similarity_words": ("value STRING", "ARRAY<STRING>", f"array_distinct(transform(filter(split(value, r'\\s+'), w -> length(w) > 2), w -> trim(BOTH {_quoted(text.EDGE_PUNCTUATION)} FROM lower(w))))"),
    "jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    "relationship": ("score DOUBLE", "STRING", "CASE WHEN score > 0.7 THEN 'DUPLICATE' WHEN score >= 0.35 THEN 'REPETITIVE' WHEN score >= 0.2 THEN 'MATERIAL_UPDATE' WHEN score >= 0.1 THEN 'RELATED' END"),
}
#: name: (parameters, columns of the result, query)
TABLES: dict[str, tuple[str, str, str]] = {
    "plain_sentences": ("value STRING", "pos INT, sentence STRING", "SELECT pos, trim(s) FROM (SELECT posexplode(filter(split(trim(value), r'(?<=[.!?])\\s+'), x -> trim(x) <> '')) AS (pos, s))"),
    "shingles": ("value STRING, n INT", "pos INT, shingle STRING", "SELECT pos, array_join(slice(w, pos + 1, n), ' ') FROM (SELECT filter(split(lower(value), r'\\s+'), x -> x <> '') AS w) LATERAL VIEW explode(if(size(w) < n, array(), sequence(0, size(w) - n))) t AS pos"),
}


def install(spark: SparkSession, prefix: str = "") -> list[str]:
    """Register all functions as temporary ones of the session; returns their names."""
    names = {n: prefix + n for n in (*SCALARS, *TABLES)}

    def body(sql: str) -> str:
        for n, full in names.items():
            sql = sql.replace("{" + n + "}", full)
        return sql

    for n, (parameters, kind, sql) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {names[n]}({parameters}) RETURNS {kind} RETURN {body(sql)}")
    for n, (parameters, columns, sql) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {names[n]}({parameters}) RETURNS TABLE({columns}) RETURN {body(sql)}")
    return list(names.values())
