"""The registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, conversations, decontam, langid, licenses, ngram_join, pii, pivot_index, quality, suffix_dedup, toxicity, warc
from .common import held_out, scratch_path, table


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "archives")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(documents, pii.fit(documents))

    def shown(spans: str) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(shown("base_spans"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.filter(~held_out()))
    return langid.identify(documents.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = toxicity.fit_and_classify(documents, ~held_out(), table(spark, sf_dir, "labels").filter(~held_out()))
    return found.select("doc_id", (~F.col("known")).alias("held_out"), "score", "predicted")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents.filter(~held_out()), table(spark, sf_dir, "labels").filter(~held_out()))
    judged = quality.judge(documents.select("doc_id", "text", held_out().alias("held_out")), model)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "held_out", "score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damage(whole), ids=whole)


QUERIES = {"op1_arc_to_warc": op1_arc_to_warc, "op2_pivot_index": op2_pivot_index, "op3_license_scan": op3_license_scan, "op4_bpe": op4_bpe, "op5_decontamination": op5_decontamination, "op6_pii": op6_pii, "op7_ngram_join": op7_ngram_join, "op8_language_id": op8_language_id, "op9_suffix_dedup": op9_suffix_dedup, "op10_toxicity": op10_toxicity, "op11_centroid_clusters": op11_centroid_clusters, "op12_quality_rules": op12_quality_rules, "op13_conversation_repair": op13_conversation_repair}
_DIGEST = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((strpos('0123456789abcdef', substr(h || '0', (5 * i // 4 + 1)::INT, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h || '0', (5 * i // 4 + 2)::INT, 1)) - 1) >> (3 - (5 * i) % 4)::INT) & 31)::INT + 1, 1)), '')"


def _clusters_sql(rounds: int = 5) -> str:
    """Each round as two tables: the vectors with their nearest centroids a<r>, and the centroids c<r> after it."""
    rounds_sql = "".join(f"""
a{r} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min(row(d, c)) AS near FROM (
    SELECT vec_id, q, c, list_sum(list_transform(range(1, 65), lambda i: (q[i] - m[i]) * (q[i] - m[i])))::BIGINT AS d FROM v, c{r}) GROUP BY vec_id),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(mean, m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list(f ORDER BY i) AS mean FROM (
        SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS f FROM (
            SELECT near[2] AS c, i, sum(q[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2)) GROUP BY c) USING (c)),""" for r in range(rounds + 1))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding::DOUBLE[], lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, q AS m FROM v QUALIFY c < 40),{rounds_sql}
z AS (SELECT vec_id, near[2] AS c, near[1] AS d FROM a{rounds})
SELECT vec_id, z.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY z.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM z JOIN c{rounds} ON c{rounds}.c = z.c"""


#: crc32 bit by bit: a byte is mixed in, then eight shifts (-1) follow.
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(substr(k, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"
_REPAIR = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
z AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS z FROM k),
h AS (SELECT coalesce(conv_id, -1) AS c, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role, CASE z WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN z = 3 THEN 2 ELSE 1 END)) AS copy FROM z WHERE z <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS shown FROM h),
f AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
      left(lag(role) OVER (PARTITION BY c ORDER BY i), 1) || left(role, 1) AS pair FROM o),
ins(state, went, spent, audit, said) AS (SELECT s, s, 0, '', '' FROM range(4) r(s) UNION ALL VALUES
  (0, 2, 5, 'I', E'\\nuser:'), (0, 3, 10, 'II', E'\\nuser:\\nassistant:'), (1, 2, 5, 'I', E'\\nuser:'), (1, 3, 10, 'II', E'\\nuser:\\nassistant:'),
  (2, 3, 5, 'I', E'\\nassistant:'), (2, 2, 10, 'II', E'\\nassistant:\\nuser:'), (3, 2, 5, 'I', E'\\nuser:'), (3, 3, 10, 'II', E'\\nuser:\\nassistant:')),
keep(state, initial, went) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
due(state, role, went) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
d(c, i, state, cost, audit, said) AS (
  SELECT DISTINCT c, 0::BIGINT, 0, 0, '', '' FROM f
  UNION ALL
  SELECT c, i, state, cost, audit, said FROM (
    SELECT d.c, d.i + 1 AS i, e.went AS state, d.cost + ins.spent + e.spent + CASE WHEN e.edit <> 'D' AND f.fault = 't' THEN 5 ELSE 0 END AS cost, d.audit || ins.audit || e.edit AS audit,
           d.said || ins.said || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN E'\\n' || f.role || ':' || f.text ELSE E'\\n' || e.role || ':' || f.text END AS said
    FROM d JOIN f ON f.c = d.c AND f.i = d.i + 1 JOIN ins ON ins.state = d.state
    JOIN (SELECT state, initial, went, 'K' AS edit, 0 AS spent, '' AS role FROM keep UNION ALL SELECT state, NULL, went, 'R', 1, role FROM due UNION ALL SELECT s, NULL, s, 'D', 2, '' FROM range(4) r(s)) e
      ON e.state = ins.went AND (e.edit <> 'K' OR e.initial = left(f.role, 1)) AND (e.edit = 'D' OR f.fault NOT IN ('b', 'd')))
  QUALIFY row_number() OVER (PARTITION BY c, state ORDER BY cost, audit) = 1),
n AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
      count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
g AS (SELECT n.*, min(row(d.cost + ins.spent, d.audit || ins.audit, d.said || ins.said)) AS best FROM n JOIN d ON d.c = n.c AND d.i = n.n JOIN ins ON ins.state = d.state AND ins.went IN (0, 3) GROUP BY ALL)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best[1], 0)::BIGINT AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(substr(best[3], 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.c = coalesce(a.conv_id, -1)"""


ORACLE: dict[str, str] = {
    "op13_conversation_repair": _REPAIR,
    "op11_centroid_clusters": _clusters_sql(),
    "op1_arc_to_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
     t AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN t USING (h)""",
    "op2_pivot_index": """
WITH RECURSIVE l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op7_ngram_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, n, i, concat_ws(' ', word, lead(word, 1) OVER k, lead(word, 2) OVER k, lead(word, 3) OVER k, lead(word, 4) OVER k) AS g FROM u WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT DISTINCT doc_id, g FROM g WHERE i <= greatest(n - 4, 1)),
z AS (SELECT doc_id, count(*) AS size FROM e GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * c >= 75 * (a.size + b.size - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT r.x AS doc_id, coalesce(any_value(z.size), 0) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN z ON z.doc_id = r.x GROUP BY r.x""",
}
