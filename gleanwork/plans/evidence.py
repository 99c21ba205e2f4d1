"""Queries over claims and evidence: orders are stories, their lineitems claims, suppliers sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence
from .scalars import as_of, read

C = F.col


def claims(s, d):
    """A claim for each order; its evidence ids are supplier keys, of which some are unknown."""
    l = read(s, d, "lineitem").groupBy(C("l_orderkey").alias("claim_id")).agg(F.array_sort(F.collect_set((C("l_suppkey") * 2).cast("string"))).alias("evidence_ids"))
    return read(s, d, "orders").select(C("o_orderkey").alias("claim_id"), F.when(C("o_orderkey") % 11 == 0, "").otherwise(C("o_orderpriority")).alias("claim_text")).join(l, "claim_id", "left")


def sources(s, d):
    return read(s, d, "supplier").select(C("s_suppkey").cast("string").alias("evidence_id"), F.when(C("s_suppkey") % 10 == 0, "offline").otherwise(F.concat(F.lit("https://s.org/"), "s_suppkey")).alias("url"))


def f11(s, d):
    return evidence.cited(claims(s, d), sources(s, d)).select("claim_id", F.size("evidence_ids").alias("known"))


def f12(s, d):
    return evidence.research_errors(claims(s, d), sources(s, d)).select("claim_id", F.array_join("errors", ",").alias("errors"))


def f13(s, d):
    return evidence.support(read(s, d, "lineitem"), "l_orderkey", C("l_returnflag") == "A")


def f10(s, d):
    e = read(s, d, "orders").select(C("o_orderkey").alias("l_orderkey"), "o_orderdate").join(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_orderkey")
    return e.filter(~evidence.too_old(C("o_orderdate"), C("l_shipdate"))).groupBy("l_orderkey").agg(F.count("*").alias("kept"))


def f14(s, d):
    checks = claims(s, d).select("claim_id", F.when(C("claim_id") % 2 == 0, C("evidence_ids")).alias("evidence_ids"))
    return evidence.backfilled(checks, claims(s, d)).select("claim_id", F.array_join("evidence_ids", ",").alias("evidence"))


def f15(s, d):
    c = read(s, d, "conversations")
    post = F.concat("text", F.when(C("turn") % 3 == 0, " https://a.org/x https://b.org/y").otherwise(""))
    used = F.when(C("turn") > 0, F.array((C("conv_id") % 7).cast("string"))).otherwise(F.array().cast("array<string>"))
    errors = evidence.post_errors(post, F.array(*[F.lit(str(k)) for k in range(5)]), used, F.array(F.lit("https://a.org/x")), 500)
    return c.select("conv_id", "turn", F.array_join(errors, ",").alias("errors"))


def f22(s, d):
    e = read(s, d, "events").groupBy("user_id").agg(F.bool_or(C("event_type") == "purchase").alias("exact"), F.max(F.when(C("event_type") == "click", C("ts"))).alias("started"))
    stale = C("started") <= as_of() - F.expr("interval 30 minutes")
    return e.select("user_id", evidence.publication_decision(C("exact"), C("started").isNotNull(), stale).alias("decision"))


def p04(s, d):
    kinds = F.when(C("s_nationkey") < 5, "primary").when(C("s_nationkey") < 15, "ESTABLISHED").when(C("s_nationkey") < 20, "specialist").otherwise("blog")
    return read(s, d, "supplier").select("s_suppkey", evidence.tier(kinds).alias("tier"))


def r12(s, d):
    models = read(s, d, "supplier").select(C("s_name").alias("model"), F.concat(F.lit("p"), C("s_nationkey") % 5).alias("provider"), (C("s_suppkey") % 3).alias("priority"), C("s_acctbal").alias("reliability"), F.array(F.when(C("s_suppkey") % 2 == 0, "json").otherwise("text"), F.lit("chat")).alias("verified"))
    tasks = read(s, d, "region").select(C("r_name").alias("task"), F.array(F.when(C("r_regionkey") % 2 == 0, "json").otherwise("chat")).alias("required"), F.array(F.concat(F.lit("p"), C("r_regionkey"))).alias("forbidden"))
    return evidence.ranked_models(models, tasks, 3)


_IDS = "(SELECT l_orderkey AS claim_id, list_sort(list(DISTINCT (l_suppkey * 2)::VARCHAR)) AS ids FROM lineitem GROUP BY 1)"
_SOURCE = "(SELECT s_suppkey::VARCHAR AS id, s_suppkey % 10 = 0 AS off FROM supplier)"
_LINKS = f"(SELECT o_orderkey AS claim_id, c.id, s.id IS NOT NULL AS known, coalesce(s.off, false) AS off FROM orders LEFT JOIN (SELECT claim_id, unnest(ids) AS id FROM {_IDS}) c ON c.claim_id = o_orderkey LEFT JOIN {_SOURCE} s ON s.id = c.id)"
QUERIES = {
    "f10_dated_evidence": (f10, "SELECT l_orderkey, count(*) AS kept FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE NOT coalesce(date_diff('day', l_shipdate::DATE, o_orderdate::DATE) > 1, false) GROUP BY 1"),
    "f11_cited_claims": (f11, f"SELECT claim_id, count(*)::INT AS known FROM {_LINKS} WHERE known AND claim_id % 11 <> 0 GROUP BY 1"),
    "f12_research_gate": (f12, f"SELECT claim_id, concat_ws(',', CASE WHEN claim_id % 11 = 0 THEN 'EMPTY_TEXT' END, CASE WHEN count(id) = 0 THEN 'NO_EVIDENCE' END, CASE WHEN count(*) FILTER (id IS NOT NULL AND NOT known) > 0 THEN 'UNKNOWN_EVIDENCE' END, CASE WHEN bool_or(off) THEN 'EVIDENCE_WITHOUT_URL' END) AS errors FROM {_LINKS} GROUP BY 1"),
    "f13_verification_gate": (f13, "SELECT l_orderkey, count(*) AS claims, count(*) FILTER (l_returnflag = 'A') AS supported, bool_and(l_returnflag = 'A') AS all_supported, bool_or(l_returnflag = 'A') AS any_supported FROM lineitem GROUP BY 1"),
    "f14_evidence_backfill": (f14, f"SELECT o_orderkey AS claim_id, array_to_string(ids, ',') AS evidence FROM orders LEFT JOIN {_IDS} ON claim_id = o_orderkey"),
    "f15_post_validation": (f15, "SELECT conv_id, turn, concat_ws(',', CASE WHEN length(text) + CASE WHEN turn % 3 = 0 THEN 32 ELSE 0 END > 500 THEN 'TOO_LONG' END, CASE WHEN turn = 0 THEN 'NO_CLAIMS' END, CASE WHEN turn > 0 AND conv_id % 7 >= 5 THEN 'UNAPPROVED_CLAIM' END, CASE WHEN turn % 3 = 0 THEN 'SEVERAL_URLS' END, CASE WHEN turn % 3 = 0 THEN 'UNVERIFIED_URL' END) AS errors FROM conversations"),
    "f22_publication_guard": (f22, "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'DUPLICATE' WHEN max(ts) FILTER (event_type = 'click') > TIMESTAMP '2024-01-19 23:30:00' THEN 'IN_PROGRESS' WHEN max(ts) FILTER (event_type = 'click') IS NOT NULL THEN 'RECOVER' ELSE 'PUBLISH' END AS decision FROM events GROUP BY 1"),
    "p04_evidence_tier": (p04, "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'A' WHEN s_nationkey < 15 THEN 'B' WHEN s_nationkey < 20 THEN 'C' ELSE 'D' END AS tier FROM supplier"),
    "r12_model_ranking": (r12, "SELECT task, model, provider, rank::INT AS rank FROM (SELECT r_name AS task, s_name AS model, 'p' || (s_nationkey % 5) AS provider, row_number() OVER (PARTITION BY r_name ORDER BY s_suppkey % 3, s_acctbal DESC, s_name) AS rank FROM supplier JOIN region ON (r_regionkey % 2 = 1 OR s_suppkey % 2 = 0) AND s_nationkey % 5 <> r_regionkey) WHERE rank <= 3"),
}
