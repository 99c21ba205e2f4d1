"""Claims, their evidence, and what may be published on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tiers of evidence by type of source; the last is a lead only.
TIERS = {"PRIMARY": "A", "OFFICIAL": "A", "ESTABLISHED": "B", "SPECIALIST": "C"}


def cited(claims: DataFrame, evidence: DataFrame, ids: str = "evidence_ids") -> DataFrame:
    """Claims with their unknown evidence ids left out; claims without text or known evidence go."""
    known = claims.select("claim_id", F.explode(ids).alias("evidence_id")).join(evidence.select("evidence_id"), "evidence_id", "left_semi")
    kept = known.groupBy("claim_id").agg(F.array_sort(F.collect_set("evidence_id")).alias(ids))
    return claims.drop(ids).join(kept, "claim_id").filter(F.trim("claim_text") != "")


def research_errors(claims: DataFrame, evidence: DataFrame, ids: str = "evidence_ids") -> DataFrame:
    """(claim_id, errors): empty text, no evidence, unknown evidence, evidence without a web address."""
    links = claims.select("claim_id", F.explode_outer(ids).alias("evidence_id")).join(evidence.select("evidence_id", "url"), "evidence_id", "left")
    facts = links.groupBy("claim_id").agg(F.count("evidence_id").alias("n"), F.count_if(F.col("evidence_id").isNotNull() & F.col("url").isNull()).alias("unknown"), F.count_if(F.col("url").isNotNull() & ~F.col("url").rlike(r"^https?://\S+$")).alias("offline"))
    rules = F.array(F.when(F.trim(F.coalesce("claim_text", F.lit(""))) == "", "EMPTY_TEXT"), F.when(F.col("n") == 0, "NO_EVIDENCE"), F.when(F.col("unknown") > 0, "UNKNOWN_EVIDENCE"), F.when(F.col("offline") > 0, "EVIDENCE_WITHOUT_URL"))
    return claims.join(facts, "claim_id").select("claim_id", F.filter(rules, lambda e: e.isNotNull()).alias("errors"))


def backfilled(verifications: DataFrame, claims: DataFrame, ids: str = "evidence_ids") -> DataFrame:
    """Verification rows without evidence ids take those of their claim."""
    own = claims.select("claim_id", F.col(ids).alias("__claimed"))
    filled = F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, F.col("__claimed")).otherwise(F.col(ids))
    return verifications.join(own, "claim_id", "left").withColumn(ids, filled).drop("__claimed")


def support(links: DataFrame, story: str, status: Column) -> DataFrame:
    """For each story: claims, supported claims, whether all or any are supported."""
    ok = F.coalesce(status, F.lit(False))
    return links.groupBy(story).agg(F.count("*").alias("claims"), F.count_if(ok).alias("supported"), F.bool_and(ok).alias("all_supported"), F.bool_or(ok).alias("any_supported"))


def too_old(story_date: Column, evidence_date: Column) -> Column:
    """Evidence dated more than a day before its story is left out; undated evidence stays."""
    return F.coalesce(F.datediff(story_date, evidence_date) > 1, F.lit(False))


def tier(source_type: Column) -> Column:
    out = F.lit("D")
    for name, letter in reversed(TIERS.items()):
        out = F.when(F.upper(source_type) == name, letter).otherwise(out)
    return out


def publication_decision(exact: Column, publishing: Column, stale: Column) -> Column:
    """What to do with a story that may be out already: the first rule that holds."""
    no = F.lit(False)
    return F.when(F.coalesce(exact, no), "DUPLICATE").when(F.coalesce(publishing & ~stale, no), "IN_PROGRESS").when(F.coalesce(publishing & stale, no), "RECOVER").otherwise("PUBLISH")


def ranked_models(models: DataFrame, tasks: DataFrame, limit: int) -> DataFrame:
    """For each task the first ``limit`` models with all required capabilities and no forbidden provider, by priority, then reliability."""
    wanted = tasks.select("task", "forbidden", F.size(F.array_distinct("required")).alias("n"), F.explode(F.array_distinct("required")).alias("capability"))
    able = models.select("model", "provider", "priority", "reliability", F.explode(F.array_distinct("verified")).alias("capability"))
    met = wanted.join(able, "capability").groupBy("task", "forbidden", "n", "model", "provider", "priority", "reliability").agg(F.count("*").alias("met"))
    fits = met.filter((F.col("met") == F.col("n")) & ~F.array_contains("forbidden", F.col("provider")))
    rank = F.row_number().over(Window.partitionBy("task").orderBy("priority", F.desc("reliability"), "model"))
    return fits.withColumn("rank", rank).filter(F.col("rank") <= limit).select("task", "model", "provider", "rank")


def post_errors(post: Column, approved: Column, used: Column, urls_known: Column, limit: int) -> Column:
    """Rules that a post breaks, in order: text, length, ids, addresses."""
    found = F.regexp_extract_all(F.coalesce(post, F.lit("")), F.lit(r"(https?://\S+)"), F.lit(1))
    rules = F.array(
        F.when(F.trim(F.coalesce(post, F.lit(""))) == "", "EMPTY_TEXT"), F.when(F.length(post) > limit, "TOO_LONG"), F.when(F.instr(post, "\0") > 0, "NUL_CHARACTER"), F.when(F.coalesce(F.size(used), F.lit(0)) <= 0, "NO_CLAIMS"),
        F.when(F.size(F.array_except(used, approved)) > 0, "UNAPPROVED_CLAIM"), F.when(F.size(found) > 1, "SEVERAL_URLS"), F.when(F.size(F.array_except(found, urls_known)) > 0, "UNVERIFIED_URL"),
    )
    return F.filter(rules, lambda e: e.isNotNull())
