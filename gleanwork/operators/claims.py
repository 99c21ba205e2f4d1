"""Claims and what speaks for them: ranking, traceability, support, source assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import publishers, text, urls
from .posts import SUPPORTED

# What a source of each type is worth.
SOURCE_RANKS = {"PRIMARY": 4, "OFFICIAL": 4, "SECONDARY": 3, "AGGREGATOR": 1, "UNKNOWN": 0, "OPINION": -1}


def source_rank(source_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SOURCE_RANKS.items() for x in pair])
    return F.coalesce(F.element_at(known, F.upper(F.coalesce(source_type, F.lit("UNKNOWN")))), F.lit(0))


def usable_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/?#\s]+"), F.lit(False)) & ~urls.is_placeholder(url)


def referenced(claimed: Column, verified: Column) -> Column:
    """Evidence of a claim that its verification names too; all of it if that names none."""
    return F.when(F.coalesce(F.size(verified), F.lit(0)) > 0, F.array_intersect(claimed, verified)).otherwise(claimed)


def _supported(verifications: DataFrame) -> DataFrame:
    return verifications.filter(F.upper("status").isin(SUPPORTED)).select("story_id", "claim_id", F.upper("status").alias("status"), F.col("evidence_ids").alias("verified_ids"))


def cited_sources(claims: DataFrame, evidence: DataFrame, verifications: DataFrame, assessments: DataFrame) -> DataFrame:
    """The usable evidence of supported claims: the claims' columns, status (the best of its verifications), evidence_id, source_id, url, pos, rank.

    Tables meet by story alone, so rows that are dealt by story stay where they
    are: a story's few claims meet its verifications, and go along with their
    evidence, whose addresses are judged last, where a claim asks for them.
    """
    def is_one(a: str, b: str) -> Column:
        """Equal, but no key of the join: that would deal both tables by it."""
        return F.array_contains(F.array(F.col(a)), F.col(b))

    def of_story(rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumnsRenamed({"story_id": "of", key: f"of_{key}"})

    checks = of_story(_supported(verifications), "claim_id")
    own = claims.join(checks, (F.col("story_id") == F.col("of")) & is_one("claim_id", "of_claim_id"))
    # Statuses in order of their names are in order of strength.
    best = F.min("status").over(Window.partitionBy("story_id", "claim_id"))
    asked = own.select(*claims.columns, best.alias("status"), referenced(F.col("evidence_ids"), F.col("verified_ids")).alias("asked"))
    known = evidence.select(F.col("story_id").alias("of"), "evidence_id", "source_id", "url", "pos")
    # In one condition with the rest, which is judged first.
    met = asked.join(known, (F.col("story_id") == F.col("of")) & F.when(F.array_contains("asked", F.col("evidence_id")), usable_url(F.col("url")))).drop("of", "asked")
    ranks = of_story(assessments.groupBy("story_id", "source_id").agg(F.max(source_rank(F.col("source_type"))).alias("rank")), "source_id")
    ranked = met.join(ranks, (F.col("story_id") == F.col("of")) & is_one("source_id", "of_source_id"), "left")
    return ranked.select(*claims.columns, "status", "evidence_id", "source_id", "url", "pos", F.coalesce("rank", F.lit(0)).alias("rank"))


def _rated(claims: DataFrame, evidence: DataFrame, verifications: DataFrame, assessments: DataFrame) -> tuple[DataFrame, Column]:
    """Supported firm claims with their strength, a row for each source, and their place by strength within their story."""
    firm = claims.filter("not (coalesce(is_forecast, false) or coalesce(is_allegation, false) or coalesce(is_opinion, false))")
    same = Window.partitionBy("story_id", "claim_id")
    links = cited_sources(firm, evidence, verifications, assessments)
    rows = links.select(*claims.columns, "status", F.max("rank").over(same).alias("quality"), F.size(F.collect_set("source_id").over(same)).cast("long").alias("sources"))
    scored = rows.withColumns({
        "certainty": (F.trim(F.coalesce("uncertainty", F.lit(""))) == "").cast("int"),
        "specificity": F.least(F.size(F.regexp_extract_all("claim_text", F.lit(r"(\b[\w'-]+\b)"), F.lit(1))), F.lit(100)),
        "full": (F.col("status") == "SUPPORTED").cast("int"),
    })
    order = [F.desc(c) for c in ("quality", "sources", "certainty", "specificity", "full")]
    return scored, F.row_number().over(Window.partitionBy("story_id").orderBy(*order, "claim_id"))


def ranked_claims(claims: DataFrame, evidence: DataFrame, verifications: DataFrame, assessments: DataFrame) -> DataFrame:
    """Supported claims that are no forecast, allegation or opinion, numbered by strength within their story.

    By source quality, distinct sources, certainty, specificity (words, 100 at
    most) and full support, all descending, then by claim id.
    """
    rated, position = _rated(claims, evidence, verifications, assessments)
    return rated.distinct().withColumn("position", position)


def strongest_claim(claims: DataFrame, evidence: DataFrame, verifications: DataFrame, assessments: DataFrame) -> DataFrame:
    """The first of the ranked claims: a claim's rows are alike, so any of them is it, and columns that nobody asks for are not read."""
    rated, position = _rated(claims, evidence, verifications, assessments)
    return rated.withColumn("position", position).filter("position = 1")


def fallback_claim(claims: DataFrame, evidence: DataFrame, verifications: DataFrame, assessments: DataFrame, editorial: DataFrame, limit: int) -> DataFrame:
    """The claim whose own wording may stand in for a failed draft: approved, one finished sentence that fits, closest to the central event, then strongest.

    editorial: story_id, allowed_claim_ids, central_event.
    """
    said = F.trim("claim_text")
    whole = (F.length(said) > 0) & (F.length(said) <= limit) & said.rlike("[.!?][\"'”’)\\]]*$") & (F.size(text.sentences(said)) == 1)
    firm = "not (coalesce(is_forecast, false) or coalesce(is_allegation, false) or coalesce(is_opinion, false))"
    events = editorial.select("story_id", "allowed_claim_ids", text.claim_tokens(F.coalesce("central_event", F.lit(""))).alias("event_tokens"))
    able = claims.join(events, "story_id").filter(F.array_contains("allowed_claim_ids", F.col("claim_id"))).filter(firm).filter(whole)
    near = F.size(F.array_intersect(text.claim_tokens(F.col("claim_text")), F.col("event_tokens")))
    central = F.rank().over(Window.partitionBy("story_id").orderBy(F.desc("near")))
    kept = able.withColumn("near", near).withColumn("central", central).filter("central = 1").select(claims.columns)
    return strongest_claim(kept, evidence, verifications, assessments)


def best_source(claims: DataFrame, evidence: DataFrame, verifications: DataFrame, assessments: DataFrame, used: DataFrame) -> DataFrame:
    """(story_id, url): of the evidence of used claims (story_id, claim_id) the best source's, then the earliest, then the largest address."""
    rows = cited_sources(claims, evidence, verifications, assessments).join(used.select("story_id", "claim_id").distinct(), ["story_id", "claim_id"], "left_semi")
    return rows.groupBy("story_id").agg(F.max_by("url", F.struct("rank", -F.col("pos"), "url")).alias("url"))


def traced(claims: DataFrame, evidence: DataFrame, allowed: DataFrame, used: DataFrame) -> DataFrame:
    """Each claim with each of its evidence and source, and whether editorial allowed it and the post used it."""
    links = claims.select("story_id", "claim_id", F.explode_outer("evidence_ids").alias("evidence_id")).join(evidence.select("story_id", "evidence_id", "source_id"), ["story_id", "evidence_id"], "left")
    marks = [t.select("story_id", "claim_id").distinct().withColumn(name, F.lit(True)) for t, name in ((allowed, "allowed"), (used, "in_post"))]
    out = links.join(marks[0], ["story_id", "claim_id"], "left").join(marks[1], ["story_id", "claim_id"], "left")
    return out.select("story_id", "claim_id", "evidence_id", "source_id", F.coalesce("allowed", F.lit(False)).alias("allowed"), F.coalesce("in_post", F.lit(False)).alias("in_post"))


def supported_domains(claims: DataFrame, evidence: DataFrame, verifications: DataFrame) -> DataFrame:
    """(story_id, domains): hosts of the evidence of supported claims, without aggregators, sorted."""
    links = claims.join(_supported(verifications).select("story_id", "claim_id"), ["story_id", "claim_id"], "left_semi").select("story_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    hosts = evidence.join(links, ["story_id", "evidence_id"], "left_semi").select("story_id", urls.host(F.col("url")).alias("host")).filter("host is not null")
    return hosts.filter(~publishers.is_aggregator(F.col("host"))).groupBy("story_id").agg(F.array_sort(F.collect_set("host")).alias("domains"))


def remapped(evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """Evidence of research claims under the ids that the claims were stored with (run_id, claim_id, stored_id); what has no stored claim goes."""
    return evidence.join(stored.select("run_id", "claim_id", "stored_id"), ["run_id", "claim_id"]).drop("claim_id").withColumnRenamed("stored_id", "claim_id")


def evidence_of(claims: DataFrame, evidence: DataFrame, stories: DataFrame) -> DataFrame:
    """Evidence of the claims of the named stories."""
    own = claims.join(stories.select("story_id").distinct(), "story_id", "left_semi").select("story_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    return evidence.join(own, ["story_id", "evidence_id"], "left_semi")


def claim_sets(verifications: DataFrame) -> DataFrame:
    """(story_id, supported, unsupported): sorted claim ids."""
    ok = F.upper("status").isin(SUPPORTED)
    return verifications.groupBy("story_id").agg(F.array_sort(F.collect_set(F.when(ok, F.col("claim_id")))).alias("supported"), F.array_sort(F.collect_set(F.when(~ok, F.col("claim_id")))).alias("unsupported"))


def all_supported(claims: DataFrame, verifications: DataFrame) -> DataFrame:
    """(story_id, all_supported): every verification supports its claim, and every claim has one."""
    checks = verifications.groupBy("story_id").agg(F.bool_and(F.coalesce(F.upper("status").isin(SUPPORTED), F.lit(False))).alias("ok"))
    bare = claims.select("story_id", "claim_id").join(verifications.select("story_id", "claim_id"), ["story_id", "claim_id"], "left_anti").select("story_id").distinct().withColumn("missing", F.lit(True))
    return claims.select("story_id").distinct().join(checks, "story_id", "left").join(bare, "story_id", "left").select("story_id", (F.coalesce("ok", F.lit(False)) & F.col("missing").isNull()).alias("all_supported"))


def support_measures(claims: DataFrame, evidence: DataFrame, verifications: DataFrame, assessments: DataFrame, as_of: Column) -> DataFrame:
    """For each claim: evidence strength (mean source rank of 4), agreement and contradiction (shares of its verifications), source diversity, days since its newest evidence.

    The names are the policy's; it gives no formulas, these are ours.
    """
    def by_story(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        return rows.filter(F.col(key).isNotNull()).groupBy("story_id").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))

    # Tables meet by story alone, so rows that are dealt by story stay where they are: a story's few claims meet its evidence, and what is known of claims and sources comes as maps.
    checks = by_story(verifications.groupBy("story_id", "claim_id").agg(F.avg(F.upper("status").isin(SUPPORTED).cast("int")).alias("agreement"), F.avg((F.upper("status") == "CONTRADICTED").cast("int")).alias("contradiction")), "claim_id", F.struct("agreement", "contradiction"), "checks")
    ranks = by_story(assessments.groupBy("story_id", "source_id").agg(F.max(source_rank(F.col("source_type"))).alias("rank")), "source_id", F.col("rank"), "ranks")
    found = evidence.join(ranks, "story_id", "left").select("story_id", F.col("evidence_id").alias("found_id"), "source_id", "published_at", F.coalesce(F.element_at("ranks", F.col("source_id")), F.lit(0)).alias("rank"))
    own = claims.select("story_id", "claim_id", "evidence_ids")
    links = own.join(found.withColumnRenamed("story_id", "of"), (F.col("story_id") == F.col("of")) & F.array_contains("evidence_ids", F.col("found_id")), "left")
    # Ids may be repeated, and those without evidence count with rank 0, as does a claim without ids.
    times = F.size(F.filter("evidence_ids", lambda x: x == F.col("found_id")))
    gathered = links.withColumn("times", F.when(F.col("found_id").isNotNull(), times).otherwise(0)).groupBy("story_id", "claim_id", "evidence_ids").agg(F.sum(F.col("times") * F.coalesce("rank", F.lit(0)) / 4).alias("sum"), F.sum("times").alias("n"), F.collect_set("found_id").alias("met"), F.collect_set("source_id").alias("sources"), F.max("published_at").alias("newest"))
    missing = F.greatest(F.size(F.filter("evidence_ids", lambda x: ~F.coalesce(F.array_contains("met", x), F.lit(False)))), F.when(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0, 1).otherwise(0))
    facts = gathered.groupBy("story_id", "claim_id").agg((F.sum("sum") / F.sum(F.col("n") + missing)).alias("strength"), F.size(F.array_distinct(F.flatten(F.collect_list("sources")))).cast("long").alias("diversity"), F.datediff(as_of, F.max("newest")).alias("recency_days"))
    check = F.element_at("checks", F.col("claim_id"))
    return facts.join(checks, "story_id", "left").select("story_id", "claim_id", "strength", "diversity", "recency_days", check["agreement"].alias("agreement"), check["contradiction"].alias("contradiction"))


def consistent_assessments(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """(story_id, consistent): assessments keep the database's source references.

    Same keys on both sides; name, authority and documented type are kept; a
    source without publisher and documented type stays UNKNOWN; with fewer than
    two publishers no independence is claimed.  expected: story_id, source_id,
    source_url, source_name, source_type, authority, publisher_name; returned:
    story_id, source_id, source_url, source_name, source_type, authority,
    independence.
    """
    key = ["story_id", "source_id", "source_url"]
    want = expected.select(*key, F.col("source_name").alias("name"), F.upper("source_type").alias("kind"), F.coalesce("authority", F.lit("")).alias("rank"), F.coalesce("publisher_name", F.lit("")).alias("publisher"), F.lit(True).alias("wanted"))
    got = returned.select(*key, "source_name", F.upper("source_type").alias("source_type"), F.coalesce("authority", F.lit("")).alias("authority"), F.upper(F.trim("independence")).alias("independence"), F.lit(True).alias("given"))
    both = want.join(got, key, "full_outer")
    kept = F.col("source_name").eqNullSafe(F.col("name")) & (F.col("authority") == F.col("rank")) & ((F.col("kind") == "UNKNOWN") | (F.col("source_type") == F.col("kind"))) & ~((F.col("publisher") == "") & (F.col("kind") == "UNKNOWN") & (F.col("source_type") != "UNKNOWN"))
    facts = both.groupBy("story_id").agg(
        F.bool_and(F.col("wanted").isNotNull() & F.col("given").isNotNull() & F.coalesce(kept, F.lit(False))).alias("same"), F.bool_and(F.coalesce(F.col("independence") == "UNKNOWN", F.lit(True))).alias("modest"),
        F.countDistinct(F.nullif(F.lower(F.trim("name")), F.lit(""))).alias("publishers"),
    )
    return facts.select("story_id", (F.col("same") & ((F.col("publishers") >= 2) | F.col("modest"))).alias("consistent"))


def repaired_assessments(returned: DataFrame, documented: DataFrame) -> DataFrame:
    """Assessments with defaults for what is null, and with the documented address, name, type and authority where the source is known."""
    doc = documented.select("source_id", F.col("source_url").alias("d_url"), F.col("source_name").alias("d_name"), F.col("source_type").alias("d_type"), F.col("authority").alias("d_authority"), F.lit(True).alias("known"))
    rows = returned.join(doc, "source_id", "left")
    blank, none = F.lit(""), F.array().cast("array<string>")
    return rows.select(
        "story_id", "source_id",
        F.when(F.col("known"), F.col("d_url")).otherwise(F.coalesce("source_url", blank)).alias("source_url"), F.when(F.col("known"), F.coalesce("d_name", blank)).otherwise(F.coalesce("source_name", blank)).alias("source_name"),
        F.when(F.col("known") & (F.coalesce("d_type", F.lit("UNKNOWN")) != "UNKNOWN"), F.col("d_type")).otherwise(F.coalesce("source_type", F.lit("UNKNOWN"))).alias("source_type"),
        F.when(F.col("known"), F.coalesce("d_authority", blank)).otherwise(F.coalesce("authority", blank)).alias("authority"),
        F.coalesce("independence", F.lit("UNKNOWN")).alias("independence"), F.coalesce("conflicts", none).alias("conflicts"), F.coalesce("uncertainty", none).alias("uncertainty"),
    )
