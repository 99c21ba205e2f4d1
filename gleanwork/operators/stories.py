"""Stories: finding and updating them, who may be published next, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, taxonomy, text, urls


# Weights of a selection score's components; they are an argument.
WEIGHTS = {"global_relevance": 1.0, "recency": 1.0, "evidence_availability": 1.0, "source_diversity": 1.0, "public_significance": 1.0, "trend_velocity": 1.0, "uniqueness": 1.0, "editorial_value": 1.0, "publication_suitability": 1.0}
#: Live publications in the order in which one of several counts.
LIVE = ["published", "publishing", "recovery_required"]


def build_gate(categories: Column, topic_fit: Column, newsworthy: Column) -> Column:
    """Why an article is no candidate row, or null: no allowed category, off topic, or no news."""
    return (
        F.when(F.size(taxonomy.allowed_only(categories)) == 0, "NO_VALID_CATEGORY")
        .when(~F.coalesce(topic_fit, F.lit(False)), "OUT_OF_SCOPE")
        .when(~F.coalesce(newsworthy, F.lit(False)), "NOT_NEWSWORTHY")
    )


def by_signature(incoming: DataFrame, stories: DataFrame) -> DataFrame:
    """``incoming`` (signature, legacy) plus the id of the stored story.

    Precedence: the new signature as a stored one, as a stored legacy one, then
    the legacy signature likewise; of several stories the least id.  Equal joins
    on one key column instead of a join by "or".
    """
    stored = F.array(F.struct(F.lit(0).alias("kind"), F.col("cluster_signature").alias("key")), F.struct(F.lit(1).alias("kind"), F.col("legacy_cluster_signature").alias("key")))
    known = stories.select(F.col("id").alias("story_id"), F.inline(stored)).filter("key is not null")
    asked = F.array(F.struct(F.lit(0).alias("turn"), F.col("signature").alias("key")), F.struct(F.lit(1).alias("turn"), F.col("legacy").alias("key")))
    pairs = incoming.select("signature", "legacy", F.inline(asked)).filter("key is not null").distinct().join(known, "key")
    found = pairs.groupBy("signature", "legacy").agg(F.min_by("story_id", F.struct("turn", "kind", "story_id")).alias("story_id"))
    same = F.expr("i.signature <=> f.signature and i.legacy <=> f.legacy")
    return incoming.alias("i").join(found.alias("f"), same, "left").select("i.*", "f.story_id")


def merged(old: Column, new: Column) -> Column:
    """Two maps as one; the new value of a key wins."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def upsert_by_signature(stories: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stories after ``incoming`` (signature, legacy, title, summary, metadata, seen_at), one row for each signature.

    A known story keeps id, status and first_seen_at and gets title, summary,
    last_seen_at and the merged metadata; others are new candidates with an id
    made of their signature.  stories: id, title, summary, status,
    first_seen_at, last_seen_at, cluster_signature, legacy_cluster_signature,
    metadata map<string,string>.
    """
    found = by_signature(incoming, stories)
    latest = found.filter("story_id is not null").groupBy("story_id").agg(F.max_by(F.struct("signature", "legacy", "title", "summary", "metadata", "seen_at"), F.struct("seen_at", "signature")).alias("n"))
    old = stories.join(latest, stories["id"] == latest["story_id"], "left")
    hit = F.col("n").isNotNull()

    def pick(new: str, column: str) -> Column:
        return F.when(hit, F.col(f"n.{new}")).otherwise(F.col(column)).alias(column)

    kept = old.select("id", pick("title", "title"), pick("summary", "summary"), "status", "first_seen_at", F.when(hit, F.greatest("last_seen_at", "n.seen_at")).otherwise(F.col("last_seen_at")).alias("last_seen_at"), pick("signature", "cluster_signature"), pick("legacy", "legacy_cluster_signature"), F.when(hit, merged(F.col("metadata"), F.col("n.metadata"))).otherwise(F.col("metadata")).alias("metadata"))
    once = F.row_number().over(Window.partitionBy("signature").orderBy(F.desc("seen_at"), "title"))
    fresh = found.filter("story_id is null").withColumn("r", once).filter("r = 1")
    made = fresh.select(F.concat(F.lit("st_"), F.left("signature", F.lit(20))).alias("id"), "title", "summary", F.lit("candidate").alias("status"), F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"), F.col("signature").alias("cluster_signature"), F.col("legacy").alias("legacy_cluster_signature"), "metadata")
    return kept.unionByName(made)


def reset(stories: DataFrame, publications: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stories, publications) after the named stories are candidates again, without publications."""
    named = ids.select("id").distinct()
    back = stories.join(named.withColumn("__hit", F.lit(True)), "id", "left")
    status = F.when(F.col("__hit"), "candidate").otherwise(F.col("status"))
    return back.withColumn("status", status).drop("__hit"), publications.join(named.withColumnRenamed("id", "story_id"), "story_id", "left_anti")


def live_publications(publications: DataFrame, as_of: Column, minutes: int = 30, with_stale: bool = True) -> DataFrame:
    """(story_id, status, started_at) of the publication that blocks a story: the first live status; an expired reservation blocks nothing unless ``with_stale``."""
    status = taxonomy.publication_status(F.col("status"))
    rank = F.array_position(F.array(*[F.lit(s) for s in LIVE]), status)
    rows = publications.select("story_id", "id", status.alias("status"), "started_at", rank.alias("rank")).filter("rank > 0")
    best = rows.groupBy("story_id").agg(F.min_by(F.struct("status", "started_at"), F.struct("rank", "id")).alias("p")).select("story_id", "p.status", "p.started_at")
    stale = (F.col("status") == "publishing") & dates.is_stale(F.col("started_at"), as_of, minutes)
    return best if with_stale else best.filter(~stale)


def candidates(stories: DataFrame, as_of: Column, max_age_days: int = 30, signals: dict[str, str] | None = None) -> DataFrame:
    """Stories that qualify: current, named, with an allowed category and sources, on topic and news, no rejected word.

    stories: id, title, summary, categories, published_at, topic_fit,
    newsworthiness, source_count.  Missing flags are assessed from title and summary.
    """
    flags = taxonomy.assessed(F.col("topic_fit"), F.col("newsworthiness"), F.col("title"), F.coalesce("summary", F.lit("")), signals)
    names = taxonomy.allowed_only(taxonomy.normalize_categories(F.col("categories"), partial=False))
    rejected = F.exists(F.split(F.trim("title"), r"\s+"), taxonomy.is_rejected_category) | F.exists("categories", taxonomy.is_rejected_category)
    rows = stories.withColumns({"flags": flags, "names": names})
    ok = (F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))) != "") & (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.size("names") > 0) & (F.coalesce("source_count", F.lit(0)) > 0) & dates.is_current(F.col("published_at"), as_of, max_age_days) & F.col("flags.topic_fit") & F.col("flags.newsworthiness") & ~F.coalesce(rejected, F.lit(False))
    return rows.filter(ok).withColumn("categories", F.array_sort("names")).drop("names", "flags")


def breaking_failures(facts: DataFrame, as_of: Column) -> DataFrame:
    """``facts`` plus failed (the conjuncts that do not hold, in order) and eligible.

    facts, one row for each story: is_breaking, rationale, first_seen_at,
    categories, domains, independent_domains, supported_domains (arrays),
    independent_reporting, copying_detected, evidence_count, all_supported.
    """
    every, independent = F.array_union("domains", "supported_domains"), F.array_union("independent_domains", "supported_domains")
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("first_seen_at")) / 60
    rules = [
        ("not_breaking", F.col("is_breaking")),
        ("no_rationale", F.trim("rationale") != ""),
        ("not_fresh", age.between(0, 180)),
        ("category", (F.size("categories") > 0) & ~F.exists("categories", taxonomy.is_rejected_category)),
        ("domains", F.size(every) >= 2),
        ("independent_domains", F.size(independent) >= 2),
        ("not_corroborated", F.coalesce("independent_reporting", F.lit(False)) | (F.size("supported_domains") >= 2)),
        ("copying", ~F.col("copying_detected")),
        ("no_evidence", F.col("evidence_count") > 0),
        ("unsupported", F.col("all_supported")),
    ]
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))
    return facts.withColumn("failed", failed).withColumn("eligible", F.size("failed") == 0)


def run_outcome(outcome: Column, publication_status: Column) -> Column:
    """What a run counts as for its caller."""
    status = F.coalesce(publication_status, F.lit(""))
    return (
        F.when(outcome.isin("CANDIDATE_REJECTED", "PUBLISHED"), outcome)
        .when(outcome == "PASS", F.when(status == "SKIPPED_DRY_RUN", "DRY_RUN").otherwise("SYSTEM_ERROR"))
        .when(outcome == "ESCALATE", "SYSTEM_ERROR")
        .when(outcome == "BLOCKED", F.when(status.endswith("RECOVERY_REQUIRED"), "RECOVERY_REQUIRED").otherwise("SYSTEM_ERROR"))
        .otherwise(F.coalesce(outcome, F.lit("UNKNOWN")))
    )


def publication_step(live: DataFrame, posts: DataFrame, stories: DataFrame) -> DataFrame:
    """What the publisher does with each story (id, content): PUBLISH, DUPLICATE, or for an open reservation RECOVERED or RECOVERY_REQUIRED.

    A reservation is recovered if exactly one post of the same text was made
    after it started; live has (story_id, status, started_at), posts (text, created_at).
    """
    own = stories.select(F.col("id").alias("story_id"), F.sha2("content", 256).alias("h")).join(live, "story_id", "left")
    made = posts.select(F.sha2("text", 256).alias("h"), "created_at")
    hits = own.filter("status = 'publishing'").join(made, "h").filter("created_at >= started_at").groupBy("story_id").agg(F.count("*").alias("hits"))
    step = F.when(F.col("status").isNull(), "PUBLISH").when(F.col("status") != "publishing", "DUPLICATE").when(F.col("hits") == 1, "RECOVERED").otherwise("RECOVERY_REQUIRED")
    return own.join(hits, "story_id", "left").select("story_id", step.alias("step"))


def ingest_summary(rows: DataFrame, kept: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """One row of counts: discovered, transformed (key not null), skipped as repeats, inserted, updated, failed."""
    found = rows.agg(F.count("*").alias("discovered"), F.count(key).alias("transformed"))
    after = kept.select(key).join(stored.select(key).distinct().withColumn("__known", F.lit(True)), key, "left").agg(F.count("*").alias("kept"), F.count("__known").alias("updated"))
    both = found.join(after)  # two single rows
    return both.select("discovered", "transformed", (F.col("transformed") - F.col("kept")).alias("skipped"), (F.col("kept") - F.col("updated")).alias("inserted"), "updated", (F.col("discovered") - F.col("transformed")).alias("failed"))


def metrics(log: DataFrame, provider: str, name: str, names: list[str]) -> DataFrame:
    """Counts of each named metric for each provider, zero where there is none."""
    return log.groupBy(provider).pivot(name, names).agg(F.count(F.lit(1))).na.fill(0)


# -- ranking ------------------------------------------------------------------


def reporting_order() -> list[Column]:
    """Newest first, stories without a date last, then most sources, then least id."""
    return [F.desc_nulls_last("first_seen_at"), F.desc("source_count"), F.asc("id")]


def reporting_candidates(stories: DataFrame, limit: int) -> DataFrame:
    return stories.orderBy(*reporting_order()).limit(limit)


def diversity_order() -> list[Column]:
    """Complete quality flags first, then publishers, then the least covered category, then sources, then id."""
    return [F.desc("quality"), F.desc("publishers"), F.asc("covered"), F.desc("source_count"), F.asc("id")]


def diverse_candidates(stories: DataFrame, distribution: DataFrame, limit: int) -> DataFrame:
    """stories (id, topic_fit, newsworthiness, categories, domains, source_count) by quality, then diversity; distribution has (category, n).

    A story counts as covered as the most covered of its categories.
    """
    quality = F.coalesce("topic_fit", F.lit(False)).cast("int") + F.coalesce("newsworthiness", F.lit(False)).cast("int")
    hosts = F.array_distinct(F.filter(F.transform("domains", lambda d: F.regexp_replace(F.lower(F.trim(d)), r"^www\.", "")), lambda d: d != ""))
    named = stories.select("id", F.explode("categories").alias("category")).join(distribution, "category").groupBy("id").agg(F.max("n").alias("covered"))
    rows = stories.join(named, "id", "left").withColumns({"quality": quality, "publishers": F.size(hosts), "covered": F.coalesce("covered", F.lit(0))})
    return rows.orderBy(*diversity_order()).limit(limit)


def recent_publications(publications: DataFrame, platform: str, limit: int, as_of: Column | None = None, hours: int = 48) -> DataFrame:
    """The newest published rows of a platform; with ``as_of`` only those of the last hours."""
    rows = publications.filter((F.col("platform") == platform) & (F.lower("status") == "published"))
    if as_of is not None:
        rows = rows.filter(F.col("published_at") >= as_of - F.expr(f"interval {hours} hours"))
    return rows.orderBy(F.desc_nulls_last("published_at"), "id").limit(limit)


def recent_stories(stories: DataFrame, as_of: Column, hours: int, limit: int) -> DataFrame:
    """Stories seen within the last hours, newest first; those without a time pass, last."""
    seen = F.coalesce("last_seen_at", "first_seen_at")
    return stories.filter(seen.isNull() | (seen >= as_of - F.expr(f"interval {hours} hours"))).orderBy(F.desc_nulls_last(seen), "id").limit(limit)


def newest(rows: DataFrame, time: str, key: str, limit: int = 10) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(time), key).limit(limit)


def latest_topic(stories: DataFrame, publications: DataFrame) -> DataFrame:
    """(topic) of the published story that was seen last."""
    out = publications.filter(F.lower("status") == "published").select(F.col("story_id").alias("id")).distinct()
    return stories.join(out, "id", "left_semi").orderBy(F.desc_nulls_last("first_seen_at"), "id").limit(1).select(text.topic_label(F.col("topic"), F.col("title")).alias("topic"))


def selection_score(components: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of named components from 0 to 1; one that is missing counts nothing."""
    used = WEIGHTS | (weights or {})
    total = sum(used.values()) or 1.0
    return sum((F.coalesce(components[n], F.lit(0.0)) * (w / total) for n, w in used.items() if n in components), F.lit(0.0))


def ranked_for_extraction(items: DataFrame, budget: int, signals: dict[str, str] | None = None) -> DataFrame:
    """The items whose pages are fetched: newest first, then feed priority (1000 if none), thin ones, likely useful ones; ties by provider and position.

    items: provider, pos, title, description, snippet, content, published_at, feed_priority.
    """
    words = F.trim(F.concat_ws(" ", F.nullif(F.trim("description"), F.lit("")), F.nullif(F.trim("snippet"), F.lit(""))))
    thin = (F.length(F.trim(F.coalesce("content", F.lit("")))) < 500) & (F.length(words) < 500)
    body = F.concat_ws(" ", "description", "snippet", "content")
    useful = taxonomy.is_newsworthy(F.col("title"), body) & (F.size(taxonomy.infer_categories(F.concat_ws(" ", "title", body), signals)) > 0)
    rows = items.withColumns({"thin": thin, "useful": useful})
    return rows.orderBy(F.desc_nulls_last("published_at"), F.coalesce("feed_priority", F.lit(1000)), F.desc("thin"), F.desc("useful"), "provider", "pos").limit(budget)


# -- memory -------------------------------------------------------------------


def warnings(similar: DataFrame) -> DataFrame:
    """(query_id, warnings, unresolved) from similar stories (query_id, title, relationship, score): a line for each duplicate or repetitive one, most similar first."""
    bad = F.col("relationship").isin("DUPLICATE", "REPETITIVE")
    line = F.format_string("Story is highly similar (%s) to recent coverage: %s", F.col("relationship"), F.col("title"))
    ranked = F.array_sort(F.collect_list(F.when(bad, F.struct((-F.col("score")).alias("s"), F.col("title").alias("t"), line.alias("line")))))
    return similar.groupBy("query_id").agg(F.transform(ranked, lambda x: x["line"]).alias("warnings"), F.bool_or(bad).alias("unresolved"))


def memory(stories: DataFrame, similar: DataFrame, publications: DataFrame, recent: DataFrame, distribution: DataFrame, most: int = 100) -> DataFrame:
    """One row for each story (id): its similar stories (query_id, id, title, relationship, score), warnings, and the recent publications, stories and category counts that all share.

    The shared parts hold at most ``most`` entries each (of more, the smallest
    ids or names), so the one row of them that goes to all tasks stays small.
    """
    publications, recent, distribution = publications.orderBy("id").limit(most), recent.orderBy("id").limit(most), distribution.orderBy("category").limit(most)
    shared = publications.agg(F.collect_list(F.struct("id", "story_id")).alias("recent_publications"))
    shared = shared.join(recent.agg(F.collect_list(F.struct("id", "title")).alias("recent_stories")))
    shared = shared.join(distribution.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_distribution")))
    own = similar.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "title", "relationship", "score"))).alias("similar_stories"))
    rows = stories.select("id").join(own, "id", "left").join(warnings(similar).withColumnRenamed("query_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns({"warnings": F.coalesce("warnings", none), "unresolved": F.coalesce("unresolved", F.lit(False))}).join(F.broadcast(shared))


def audit(links: DataFrame, items: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """One row for each story (story_id) of its linked items: publishers, providers and queries in the order in which they first appear, the first time, and how many items.

    links: story_id, item_id and the columns of ``order``; items: item_id,
    publisher_domain, publisher_name, provider, query, published_at.  A
    publisher is its domain, else its name; blank values are left out; links to
    unknown items count as sources without facts.  A value is one row for each
    story before it is gathered, so a story holds its distinct values only.
    Links are dealt by item and then by story, each time into ``parts`` parts if
    given, so that a task's links need not grow with the table.
    """
    blank = F.lit("")
    named = items.select("item_id", F.coalesce(F.nullif("publisher_domain", blank), F.nullif("publisher_name", blank)).alias("publishers"), F.nullif("provider", blank).alias("providers"), F.nullif("query", blank).alias("queries"), "published_at")
    linked = links.select("story_id", "item_id", *[c for c in order if c not in ("story_id", "item_id")])
    if parts:
        linked, named = linked.repartition(parts, "item_id"), named.repartition(parts, "item_id").hint("merge")
    rows = linked.join(named, "item_id", "left")
    dealt = rows.repartition(parts, "story_id") if parts else rows.repartition("story_id")
    # A link's place as a number: least places are then found by hash, without sorting a row for each value.
    placed = dealt.withColumn("place", F.rank().over(Window.partitionBy("story_id").orderBy(*order, "item_id")))
    kinds = ["publishers", "providers", "queries"]
    undated = F.lit(None).cast(dict(named.dtypes)["published_at"])
    facts = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"), undated.alias("date")) for k in kinds]
    link = F.struct(F.lit("link").alias("kind"), F.lit(None).cast("string").alias("value"), F.col("published_at").alias("date"))
    values = placed.select("story_id", "place", F.explode(F.array(*facts, link)).alias("x")).filter("x.value is not null or x.kind = 'link'")
    firsts = values.groupBy("story_id", "x.kind", "x.value", "x.date").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "value")))), lambda v: v["value"]).alias(k) for k in kinds]
    first_date = F.min(F.when(F.col("date").isNotNull(), F.struct("place", "date")))["date"]
    return firsts.groupBy("story_id").agg(*lists, first_date.alias("published_at"), F.sum(F.when(F.col("kind") == "link", F.col("n"))).alias("sources"))


def replay_attempts(results: DataFrame, group: str, order: list[str], wanted: int) -> DataFrame:
    """Attempts in order, each ATTEMPTED or SKIPPED: they end with a system failure, an unclear publication, or the wanted number of posts."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    stop = F.max((~F.col("outcome").isin("CANDIDATE_REJECTED", "PUBLISHED")).cast("int")).over(before)
    done = F.sum((F.col("outcome") == "PUBLISHED").cast("int")).over(before)
    return results.withColumn("state", F.when((F.coalesce(stop, F.lit(0)) == 1) | (F.coalesce(done, F.lit(0)) >= wanted), "SKIPPED").otherwise("ATTEMPTED"))


def social_rows(posts: DataFrame, platform: str = "threads") -> DataFrame:
    """Posts of one provider (id, text, username, permalink, timestamp, media_type, media_url, thumbnail_url, replied_to, root_post) in the provider-neutral shape."""
    media = F.coalesce("thumbnail_url", "media_url")
    return posts.select(
        F.col("id").cast("string").alias("id"), F.lit(platform).alias("platform"), F.col("username").alias("author_username"), F.coalesce("text", F.lit("")).alias("text"), dates.as_utc(F.col("timestamp")).alias("created_at"), "permalink", F.col("permalink").alias("source_url"),
        F.when(media.isNotNull(), F.array(F.struct(F.coalesce("media_type", F.lit("unknown")).alias("type"), media.alias("url")))).otherwise(F.array().cast("array<struct<type:string,url:string>>")).alias("media"),
        F.col("replied_to").cast("string").alias("reply_to_id"), F.col("root_post").cast("string").alias("conversation_id"), F.col("replied_to").isNotNull().alias("is_reply"),
    )


def social_counts(rows: DataFrame) -> DataFrame:
    """Posts, authors, replies to a root, deeper entries, and conversations."""
    direct = F.col("is_reply") & F.col("reply_to_id").eqNullSafe(F.col("conversation_id"))
    return rows.agg(F.count_if(~F.col("is_reply")).alias("posts"), F.countDistinct("author_username").alias("profiles"), F.count_if(direct).alias("replies"), F.count_if(F.col("is_reply") & ~direct).alias("conversation_entries"), F.countDistinct(F.coalesce("conversation_id", "id")).alias("conversations"))


def restricted_coverage(results: DataFrame, domain: str) -> DataFrame:
    """How many results lie on a domain, and how many titles name it."""
    host = urls.host(F.col("url"))
    return results.agg(F.count_if((host == domain) | host.endswith(f".{domain}")).alias("direct"), F.count_if(F.lower("title").contains(domain)).alias("mentions"))


def publisher_count(domains: Column) -> Column:
    """Distinct publishers, whatever their case and www."""
    return F.size(F.array_distinct(F.filter(F.transform(domains, lambda d: F.regexp_replace(F.lower(F.trim(d)), r"^www\.", "")), lambda d: d != "")))


