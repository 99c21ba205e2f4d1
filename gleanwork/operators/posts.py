"""What a post must fulfil before it goes out: rules as an array of codes, in a fixed order.

Claims, evidence and verifications are tables keyed by story; they are
aggregated to one row for each story (bounded by what one story has), joined to
its posts, and judged by array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Statuses that count as supported, the rules that send a post back, and how often.
SUPPORTED = ["SUPPORTED", "SUPPORTED_AS_ATTRIBUTED"]
EDITORIAL_ERRORS = ["UNAPPROVED_CLAIM", "DRAFT_UNAPPROVED"]
WRITER_ERRORS = ["EMPTY_TEXT", "NUL_CHARACTER", "SOURCE_LABEL", "INTERNAL_INSTRUCTIONS", "THIN_SENTENCE", "UNGROUNDED_SENTENCE", "MAPPING_DIFFERS", "REPETITIVE", "SEVERAL_URLS", "LOST_ATTRIBUTION", "LOST_SUBJECT", "TOO_LONG"]
MOST_WRITER_ATTEMPTS, MOST_EDITORIAL_FIXES = 2, 1
LEAKED = r"(?i)(?:return\s+json|you are the (?:writer|platform adaptor)|approved claims\s*\(|system prompt|do not include this instruction)"
TRAILING = r"[.,;:!?)\]}]+$"


def _none() -> Column:
    return F.array().cast("array<string>")


def story_claims(claims: DataFrame, evidence: DataFrame, verifications: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One row for each story: its claims with tokens, whether they are verified and backed by addresses, and the addresses.

    Addresses are those of evidence and of linked ``sources`` (story_id,
    canonical_url, url), of which the canonical one counts if there is one.
    """
    checks = verifications.groupBy("story_id", "claim_id").agg(F.bool_or(F.upper("status").isin(SUPPORTED)).alias("verified"))
    links = claims.select("story_id", "claim_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("story_id", "evidence_id", "url"), ["story_id", "evidence_id"], "left")
    backed = links.groupBy("story_id", "claim_id").agg(F.bool_and(F.coalesce(F.col("url").rlike("^https?://"), F.lit(False))).alias("backed"))
    facts = claims.select("story_id", "claim_id", text.claim_tokens(F.col("claim_text")).alias("tokens"), F.when(F.col("is_forecast"), text.attribution_anchor(F.col("attribution"))).alias("anchor"))
    full = facts.join(checks, ["story_id", "claim_id"], "left").join(backed, ["story_id", "claim_id"], "left")
    no = F.lit(False)
    own = F.struct("claim_id", "tokens", "anchor", F.coalesce("verified", no).alias("verified"), F.coalesce("backed", no).alias("backed"))
    by_story = full.groupBy("story_id").agg(F.array_sort(F.collect_list(own)).alias("claims"))
    known = evidence.select("story_id", "url")
    if sources is not None:
        blank = F.lit("")
        known = known.union(sources.select("story_id", F.coalesce(F.nullif("canonical_url", blank), F.nullif("url", blank))))
    addresses = known.filter("url is not null").groupBy("story_id").agg(F.collect_set(F.regexp_replace("url", TRAILING, "")).alias("urls"))
    return by_story.join(addresses, "story_id", "left")


def grounding(tokens: Column, claims: Column) -> Column:
    """Ids of the claims that hold every token of a sentence; a sentence without tokens has none."""
    held = F.filter(claims, lambda c: (F.size(tokens) > 0) & (F.size(F.array_except(tokens, c["tokens"])) == 0))
    return F.transform(held, lambda c: c["claim_id"])


def post_claim_ids(post: Column, claims: Column, urls: Column) -> Column:
    """Sorted distinct ids of the claims that ground a sentence other than a bare source address."""
    own = F.filter(text.sentences(post), lambda s: ~text.is_source_reference(s, urls))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda s: grounding(text.claim_tokens(s), claims)))))


def _walk(sentences: Column, approved: Column) -> Column:
    """Sentences in order until the first that no approved claim holds: (thin, loose, mapped ids, token lists)."""
    start = F.struct(F.lit(False).alias("thin"), F.lit(False).alias("loose"), _none().alias("mapped"))

    def step(acc: Column, tokens: Column) -> Column:
        def found(ids: Column) -> Column:
            loose = F.size(ids) == 0
            return F.struct(acc["thin"].alias("thin"), loose.alias("loose"), F.when(loose, acc["mapped"]).otherwise(F.array_union(acc["mapped"], ids)).alias("mapped"))

        return (
            F.when(acc["loose"], acc)
            .when(F.size(tokens) < 2, F.struct(F.lit(True).alias("thin"), acc["loose"].alias("loose"), acc["mapped"].alias("mapped")))
            .otherwise(text.let(grounding(tokens, approved), found))
        )

    return F.aggregate(sentences, start, step)


def validated(posts: DataFrame, claims: DataFrame, evidence: DataFrame, verifications: DataFrame, limit: int = 500, sources: DataFrame | None = None) -> DataFrame:
    """``posts`` plus errors (codes in order), mapped_claim_ids and state (PASS or BLOCK).

    posts: story_id, post, claim_ids, draft_claim_ids, allowed_claim_ids,
    seed_title, seed_summary; ``sources``: see ``story_claims``.  The repetition rule stands by itself here: it
    looks at every post and not only at posts without other errors.
    """
    facts = story_claims(claims, evidence, verifications, sources)
    rows = posts.join(facts, "story_id", "left").withColumns({"claims": F.coalesce("claims", F.array().cast(facts.schema["claims"].dataType)), "urls": F.coalesce("urls", _none()), "post": F.coalesce("post", F.lit(""))})
    rows = rows.withColumns({
        "verified_ids": F.transform(F.filter("claims", lambda c: c["verified"]), lambda c: c["claim_id"]),
        "known_ids": F.transform("claims", lambda c: c["claim_id"]),
        "backed_ids": F.transform(F.filter("claims", lambda c: c["backed"]), lambda c: c["claim_id"]),
        "approved": F.filter("claims", lambda c: c["verified"] & F.array_contains("allowed_claim_ids", c["claim_id"])),
        "sentence_tokens": F.transform(F.filter(text.sentences(F.col("post")), lambda s: ~text.is_source_reference(s, F.col("urls"))), text.claim_tokens),
        "post_urls": F.regexp_extract_all("post", F.lit(r"(https?://\S+)"), F.lit(1)),
        "subject": text.distinctive(F.col("seed_title"), F.col("seed_summary")),
        "low": F.lower("post"),
    })
    # Without approved claims no sentence is looked at.
    judged = F.when(F.size("approved") > 0, F.col("sentence_tokens")).otherwise(F.array().cast("array<array<string>>"))
    rows = rows.withColumn("walk", _walk(judged, F.col("approved")))
    low, said = F.col("low"), F.trim("post") != ""
    anchors = F.filter(F.transform(F.filter("claims", lambda c: F.array_contains("allowed_claim_ids", c["claim_id"])), lambda c: c["anchor"]), lambda a: a.isNotNull())
    places = F.sequence(F.lit(0), F.size("sentence_tokens") - 1)
    # Each sentence against those behind it.
    again = (F.size("sentence_tokens") > 1) & F.exists(places, lambda i: F.exists(F.slice("sentence_tokens", i + 2, F.size("sentence_tokens")), lambda later: text.repetitive(F.get("sentence_tokens", i), later)))
    rules = [
        ("EMPTY_TEXT", ~said),
        ("NOT_UTF8", ~F.is_valid_utf8("post")),
        ("NUL_CHARACTER", F.col("post").contains("\0")),
        ("SOURCE_LABEL", F.col("post").rlike(r"(?i)\bSource\s*[:-]")),
        ("INTERNAL_INSTRUCTIONS", F.col("post").rlike(LEAKED)),
        ("EDITORIAL_UNVERIFIED", F.size(F.array_except("allowed_claim_ids", "verified_ids")) > 0),
        ("UNAPPROVED_CLAIM", F.size(F.array_except("claim_ids", "allowed_claim_ids")) > 0),
        ("UNKNOWN_CLAIM", F.size(F.array_except("claim_ids", "known_ids")) > 0),
        ("CLAIM_WITHOUT_EVIDENCE", F.size(F.array_except(F.array_intersect("claim_ids", "known_ids"), "backed_ids")) > 0),
        ("DRAFT_UNAPPROVED", F.size(F.array_except("draft_claim_ids", "allowed_claim_ids")) > 0),
        ("NO_CLAIMS", said & (F.size("claim_ids") == 0)),
        ("THIN_SENTENCE", F.col("walk.thin")),
        ("UNGROUNDED_SENTENCE", F.col("walk.loose")),
        ("MAPPING_DIFFERS", (F.size(F.array_except("walk.mapped", "claim_ids")) > 0) | (F.size(F.array_except("claim_ids", "walk.mapped")) > 0)),
        ("DRAFT_OMITS", F.size(F.array_except("walk.mapped", "draft_claim_ids")) > 0),
        ("REPETITIVE", again),
        ("SEVERAL_URLS", F.size("post_urls") > 1),
        ("UNVERIFIED_URL", F.exists("post_urls", lambda u: ~F.array_contains("urls", F.regexp_replace(u, TRAILING, "")))),
        ("LOST_ATTRIBUTION", F.exists(anchors, lambda a: ~low.contains(a))),
        ("LOST_SUBJECT", (F.size("subject") > 0) & ~F.exists("subject", lambda w: low.contains(w))),
        ("TOO_LONG", F.length("post") > limit),
    ]
    errors = F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), code) for code, hit in rules]))
    out = rows.select(*posts.columns, errors.alias("errors"), F.array_sort("walk.mapped").alias("mapped_claim_ids"))
    return out.withColumn("state", F.when(F.size("errors") == 0, "PASS").otherwise("BLOCK"))


def simple_errors(post: Column, char_count: Column, claim_ids: Column, draft_ids: Column, allowed_ids: Column, subject: Column, anchors: Column, limit: int = 500) -> Column:
    """The shorter rule set: emptiness, a wrong count, unapproved ids, lost subject or attribution, length."""
    low = F.lower(post)
    rules = [
        ("EMPTY_TEXT", F.trim(post) == ""),
        ("COUNT_MISMATCH", char_count != F.length(post)),
        ("UNAPPROVED_CLAIM", F.size(F.array_except(claim_ids, allowed_ids)) > 0),
        ("DRAFT_UNAPPROVED", F.size(F.array_except(draft_ids, allowed_ids)) > 0),
        # Each named once: the words of the subject are many expressions, and inside a lambda the post is lowered for each word.
        ("LOST_SUBJECT", text.let(subject, lambda words: (F.size(words) > 0) & ~text.let(low, lambda said: F.exists(words, lambda w: said.contains(w))))),
        ("LOST_ATTRIBUTION", text.let(low, lambda said: F.exists(anchors, lambda a: a.isNotNull() & ~said.contains(a)))),
        ("TOO_LONG", F.length(post) > limit),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), code) for code, hit in rules]))


def attribution_survives(post: Column, attribution: Column) -> Column:
    """The longest word of an attribution is part of the post; without an attribution nothing can get lost."""
    return F.coalesce(F.lower(post).contains(text.attribution_anchor(attribution)), F.lit(True))


def retry_target(errors: Column, writer_attempts: Column, editorial_fixes: Column) -> Column:
    """Who gets a blocked post back: editorial for unapproved claims, else the writer, as long as attempts are left."""
    editorial = F.arrays_overlap(errors, F.array(*[F.lit(e) for e in EDITORIAL_ERRORS]))
    writer = F.arrays_overlap(errors, F.array(*[F.lit(e) for e in WRITER_ERRORS]))
    return F.when(editorial & (editorial_fixes < MOST_EDITORIAL_FIXES), "editorial").when(writer & (writer_attempts < MOST_WRITER_ATTEMPTS), "writer")


def repetitive_sentences(posts: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """Pairs of sentences of a post that say the same, by their places from 0.

    Pairs are formed inside the row, each once, so nothing is shuffled; posts are
    short.  A sentence without telling words is like no other.
    """
    tokens = F.transform(text.plain_sentences(F.coalesce(body, F.lit(""))), text.claim_tokens)
    rows = posts.select(*key, tokens.alias("t"))
    later = F.transform("t", lambda a, i: F.filter(F.transform("t", lambda b, j: F.when((j > i) & text.repetitive(a, b), F.struct(i.alias("first"), j.alias("second")))), lambda p: p.isNotNull()))
    return rows.select(*key, F.explode(F.flatten(later)).alias("p")).select(*key, "p.first", "p.second")
