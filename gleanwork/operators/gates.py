"""Rule gates: what is kept, what is rejected, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, taxonomy, text, urls

PORTAL_TITLE = r"(?i)^(?:Breaking News, Latest News|Latest News, Breaking News|Breaking News & Top Stories|Top World News|[A-Z][a-zA-Z]+ (?:News|Breaking News)(?: [-,:|]|$))"


def valid_article(url: Column, title: Column) -> Column:
    t = F.trim(title)
    return F.coalesce((url != "") & (F.length(t) >= 15) & ~urls.is_store(url) & ~urls.is_portal(url) & ~t.rlike(PORTAL_TITLE), F.lit(False))


def reject_reason(url: Column, title: Column, body: Column, published: Column, as_of: Column, provider: Column | None = None, signals: dict[str, str] | None = None, max_age_days: int = 30) -> Column:
    """The first rule that an article breaks, or null; the order of rules is part of the contract."""
    u, t, b = F.trim(F.coalesce(url, F.lit(""))), F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(body, F.lit("")))
    allowed = F.array_intersect(taxonomy.infer_categories(F.concat_ws(" ", t, b), signals), F.array(*[F.lit(c) for c in (signals or taxonomy.ALLOWED)]))
    wrapped = F.coalesce((provider == "google_news") & urls.host(u).rlike(r"(?:^news|\.)\.?google\.com$"), F.lit(False)) if provider is not None else F.lit(False)
    return (
        F.when((u == "") | (t == ""), "INSUFFICIENT_METADATA")
        .when(~u.rlike(r"^(?i:https?)://[^/?#]+"), "INSUFFICIENT_METADATA")
        .when(urls.is_store(u) | urls.is_portal(u) | t.rlike(PORTAL_TITLE), "PORTAL_PAGE")
        .when(F.length(t) < 15, "INSUFFICIENT_METADATA")
        .when(F.lower(t).rlike(taxonomy.OPINION), "OPINION_CONTENT")
        .when(F.lower(t).rlike(taxonomy.PROMOTION), "PROMOTIONAL_CONTENT")
        .when(wrapped, "UNRESOLVED_PUBLISHER")
        .when(F.length(b) < 40, "INSUFFICIENT_METADATA")
        .when(F.size(allowed) == 0, "OUT_OF_SCOPE")
        .when(~taxonomy.is_newsworthy(t, b), "NOT_NEWSWORTHY")
        .when(published.isNull() | (published > as_of + F.expr("interval 1 day")), "INSUFFICIENT_METADATA")
        .when(~dates.is_current(published, as_of, max_age_days), "STALE_ARTICLE")
    )


def split_rejects(articles: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reject_reason``): no row is lost."""
    judged = articles.withColumn("reject_reason", reason)
    return judged.filter("reject_reason is null").drop("reject_reason"), judged.filter("reject_reason is not null")


def complete_groups(rows: DataFrame, key: str, valid: Column) -> DataFrame:
    """Keys of which every linked row is valid; one bad row rejects its group."""
    return rows.groupBy(key).agg(F.count("*").alias("linked"), F.bool_and(F.coalesce(valid, F.lit(False))).alias("complete")).filter("complete").select(key, "linked")


def subject_survives(seed: Column, post: Column) -> Column:
    """Some telling word of the seed is part of the post."""
    return F.exists(F.split(text.title_signature(seed), " "), lambda w: (w != "") & F.lower(post).contains(w))


def relationship(score: Column) -> Column:
    return F.when(score > 0.70, "DUPLICATE").when(score >= 0.35, "REPETITIVE").when(score >= 0.20, "MATERIAL_UPDATE").when(score >= 0.10, "RELATED")
