"""What became of attempts: models that answered, fallbacks, reconciled publications, pages, last times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import capped

BLANK = ""


def model_sets(attempts: DataFrame, model: str, ok: Column) -> DataFrame:
    """One row for each model: how often it succeeded and failed, and whether it is in one set or in both.

    An attempt whose outcome is unknown (null) failed.  Rows without a model are
    left out.  Counts are pre-aggregated, so a model with most rows costs no more.
    """
    good = F.coalesce(ok, F.lit(False))
    counted = attempts.filter(F.col(model).isNotNull()).groupBy(model).agg(F.count_if(good).alias("successes"), F.count_if(~good).alias("failures"))
    state = F.when(F.col("failures") == 0, "SUCCESS").when(F.col("successes") == 0, "FAILED").otherwise("BOTH")
    return counted.withColumn("state", state)


def first_answers(answers: DataFrame, query: str, order: str, providers: list[str], provider: str = "provider", result: str = "result", error: str = "error") -> DataFrame:
    """One row for each query: the answer of the first provider, in the order given, that did not fail.

    Of several answers of one provider the first by ``order`` (unique in a query)
    decides.  ``errors`` lists the failures passed on the way, ``name: error``,
    in the providers' order; a query whose providers all failed is FAILED and has
    all of them.  Answers of other providers do not count; queries that have no
    others are left out.  A query has as many aggregates as there are providers,
    whatever its number of answers.
    """
    one = F.struct(F.col(result).alias("result"), F.col(error).alias("error"), F.lit(True).alias("given"))
    per = answers.filter(F.col(provider).isin(providers)).groupBy(query).agg(*[F.min_by(F.when(F.col(provider) == p, one), F.when(F.col(provider) == p, F.col(order))).alias(f"__p{k}") for k, p in enumerate(providers)])
    row = F.array(*[F.struct(F.lit(p).alias("provider"), F.col(f"__p{k}.result").alias("result"), F.col(f"__p{k}.error").alias("error"), F.lit(k).alias("rank"), F.coalesce(F.col(f"__p{k}.given"), F.lit(False)).alias("given")) for k, p in enumerate(providers)])
    asked = per.select(query, F.filter(row, lambda a: a["given"]).alias("a"))
    won = F.get(F.filter("a", lambda a: a["error"].isNull()), F.lit(0))
    found = asked.withColumn("won", won)
    passed = F.filter("a", lambda a: a["error"].isNotNull() & (a["rank"] < F.coalesce(F.col("won.rank"), F.lit(len(providers)))))
    said = F.array_join(F.transform(passed, lambda a: F.concat(a["provider"], F.lit(": "), a["error"])), "; ")
    return found.select(query, F.col("won.provider").alias("provider"), F.col("won.result").alias("result"), said.alias("errors"), F.when(F.col("won").isNull(), "FAILED").otherwise("ANSWERED").alias("state"))


def reconciled(reservations: DataFrame, posts: DataFrame, keys: list[str]) -> DataFrame:
    """Each reservation with the post that it led to: same text, created when the reservation started or later.

    reservations: keys, text, started_at; posts: external_id, url, text,
    created_at.  One post is a MATCH, several are AMBIGUOUS, none is NONE (the
    attempt never went out), and a reservation without start is INVALID.  Posts
    without id or time and null texts match nothing.  All that the rule needs of
    a text is its two latest posts, so those are kept before the shuffle and a
    text that a third of all posts share is two rows; the texts themselves stay
    where they are, 128 bits or more of their hash travel.
    """
    digest = F.sha2("text", 256)
    known = posts.filter("external_id is not null and created_at is not null and text is not null").select(digest.alias("__h"), "external_id", "url", "created_at")
    latest = capped(known, ["__h"], [F.desc("created_at"), F.col("external_id")], 2)
    pair = latest.groupBy("__h").agg(F.max(F.when(F.col("pos") == 1, F.struct("created_at", "external_id", "url"))).alias("__one"), F.max(F.when(F.col("pos") == 2, F.col("created_at"))).alias("__two"))
    asked = reservations.select(*keys, "started_at", digest.alias("__h")).join(pair, "__h", "left")
    hit = F.coalesce(F.col("__one.created_at") >= F.col("started_at"), F.lit(False))
    more = F.coalesce(F.col("__two") >= F.col("started_at"), F.lit(False))
    state = F.when(F.col("started_at").isNull(), "INVALID").when(more, "AMBIGUOUS").when(hit, "MATCH").otherwise("NONE")
    told = asked.withColumn("state", state)
    own = F.when(F.col("state") == "MATCH", F.col("__one"))
    return told.select(*keys, "state", own["external_id"].alias("external_id"), own["url"].alias("url"), own["created_at"].alias("published_at"))


def paged(rows: DataFrame, key: list[str], order: list[str | Column], page_size: int, limit: int = 20, max_pages: int = 3) -> DataFrame:
    """What paging collects of each key: pages are taken until ``limit`` items or ``max_pages`` are reached, then cut at the limit.

    ``pos`` numbers the items from 1, ``page`` their pages from 0.  Both caps
    reach the scan's side of the shuffle.
    """
    if min(page_size, limit, max_pages) < 1:
        raise ValueError("page size, limit and pages must be positive")
    return capped(rows, key, order, min(limit, page_size * max_pages)).withColumn("page", F.floor((F.col("pos") - 1) / page_size))


def last_published(publications: DataFrame, by: list[str], published_at: str = "published_at", status: str = "status") -> DataFrame:
    """The latest time of what is really published; a platform with none has no row."""
    return publications.filter(F.lower(status) == "published").groupBy(*by).agg(F.max(published_at).alias("last_published_at")).filter("last_published_at is not null")


def published_since_day(publications: DataFrame, by: list[str], as_of: Column, published_at: str = "published_at", status: str = "status") -> DataFrame:
    """How much was published since the start of the day of ``as_of``."""
    return publications.filter((F.lower(status) == "published") & (F.col(published_at) >= F.date_trunc("day", as_of))).groupBy(*by).agg(F.count("*").alias("published_today"))


def unlinked(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Rows that no link names; a null key is named by none.  Links are made distinct before they travel."""
    return rows.join(links.select(key).distinct(), key, "left_anti")


def same_members(a: Column, b: Column) -> Column:
    """Whether two lists hold the same values, whatever their order and repeats; null lists are empty."""
    sides = [F.array_sort(F.array_distinct(F.array_compact(F.coalesce(x, F.array().cast("array<string>"))))) for x in (a, b)]
    return sides[0] == sides[1]


def all_members(*lists: Column) -> Column:
    """The sorted union of lists without nulls and blanks; null lists are empty."""
    union = F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))
    return F.array_sort(F.filter(union, lambda v: F.coalesce(v != BLANK, F.lit(False))))
