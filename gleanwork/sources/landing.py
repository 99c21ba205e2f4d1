"""Provider payloads as tables of articles with one schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, urls

ARTICLE = ["title", "url", "description", "content", "source_domain", "published_at", "language"]
GDELT = "articles array<struct<url: string, title: string, seendate: string, domain: string, language: string>>"
SEARCH = "results array<struct<url: string, href: string, title: string, body: string, excerpt: string, content: string, raw_content: string, date: string, published_date: string, score: double>>"


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def gdelt_articles(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Articles of GDELT answers; empty answers give no rows, rows without url or title are left out."""
    a = payloads.select(F.explode(F.from_json(payload, GDELT)["articles"]).alias("a"))
    url, title = _blank_to_null(F.col("a.url")), _blank_to_null(F.col("a.title"))
    return a.select(
        title.alias("title"), url.alias("url"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("content"),
        F.coalesce(_blank_to_null(F.col("a.domain")), urls.host(url)).alias("source_domain"), dates.compact_time(F.col("a.seendate")).alias("published_at"), F.col("a.language").alias("language"),
    ).filter("url is not null and title is not null")


def search_articles(payloads: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(articles, rejects) of search answers of any provider's shape; the url stands in for a missing title of scored results."""
    r = payloads.select(F.explode(F.from_json(payload, SEARCH)["results"]).alias("r"))
    url = F.coalesce(_blank_to_null(F.col("r.url")), _blank_to_null(F.col("r.href")))
    rows = r.select(
        F.coalesce(_blank_to_null(F.col("r.title")), F.when(F.col("r.score").isNotNull(), url)).alias("title"), url.alias("url"),
        F.coalesce("r.body", "r.excerpt", "r.content").alias("description"), F.coalesce("r.raw_content", "r.content").alias("content"), urls.host(url).alias("source_domain"),
        dates.shown_date(F.coalesce("r.date", "r.published_date")).alias("published_at"), F.lit(None).cast("string").alias("language"),
    )
    good = F.col("url").isNotNull() & F.col("title").isNotNull()
    return rows.filter(good), rows.filter(~good)


def feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of RSS (``item``) or Atom (``entry``) files; entries without title or link are left out, as are those that cannot be parsed."""
    if row_tag == "entry":
        return _atom_entries(spark, path)
    schema = "title string, link string, description string, summary string, pubDate string, updated string, guid string, author string, source struct<_VALUE: string, _url: string>, category array<string>, _corrupt_record string"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return raw.filter("title is not null and link is not null").select(
        "title", F.col("link").alias("url"), F.coalesce("description", "summary").alias("description"), dates.publication_time(F.coalesce("pubDate", "updated")).alias("published_at"),
        F.coalesce("guid", urls.short_hash(F.coalesce(urls.canonicalize_url(F.col("link")), F.col("link")), 16)).alias("id"), F.col("source._VALUE").alias("publisher"), urls.host(F.col("source._url")).alias("publisher_domain"), "author", F.col("category").alias("categories"),
    )


def _atom_entries(spark: SparkSession, path: str) -> DataFrame:
    schema = "title string, link array<struct<_href: string, _rel: string>>, summary string, content string, published string, updated string, id string, author struct<name: string>, source struct<title: string>, category array<struct<_term: string>>, _corrupt_record string"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    # The entry's own page: a link of kind "alternate" or of no kind, else the first.
    own = F.coalesce(F.get(F.filter("link", lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get("link", F.lit(0)))["_href"]
    rows = raw.withColumn("url", own).filter("title is not null and url is not null")
    return rows.select(
        "title", "url", F.coalesce("summary", "content").alias("description"), dates.publication_time(F.coalesce("published", "updated")).alias("published_at"), F.coalesce("id", urls.short_hash(F.coalesce(urls.canonicalize_url(F.col("url")), F.col("url")), 16)).alias("id"),
        F.col("source.title").alias("publisher"), F.lit(None).cast("string").alias("publisher_domain"), F.col("author.name").alias("author"), F.transform("category", lambda c: c["_term"]).alias("categories"),
    )


def feed_registry(feeds: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """(active feeds by priority and id, rejects with reasons)."""
    once = feeds.groupBy("id").agg(F.count("*").alias("__n"))
    wrong = F.filter(
        F.array(
            F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "id"), F.when(F.col("__n") > 1, "repeated id"), F.when(~F.coalesce(F.col("url").startswith("https://"), F.lit(False)), "url"),
            F.when(~F.coalesce(F.col("category").isin(categories), F.lit(False)), "category"), F.when(~F.coalesce(F.col("priority") > 0, F.lit(False)), "priority"), F.when(F.col("active").isNull(), "active"),
            *([F.when((F.coalesce(F.trim("publisher_domain"), F.lit("")) == "") | urls.host(F.col("url")).endswith("google.com"), "publisher")] if "publisher_domain" in feeds.columns else []),
        ),
        lambda x: x.isNotNull(),
    )
    judged = feeds.join(once, "id", "left").withColumn("reasons", wrong).drop("__n")
    return judged.filter("size(reasons) = 0 and active").drop("reasons").orderBy("priority", "id"), judged.filter("size(reasons) > 0")


class Providers:
    """Named loaders in a fixed order; one that fails gives no rows and is reported."""

    def __init__(self):
        self.loaders: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, loader: Callable[[SparkSession], DataFrame]) -> None:
        self.loaders[name] = loader

    @classmethod
    def ordered(cls, feeds: list[tuple[str, int, Callable[[SparkSession], DataFrame]]], searches: list[tuple[str, Callable[[SparkSession], DataFrame]]], optional: tuple[str, Callable[[SparkSession], DataFrame]] | None = None) -> Providers:
        """Feeds by priority and name, then search providers as given, then the optional one."""
        out = cls()
        for name, _, loader in sorted(feeds, key=lambda f: (f[1], f[0])):
            out.register(name, loader)
        for name, loader in [*searches, *([optional] if optional else [])]:
            out.register(name, loader)
        return out

    def scan(self, spark: SparkSession, normalize: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, dict[str, str]]:
        parts, failed = [], {}
        for rank, (name, loader) in enumerate(self.loaders.items()):
            try:
                rows = loader(spark)
                rows = normalize(rows) if normalize else rows
                parts.append(rows.withColumns({"provider": F.lit(name), "provider_rank": F.lit(rank)}))
            except Exception as e:  # noqa: BLE001
                failed[name] = str(e)
        if not parts:
            raise ValueError(f"no provider could be read: {failed}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), failed


def log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
