"""Tolerant payloads, per-query limits, snapshots, capability tables and sinks."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, urls

#: Where a provider may keep its list; the first that holds one counts.
LIST_KEYS = ["items", "results", "articles", "data"]


def _literal_to_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(_as_json, na_action="ignore")


def _as_json(value: str) -> str | None:
    try:
        parsed = ast.literal_eval(value)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return json.dumps(parsed) if isinstance(parsed, dict) else None


def lenient(raw: Column) -> Column:
    """A payload as variant: JSON, else a Python dictionary literal, else null.  Raw text is never taken for evidence.

    Only texts that are no JSON and look like a dictionary leave the JVM.
    """
    said = F.trim(raw)
    literal = F.when(F.try_parse_json(said).isNull() & said.startswith("{"), said)
    return F.coalesce(F.try_parse_json(said), F.try_parse_json(F.pandas_udf(_literal_to_json, "string")(literal)))


def listed_items(payload: Column) -> Column:
    """The items of a variant payload: itself if it is a list, else the first list under a known key; else no items."""
    lists = [F.try_variant_get(payload, "$", "array<variant>"), *[F.try_variant_get(payload, f"$.{k}", "array<variant>") for k in LIST_KEYS]]
    return F.coalesce(*lists, F.array().cast("array<variant>"))


def readable(content_type: Column) -> Column:
    """HTML, XML or text; a missing type passes."""
    low = F.lower(F.trim(content_type))
    return low.isNull() | (low == "") | low.rlike("html|xml|text/")


def first_per_query(rows: DataFrame, query: str, position: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each query, in feed order."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(position))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= limit).drop("__rank")


def equal_to(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the given values; Spark pushes the conjunction into the scan."""
    for name, value in values.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


DDGS = "array<struct<href: string, url: string, title: string, body: string, snippet: string, excerpt: string, source: string, date: string>>"


def ddgs_articles(payloads: DataFrame, kind: Column, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(articles, rejects) of text or news answers: text has no date and no source; rows without url or title are rejects."""
    r = payloads.select(kind.alias("kind"), F.explode(F.from_json(payload, DDGS)).alias("r"))
    is_text = F.col("kind") == "text"
    own, other = F.when(is_text, F.col("r.href")).otherwise(F.col("r.url")), F.when(is_text, F.col("r.url")).otherwise(F.col("r.href"))
    url = F.coalesce(_blank_to_null(own), _blank_to_null(other))
    said = F.coalesce(_blank_to_null(F.col("r.body")), F.when(is_text, F.col("r.snippet")).otherwise(F.col("r.excerpt")))
    rows = r.select("kind", _blank_to_null(F.col("r.title")).alias("title"), url.alias("url"), said.alias("description"), said.alias("snippet"), F.when(~is_text, F.col("r.source")).alias("source_name"), F.when(~is_text, dates.shown_date(F.col("r.date"))).alias("published_at"))
    good = F.col("url").isNotNull() & F.col("title").isNotNull()
    return rows.filter(good), rows.filter(~good)


TAVILY = "results array<struct<url: string, title: string, content: string, raw_content: string, score: double, published_date: string>>"


def tavily_articles(payloads: DataFrame, payload: str = "payload", extract: bool = False) -> DataFrame:
    """Articles of search answers (content is description and snippet, raw content the content, score and date are kept) or of extract answers (either is the content)."""
    r = payloads.select(F.explode(F.from_json(payload, TAVILY)["results"]).alias("r"))
    url = _blank_to_null(F.col("r.url"))
    said = F.lit(None).cast("string") if extract else F.col("r.content")
    body = F.coalesce(_blank_to_null(F.col("r.raw_content")), F.col("r.content")) if extract else F.col("r.raw_content")
    return r.select(F.coalesce(_blank_to_null(F.col("r.title")), url).alias("title"), url.alias("url"), urls.canonicalize_url(url).alias("canonical_url"), said.alias("description"), said.alias("snippet"), body.alias("content"), F.col("r.score").alias("score"), F.col("r.published_date").alias("published_date")).filter("url is not null")


# -- logs, snapshots, tables ----------------------------------------------


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def last_lines(log: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    return log.orderBy(*order).limit(n)


def newest_snapshot(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of the newest file of a folder of JSON snapshots, one document a file."""
    reader = spark.read.option("multiLine", True)
    found = (reader.schema(schema) if schema else reader).json(path)
    marked = found.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_modification_time").alias("__at"))
    newest = marked.agg(F.max_by("__file", F.struct("__at", "__file")).alias("__file"))
    return marked.join(F.broadcast(newest), "__file", "left_semi").drop("__file", "__at")


def with_fallback(primary: DataFrame, fallback: DataFrame, registry: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the primary table that the registry knows; those of the fallback only if there are none."""
    first = primary.join(registry.select(key).distinct(), key, "left_semi")
    none = first.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(1).alias("__one"))
    second = fallback.join(registry.select(key).distinct(), key, "left_semi").withColumn("__one", F.lit(1))
    return first.unionByName(second.join(F.broadcast(none), "__one", "left_semi").drop("__one").select(first.columns))


def matched_capabilities(capabilities: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered models with their capability rows."""
    return registry.join(capabilities, ["provider", "model"])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def latest_table(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot folder under ``root`` that carries its success mark: the largest number among numbered folders, else the last name."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    marked = [s.getPath() for s in fs.listStatus(fs_path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not marked:
        raise FileNotFoundError(f"no finished snapshot under {root}")
    newest = max(marked, key=lambda p: (p.getName().isdigit(), int(p.getName()) if p.getName().isdigit() else 0, p.getName()))
    return spark.read.parquet(newest.toString())
