"""The column functions as SQL functions, by views over one expression each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dates, publishers, taxonomy, text, urls

#: Functions of one string that a SQL user may call through ``evaluate``.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "canonicalize_url": urls.canonicalize_url, "url_host": urls.host, "is_portal": urls.is_portal, "is_placeholder": urls.is_placeholder, "date_in_path": urls.date_in_path, "is_wrapper": publishers.is_wrapper,
    "clean_text": text.clean_text, "content_hash": text.content_hash, "normalize_title": text.normalize_title, "title_signature": text.title_signature, "claim_tokens": text.claim_tokens, "sentences": text.sentences,
    "publication_time": dates.publication_time, "compact_time": dates.compact_time, "shown_date": dates.shown_date, "normalize_category": taxonomy.synonym, "infer_categories": taxonomy.infer_categories, "publication_status": taxonomy.publication_status,
}


def evaluate(rows: DataFrame, **columns: str) -> DataFrame:
    """``rows`` plus columns made by named functions: ``evaluate(df, host="url_host(url)")``; they stay Catalyst expressions."""
    made = {}
    for name, call in columns.items():
        function, _, argument = call.partition("(")
        made[name] = FUNCTIONS[function.strip()](F.expr(argument.rstrip().removesuffix(")")))
    return rows.withColumns(made)


def register_functions(spark: SparkSession, view: str, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A temporary view of ``rows`` with the named columns, for SQL users; returns what it shows."""
    out = evaluate(rows, **columns)
    out.createOrReplaceTempView(view)
    return out
