"""Who published an article: aggregator wrappers, publisher identity, source types."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, urls

# The aggregator, its wrapper path and the markers before a wrapped address.
WRAPPER_HOST = "news.google.com"
WRAPPER_PATH = "/rss/articles/"
MARKERS = ["CBMiW0FVX3", "CBMiW0FV", "CBMiW0", "CBMiugFB", "CBMiqwFB", "CBMiqAFB", "CBMi"]
PROVIDERS = ["google_news", "tavily", "ddgs", "gdelt"]
WRAPPER_NAMES = ["google news", "google news rss"]
AGGREGATORS = ["google.com", "news.google.com", "news.yahoo.com", "bing.com", "duckduckgo.com", "tavily.com", "gdeltproject.org"]
PORTAL_TITLES = ["Breaking News, Latest News and Videos", "Breaking News, Latest Headlines", "Breaking News, US News, World News", "Top World News", "Latest News, Breaking News", "Breaking News & Top Stories"]

_ADDRESS = re.compile(rb"https?://[^\x00-\x1f\"'\\<>\x7f-\xff ]+")


def is_wrapper(url: Column) -> Column:
    """An aggregator's article link that stands for the publisher's."""
    bare = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))
    return F.coalesce((bare == WRAPPER_HOST) & urls.path(url).startswith(WRAPPER_PATH), F.lit(False))


def wrapped_id(url: Column) -> Column:
    return F.when(is_wrapper(url), F.nullif(F.regexp_extract(url, rf"{re.escape(WRAPPER_PATH)}([^/?#]*)", 1), F.lit("")))


def _unwrapped(code: str | None) -> str | None:
    """The first address of a publisher in the decoded id; padding is often left out, and a marker may shift the alphabet."""
    if not code:
        return None
    marker = next((m for m in MARKERS if code.startswith(m)), "")
    for body in dict.fromkeys([code, code[len(marker) :]]):
        usable = re.sub(r"[^A-Za-z0-9_-]", "", body)
        usable = usable[: len(usable) - (len(usable) % 4 == 1)]
        raw = base64.urlsafe_b64decode(usable + "=" * (-len(usable) % 4))
        for m in _ADDRESS.finditer(raw):
            found = m.group().decode("ascii")
            host = found.split("/")[2].lower()
            if host and host != "google.com" and not host.endswith(".google.com"):
                return found
    return None


def _unwrap_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for codes in batches:
        yield codes.map(_unwrapped, na_action="ignore")


def unwrapped(url: Column) -> Column:
    """The publisher's address inside a wrapper link, without any request; null if it holds none."""
    return F.pandas_udf(_unwrap_batches, "string")(wrapped_id(url))


def is_cleanup_portal(url: Column, title: Column) -> Column:
    """A landing page as the clean-up job sees it: a known title, the root, or one known section."""
    named = F.exists(F.array(*[F.lit(t) for t in PORTAL_TITLES]), lambda t: F.coalesce(title, F.lit("")).contains(t))
    parts = F.filter(F.split(F.coalesce(urls.path(F.trim(url)), F.lit("/")), "/"), lambda p: p != "")
    return named | (F.size(parts) == 0) | ((F.size(parts) == 1) & F.lower(F.get(parts, F.lit(0))).isin(urls.SECTIONS))


def canonical_or_article(canonical: Column, article: Column) -> Column:
    """The canonical address, unless it is missing or an aggregator's."""
    host = urls.host(canonical)
    return F.when(host.isNull() | (host == "google.com") | host.endswith(".google.com"), article).otherwise(canonical)


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def publisher_name(item: Column, metadata: Column, source: Column, url: Column, provider: Column) -> Column:
    """Name on the item, in its metadata, of its source, or the host; an aggregator's name gives way to the host."""
    host = F.coalesce(urls.host(url), F.lit(""))
    name = F.coalesce(_first(item, metadata, source, host), F.lit(""))
    own_host = F.lower(F.regexp_extract(F.when(name.contains("://"), F.regexp_extract(name, r"://(.*)", 1)).otherwise(name), r"^([^/?#:]*)", 1))
    wrapper = own_host.endswith("google.com") | ((provider == "google_news") & F.lower(name).isin(WRAPPER_NAMES))
    return F.when(F.coalesce(wrapper, F.lit(False)), host).otherwise(name)


def publisher_domain(item: Column, metadata: Column, source: Column, url: Column) -> Column:
    host = F.coalesce(urls.host(url), F.lit(""))
    domain = F.coalesce(F.regexp_replace(F.lower(_first(item, metadata, source, host)), r"^www\.", ""), F.lit(""))
    return F.when(domain.endswith("google.com"), host).otherwise(domain)


def documented_source_type(name: Column, domain: Column) -> Column:
    """AGGREGATOR for the search providers and the aggregator's own domain, else UNKNOWN: nothing more is documented."""
    known = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_")).isin(PROVIDERS) | (F.regexp_replace(F.lower(F.trim(domain)), r"^\.+|\.+$", "") == WRAPPER_HOST)
    return F.when(F.coalesce(known, F.lit(False)), "AGGREGATOR").otherwise("UNKNOWN")


def is_aggregator(host: Column) -> Column:
    # Named once: for each aggregator the address would be taken apart again.
    return text.let(host, lambda h: h.isin(AGGREGATORS) | h.rlike(r"\.(?:" + "|".join(re.escape(a) for a in AGGREGATORS) + ")$"))


def article_key(url: Column) -> Column:
    """The canonical address as a key; blank for what has no address at all."""
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", "").otherwise(urls.canonicalize_url(url))
