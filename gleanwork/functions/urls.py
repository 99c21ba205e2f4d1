"""URL identity as column expressions; only unusual URLs leave the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track readers.
TRACKING_PREFIXES = ["utm_", "ga_", "mc_", "pk_"]
TRACKING_NAMES = ["fbclid", "gclid", "dclid", "msclkid", "yclid", "_openstat", "igshid", "ref", "ref_src", "ref_url", "spm", "cmpid", "ncid"]

_TRACKING = f"^(?:(?:{'|'.join(TRACKING_PREFIXES)}).*|(?:{'|'.join(TRACKING_NAMES)}))$"
#: Paths and queries that need no re-quoting.
_PLAIN = r"^[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9.:-]+(?:/[A-Za-z0-9_.~/:@!$&'()*,;=-]*)?(?:\?[A-Za-z0-9_.~&=-]*)?(?:#.*)?$"


def _is_tracking(key: str) -> bool:
    key = key.lower()
    return key in TRACKING_NAMES or key.startswith(tuple(TRACKING_PREFIXES))


def _canonical(url: str | None) -> str | None:
    """One URL with escapes or letters outside ASCII."""
    try:
        parts = urlsplit((url or "").strip())
    except ValueError:
        return None
    scheme, host = parts.scheme.lower(), parts.netloc.lower()
    if scheme not in ("http", "https") or not host:
        return None
    host = host.removesuffix({"http": ":80", "https": ":443"}[scheme])
    path = re.sub("/+", "/", parts.path).rstrip("/") or "/"
    kept = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not _is_tracking(k))
    return urlunsplit((scheme, host, quote(unquote(path), safe="/:@!$&'()*+,;="), urlencode(kept), ""))


def _canonical_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for urls in batches:
        yield urls.map(_canonical, na_action="ignore")


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def strip_tracking(query: Column) -> Column:
    """The pairs of a query string that do not track, blanks kept, sorted by (key, value)."""
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).rlike(_TRACKING))
    as_structs = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v")))
    return F.array_join(F.transform(F.array_sort(as_structs), lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&")


def canonicalize_url(url: Column) -> Column:
    """Canonical form, or null: http(s) only, lower-case host, no default port, no fragment, no tracking, one slash."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    raw_host = F.lower(F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1))
    named = F.when(scheme == "http", F.regexp_replace(raw_host, ":80$", "")).otherwise(F.regexp_replace(raw_host, ":443$", ""))
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/+", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))
    query = strip_tracking(query_string(u))
    plain = F.when(scheme.isin("http", "https") & (named != ""), F.concat(scheme, F.lit("://"), named, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))
    return F.when(u.rlike(_PLAIN), plain).when(u.rlike("(?i)^https?://"), F.pandas_udf(_canonical_batches, "string")(u))


def host(url: Column) -> Column:
    """Lower-case host without a leading www."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def is_http_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(r"^https?://\S+$"), F.lit(False))


# Landing paths, stores, places that are no publisher.
SECTIONS = ["news", "breaking-news", "world", "us", "politics", "business", "technology", "tech", "entertainment", "sports", "health", "science", "latest", "top-stories", "home"]
STORES = ["apps\\.apple\\.com", "play\\.google\\.com", "microsoft\\.com/store", "chrome\\.google\\.com/webstore", "download"]
PLACEHOLDER_HOST = r"(^|\.)example\.[a-z]+$|^localhost$|\.invalid$|\.test$"


def is_portal(url: Column) -> Column:
    return F.lower(path(url)).rlike(f"^/*$|^/(?:{'|'.join(SECTIONS)})/?$|^/index\\.html?$")


def is_store(url: Column) -> Column:
    return F.lower(url).rlike("|".join(STORES))


def is_placeholder(url: Column) -> Column:
    return F.coalesce(host(url).rlike(PLACEHOLDER_HOST), F.lit(False))


def is_extractable(url: Column) -> Column:
    """No media or document file, and no video, gallery or live segment."""
    return is_http_url(url) & ~F.lower(path(url)).rlike(r"\.(?:pdf|jpe?g|png|gif|mp[34]|zip)$|/(?:video|videos|gallery|live)/")


def date_in_path(url: Column) -> Column:
    """A /yyyy/mm/dd/ or /yyyy-mm-dd date, null if it is none."""
    y, m, d = (F.regexp_extract(url, r"/(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?:/|$|\D)", k) for k in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).try_cast("date")


def short_hash(value: Column, length: int, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(value, 256), F.lit(length)))


def item_id(given: Column, canonical: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), short_hash(F.coalesce(canonical, url), 16))
