"""Search over stored articles: one query compiled to filters that reach the scan, and an order with a limit.

A query has terms (words, or phrases in quotes; all must occur, as whole words,
in any case) or a tag, and conditions on language, country, time and domains.
Conditions on columns of the table stay plain comparisons, so Parquet sees
language, country, time and exact domains; terms are looked for in what is left.

``TOP`` orders by terms found in the title (2 each) and the text (1 each), then
by time; ``RECENT`` by time alone.  Ties go to the smaller id, rows without a
time come last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

#: Units of a time span such as 90min, 36h, 2d, 1w, 3m (30 days each).
SPAN_MINUTES = {"min": 1, "h": 60, "d": 1440, "w": 10080, "m": 43200}


def terms_of(text: str) -> list[str]:
    """Words and quoted phrases of a query, lower-case, each once."""
    found = re.findall(r'"([^"]*)"|(\S+)', text.lower())
    cleaned = (" ".join((phrase or word.strip('"')).split()) for phrase, word in found)
    return list(dict.fromkeys(t for t in cleaned if t))


def span_minutes(span: str) -> int:
    got = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", span.lower())
    if not got or got[2] not in SPAN_MINUTES:
        raise ValueError(f"no time span: {span!r}")
    return int(got[1]) * SPAN_MINUTES[got[2]]


@dataclass(frozen=True)
class Search:
    text: str = ""
    tag: str | None = None
    language: str | None = None
    country: str | None = None
    #: Either a span before ``as_of``, or bounds (since inclusive, until exclusive), as timestamps in text.
    span: str | None = None
    as_of: str | None = None
    since: str | None = None
    until: str | None = None
    include_domains: tuple[str, ...] = ()
    exclude_domains: tuple[str, ...] = ()
    order: str = "RECENT"
    limit: int | None = None
    #: Names of the table's columns.
    columns: dict = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if self.order not in ("TOP", "RECENT"):
            raise ValueError(f"no order: {self.order!r}")
        if self.span and (not self.as_of or self.since or self.until):
            raise ValueError("a span goes with as_of and without bounds")
        if self.limit is not None and self.limit < 0:
            raise ValueError("the limit is negative")

    def _col(self, name: str) -> Column:
        return F.col(f"`{self.columns.get(name, name)}`")

    def conditions(self) -> list[Column]:
        """What must hold, in the order in which it costs."""
        out = [self._col(n) == v for n, v in (("language", self.language), ("country", self.country)) if v is not None]
        at = self._col("published_at")
        moment = lambda v: F.to_timestamp(F.lit(v))
        if self.span:
            out += [at >= moment(self.as_of) - F.make_dt_interval(mins=F.lit(span_minutes(self.span))), at <= moment(self.as_of)]
        out += [at >= moment(self.since)] if self.since else []
        out += [at < moment(self.until)] if self.until else []
        if self.include_domains or self.exclude_domains:
            host = self._col("domain") if "domain" in self.columns else urls.host(self._col("url"))
            if self.include_domains:
                out.append(F.coalesce(self._in(host, self.include_domains), F.lit(False)))
            if self.exclude_domains:
                # A row whose domain is not known is none of those excluded.
                out.append(~F.coalesce(self._in(host, self.exclude_domains), F.lit(False)))
        if self.tag is not None:
            out.append(F.exists(self._col("tags"), lambda t: F.lower(F.trim(t)) == self.tag.strip().lower().removeprefix("#")))
        terms = terms_of(self.text)
        if terms:
            both = F.lower(F.concat_ws("\n", self._col("title"), self._col("text")))
            out += [both.rlike(self._pattern(t)) for t in terms]
        return out

    @staticmethod
    def _in(host: Column, domains: tuple[str, ...]) -> Column:
        """The host is one of the domains or lies below one."""
        names = [d.lower().strip().removeprefix("www.") for d in domains]
        return reduce(lambda a, b: a | b, [host.endswith("." + n) for n in names], host.isin(names))

    @staticmethod
    def _pattern(term: str) -> str:
        words = r"\s+".join("".join("\\" + c if not c.isalnum() and c != "_" and ord(c) < 128 else c for c in w) for w in term.split())
        return rf"(?:^|[^\p{{L}}\p{{N}}_]){words}(?:[^\p{{L}}\p{{N}}_]|$)"

    def score(self) -> Column:
        def found(c: Column, weight: int) -> Column:
            low = F.lower(F.coalesce(c, F.lit("")))
            return reduce(lambda a, b: a + b, [F.when(low.rlike(self._pattern(t)), weight).otherwise(0) for t in terms_of(self.text)], F.lit(0))

        return (found(self._col("title"), 2) + found(self._col("text"), 1)).cast("int")

    def run(self, articles: DataFrame) -> DataFrame:
        """Rows of ``articles`` that match, best first, plus ``score``; an optional limit makes it a top-k in one pass."""
        kept = reduce(lambda df, c: df.filter(c), self.conditions(), articles)
        recent = [self._col("published_at").desc_nulls_last(), self._col("id").asc()]
        ranked = kept.withColumn("score", self.score()).orderBy(*([F.desc("score")] if self.order == "TOP" else []), *recent)
        return ranked if self.limit is None else ranked.limit(self.limit)
