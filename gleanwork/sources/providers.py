"""Paged providers as a Python data source, for batches and for streams.

A provider is a name and a function ``fetch(cursor)`` that returns
``(items, next cursor or None)``.  ``spark.read.format("gleanwork_providers")``
reads each provider as a partition of its own, page by page, until its cursor
ends, a cap on pages or items is reached, or it fails.  A failure is a row with
``error`` set, behind the items read before it, so one provider that fails in a
task takes nothing from the others.

As a stream (``readStream``) every trigger reads one further page of each
provider, on the driver, as the end of a page is what names the next one; a page
of each provider is all that it holds.  Offsets are the cursors, so a restarted
stream goes on after the last page that was committed, and an item that comes
again on a later page is left to ``once_by_id``.

Options: ``fetch``, the function's name as ``module:function``, called as
``function(provider, cursor)`` where the data is read; ``providers``, names
joined by commas, in order; ``max_pages`` and ``max_items`` for each provider
(batch; none by default), ``dedupe`` (default true: an item id that a provider
repeats is left out, ids being ``id``, else ``url`` of an item).
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "provider string, provider_rank int, page int, position int, item string, error string"
Fetch = Callable[[str, str | None], tuple[list, str | None]]


def function_named(name: str) -> Fetch:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class _Provider(InputPartition):
    name: str
    rank: int


def _shown(item) -> str:
    return item if isinstance(item, str) else json.dumps(item, ensure_ascii=False, sort_keys=True, default=str)


def _identity(item) -> str:
    """What tells an item from others of its provider."""
    if isinstance(item, dict):
        for name in ("id", "url"):
            if item.get(name):
                return f"{name}:{item[name]}"
    return _shown(item)


def pages(fetch: Fetch, provider: str, rank: int, max_pages: int | None = None, max_items: int | None = None, dedupe: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA of all pages of a provider, up to the caps."""
    cursor, page, count, seen, cursors = None, 0, 0, set(), set()
    while max_pages is None or page < max_pages:
        try:
            items, following = fetch(provider, cursor)
        except Exception as e:  # noqa: BLE001  a provider's failure is a row
            yield provider, rank, page, None, None, f"{type(e).__name__}: {e}"
            return
        for item in items:
            if max_items is not None and count >= max_items:
                return
            if dedupe:
                if (known := _identity(item)) in seen:
                    continue
                seen.add(known)
            yield provider, rank, page, count, _shown(item), None
            count += 1
        page += 1
        if following is None:
            return
        if following in cursors:
            yield provider, rank, page, None, None, f"cursor {following} was given before"
            return
        cursors.add(following)
        cursor = following


def _number(options: dict, name: str) -> int | None:
    value = options.get(name)
    return None if value in (None, "") else int(value)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Provider(n, k) for k, n in enumerate(_names(self.options))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        fetch = function_named(self.options["fetch"])
        yield from pages(fetch, partition.name, partition.rank, _number(self.options, "max_pages"), _number(self.options, "max_items"), str(self.options.get("dedupe", "true")).lower() == "true")


class _StreamReader(SimpleDataSourceStreamReader):
    """Offsets: for each provider the cursor of its next page, how many pages came before, and whether it has ended."""

    def __init__(self, options: dict):
        self.fetch, self.names = function_named(options["fetch"]), _names(options)

    def initialOffset(self) -> dict:  # noqa: N802  names are Spark's
        return {n: {"cursor": "", "page": 0, "ended": False} for n in self.names}

    def _page(self, rank: int, name: str, at: dict) -> tuple[list[tuple], dict]:
        ends: list[str | None] = []

        def once(provider: str, _: str | None) -> tuple[list, None]:
            items, following = self.fetch(provider, at["cursor"] or None)
            ends.append(following)
            return items, None

        rows = [(p, r, at["page"], position, item, error) for p, r, _, position, item, error in pages(once, name, rank)]
        following = ends[0] if ends else None
        return rows, {"cursor": following or "", "page": at["page"] + 1, "ended": following is None}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], {}
        for rank, n in enumerate(self.names):
            end[n] = start.get(n) or self.initialOffset()[n]
            if not end[n]["ended"]:
                own, end[n] = self._page(rank, n, end[n])
                rows += own
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """A batch planned before a failure, read again."""
        for rank, n in enumerate(self.names):
            at = start.get(n) or self.initialOffset()[n]
            if at["page"] < end[n]["page"]:
                yield from self._page(rank, n, at)[0]

    def commit(self, end: dict) -> None:
        pass


def _names(options: dict) -> list[str]:
    return list(dict.fromkeys(n.strip() for n in options.get("providers", "").split(",") if n.strip()))


class ProviderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gleanwork_providers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


def scan(spark: SparkSession, fetch: str, providers: list[str], max_pages: int | None = None, max_items: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, failures) of all providers, each read by a task of its own."""
    spark.dataSource.register(ProviderSource)
    options = {"fetch": fetch, "providers": ",".join(providers), "max_pages": max_pages or "", "max_items": max_items or ""}
    rows = spark.read.format("gleanwork_providers").options(**options).load()
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("provider", "provider_rank", "page", "error")


def stream(spark: SparkSession, fetch: str, providers: list[str]) -> DataFrame:
    spark.dataSource.register(ProviderSource)
    return spark.readStream.format("gleanwork_providers").options(fetch=fetch, providers=",".join(providers)).load()
