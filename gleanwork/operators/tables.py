"""Maintenance of tables kept as Parquet: each operation returns the new state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The columns that incoming rows supply win, others keep their value; ``change`` is inserted, updated or kept.

    Of several incoming rows of one key the last by ``order`` counts (by all
    columns if none is given).
    """
    rest = [c for c in incoming.columns if c not in key]
    last = F.max_by(F.struct(*(rest or key)), F.struct(*(order or incoming.columns)))
    once = incoming.groupBy(*key).agg(last.alias("__row")).select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest])
    same = reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key])
    both = current.withColumn("__old", F.lit(True)).alias("old").join(once.withColumn("__new", F.lit(True)).alias("new"), same, "full_outer")
    columns = [F.when(F.col("new.__new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) if c in once.columns else F.col(f"old.{c}").alias(c) for c in current.columns]
    change = F.when(F.col("new.__new").isNull(), "kept").when(F.col("old.__old").isNull(), "inserted").otherwise("updated")
    return both.select(*columns, change.alias("change"))


def insert_if_absent(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    return current.union(incoming.select(current.columns).dropDuplicates(key).join(current.select(key), key, "left_anti").select(current.columns))


def get_or_create(keys: DataFrame, dimension: DataFrame, natural: str | list[str], prefix: str) -> DataFrame:
    """Ids of natural keys (one column or several): those known, and for new ones an id made of the key alone."""
    names = [natural] if isinstance(natural, str) else natural
    known = keys.select(*names).distinct().join(dimension.select(*names, "id"), names, "left")
    made = F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\0", *[F.col(n).cast("string") for n in names]), 256), F.lit(20)))
    return known.select(*names, F.coalesce("id", made).alias("id"), F.col("id").isNull().alias("created"))


def update_where(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return rows.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()})


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def cascade(items: DataFrame, links: DataFrame, stories: DataFrame, junk: Column, item_id: str, story_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Junk items go, their links go, and stories left without links go."""
    kept_items = delete_where(items, junk)
    kept_links = links.join(kept_items.select(item_id), item_id, "left_semi")
    return kept_items, kept_links, stories.join(kept_links.select(story_id), story_id, "left_semi")


def latest_state(log: DataFrame, key: str, order: list[str], allowed: dict[str, list[str]], state: str, start: str, bucket: Column | None = None) -> DataFrame:
    """Fold each key's events in order; a step that is not allowed from the present state changes nothing.

    A key's log may be long: the events of one ``bucket`` (by default an hour of
    the first order column) are folded from every possible state, and then the
    buckets' results in order, so no row holds more than one bucket's events.
    """
    states = sorted({start, *allowed, *(s for steps in allowed.values() for s in steps)})

    def fold(now: Column, event: Column) -> Column:
        return reduce(lambda out, rule: out.when((now == rule[0]) & event[state].isin(rule[1]), event[state]), allowed.items(), F.when(F.lit(False), now)).otherwise(now)

    part = bucket if bucket is not None else F.date_trunc("hour", F.col(order[0])) if dict(log.dtypes)[order[0]].startswith(("timestamp", "date")) else F.floor(F.col(order[0]) / 1000)
    steps = log.withColumn("__part", part).groupBy(key, "__part").agg(F.array_sort(F.collect_list(F.struct(*order, state))).alias("steps"))
    ends = F.create_map(*[x for s in states for x in (F.lit(s), F.aggregate("steps", F.lit(s), fold))])
    parts = steps.select(key, "__part", ends.alias("ends"), F.size("steps").alias("n"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("__part").alias("part"), F.map_entries("ends").alias("ends")))).alias("parts"), F.sum("n").cast("int").alias("events"))
    return whole.select(key, F.aggregate("parts", F.lit(start), lambda now, p: F.coalesce(F.element_at(F.map_from_entries(p["ends"]), now), now)).alias("state"), "events")


# The life of a publication.
PUBLICATION_STEPS = {"draft": ["publishing"], "publishing": ["published", "failed", "recovery_required"], "recovery_required": ["published", "failed"], "failed": ["publishing"]}


def reserved(stories: DataFrame, live: DataFrame, started_at: Column, platform: str = "threads") -> DataFrame:
    """A reservation row for each story (id, content) without a live publication: status, content, keys and start."""
    free = stories.join(live.select(F.col("story_id").alias("id")), "id", "left_anti")
    key = F.sha2(F.concat_ws("\0", F.lit(platform), F.col("id").cast("string"), F.col("content")), 256)
    return free.select(F.col("id").alias("story_id"), F.lit(platform).alias("platform"), F.lit("publishing").alias("status"), "content", started_at.alias("started_at"), key.alias("idempotency_key"), F.sha2("content", 256).alias("content_sha256"))


def finalized(reservations: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Reservations with the outcome of posting them (story_id, status, external_id): published needs an id, unknown asks for recovery, the time is set once published."""
    r = results.select("story_id", F.upper("status").alias("result"), F.col("external_id").alias("external_post_id"))
    status = F.when((F.col("result") == "PUBLISHED") & F.col("external_post_id").isNotNull(), "published").when(F.col("result").isin("PUBLISHED", "UNKNOWN"), "recovery_required").when(F.col("result").isNotNull(), "failed").otherwise(F.col("status"))
    return reservations.join(r, "story_id", "left").withColumn("status", status).withColumn("published_at", F.when(F.col("status") == "published", at)).drop("result")


def write_snapshot(rows: DataFrame, path: str) -> None:
    """A new snapshot becomes visible with its success marker; readers take the newest marked one."""
    rows.write.mode("errorifexists").parquet(path)
