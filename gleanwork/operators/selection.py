"""A run over candidates with its parts passed in: what is remembered, what is judged, what an attempt gives.

The parts are functions of DataFrames.  Defaults are the library's own; tests
and other newsrooms pass theirs, and nothing has to be replaced inside.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stories import replay_attempts

Builder = Callable[[DataFrame], DataFrame]


def no_memory(candidates: DataFrame) -> DataFrame:
    """(id, warnings, unresolved) of a newsroom that remembers nothing."""
    return candidates.select("id", F.array().cast("array<string>").alias("warnings"), F.lit(False).alias("unresolved"))


@dataclass(frozen=True)
class Run:
    """``memory``: candidates to (id, warnings, unresolved).  ``attempt``: accepted candidates to (id, outcome).

    A candidate is attempted unless memory holds an unresolved duplicate; ids
    that memory or attempts leave out are not remembered and have no outcome.
    """

    attempt: Builder
    memory: Builder = no_memory
    wanted: int = 1

    def over(self, candidates: DataFrame, group: str, order: list[str | Column]) -> DataFrame:
        """Candidates with ``warnings``, ``outcome`` and ``state``: in order within a group, REMEMBERED, ATTEMPTED or SKIPPED.

        Attempts end with a system failure or the wanted number of posts; rows
        after that are SKIPPED, whatever ``attempt`` says of them.  ``attempt``
        is asked once, for all candidates that memory lets pass.
        """
        known = self.memory(candidates).select("id", "warnings", "unresolved")
        rows = candidates.join(known, "id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
        held = F.coalesce("unresolved", F.lit(False))
        passing = rows.filter(~held).drop("unresolved")
        tried = passing.join(self.attempt(passing).select("id", "outcome"), "id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("SYSTEM_ERROR")))
        judged = replay_attempts(tried, group, order, self.wanted)
        done = judged.withColumn("outcome", F.when(F.col("state") == "ATTEMPTED", F.col("outcome")))
        kept = rows.filter(held).drop("unresolved").withColumns({"outcome": F.lit(None).cast("string"), "state": F.lit("REMEMBERED")})
        return done.unionByName(kept)
