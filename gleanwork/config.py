"""Options of the newsroom jobs, read from the environment once and passed on explicitly."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    cluster_hours: int = 36
    max_article_age_days: int = 30
    max_extractions: int = 50
    stale_reservation_minutes: int = 30
    max_characters: int = 500
    with_optional_search: bool = False

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] | None = None) -> Options:
        """Unset or unreadable values keep their default; the cluster window lies between 1 and 168 hours, a reservation lasts at least 5 minutes."""
        e = os.environ if environment is None else environment

        def number(name: str, default: int) -> int:
            try:
                return int(e.get(name, ""))
            except ValueError:
                return default

        return cls(
            cluster_hours=min(168, max(1, number("NEWSROOM_CLUSTER_WINDOW_HOURS", cls.cluster_hours))),
            max_article_age_days=number("NEWSROOM_MAX_ARTICLE_AGE_DAYS", cls.max_article_age_days),
            max_extractions=number("NEWSROOM_MAX_ARTICLE_EXTRACTIONS", cls.max_extractions),
            stale_reservation_minutes=max(5, number("NEWSROOM_STALE_RESERVATION_MINUTES", cls.stale_reservation_minutes)),
            max_characters=number("THREADS_MAX_CHARS", cls.max_characters),
            with_optional_search=e.get("NEWSROOM_ENABLE_TAVILY", "").strip().lower() in ("1", "true", "yes"),
        )
