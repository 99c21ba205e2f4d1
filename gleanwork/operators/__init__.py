"""Operators on tables: gates, joins, dedup, clustering, roll-ups, ranking, maintenance."""
