"""Every registered query by name, and its SQL."""

from __future__ import annotations

from . import dataset_queries, decision_queries, episode_queries, insight_queries, matchday_queries, player_queries, report_queries, scoring_queries, team_queries, telemetry_queries

MODULES = (team_queries, telemetry_queries, player_queries, scoring_queries, report_queries, insight_queries, matchday_queries, decision_queries, episode_queries, dataset_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
