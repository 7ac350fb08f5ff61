"""All queries of the core: (spark, folder of the tables) -> DataFrame, and their SQL for DuckDB."""

from __future__ import annotations

from gristmill.plans import problems, reference, sources

QUERIES: dict = {**reference.QUERIES, **sources.QUERIES, **problems.QUERIES}
SQL: dict[str, str] = {**reference.SQL, **sources.SQL, **problems.SQL}
