"""Collects queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable


class Queries:
    def __init__(self) -> None:
        self.run: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        """Registers a function (spark, sf_dir) under its name; sql is DuckDB's way to the same rows."""

        def register(f: Callable) -> Callable:
            self.run[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register
