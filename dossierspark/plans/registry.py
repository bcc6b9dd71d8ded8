"""Registered queries with the SQL that states the same result."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries = {}
        self.oracle = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            assert name not in self.queries, name
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn
        return wrap
