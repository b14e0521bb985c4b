"""Registered queries over the given tables, with the SQL that must give the same rows."""

from reqweave.queries import answer_checks, calls, files, hints, profiles, records, requests, sqltool, texts, tools  # noqa: F401
from reqweave.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
