"""Registered queries: each runs one operator over the given tables, with its SQL counterpart."""

from catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "load"]


def load() -> None:
    """Import every module that registers queries."""
    from catalog import activity, decisions, learners, people, preparation, sampling, sequences, sessions  # noqa: F401
