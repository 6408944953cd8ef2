"""Named queries over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations


def _all() -> dict:
    from . import corpus, details, members, messages, metrics, stored

    return corpus.QUERIES | messages.QUERIES | metrics.QUERIES | details.QUERIES | members.QUERIES | stored.QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
