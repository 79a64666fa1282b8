"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from vellum.plans import catalogue


def queries() -> dict:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.SQL)
