"""The access predicate: default deny, explicit deny first, sections only narrow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _has(array: Column, value: Column) -> Column:
    """False where the list or the value is missing."""
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def allow(user: str, corpus_id: Column, tenant_id: Column, policy: str) -> Column:
    """Whether the principal in struct column ``user`` passes the rule in struct column ``policy``.

    ``user``: user_id, active, tenant_id, roles, department_id, allowed_corpus_ids.
    ``policy``: classification, allowed_roles, department_ids, allowed_users, denied_users.
    Restricted text needs an allowed role within the departments, or to be named; unknown
    classifications, missing rules and missing metadata deny.
    """
    u, p = (lambda c: F.col(f"{user}.{c}")), (lambda c: F.col(f"{policy}.{c}"))
    no_department = F.size(F.coalesce(p("department_ids"), F.array().cast("array<string>"))) == 0
    by_role = F.coalesce(F.arrays_overlap(u("roles"), p("allowed_roles")), F.lit(False))
    restricted = (by_role & (no_department | _has(p("department_ids"), u("department_id")))) | _has(p("allowed_users"), u("user_id"))
    by_class = (
        F.when(p("classification") == "public", True)
        .when(p("classification") == "internal", True)  # any active principal of the tenant is staff
        .when(p("classification") == "restricted", restricted)
        .otherwise(False)
    )
    rule = (
        u("active")
        & (u("tenant_id") == tenant_id)
        & _has(u("allowed_corpus_ids"), corpus_id)
        & ~_has(p("denied_users"), u("user_id"))
        & by_class
    )
    return F.coalesce(rule, F.lit(False))


def may_read_history(grants: Column, corpus_id: Column) -> Column:
    return _has(grants, F.concat(F.lit("read_history:"), corpus_id))
