"""Deterministic checks of answers against their evidence: quantities, negation, arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number with its unit, if one of these follows; the units that rules for objects and loans use.
UNITS = ("%", "kg", "g", "km", "cm", "mm", "m", "hours", "hour", "h", "days", "day", "eur", "usd")
QUANTITY = r"\p{N}+(?:[.,]\p{N}+)*(?:\s*(?:" + "|".join(UNITS) + r")(?:[^\p{L}\p{N}]|$))?"
NEGATION = r"(?i)(^|[^\p{L}])(not|no|never|none|without|neither|nor|cannot|\p{L}+n't)([^\p{L}]|$)"


def quantities(text: Column) -> Column:
    """Distinct numbers with their units, without the space between: ``2.5kg``, ``30%``, ``7``."""
    found = F.regexp_extract_all(F.lower(text), F.lit(QUANTITY), F.lit(0))
    return F.array_distinct(F.transform(found, lambda q: F.regexp_replace(q, r"[^\p{L}\p{N}%.,]|[.,]$", "")))


def negated(text: Column) -> Column:
    return F.coalesce(text.rlike(NEGATION), F.lit(False))


def charge(amount: Column, free: Column, rate: Column, rule: Column) -> Column:
    """``rate`` for each unit of ``amount`` beyond ``free``: struct (status, result, inputs, citation).

    The inputs and the rule are shown with the result; without an amount, a limit, a rate or a rule to
    cite it abstains.
    """
    known = amount.isNotNull() & free.isNotNull() & rate.isNotNull() & rule.isNotNull()
    return F.struct(
        F.when(known, "calculated").otherwise("abstained").alias("status"),
        F.when(known, F.round(F.greatest(amount - free, F.lit(0.0)) * rate, 6)).alias("result"),
        F.struct(amount.alias("amount"), free.alias("free"), rate.alias("rate")).alias("inputs"), rule.alias("citation"))
