"""Running sums and maxima that no group of rows can overload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.staging import staged


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, current: bool = True) -> DataFrame:
    """Adds a column for each of ``sums`` and ``maxima`` (name: of which column): over the rows of ``by`` up to this one in ``order``.

    ``order`` tells all rows apart.  ``current=False`` leaves the row itself out; before the first row a sum is 0
    and a maximum null.  Rows are dealt by ranges of (by, order), so that a group of any size is spread; a range is
    swept in one task, and one value for each group and range is carried on.  The ranges are sampled, so the dealt
    rows are written once, with their range's number, and read twice.
    """
    sums, maxima = sums or {}, maxima or {}
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(width, *by, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_{n}") for n, c in maxima.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_of_{c}" for c in (*by, "_range")}
    carried = totals.select(
        *[F.col(c).alias(n) for c, n in names.items()], *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums], *[F.max(f"_{n}").over(earlier).alias(f"_{n}") for n in maxima])
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    upto = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    both = ranged.join(carried, same)

    def total(name: str, of: str) -> Column:
        return F.coalesce(F.col(f"_{name}"), F.lit(0)) + F.coalesce(F.sum(of).over(upto), F.lit(0))

    added = {n: total(n, c) for n, c in sums.items()} | {n: F.greatest(F.col(f"_{n}"), F.max(c).over(upto)) for n, c in maxima.items()}
    return both.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` up to and with this row, within ``by`` in ``order``."""
    return running(df, by, order, {out: value})
