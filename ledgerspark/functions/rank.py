"""Numbering rows within a group that may be far larger than one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], coarse: str, order: list, out: str) -> DataFrame:
    """``row_number()`` over ``keys`` ordered by ``coarse`` and then ``order``.

    Only rows that share ``keys`` *and* ``coarse`` meet in one task; the slices are
    stitched together by a running total over their sizes, which is one row per slice.
    """
    inner = Window.partitionBy(*keys, coarse).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, coarse).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, coarse, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        df.withColumn("_pos", F.row_number().over(inner))
        .join(offsets, [*keys, coarse])
        .withColumn(out, F.col("_before") + F.col("_pos"))
        .drop("_before", "_pos")
    )


def running(df: DataFrame, keys: list[str], coarse: str, order: list, **sums: str) -> DataFrame:
    """For each ``out=column`` the sum of ``column`` over the rows of the group before this one, and ``out_all`` over the whole group.

    Cut into slices of ``coarse`` as :func:`ranked`.
    """
    inner = Window.partitionBy(*keys, coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    slices = df.groupBy(*keys, coarse).agg(*[F.sum(c).alias(f"_{o}") for o, c in sums.items()])
    carried = slices.select(
        *keys, coarse, *[F.coalesce(F.sum(f"_{o}").over(before), F.lit(0)).alias(f"_{o}_before") for o in sums],
        *[F.sum(f"_{o}").over(whole).alias(f"{o}_all") for o in sums])
    own = df.withColumns({f"_{o}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for o, c in sums.items()})
    joined = own.join(carried, [*keys, coarse])
    return joined.withColumns({o: F.col(f"_{o}") + F.col(f"_{o}_before") for o in sums}).drop(
        *[f"_{o}" for o in sums], *[f"_{o}_before" for o in sums])


def running_min(df: DataFrame, keys: list[str], coarse: str, order: list, value: str, out: str) -> DataFrame:
    """``out``: the least ``value`` over the rows of the group before this one, null if there is none; slices as in :func:`ranked`."""
    inner = Window.partitionBy(*keys, coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*keys, coarse).agg(F.min(value).alias("_least")).select(
        *keys, coarse, F.min("_least").over(before).alias("_carried"))
    return df.withColumn("_own", F.min(value).over(inner)).join(carried, [*keys, coarse]).withColumn(
        out, F.least("_own", "_carried")).drop("_own", "_carried")


def top_per(df: DataFrame, keys: list[str], order: list[Column], limit: int | None, out: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each group, numbered from 1; without a limit all rows.

    Spark trims every input partition to ``limit`` rows per group before the shuffle
    (WindowGroupLimit), so a hot group never moves whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn(out, F.row_number().over(w))
    return numbered if limit is None else numbered.where(F.col(out) <= limit)
