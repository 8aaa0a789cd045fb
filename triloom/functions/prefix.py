"""Running sums over a whole table without one task seeing a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_running_sum(
    df: DataFrame, value: str, bucket: str, order: Sequence[Column | str], out: str, by: Sequence[str] = ()
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows of the same ``by`` up to this one.

    ``bucket`` is a whole number that grows with the order (rows of a smaller bucket come
    first). The sums of the buckets, a table of as many rows as there are buckets, are
    accumulated apart and joined back; the rows themselves are only windowed inside
    their bucket. Buckets must therefore be small, not groups: a ``by`` that holds a
    third of all rows is spread over many buckets.

    Null values count as 0. An empty table gives an empty table.
    """
    by = list(by)
    totals = df.groupBy(*by, bucket).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__total"))
    before = F.sum("__total").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*by, bucket, F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum(F.coalesce(F.col(value), F.lit(0))).over(
        Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        df.withColumn("__inside", inside)
        .join(offsets, [*by, bucket])
        .withColumn(out, F.col("__inside") + F.col("__before"))
        .drop("__inside", "__before")
    )
