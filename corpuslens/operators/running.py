"""Running sums and places in an order, without a window over one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.storage import materialise

#: Tables of up to so many rows are summed in one window; larger ones range by range.
SINGLE = 1_000_000


def running_sum(df: DataFrame, value: str, order: Sequence[Column | str], name: str = "ahead", by: Sequence[str] = (), single: int | None = None) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of its group that come before it in `order`, which must be total within a group.

    df is stored first.  A large table is cut into ranges of the order; each
    range is summed on its own, and the totals of the ranges before it, a table
    with one row per range and group, are added.  No task sees more than one
    range.  The columns `by` must not be null.
    """
    single = SINGLE if single is None else single
    df = materialise(df, "running")
    ahead = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if df.limit(single + 1).count() <= single:
        return df.withColumn(name, ahead(W.partitionBy(*by).orderBy(*order), value))
    # stored with its range, as a range that is cut anew could have other bounds
    x = materialise(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "running-ranges")
    totals = x.groupBy("_range", *by).agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", ahead(W.partitionBy(*by).orderBy("_range"), "_total")).drop("_total")
    x = x.withColumn("_inside", ahead(W.partitionBy("_range", *by).orderBy(*order), value))
    return x.join(before, ["_range", *by]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def places(df: DataFrame, order: Sequence[Column | str], name: str = "place", single: int | None = None) -> DataFrame:
    """df with `name`: the row's place in the order, from 1."""
    x = running_sum(df.withColumn("_one", F.lit(1)), "_one", order, "_ahead", (), single)
    return x.withColumn(name, F.col("_ahead") + 1).drop("_one", "_ahead")
