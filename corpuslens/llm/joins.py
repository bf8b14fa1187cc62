"""Joins with a table of distinct keys that hold when one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of up to so many rows are broadcast: some 100 bytes a row in the JVM's hash table, so 10 MB.
BROADCAST_ROWS = 100_000
#: More rows of one key than this are spread over several tasks.
HOT_ROWS = 1_000_000
SALT = 32


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df has at most `rows` rows, BROADCAST_ROWS if not given; reads no more of it than that."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def hot_keys(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Keys with more than `rows` rows, by partial counts; at most one for every `rows` rows of df."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > (HOT_ROWS if rows is None else rows)).select(key)


def join_hot(big: DataFrame, small: DataFrame, key: str, spread: str, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join of big with a table of distinct keys; how: left, inner or left_semi.

    A table of checked size is broadcast.  Beyond it the hot keys of big are
    counted (or given), their rows are spread over SALT tasks by a hash of the
    column `spread`, and only their rows of small are repeated.
    """
    if is_small(small):
        return big.join(F.broadcast(small), key, how)
    hot = hot_keys(big, key) if hot is None else hot
    if not hot.limit(1).count():
        return big.join(small, key, how)
    flag = F.broadcast(hot.withColumn("_hot", F.lit(True)))  # one key for every HOT_ROWS rows at most
    left = big.join(flag, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")).otherwise(0)).drop("_hot")
    right = small.join(flag, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")
