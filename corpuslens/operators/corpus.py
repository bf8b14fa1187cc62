"""Building a corpus: defaults, quality filters, deduplication, splits and leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators.running import running_sum


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the given order; null keys are a key, null values come first.

    The rank filter becomes a group limit in every task before the shuffle, so a
    key that holds a large part of all rows sends one row per task, and columns
    that nothing uses later aren't read.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", rank).where(F.col("_first") == 1).drop("_first")


def with_defaults(df: DataFrame) -> DataFrame:
    """Code samples with the defaults of absent and empty values and one spelling of names."""
    low = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown"))
    filled = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    return df.select(
        "sample_id",
        "label",
        F.col("vulnerable_code").alias("code"),
        "fixed_code",
        "source",
        "split",
        "fetched_at",
        "commit_message",
        "file_path",
        "cve_id",
        "origin",
        F.coalesce(F.nullif(F.upper(F.trim("cwe_id")), F.lit("")), F.lit("unknown")).alias("cwe"),
        low("language").alias("language"),
        filled("ros_component", "other").alias("component"),
        filled("ros_version", "other").alias("version"),
        filled("severity", "MEDIUM").alias("severity"),
        low("repo").alias("repo"),
    )


def quality(code: Column) -> dict[str, Column]:
    """The three quality rules: q1 3 filled lines and 50 characters; q2 8 to 80 filled lines; q3 3 meaningful lines and 50 characters."""
    n = F.size(T.filled_lines(code))
    long_ = F.length(code) >= 50
    return {"q1": (n >= 3) & long_, "q2": n.between(8, 80), "q3": (F.size(T.meaningful_lines(code)) >= 3) & long_}


def filter_report(df: DataFrame, keep: Column, label: str) -> DataFrame:
    """Rows kept and removed by a filter, per label."""
    kept = F.coalesce(keep, F.lit(False))
    return df.groupBy(label).agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"))


def rare_to(df: DataFrame, column: str, least: int, other: str) -> DataFrame:
    """Values of a column with fewer than `least` rows replaced by `other`; counts are aggregated first and joined back."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    return df.join(counts, column).withColumn(column, F.when(F.col("_n") < least, other).otherwise(F.col(column))).drop("_n")


def hash_split(df: DataFrame, group: str, train_share: int = 60, seed: str = "") -> DataFrame:
    """`part` train or test by the hash of the group: all rows of a group fall on one side, without a shuffle."""
    return df.withColumn("part", F.when(T.bucket(F.col(group), seed) < train_share, "train").otherwise("test"))


def greedy_split(df: DataFrame, group: str, classes: str, share: float = 0.6) -> DataFrame:
    """(group, n, part): groups in ascending order of size go to train until its share of rows is reached; a group with a class that train lacks goes there anyway.

    Until the share is reached train has all groups before, so a group is in
    train if the rows before it are fewer than the share, or if it is the first
    group in the order (size, name) that has one of its classes: a running sum
    over the groups and a minimum per class, without a fold.  Null classes are
    no class, a null group is a group.
    """
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    groups = running_sum(n, "n", ["n", group], "_ahead")
    total = n.agg(F.sum("n").alias("_total"))
    pairs = df.where(F.col(classes).isNotNull()).select(F.col(group).alias("_g"), F.col(classes).alias("_c")).distinct()
    pairs = pairs.join(n, F.col(group).eqNullSafe(F.col("_g")))
    first = pairs.groupBy("_c").agg(F.min(F.struct("n", group)).alias("m")).select(F.col(f"m.{group}").alias("_g"), F.lit(True).alias("_first")).distinct()
    x = groups.join(first, F.col(group).eqNullSafe(F.col("_g")), "left").join(F.broadcast(total))  # total is one row
    train = (F.col("_ahead") < share * F.col("_total")) | F.col("_first").isNotNull()
    return x.select(group, "n", F.when(train, "train").otherwise("test").alias("part"))


def sample_per_class(df: DataFrame, group: str, key: str, most: int, seed: str = "42") -> DataFrame:
    """At most `most` rows per class, those with the smallest hashes of seed and key."""
    order = W.partitionBy(group).orderBy(F.md5(F.concat(F.lit(seed), F.col(key))), key)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def leakage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a that occur in b; nulls never match."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def without(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key doesn't occur in b; rows with a null key stay."""
    return a.join(b.select(key), key, "left_anti")
