"""Scores of predictions and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))


def confusion(df: DataFrame, truth: str, predicted: Column, *by: str, digits: int = 4) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall and f1 per group; rows without a truth or a prediction are left out."""
    t, p = F.col(truth) == 1, predicted
    x = df.where(F.col(truth).isNotNull() & p.isNotNull()).groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(2 * precision * recall, precision + recall)
    scores = {"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall, "f1": f1}
    return x.withColumns({n: F.round(e, digits) for n, e in scores.items()})


def recall_by_class(df: DataFrame, truth: str, predicted: Column, cls: str) -> DataFrame:
    """Recall of the positives of each class; a null class is `unknown`."""
    x = df.where((F.col(truth) == 1) & predicted.isNotNull()).groupBy(F.coalesce(F.nullif(F.trim(cls), F.lit("")), F.lit("unknown")).alias("cwe"))
    return x.agg(F.count("*").alias("total"), F.count_if(predicted).alias("found")).withColumn("recall", F.round(F.col("found") / F.col("total"), 4))


def deltas(scores: DataFrame, order: str, score: str) -> DataFrame:
    """Difference of a score to the row before; scores has one row per configuration."""
    before = F.lag(score).over(W.orderBy(order))
    return scores.withColumn("delta", F.round(F.col(score) - before, 4))


def elimination_by_class(df: DataFrame, cls: str, eliminated: Column) -> DataFrame:
    """(cwe, total, eliminated, rate) of repairs per class; a null class is `unknown`, a null outcome is no elimination."""
    x = df.groupBy(F.coalesce(F.col(cls), F.lit("unknown")).alias("cwe"))
    x = x.agg(F.count("*").alias("total"), F.count_if(F.coalesce(eliminated, F.lit(False))).alias("eliminated"))
    return x.withColumn("rate", F.round(F.col("eliminated") / F.col("total"), 4))


def repair_summary(df: DataFrame, *by: str) -> DataFrame:
    """Rates of compiled, fixed and approved repairs and the mean similarity where there is one."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return df.groupBy(*by).agg(F.count("*").alias("total"), rate("compiled").alias("compiled_rate"), rate("fixed").alias("fixed_rate"), rate("approved").alias("approved_rate"), F.round(F.avg("similarity"), 6).alias("avg_similarity"))
