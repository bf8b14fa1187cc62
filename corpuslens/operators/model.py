"""Feature matrices and models on pyspark.ml."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import distributions as D

MAX_LEVELS = 200


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, by their population standard deviation (1 where that is 0); one aggregate, joined as one row."""
    s = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    x = df.join(F.broadcast(s))
    return x.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")) for c in columns}).drop(*(f"{k}_{c}" for c in columns for k in "ms"))


def one_hot(df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """Indicator columns of the sorted levels, the first left out; at most MAX_LEVELS levels."""
    levels = sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(MAX_LEVELS + 1).collect())
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels")
    names = {f"{column}={v}": (F.col(column) == v).cast("double") for v in levels[1:]}
    return df.withColumns({n: F.coalesce(e, F.lit(0.0)) for n, e in names.items()}), list(names)


def folds(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """Stratified folds: rows of a label in the order of the md5 of their key, dealt out in turn."""
    return df.withColumn("fold", ((F.row_number().over(W.partitionBy(label).orderBy(F.md5(F.col(key)), key)) - 1) % k).cast("int"))


def _enough(df: DataFrame, label: str, least: int = 10) -> bool:
    rows = df.groupBy(label).count().limit(3).collect()
    return len(rows) == 2 and min(r["count"] for r in rows) >= least


def _assembled(df: DataFrame, columns: list[str], label: str, *keep: str) -> DataFrame:
    x = VectorAssembler(inputCols=columns, outputCol="features").transform(df.withColumn("y", F.col(label).cast("double")))
    return x.select("features", "y", *keep)


def logistic(df: DataFrame, columns: list[str], label: str, c: float = 1.0):
    """Fitted L2 logistic regression with penalty 1/c on the sum of losses; columns should be scaled. None without enough rows of both classes."""
    if not _enough(df, label):
        return None
    x = _assembled(df, columns, label)
    return LogisticRegression(labelCol="y", regParam=1.0 / (c * max(1, x.count())), elasticNetParam=0.0, standardization=False, maxIter=100).fit(x)


def ranked_coefficients(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, coef, rank) of logistic regression by the absolute value of the coefficient; columns should be scaled."""
    model = logistic(df, columns, label)
    pairs = [] if model is None else sorted(zip(columns, model.coefficients.toArray()), key=lambda r: (-abs(r[1]), r[0]))
    return df.sparkSession.createDataFrame([(f, float(c), i) for i, (f, c) in enumerate(pairs, 1)], "feature string, coef double, rank int")


def wald(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, coef, se, z, p) by the Fisher information, a k x k matrix that is summed in the tasks."""
    spark = df.sparkSession
    schema = "feature string, coef double, se double, z double, p double, pseudo_r2 double"
    model = logistic(df, columns, label)
    if model is None:
        return spark.createDataFrame([], schema)
    beta = np.append(model.coefficients.toArray(), model.intercept)
    names = [*columns, "intercept"]
    k = len(names)

    def partial(batches):
        import pandas as pd

        total, ll = np.zeros((k, k)), 0.0
        for pdf in batches:
            x = np.column_stack([pdf[columns].to_numpy(float), np.ones(len(pdf))])
            eta = x @ beta
            p = 1 / (1 + np.exp(-eta))
            total += (x * (p * (1 - p))[:, None]).T @ x
            y = pdf[label].to_numpy(float)
            ll += float((y * eta - np.logaddexp(0, eta)).sum())
        yield pd.DataFrame({"at": range(k * k + 1), "v": [*total.ravel(), ll]})

    sums = df.select(*columns, label).mapInPandas(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()  # k * k + 1 rows
    info = np.array([r.v for r in sums[:-1]]).reshape(k, k)
    n1, n = (int(v) for v in df.agg(F.sum(F.col(label).cast("long")), F.count("*")).first())
    null = n1 * np.log(n1 / n) + (n - n1) * np.log(1 - n1 / n)
    r2 = float(1 - sums[-1].v / null)
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(info)), 1e-300))
    return spark.createDataFrame([(f, float(b), float(s), float(b / s), D.normal_two_sided(float(b / s)), r2) for f, b, s in zip(names, beta, se)], schema)


def nested_tests(df: DataFrame, blocks: dict[str, list[str]], label: str) -> DataFrame:
    """(model, features, log_likelihood, chi2, df, p): each block of features added to those before."""
    spark = df.sparkSession
    schema = "model string, features int, log_likelihood double, chi2 double, df int, p double"
    used, rows, before = [], [], None
    for name, cols in blocks.items():
        used = used + cols
        model = logistic(df, used, label, c=1e6)
        if model is None:
            return spark.createDataFrame([], schema)
        ll = -model.summary.objectiveHistory[-1] * df.count()
        chi2 = None if before is None else max(0.0, 2 * (ll - before))
        rows.append((name, len(used), float(ll), chi2, len(cols), None if chi2 is None else D.chi2_tail(chi2, len(cols))))
        before = ll
    return spark.createDataFrame(rows, schema)


def cross_validated_auc(df: DataFrame, columns: list[str], label: str, key: str, k: int = 5) -> DataFrame:
    """(fold, auc) of logistic regression on stratified folds."""
    x = folds(df, key, label, k)
    spark, rows = df.sparkSession, []
    if _enough(df, label):
        for i in range(k):
            model = logistic(x.where(F.col("fold") != i), columns, label)
            if model is not None:
                test = model.transform(_assembled(x.where(F.col("fold") == i), columns, label))
                rows.append((i, float(BinaryClassificationEvaluator(labelCol="y").evaluate(test))))
    return spark.createDataFrame(rows, "fold int, auc double")


def forest_importance(df: DataFrame, columns: list[str], label: str, trees: int = 100, seed: int = 42) -> DataFrame:
    """(feature, importance, rank) of a random forest."""
    spark = df.sparkSession
    if not _enough(df, label):
        return spark.createDataFrame([], "feature string, importance double, rank int")
    model = RandomForestClassifier(labelCol="y", numTrees=trees, seed=seed).fit(_assembled(df, columns, label))
    ranked = sorted(zip(columns, model.featureImportances.toArray()), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(f, float(v), i) for i, (f, v) in enumerate(ranked, 1)], "feature string, importance double, rank int")
