"""Statistics as aggregates.

Data-sized work is grouping and summing; what follows runs on tables with one
row per category, per distinct value or per test.  Rank statistics are
computed on the frequency table of distinct values (`frequencies`), so ranks
never need a sort of all rows, and two groups are never compared pair by pair.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import distributions as D
from corpuslens.operators.running import places, running_sum
from corpuslens.storage import materialise

#: Fixed value: the 97.5 % point of the normal distribution.
Z975 = 1.959963984540054


def shares(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """(column, n, share) with the share in per cent of all rows."""
    x = df.groupBy(column).agg(F.count("*").alias("n"))
    return x.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), digits))


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median and sample standard deviation (0 for one row) per group, from the counts of distinct values."""
    f = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("m"))
    f = running_sum(f, "m", ["value"], "ahead", by)
    s = f.groupBy(*by).agg(F.sum("m").alias("n"), (F.sum(F.col("m") * F.col("value")) / F.sum("m")).alias("mean"))
    x = f.join(s, list(by)) if by else f.join(F.broadcast(s))  # without groups s is one row
    holds = lambda at: F.max(F.when((F.col("ahead") <= at) & (at < F.col("ahead") + F.col("m")), F.col("value")))
    n = F.col("n")
    d = F.col("value") - F.col("mean")
    x = x.groupBy(*by, "n", "mean").agg(holds(F.floor((n - 1) / 2)).alias("lo"), holds(F.floor(n / 2)).alias("hi"), F.sum(F.col("m") * d * d).alias("q"))
    std = F.when(n > 1, F.sqrt(F.col("q") / F.when(n > 1, n - 1))).otherwise(0.0)
    return x.select(*by, "n", F.round("mean", 6).alias("mean"), ((F.col("lo") + F.col("hi")) / 2).alias("median"), F.round(std, 6).alias("std"))


def wilson(positive: Column, total: Column) -> dict[str, Column]:
    """Wilson interval of a proportion; zeros for an empty group."""
    z, n = Z975, F.when(total == 0, 1).otherwise(total)
    p = positive / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low, high = F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))
    return {"ci_low": F.when(total == 0, 0.0).otherwise(F.round(low, 6)), "ci_high": F.when(total == 0, 0.0).otherwise(F.round(high, 6))}


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Odds ratio of a 2x2 table with 0.5 added to every cell, and its log-normal interval."""
    a, b, c, d = (x + 0.5 for x in (a, b, c, d))
    o = (a * d) / (b * c)
    se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return {"odds_ratio": F.round(o, 6), "or_low": F.round(F.exp(F.log(o) - Z975 * se), 6), "or_high": F.round(F.exp(F.log(o) + Z975 * se), 6)}


def two_by_two(df: DataFrame, group: str, positive: Column) -> DataFrame:
    """Per group the cells in/out by positive/negative: a, b inside, c, d outside."""
    x = df.groupBy(group).agg(F.count_if(positive).alias("a"), F.count_if(~positive).alias("b"))
    whole = W.partitionBy()
    return x.withColumns({"c": F.sum("a").over(whole) - F.col("a"), "d": F.sum("b").over(whole) - F.col("b")})


def density(df: DataFrame, group: str, positive: Column) -> DataFrame:
    """Totals, positives, density with its Wilson interval and the odds ratio against all other groups."""
    x = two_by_two(df, group, positive)
    total = F.col("a") + F.col("b")
    x = x.select(group, total.alias("total"), F.col("a").alias("positive"), F.round(F.col("a") / total, 6).alias("density"), "a", "b", "c", "d")
    return x.withColumns(wilson(F.col("positive"), F.col("total")) | odds_ratio(*(F.col(c) for c in "abcd"))).drop(*"abcd")


def label_of(x: Column, edges: tuple[float, ...], names: tuple[str, ...] = ("negligible", "small", "medium", "large")) -> Column:
    """Name of the band of |x|; edges belong to the band above."""
    out = F.when(F.abs(x) < edges[0], names[0])
    for e, n in zip(edges[1:], names[1:]):
        out = out.when(F.abs(x) < e, n)
    return out.otherwise(names[-1])


#: Bands of Cliff's delta, Cohen's d and Cramer's V.
DELTA_BANDS, D_BANDS, V_BANDS = (0.147, 0.33, 0.474), (0.2, 0.5, 0.8), (0.1, 0.3, 0.5)

# ---- rank statistics ------------------------------------------------------------------------------


def frequencies(df: DataFrame, value: str, positive: Column, *by: str) -> DataFrame:
    """(by, value, n1, n0, rank): rows of both groups per distinct value and the average rank of the value."""
    x = df.where(F.col(value).isNotNull() & positive.isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count_if(positive).alias("n1"), F.count_if(~positive).alias("n0"))
    n = F.col("n1") + F.col("n0")
    x = running_sum(x.withColumn("_n", n), "_n", ["value"], "_ahead", by)
    return x.withColumn("rank", F.col("_ahead") + (n + 1) / 2).drop("_n", "_ahead")


def rank_test(df: DataFrame, value: str, positive: Column, *by: str) -> DataFrame:
    """n1, n0, u, delta, a, z and p of the Mann-Whitney test of positives against the rest, per group.

    u and a are the positives'; delta = 2 u / (n1 n0) - 1.  z has tie and
    continuity corrections; with fewer than 3 rows on a side u, z and p are
    null, delta is 0 and a is 0.5.
    """
    f = frequencies(df, value, positive, *by)
    t = F.col("n1") + F.col("n0")
    s = f.groupBy(*by).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum(F.col("n1") * F.col("rank")).alias("r1"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n, both = n1 + n0, n1 * n0
    few = F.least("n1", "n0") < 3
    u = F.col("r1") - n1 * (n1 + 1) / 2
    var = F.try_divide(both, F.lit(12.0)) * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.when(var <= 0, 0.0).otherwise(F.greatest(F.abs(u - both / 2) - 0.5, F.lit(0.0)) / F.sqrt(F.when(var <= 0, 1.0).otherwise(var)) * F.signum(u - both / 2))
    a = F.when(few, 0.5).otherwise(F.try_divide(u, both))
    out = s.select(*by, "n1", "n0", F.when(~few, u).alias("u"), F.round(2 * a - 1, 6).alias("delta"), F.round(a, 6).alias("a"), F.round(F.when(~few, z), 6).alias("z"))
    return out.withColumns({"effect": label_of(F.col("delta"), DELTA_BANDS), "p": D.column(D.normal_two_sided)(F.col("z"))})


def cohens_d(df: DataFrame, value: str, positive: Column, *by: str) -> DataFrame:
    """Difference of means by the pooled sample standard deviation; 0 if that is 0 or a side is empty."""
    x = df.where(F.col(value).isNotNull() & positive.isNotNull()).groupBy(*by)
    s = x.agg(F.count_if(positive).alias("n1"), F.count_if(~positive).alias("n0"), *(g(F.when(p, F.col(value))).alias(f"{n}{i}") for i, p in ((1, positive), (0, ~positive)) for n, g in (("m", F.avg), ("v", F.var_samp))))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.coalesce("v1", F.lit(0.0)) + (F.col("n0") - 1) * F.coalesce("v0", F.lit(0.0)), (F.col("n1") + F.col("n0") - 2).cast("double")))
    d = F.coalesce(F.round(F.try_divide(F.col("m1") - F.col("m0"), F.nullif(pooled, F.lit(0.0))), 6), F.lit(0.0))
    return s.select(*by, "n1", "n0", d.alias("d")).withColumn("effect", label_of(F.col("d"), D_BANDS))


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, n, rho, p): the correlation of average ranks per group, from the counts of distinct value pairs."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    pairs = materialise(pairs, "rank-pairs")

    def ranks(c: str) -> DataFrame:
        v = running_sum(pairs.groupBy(*by, c).agg(F.sum("n").alias("m")), "m", [c], "_ahead", by)
        return v.select(*by, c, (F.col("_ahead") + (F.col("m") + 1) / 2).alias(f"r{c}"))

    total = pairs.groupBy(*by).agg(F.sum("n").alias("t"))
    p = pairs.join(ranks("x"), [*by, "x"]).join(ranks("y"), [*by, "y"])
    p = p.join(total, list(by)) if by else p.join(F.broadcast(total))  # without groups total is one row
    w = lambda e: F.sum(F.col("n") * e)
    # centred at the mean rank (n + 1) / 2, which both sides share
    mid = (F.col("t") + 1) / 2
    p = p.withColumns({"dx": F.col("rx") - mid, "dy": F.col("ry") - mid})
    s = p.groupBy(*by).agg(F.sum("n").alias("n"), w(F.col("dx") * F.col("dy")).alias("xy"), w(F.col("dx") * F.col("dx")).alias("xx"), w(F.col("dy") * F.col("dy")).alias("yy"))
    return s.select(*by, "n", F.round(F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))), 6).alias("rho")).withColumn("p", D.column(D.spearman_p)(F.col("rho"), F.col("n").cast("double")))


# ---- contingency tables ----------------------------------------------------------------------------


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """The full grid (a, b, n) of the values that occur, 0 where a pair doesn't; null values are left out."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    # one row per distinct value on each side, which the counts bound
    grid = n.select(a).distinct().join(n.select(b).distinct(), F.lit(True))
    return grid.join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def chi_square(table: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, chi2, df, p, v): independence of a contingency table and the bias-corrected Cramer's V.

    2x2 tables get Yates' correction; where the corrected dimensions vanish V is uncorrected.
    """
    row, col, all_ = F.sum("n").over(W.partitionBy(a)), F.sum("n").over(W.partitionBy(b)), F.sum("n").over(W.partitionBy())
    x = table.withColumns({"r_": row, "c_": col, "t_": all_}).where("r_ > 0 and c_ > 0").withColumn("e_", F.col("r_") * F.col("c_") / F.col("t_"))
    x = x.groupBy().agg(F.sum("n").alias("n"), F.count_distinct(a).alias("rows"), F.count_distinct(b).alias("cols"), F.sum((F.col("n") - F.col("e_")) ** 2 / F.col("e_")).alias("plain"), F.sum(F.pow(F.greatest(F.abs(F.col("n") - F.col("e_")) - 0.5, F.lit(0.0)), F.lit(2.0)) / F.col("e_")).alias("yates"))
    x = x.withColumn("chi2", F.when((F.col("rows") == 2) & (F.col("cols") == 2), F.col("yates")).otherwise(F.col("plain"))).withColumn("df", (F.col("rows") - 1) * (F.col("cols") - 1))
    n, k, r = F.col("n").cast("double"), F.col("cols").cast("double"), F.col("rows").cast("double")
    phi2 = F.try_divide(F.col("chi2"), n)
    corr = F.greatest(phi2 - F.try_divide((k - 1) * (r - 1), n - 1), F.lit(0.0))
    rc, kc = r - F.try_divide((r - 1) * (r - 1), n - 1), k - F.try_divide((k - 1) * (k - 1), n - 1)
    low, plain = F.least(rc, kc) - 1, F.least(r, k) - 1
    v = F.when(low > 0, F.sqrt(F.try_divide(corr, low))).otherwise(F.sqrt(F.try_divide(phi2, F.nullif(plain, F.lit(0.0)))))
    return x.select("n", F.round("chi2", 6).alias("chi2"), "df", F.round(v, 6).alias("v")).withColumns({"p": D.column(D.chi2_tail)(F.col("chi2"), F.col("df").cast("double")), "effect": label_of(F.col("v"), V_BANDS)})


def goodness_of_fit(counts: DataFrame, n: str) -> DataFrame:
    """One row (k, chi2, p) against equal frequencies."""
    s = counts.agg(F.count("*").alias("k"), F.sum(n).alias("t"), F.sum((F.col(n) * F.col(n)).cast("double")).alias("q"))
    chi2 = F.round(F.col("q") * F.col("k") / F.col("t") - F.col("t"), 6)
    return s.select("k", chi2.alias("chi2")).withColumn("p", D.column(D.chi2_tail)(F.col("chi2"), (F.col("k") - 1).cast("double")))


def two_proportions(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """z of the pooled two-proportion test, 0 if its error is 0."""
    p = F.try_divide((x1 + x2).cast("double"), (n1 + n2).cast("double"))
    se = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n1.cast("double")) + F.try_divide(F.lit(1.0), n2.cast("double"))))
    return F.coalesce(F.round(F.try_divide(F.try_divide(x1.cast("double"), n1.cast("double")) - F.try_divide(x2.cast("double"), n2.cast("double")), F.nullif(se, F.lit(0.0))), 6), F.lit(0.0))


def diversity(counts: DataFrame, n: str, *by: str) -> DataFrame:
    """classes, entropy (log2), its share of the maximum (1 for one class), Gini-Simpson index and Gini coefficient of counts, per group.

    Classes with equal counts are one row with their number, so the order that
    the Gini coefficient needs is over distinct counts, of which N rows have at
    most the square root of 2 N.
    """
    f = counts.where(F.col(n) > 0).groupBy(*by, F.col(n).alias("n")).agg(F.count("*").alias("m"))
    whole, before = W.partitionBy(*by), W.partitionBy(*by).orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    f = f.withColumns({"t": F.sum(F.col("n") * F.col("m")).over(whole), "i": F.coalesce(F.sum("m").over(before), F.lit(0)) + (F.col("m") + 1) / 2})
    p = F.col("n") / F.col("t")
    x = f.groupBy(*by).agg(F.sum("m").alias("classes"), F.sum(-F.col("m") * p * F.log2(p)).alias("h"), F.sum(F.col("m") * p * p).alias("s"), F.sum(F.col("i") * F.col("m") * F.col("n")).alias("w"), F.max("t").alias("t"))
    k = F.col("classes")
    return x.select(*by, "classes", F.round("h", 6).alias("entropy"), F.round(F.when(k > 1, F.col("h") / F.log2(F.when(k > 1, k).otherwise(2))).otherwise(1.0), 6).alias("evenness"), F.round(1 - F.col("s"), 6).alias("gini_simpson"), F.round(2 * F.col("w") / (k * F.col("t")) - (k + 1) / k, 6).alias("gini"))


def lorenz(counts: DataFrame, n: str, tie: str) -> DataFrame:
    """Points (i, x, y) of the Lorenz curve with the origin; counts has one row per class, whose `tie` is distinct."""
    c = running_sum(places(counts, [n, tie], "i"), n, ["i"], "_ahead")
    s = counts.agg(F.count("*").alias("_k"), F.sum(n).alias("_t"))
    pts = c.join(F.broadcast(s)).select(F.col("i").cast("int").alias("i"), F.round(F.col("i") / F.col("_k"), 6).alias("x"), F.round((F.col("_ahead") + F.col(n)) / F.col("_t"), 6).alias("y"))  # s is one row
    return pts.unionByName(counts.sparkSession.createDataFrame([(0, 0.0, 0.0)], "i int, x double, y double"))


def pmi(joint: Column, left: Column, right: Column, total: Column) -> Column:
    """Pointwise mutual information in bits, 0 where a count is 0."""
    none = (joint == 0) | (left == 0) | (right == 0)
    return F.when(none, 0.0).otherwise(F.round(F.log2(F.when(none, 1.0).otherwise(joint * total / (left * right))), 6))


# ---- several tests -----------------------------------------------------------------------------------


def holm(tests: DataFrame, p: str, tie: str, *by: str) -> DataFrame:
    """Holm-Bonferroni adjusted p as `p_holm`, and `significant_holm`."""
    w = W.partitionBy(*by).orderBy(p, tie)
    raw = F.least(F.col(p) * (F.count("*").over(W.partitionBy(*by)) - F.row_number().over(w) + 1), F.lit(1.0))
    x = tests.withColumn("_raw", raw)
    return x.withColumn("p_holm", F.max("_raw").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_raw").withColumn("significant_holm", F.col("p_holm") < 0.05)


def benjamini_hochberg(tests: DataFrame, p: str, tie: str, *by: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p as `p_bh`, and `significant_bh`."""
    w = W.partitionBy(*by).orderBy(p, tie)
    raw = F.least(F.col(p) * F.count("*").over(W.partitionBy(*by)) / F.row_number().over(w), F.lit(1.0))
    x = tests.withColumn("_raw", raw)
    return x.withColumn("p_bh", F.min("_raw").over(w.rowsBetween(0, W.unboundedFollowing))).drop("_raw").withColumn("significant_bh", F.col("p_bh") < 0.05)


# ---- bootstrap -----------------------------------------------------------------------------------------


def _normal_cdf(z: np.ndarray | float) -> float:
    return NormalDist().cdf(float(z))


def bca_bounds(draws: np.ndarray, point: float, acceleration: float, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated interval from resampled statistics.

    Where no or every resample lies below the point (a proportion of 0 or 1) the
    correction is not defined; the interval is the percentile one then.
    """
    below = float(np.mean(draws < point))
    edges = ((1 - level) / 2, (1 + level) / 2)
    if 0 < below < 1:
        z0 = NormalDist().inv_cdf(below)
        shifted = [z0 + NormalDist().inv_cdf(e) for e in edges]
        edges = tuple(_normal_cdf(z0 + s / (1 - acceleration * s)) for s in shifted)
    low, high = np.percentile(draws, [100 * e for e in edges])
    return float(low), float(high)


def proportion_acceleration(x: int, n: int) -> float:
    """Jackknife acceleration of a proportion in closed form: leaving a row out gives one of two values."""
    if n < 2 or not 0 < x < n:
        return 0.0
    one, zero = (x - 1) / (n - 1), x / (n - 1)
    mean = (x * one + (n - x) * zero) / n
    cubes = x * (mean - one) ** 3 + (n - x) * (mean - zero) ** 3
    squares = x * (mean - one) ** 2 + (n - x) * (mean - zero) ** 2
    return cubes / (6 * squares**1.5)


def bootstrap_proportions(counts: DataFrame, key: str, positive: str, total: str, resamples: int = 10_000, seed: int = 42, method: str = "bca") -> DataFrame:
    """Interval of each group's proportion, `bca` or `percentile`; zeros for an empty group.

    Resampling n rows of 0 and 1 draws Binomial(n, p) counts, and the jackknife
    has a closed form, so a group of any size costs one vector of `resamples`
    numbers; counts has one row per group.
    """
    if method not in ("bca", "percentile"):
        raise ValueError("method must be bca or percentile")

    def run(batches):
        for pdf in batches:
            out = []
            for k, x, n in zip(pdf[key], pdf[positive], pdf[total]):
                if not n:
                    out.append((k, 0.0, 0.0, 0.0))
                    continue
                rng = np.random.default_rng([seed, *str(k).encode()])
                draws = rng.binomial(int(n), x / n, resamples) / n
                low, high = bca_bounds(draws, x / n, proportion_acceleration(int(x), int(n))) if method == "bca" else map(float, np.percentile(draws, [2.5, 97.5]))
                out.append((k, x / n, low, high))
            yield pd.DataFrame(out, columns=[key, "proportion", "boot_low", "boot_high"])

    kind = counts.schema[key].dataType.simpleString()
    return counts.select(key, positive, total).mapInPandas(run, f"{key} {kind}, proportion double, boot_low double, boot_high double")


def bootstrap_means(df: DataFrame, value: str, by: str, resamples: int = 10_000, seed: int = 42, method: str = "bca") -> DataFrame:
    """Interval of each group's mean, `bca` or `percentile`.

    Works on the frequency table: resampling rows draws multinomial counts over
    the distinct values, and the jackknife has one value per distinct value, so
    a task holds one row per distinct value of a group.
    """
    f = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("m"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        v, m = pdf.value.to_numpy(float), pdf.m.to_numpy(np.int64)
        n, rng = int(m.sum()), np.random.default_rng([seed, *str(pdf[by].iloc[0]).encode()])
        point, step = float((v * m).sum() / n), max(1, 4_000_000 // len(v))
        draws = np.concatenate([rng.multinomial(n, m / n, min(step, resamples - a)) @ v / n for a in range(0, resamples, step)])
        left = ((v * m).sum() - v) / max(1, n - 1)
        d = (left * m).sum() / n - left
        squares = float((m * d**2).sum())
        low, high = bca_bounds(draws, point, float((m * d**3).sum()) / (6 * squares**1.5) if squares > 1e-300 else 0.0) if method == "bca" else map(float, np.percentile(draws, [2.5, 97.5]))
        return pd.DataFrame([(pdf[by].iloc[0], point, low, high)], columns=[by, "mean", "boot_low", "boot_high"])

    kind = f.schema[by].dataType.simpleString()
    return f.groupBy(by).applyInPandas(run, f"{by} {kind}, mean double, boot_low double, boot_high double")


def bootstrap_delta(df: DataFrame, value: str, positive: Column, by: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile interval of Cliff's delta per group, both sides resampled independently.

    Works on the frequency table: resampling rows draws multinomial counts over
    the distinct values, so a task holds one row per distinct value.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        n1, n0 = pdf.n1.to_numpy(float), pdf.n0.to_numpy(float)
        rng = np.random.default_rng([seed, *str(pdf[by].iloc[0]).encode()])

        def delta(a, b):
            below = np.cumsum(b, axis=-1)
            return (a * (below - b)).sum(-1) / (a.sum(-1) * b.sum(-1)) - (a * (b.sum(-1, keepdims=True) - below)).sum(-1) / (a.sum(-1) * b.sum(-1))

        if not n1.sum() or not n0.sum():
            return pd.DataFrame([(pdf[by].iloc[0], 0.0, 0.0, 0.0)], columns=[by, "delta", "boot_low", "boot_high"])
        step = max(1, 2_000_000 // len(pdf))  # resamples at a time, so that memory stays small
        draw = lambda n, k: rng.multinomial(int(n.sum()), n / n.sum(), k).astype(float)
        parts = [delta(draw(n1, k), draw(n0, k)) for k in (min(step, resamples - a) for a in range(0, resamples, step))]
        low, high = np.percentile(np.concatenate(parts), [2.5, 97.5])
        return pd.DataFrame([(pdf[by].iloc[0], float(delta(n1[None], n0[None])[0]), low, high)], columns=[by, "delta", "boot_low", "boot_high"])

    f = frequencies(df, value, positive, by)
    kind = f.schema[by].dataType.simpleString()
    return f.groupBy(by).applyInPandas(run, f"{by} {kind}, delta double, boot_low double, boot_high double")
