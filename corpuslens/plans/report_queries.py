"""The ten reports of the empirical study, each a flat table; p-values are in tables of their own."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import distributions as D
from corpuslens.operators import model as M
from corpuslens.operators import stats as S
from corpuslens.plans.catalogue import query
from corpuslens.plans.corpus_queries import ANTI, ANTI_SQL, flagged
from corpuslens.plans.stats_queries import (
    _API,
    _CELLS,
    _CODE,
    _COMPLEX,
    _FREQ,
    _L,
    _LAYERS,
    _ODDS,
    _PMI,
    _WILSON,
    _spearman_sql,
    bh_sql,
    density_sql,
    exact_sql,
    feature_tests,
    holm_sql,
    labelled,
    long_metrics,
    model_input,
    normal_p_sql,
    pmi_table,
    positive,
    rho_p_sql,
)
from corpuslens.plans.tables import samples, with_samples

#: Places in the public 2024 list of dangerous weaknesses.
TOP25 = {"CWE-79": 1, "CWE-787": 2, "CWE-89": 3, "CWE-78": 7, "CWE-476": 9, "CWE-416": 10, "CWE-190": 12, "CWE-362": 15, "CWE-119": 17, "CWE-401": 32, "CWE-134": 36}
HIGH = ("HIGH", "CRITICAL")


@query("report_r1", with_samples(", r(cwe, external_rank) AS (VALUES " + ", ".join(f"('{c}', {n})" for c, n in TOP25.items()) + "), l(cwe, layer) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _LAYERS) + "), n AS (SELECT cwe, count(*) AS n, count_if(severity IN ('HIGH', 'CRITICAL')) AS high FROM samples WHERE label = 1 GROUP BY cwe) SELECT cwe, n, round(n * 100.0 / sum(n) OVER (), 4)::DOUBLE AS share, high, coalesce(layer, 'unmapped') AS layer, external_rank, row_number() OVER (ORDER BY n DESC, cwe) AS place FROM n LEFT JOIN r USING (cwe) LEFT JOIN l USING (cwe)"))
def report_r1(spark, sf):
    """Classes of the vulnerable samples: share, severity, layer and rank elsewhere."""
    n = samples(spark, sf).where(positive()).groupBy("cwe").agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin(*HIGH)).alias("high"))
    rank = spark.createDataFrame(list(TOP25.items()), "cwe string, external_rank int")
    layer = spark.createDataFrame(_LAYERS, "cwe string, layer string")
    x = n.join(F.broadcast(rank), "cwe", "left").join(F.broadcast(layer), "cwe", "left")  # eleven and eight rows
    return x.select("cwe", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 4).alias("share"), "high", F.coalesce("layer", F.lit("unmapped")).alias("layer"), "external_rank", F.row_number().over(W.orderBy(F.desc("n"), "cwe")).alias("place"))  # one row per class of weakness, of which there are some hundreds


@query("report_r1_diversity", with_samples(", n AS (SELECT cwe, count(*) AS n FROM samples WHERE label = 1 GROUP BY cwe), p AS (SELECT *, n / sum(n) OVER () AS p, row_number() OVER (ORDER BY n) AS i FROM n) SELECT count(*) AS classes, round(sum(-p * log2(p)), 6) AS entropy, round(sum(-p * log2(p)) / log2(count(*)), 6) AS evenness, round(1 - sum(p * p), 6) AS gini_simpson, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM p"))
def report_r1_diversity(spark, sf):
    return S.diversity(samples(spark, sf).where(positive()).groupBy("cwe").agg(F.count("*").alias("n")), "n")


@query("report_r2", with_samples(density_sql(_L, "l", "component", "label = 1").replace("SELECT component, total", ", k AS (SELECT component, cwe AS top_class, n AS top_n FROM (SELECT component, cwe, count(*) AS n, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, cwe) AS r FROM l WHERE label = 1 GROUP BY component, cwe) WHERE r = 1) SELECT component, top_class, top_n, total", 1).replace("FROM x", "FROM x LEFT JOIN k USING (component)")))
def report_r2(spark, sf):
    """Density, interval and odds ratio per component with its most frequent class."""
    x = labelled(spark, sf)
    c = x.where(positive()).groupBy("component", "cwe").agg(F.count("*").alias("n"))
    top = c.groupBy("component").agg(F.min_by(F.struct("cwe", "n"), F.struct(-F.col("n"), F.col("cwe"))).alias("m")).select("component", F.col("m.cwe").alias("top_class"), F.col("m.n").alias("top_n"))
    return S.density(x, "component", positive()).join(top, "component", "left")


def _exact(x, tie):
    return x.withColumn("p", F.round(D.column(D.fisher_two_sided)(*(F.col(c).cast("double") for c in "abcd")), 9))


def _rounded(x, *columns):
    return x.withColumns({c: F.round(c, 7) for c in columns})


#: Cells of each group against all others, from counts g (key, a, b).
_AGAINST = "k AS (SELECT {0}, a, b, (sum(a) OVER () - a)::BIGINT AS c, (sum(b) OVER () - b)::BIGINT AS d FROM g)"


@query("report_r2_tests", with_samples(_L + ", g AS (SELECT component, count_if(label = 1) AS a, count_if(label <> 1) AS b FROM l GROUP BY component), " + _AGAINST.format("component") + "," + exact_sql("component") + ", " + holm_sql("component") + " SELECT component, a, b, c, d, round(p, 7) AS p, round(p_holm, 7) AS p_holm, p_holm < 0.05 AS significant_holm FROM k JOIN pv USING (component) JOIN r USING (component)"))
def report_r2_tests(spark, sf):
    """Exact tests of every component against the rest, Holm-adjusted."""
    return _rounded(S.holm(_exact(S.two_by_two(labelled(spark, sf), "component", positive()), "component"), "p", "component"), "p", "p_holm")


@query("report_r3", with_samples(_FREQ + ", e AS (SELECT metric, round(avg(value) FILTER (WHERE label = 1), 6) AS mean_1, round(avg(value) FILTER (WHERE label <> 1), 6) AS mean_0, median(value) FILTER (WHERE label = 1) AS median_1, median(value) FILTER (WHERE label <> 1) AS median_0 FROM u GROUP BY metric) SELECT metric, mean_1, mean_0, median_1, median_0, round(2 * (u / (n1 * n0)) - 1, 6) AS delta, round(u / (n1 * n0), 6) AS a FROM t JOIN e USING (metric)"))
def report_r3(spark, sf):
    """Complexity of vulnerable and clean samples."""
    x = long_metrics(spark, sf)
    d = S.describe(x.withColumn("side", positive().cast("int")), "value", "metric", "side")
    m = d.groupBy("metric").agg(*(F.max(F.when(F.col("side") == i, F.col(c))).alias(f"{c}_{i}") for c in ("mean", "median") for i in (1, 0)))
    return m.join(S.rank_test(x, "value", positive(), "metric").select("metric", "delta", "a"), "metric")


_Z = "round(CASE WHEN var <= 0 THEN 0 ELSE greatest(abs(u - n1 * n0 / 2) - 0.5::DOUBLE, 0.0::DOUBLE) / sqrt(var) * sign(u - n1 * n0 / 2) END, 6)"


@query("report_r3_tests", with_samples(_FREQ + f", s2 AS (SELECT metric, n1::BIGINT AS n1, n0::BIGINT AS n0, u, round(2 * (u / (n1 * n0)) - 1, 6) AS delta, round(u / (n1 * n0), 6) AS a, {_Z} AS z FROM t), pv AS (SELECT metric, {normal_p_sql('z')} AS p FROM s2), " + holm_sql("metric") + " SELECT metric, n1, n0, u, delta, a, z, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS effect, round(p, 7) AS p, round(p_holm, 7) AS p_holm, p_holm < 0.05 AS significant_holm FROM s2 JOIN pv USING (metric) JOIN r USING (metric)"))
def report_r3_tests(spark, sf):
    """Rank tests of the metrics, Holm-adjusted, with effect labels."""
    return _rounded(S.holm(S.rank_test(long_metrics(spark, sf), "value", positive(), "metric"), "p", "metric"), "p", "p_holm")


_FAMILY = "CASE WHEN language IN ('c', 'c++', 'cpp', 'cxx') THEN 'C/C++' WHEN language IN ('python', 'py', 'python3') THEN 'Python' ELSE 'other' END"


def by_family(spark, sf):
    low = F.col("language")
    return labelled(spark, sf).withColumn("family", F.when(low.isin("c", "c++", "cpp", "cxx"), "C/C++").when(low.isin("python", "py", "python3"), "Python").otherwise("other"))


@query("report_r4", with_samples(density_sql(_L + f", fam AS (SELECT *, {_FAMILY} AS family FROM l)", "fam", "family", "label = 1")))
def report_r4(spark, sf):
    """Density per language."""
    return S.density(by_family(spark, sf), "family", positive())


@query("report_r4_tests", with_samples(_L + f", g AS (SELECT cwe, count_if(family = 'C/C++') AS a, count_if(family = 'Python') AS b FROM (SELECT *, {_FAMILY} AS family FROM l) WHERE label = 1 AND family <> 'other' GROUP BY cwe), " + _AGAINST.format("cwe") + "," + exact_sql("cwe") + ", " + holm_sql("cwe") + " SELECT cwe, a, b, c, d, round(p, 7) AS p, round(p_holm, 7) AS p_holm, p_holm < 0.05 AS significant_holm FROM k JOIN pv USING (cwe) JOIN r USING (cwe)"))
def report_r4_tests(spark, sf):
    """Per class, the exact test of C/C++ against Python among the vulnerable samples, Holm-adjusted."""
    x = by_family(spark, sf).where(positive() & (F.col("family") != "other"))
    c = F.col("family") == "C/C++"
    t = x.groupBy("cwe").agg(F.count_if(c).alias("a"), F.count_if(~c).alias("b"))
    w = W.partitionBy()
    t = t.withColumns({"c": F.sum("a").over(w) - F.col("a"), "d": F.sum("b").over(w) - F.col("b")})
    return _rounded(S.holm(_exact(t, "cwe"), "p", "cwe"), "p", "p_holm")


@query("report_r5", with_samples(_PMI + ", p AS (SELECT feature, cwe, joint, n_feature, CASE WHEN joint = 0 THEN 0.0::DOUBLE ELSE round(log2(joint::DOUBLE * total / (n_feature * n_cwe)), 6) END AS pmi FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY pmi DESC, cwe) AS r FROM p) SELECT feature, n_feature::BIGINT AS n, cwe AS closest_class, joint, pmi FROM b WHERE r = 1".replace(") , p AS", "), p AS")))
def report_r5(spark, sf):
    """Every feature with the class that it goes with most."""
    t = pmi_table(spark, sf)
    b = t.groupBy("feature").agg(F.min_by(F.struct("n_feature", "cwe", "joint", "pmi"), F.struct(-F.col("pmi"), F.col("cwe"))).alias("m"))
    return b.select("feature", F.col("m.n_feature").alias("n"), F.col("m.cwe").alias("closest_class"), "m.joint", "m.pmi")


@query("report_r5_tests", with_samples(_CELLS + ", " + bh_sql("feature") + f", o AS (SELECT feature, a + 0.5::DOUBLE AS a, b + 0.5::DOUBLE AS b, c + 0.5::DOUBLE AS c, d + 0.5::DOUBLE AS d FROM k), o2 AS (SELECT feature, {_ODDS} FROM o) SELECT feature, a, b, c, d, odds_ratio, or_low, or_high, round(p, 7) AS p, round(p_bh, 7) AS p_bh, p_bh < 0.05 AS significant_bh FROM k JOIN o2 USING (feature) JOIN pv USING (feature) JOIN r USING (feature)"))
def report_r5_tests(spark, sf):
    """Exact tests of the features against the label, Benjamini-Hochberg adjusted."""
    return _rounded(S.benjamini_hochberg(feature_tests(spark, sf), "p", "feature"), "p", "p_bh")


@query("report_r6", with_samples(f", c AS ({_CODE}), f AS (SELECT cwe, {ANTI_SQL} FROM c WHERE label = 1), u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS pattern, cwe, count_if({n}) AS n, count(*) AS total FROM f GROUP BY cwe" for n in ANTI) + "), r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, cwe) AS k, sum(n) OVER (PARTITION BY pattern) AS all_, sum(total) OVER (PARTITION BY pattern) AS t FROM u) SELECT pattern, all_::BIGINT AS n, round(all_ * 100.0 / t, 4)::DOUBLE AS prevalence, cwe AS dominant_class, n AS dominant_n FROM r WHERE k = 1"))
def report_r6(spark, sf):
    """Anti-patterns of the vulnerable samples with the class they occur in most."""
    x = flagged(spark, sf).where(positive()).unpivot(["cwe"], ANTI, "pattern", "has").groupBy("pattern", "cwe").agg(F.count_if("has").alias("n"), F.count("*").alias("total"))
    y = x.groupBy("pattern").agg(F.sum("n").alias("all_"), F.sum("total").alias("t"), F.min_by(F.struct("cwe", "n"), F.struct(-F.col("n"), F.col("cwe"))).alias("m"))
    return y.select("pattern", F.col("all_").alias("n"), F.round(F.col("all_") * 100.0 / F.col("t"), 4).alias("prevalence"), F.col("m.cwe").alias("dominant_class"), F.col("m.n").alias("dominant_n"))


_SEV = ", s AS (SELECT *, severity IN ('HIGH', 'CRITICAL') AS high FROM samples WHERE label = 1)"


@query("report_r7", with_samples(_SEV + f", g AS (SELECT cwe, count_if(high) AS h, count_if(NOT high) AS l FROM s GROUP BY cwe), x AS (SELECT cwe, h AS n_high, h + l AS total, h + 0.5::DOUBLE AS a, l + 0.5::DOUBLE AS b, sum(h) OVER () - h + 0.5::DOUBLE AS c, sum(l) OVER () - l + 0.5::DOUBLE AS d FROM g) SELECT cwe, n_high, total, {_ODDS} FROM x"))
def report_r7(spark, sf):
    """High and critical severity per class with the odds ratio against the other classes."""
    x = samples(spark, sf).where(positive())
    t = S.two_by_two(x, "cwe", F.col("severity").isin(*HIGH))
    return t.withColumns(S.odds_ratio(*(F.col(c) for c in "abcd"))).select("cwe", F.col("a").alias("n_high"), (F.col("a") + F.col("b")).alias("total"), "odds_ratio", "or_low", "or_high")


@query("report_r7_levels", with_samples("SELECT severity, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM samples WHERE label = 1 GROUP BY severity"))
def report_r7_levels(spark, sf):
    return S.shares(samples(spark, sf).where(positive()), "severity")


@query("report_r7_tests", with_samples(_SEV + ", g AS (SELECT cwe, count_if(high) AS a, count_if(NOT high) AS b FROM s GROUP BY cwe), " + _AGAINST.format("cwe") + "," + exact_sql("cwe") + ", " + bh_sql("cwe") + " SELECT cwe, a, b, c, d, round(p, 7) AS p, round(p_bh, 7) AS p_bh, p_bh < 0.05 AS significant_bh FROM k JOIN pv USING (cwe) JOIN r USING (cwe)"))
def report_r7_tests(spark, sf):
    t = S.two_by_two(samples(spark, sf).where(positive()), "cwe", F.col("severity").isin(*HIGH))
    return _rounded(S.benjamini_hochberg(_exact(t, "cwe"), "p", "cwe"), "p", "p_bh")


@query("report_r8", with_samples(f", g AS (SELECT repo, count(*) AS total, count_if(label = 1) AS positive, count(DISTINCT cwe) AS classes FROM samples WHERE label IS NOT NULL GROUP BY repo) SELECT repo, total, positive, classes, round(positive / total, 6) AS density, {_WILSON} FROM g"))
def report_r8(spark, sf):
    """Size, density with its interval, and number of classes per repository."""
    g = labelled(spark, sf).groupBy("repo").agg(F.count("*").alias("total"), F.count_if(positive()).alias("positive"), F.count_distinct("cwe").alias("classes"))
    return g.withColumn("density", F.round(F.col("positive") / F.col("total"), 6)).withColumns(S.wilson(F.col("positive"), F.col("total")))


@query("report_r8_concentration", with_samples(", n AS (SELECT repo, count(*) AS n FROM samples GROUP BY repo), p AS (SELECT *, row_number() OVER (ORDER BY n) AS i, row_number() OVER (ORDER BY n DESC, repo) AS k FROM n) SELECT count(*) AS repos, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini, round(sum(CASE WHEN k <= 10 THEN n ELSE 0 END) * 100.0 / sum(n), 4)::DOUBLE AS top10_share FROM p"))
def report_r8_concentration(spark, sf):
    n = samples(spark, sf).groupBy("repo").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "repo").limit(10).agg(F.sum("n").alias("top"))  # the share of the ten largest
    all_ = n.agg(F.sum("n").alias("t"))
    share = top.join(all_).select(F.round(F.col("top") * 100.0 / F.col("t"), 4).alias("top10_share"))
    return S.diversity(n, "n").select(F.col("classes").alias("repos"), "gini").join(share)


@query("report_r8_tests", with_samples(_L + ", g AS (SELECT repo, count(*) AS total, avg((label = 1)::INT::DOUBLE) AS density FROM l GROUP BY repo)" + f" SELECT *, round({rho_p_sql('rho', 'n')}, 7) AS p FROM (" + _spearman_sql("total", "density", "g") + ")"))
def report_r8_tests(spark, sf):
    """Rank correlation of a repository's size and density."""
    g = labelled(spark, sf).groupBy("repo").agg(F.count("*").alias("total"), F.avg(positive().cast("double")).alias("density"))
    return _rounded(S.spearman(g, "total", "density"), "p")


@query("report_r9", with_samples(_L + f", f AS (SELECT *, {_FAMILY} AS family FROM l), n AS (SELECT cwe, component, family, count(*) AS n, count_if(label = 1) AS positive FROM f GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY cwe) AS a, sum(n) OVER (PARTITION BY component) AS b, sum(n) OVER (PARTITION BY family) AS c, sum(n) OVER () AS t FROM n) SELECT cwe, component, family, n, positive, round(n::DOUBLE * t * t / (a::DOUBLE * b * c), 6) AS lift FROM w"))
def report_r9(spark, sf):
    """Combinations of class, component and language with their lift over independence."""
    n = by_family(spark, sf).groupBy("cwe", "component", "family").agg(F.count("*").alias("n"), F.count_if(positive()).alias("positive"))
    s = lambda *k: F.sum("n").over(W.partitionBy(*k))
    lift = F.col("n").cast("double") * s() * s() / (s("cwe").cast("double") * s("component") * s("family"))
    return n.withColumn("lift", F.round(lift, 6))


@query("report_r9_clusters")
def report_r9_clusters(spark, sf):
    """Components in three clusters by their class profile (k-means, our choice of method)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    c = samples(spark, sf).where(positive()).groupBy("component", "cwe").agg(F.count("*").alias("n"))
    top = [r.cwe for r in c.groupBy("cwe").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cwe").limit(8).collect()]
    x = c.groupBy("component").pivot("cwe", top).agg(F.sum("n")).na.fill(0)
    total = sum((F.col(f"`{t}`") for t in top), F.lit(0))
    x = x.select("component", *((F.col(f"`{t}`") / F.greatest(total, F.lit(1))).alias(t) for t in top))
    v = VectorAssembler(inputCols=top, outputCol="features").transform(x)
    return KMeans(k=min(3, max(2, v.count())), seed=42).fit(v).transform(v).select("component", F.col("prediction").alias("cluster"))


@query("report_r10")
def report_r10(spark, sf):
    """Mean and deviation of the AUC over folds for the nested feature sets."""
    x = model_input(spark, sf)
    out = None
    for name, cols in (("complexity", _COMPLEX), ("complexity+api", [*_COMPLEX, *_API])):
        r = M.cross_validated_auc(x, cols, "label", "sample_id").agg(F.lit(name).alias("model"), F.lit(len(cols)).alias("features"), F.round(F.avg("auc"), 6).alias("auc"), F.round(F.coalesce(F.stddev_samp("auc"), F.lit(0.0)), 6).alias("deviation"))
        out = r if out is None else out.unionByName(r)
    return out
