"""Queries on counts, rank statistics, contingency tables, corrections and models."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import code as C
from corpuslens.functions import distributions as D
from corpuslens.operators import corpus
from corpuslens.operators import model as M
from corpuslens.operators import stats as S
from corpuslens.operators.running import places
from corpuslens.plans.catalogue import query
from corpuslens.plans.corpus_queries import _CODE, ANTI, ANTI_SQL, METRICS_SQL, flagged, long_features, measured
from corpuslens.plans.tables import FEATURES_SQL, samples, table, with_samples

Z = S.Z975
def positive():
    return F.col("label") == 1



def labelled(spark, sf):
    return samples(spark, sf).where("label is not null")


_L = ", l AS (SELECT * FROM samples WHERE label IS NOT NULL)"

_WILSON = f"round(greatest((positive / total + {Z * Z}::DOUBLE / (2 * total)) / (1 + {Z * Z}::DOUBLE / total) - {Z}::DOUBLE * sqrt(positive / total * (1 - positive / total) / total + {Z * Z}::DOUBLE / (4 * total * total)) / (1 + {Z * Z}::DOUBLE / total), 0.0::DOUBLE), 6) AS ci_low, round(least((positive / total + {Z * Z}::DOUBLE / (2 * total)) / (1 + {Z * Z}::DOUBLE / total) + {Z}::DOUBLE * sqrt(positive / total * (1 - positive / total) / total + {Z * Z}::DOUBLE / (4 * total * total)) / (1 + {Z * Z}::DOUBLE / total), 1.0::DOUBLE), 6) AS ci_high"
_ODDS = f"round((a * d) / (b * c), 6) AS odds_ratio, round(exp(ln((a * d) / (b * c)) - {Z}::DOUBLE * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS or_low, round(exp(ln((a * d) / (b * c)) + {Z}::DOUBLE * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS or_high"


def density_sql(head: str, source: str, group: str, positive: str) -> str:
    return f"""{head}, g AS (SELECT {group}, count(*) AS total, count_if({positive}) AS positive FROM {source} GROUP BY ALL),
x AS (SELECT *, positive + 0.5::DOUBLE AS a, total - positive + 0.5::DOUBLE AS b, sum(positive) OVER () - positive + 0.5::DOUBLE AS c, sum(total - positive) OVER () - (total - positive) + 0.5::DOUBLE AS d FROM g)
SELECT {group}, total, positive, round(positive / total, 6) AS density, {_WILSON}, {_ODDS} FROM x"""


@query("density_by_component", with_samples(density_sql(_L, "l", "component", "label = 1")))
def density_by_component(spark, sf):
    return S.density(labelled(spark, sf), "component", positive())


@query("class_distribution_share", with_samples("SELECT cwe, n, round(n * 100.0 / sum(n) OVER (), 4)::DOUBLE AS share FROM (SELECT cwe, count(*) AS n FROM samples GROUP BY cwe)"))
def class_distribution_share(spark, sf):
    return S.shares(samples(spark, sf), "cwe")


@query("class_severity_matrix", with_samples(", n AS (SELECT cwe, severity, count(*) AS n FROM samples GROUP BY ALL) SELECT a.cwe, b.severity, coalesce(n, 0) AS n FROM (SELECT DISTINCT cwe FROM n) a CROSS JOIN (SELECT DISTINCT severity FROM n) b LEFT JOIN n USING (cwe, severity)"))
def class_severity_matrix(spark, sf):
    return S.contingency(samples(spark, sf), "cwe", "severity")


@query("rare_group_collapse", with_samples(", c AS (SELECT cwe, count(*) AS k FROM samples GROUP BY cwe) SELECT CASE WHEN k < 10 THEN 'other_minor' ELSE cwe END AS cwe, count(*) AS n FROM samples JOIN c USING (cwe) GROUP BY ALL"))
def rare_group_collapse(spark, sf):
    return corpus.rare_to(samples(spark, sf), "cwe", 10, "other_minor").groupBy("cwe").agg(F.count("*").alias("n"))


@query("dominant_class_per_group", with_samples("SELECT component, cwe, n FROM (SELECT component, cwe, count(*) AS n, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, cwe) AS r FROM samples GROUP BY component, cwe) WHERE r = 1"))
def dominant_class_per_group(spark, sf):
    x = samples(spark, sf).groupBy("component", "cwe").agg(F.count("*").alias("n"))
    return x.groupBy("component").agg(F.min_by(F.struct("cwe", "n"), F.struct(-F.col("n"), F.col("cwe"))).alias("m")).select("component", "m.cwe", "m.n")


@query("top_repos_cumulative", with_samples(", r AS (SELECT repo, count(*) AS n, count_if(label = 1) AS positive FROM samples GROUP BY repo), t AS (SELECT * FROM r ORDER BY n DESC, repo LIMIT 10) SELECT repo, n, positive, round(sum(n) OVER (ORDER BY n DESC, repo ROWS UNBOUNDED PRECEDING) * 100.0 / (SELECT sum(n) FROM r), 4)::DOUBLE AS cumulative FROM t"))
def top_repos_cumulative(spark, sf):
    r = samples(spark, sf).groupBy("repo").agg(F.count("*").alias("n"), F.count_if(positive()).alias("positive"))
    total = r.agg(F.sum("n").alias("t"))
    top = r.orderBy(F.desc("n"), "repo").limit(10)  # the report is on ten repositories
    w = W.orderBy(F.desc("n"), "repo").rowsBetween(W.unboundedPreceding, 0)
    return top.join(F.broadcast(total)).select("repo", "n", "positive", F.round(F.sum("n").over(w) * 100.0 / F.col("t"), 4).alias("cumulative"))


@query("repo_class_profile_grid", with_samples(", r AS (SELECT repo, count(*) AS n FROM samples GROUP BY repo ORDER BY n DESC, repo LIMIT 5), k AS (SELECT DISTINCT cwe FROM samples), c AS (SELECT repo, cwe, count(*) AS n FROM samples GROUP BY ALL) SELECT r.repo, k.cwe, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) * 100.0 / r.n, 4)::DOUBLE AS share FROM r CROSS JOIN k LEFT JOIN c ON c.repo = r.repo AND c.cwe = k.cwe"))
def repo_class_profile_grid(spark, sf):
    c = samples(spark, sf).groupBy("repo", "cwe").agg(F.count("*").alias("n"))
    r = c.groupBy("repo").agg(F.sum("n").alias("all_")).orderBy(F.desc("all_"), "repo").limit(5)  # five repositories by definition
    grid = c.select("cwe").distinct().join(F.broadcast(r), F.lit(True))
    x = grid.join(c, ["repo", "cwe"], "left")
    return x.select("repo", "cwe", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) * 100.0 / F.col("all_"), 4).alias("share"))


@query("grouping_sets_combo", with_samples("SELECT coalesce(component, 'all') AS component, coalesce(language, 'all') AS language, grouping(component) + 2 * grouping(language) AS level, count(*) AS n, count_if(label = 1) AS positive FROM samples GROUP BY CUBE (component, language)"))
def grouping_sets_combo(spark, sf):
    x = samples(spark, sf).cube("component", "language").agg((F.grouping("component").cast("int") + 2 * F.grouping("language").cast("int")).cast("long").alias("level"), F.count("*").alias("n"), F.count_if(positive()).alias("positive"))
    return x.select(F.coalesce("component", F.lit("all")).alias("component"), F.coalesce("language", F.lit("all")).alias("language"), "level", "n", "positive")


_PROFILE = "SELECT cwe, count(*) AS n FROM samples WHERE language IN ({0}) GROUP BY cwe"
_CPP, _PY = "'c++', 'cpp', 'cxx', 'c'", "'python', 'py', 'python3'"


def _profile(spark, sf, names, n):
    return samples(spark, sf).where(F.col("language").isin(*names)).groupBy("cwe").agg(F.count("*").alias(n))


def _profiles(spark, sf):
    return _profile(spark, sf, ("c++", "cpp", "cxx", "c"), "n_c"), _profile(spark, sf, ("python", "py", "python3"), "n_py")


@query("common_classes_inner", with_samples(f"SELECT cwe, a.n AS n_c, b.n AS n_py FROM ({_PROFILE.format(_CPP)}) a JOIN ({_PROFILE.format(_PY)}) b USING (cwe)"))
def common_classes_inner(spark, sf):
    a, b = _profiles(spark, sf)
    return a.join(b, "cwe")


@query("class_profile_full_outer", with_samples(f"SELECT cwe, coalesce(a.n, 0) AS n_c, coalesce(b.n, 0) AS n_py FROM ({_PROFILE.format(_CPP)}) a FULL JOIN ({_PROFILE.format(_PY)}) b USING (cwe)"))
def class_profile_full_outer(spark, sf):
    a, b = _profiles(spark, sf)
    return a.join(b, "cwe", "full").select("cwe", F.coalesce("n_c", F.lit(0)).alias("n_c"), F.coalesce("n_py", F.lit(0)).alias("n_py"))


@query("rank_by_count", with_samples("SELECT repo, n, row_number() OVER (ORDER BY n DESC, repo) AS place FROM (SELECT repo, count(*) AS n FROM samples GROUP BY repo)"))
def rank_by_count(spark, sf):
    x = samples(spark, sf).groupBy("repo").agg(F.count("*").alias("n"))
    return places(x, [F.desc("n"), "repo"])


def _simpson(f: str, upper: str, steps: int = 2000) -> str:
    """SQL of the integral of f, an expression in x, from 0 to upper."""
    x = f"({upper}) * i / {steps}"
    return f"(({upper}) / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)::DOUBLE * ({f.replace('$x', x)}))))"


def normal_p_sql(z: str) -> str:
    """SQL of the two-sided p of a normal statistic."""
    return f"greatest(0.0::DOUBLE, 1 - 2 * 0.3989422804014327::DOUBLE * {_simpson('exp(-($x) * ($x) / 2)', f'least(abs({z}), 12.0::DOUBLE)')})"


def chi2_p_sql(x: str, df: str) -> str:
    """SQL of the upper tail of chi-square, by its density over the square root."""
    density = f"2 * exp(({df} - 1) * ln($x + 1e-300) - ($x) * ($x) / 2 - {df} / 2.0::DOUBLE * ln(2.0::DOUBLE) - lgamma({df} / 2.0::DOUBLE))"
    return f"greatest(0.0::DOUBLE, 1 - {_simpson(density, f'sqrt({x}::DOUBLE)')})"


def rho_p_sql(rho: str, n: str) -> str:
    """SQL of the two-sided p of a rank correlation by the t distribution, at the angle whose tangent is t / sqrt(df)."""
    const = f"exp(lgamma(({n} - 1) / 2.0::DOUBLE) - lgamma(({n} - 2) / 2.0::DOUBLE)) / sqrt(pi())"
    return f"greatest(0.0::DOUBLE, 1 - 2 * {const} * {_simpson(f'pow(cos($x), {n} - 3)', f'atan(abs({rho}) / sqrt(1 - {rho} * {rho}))')})"


METRICS = ["loc", "sloc", "num_calls", "num_conditions", "num_pointers"]
_LONG = f", c AS ({_CODE}), m AS (SELECT sample_id, label, {METRICS_SQL} FROM c WHERE label IS NOT NULL), u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, label, {n} AS value FROM m" for n in METRICS) + ")"


def long_metrics(spark, sf, *keep: str):
    """(metric, value, keep...) of every labelled sample: one scan, unpivoted."""
    return measured(spark, sf).where("label is not null").unpivot(["label", *keep], METRICS, "metric", "value")


@query("descriptive_stats_by_label", with_samples(_LONG + " SELECT metric, label, count(*) AS n, round(avg(value), 6) AS mean, median(value) AS median, round(coalesce(stddev_samp(value), 0), 6) AS std FROM u GROUP BY ALL"))
def descriptive_stats_by_label(spark, sf):
    return S.describe(long_metrics(spark, sf), "value", "metric", "label")


_FREQ = _LONG + """, f AS (SELECT metric, value, count_if(label = 1) AS n1, count_if(label <> 1) AS n0 FROM u GROUP BY ALL),
k AS (SELECT *, coalesce(sum(n1 + n0) OVER (PARTITION BY metric ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n1 + n0 + 1) / 2 AS rank FROM f),
s AS (SELECT metric, sum(n1)::DOUBLE AS n1, sum(n0)::DOUBLE AS n0, sum(n1 * rank) AS r1, sum(((n1 + n0)::HUGEINT * (n1 + n0) * (n1 + n0) - (n1 + n0))::DOUBLE) AS ties FROM k GROUP BY metric),
t AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1))) AS var FROM s)"""


@query("cliffs_delta", with_samples(_FREQ + " SELECT metric, round(2 * (u / (n1 * n0)) - 1, 6) AS delta FROM t"))
def cliffs_delta(spark, sf):
    return S.rank_test(long_metrics(spark, sf), "value", positive(), "metric").select("metric", "delta")


@query("vargha_delaney", with_samples(_FREQ + " SELECT metric, round(u / (n1 * n0), 6) AS a FROM t"))
def vargha_delaney(spark, sf):
    return S.rank_test(long_metrics(spark, sf), "value", positive(), "metric").select("metric", "a")


@query("mann_whitney_u", with_samples(_FREQ + f" SELECT metric, n1::BIGINT AS n1, n0::BIGINT AS n0, u, round(greatest(abs(u - n1 * n0 / 2) - 0.5::DOUBLE, 0.0::DOUBLE) / sqrt(var) * sign(u - n1 * n0 / 2), 6) AS z, round({normal_p_sql('round(greatest(abs(u - n1 * n0 / 2) - 0.5::DOUBLE, 0.0::DOUBLE) / sqrt(var), 6)')}, 7) AS p FROM t"))
def mann_whitney_u(spark, sf):
    return S.rank_test(long_metrics(spark, sf), "value", positive(), "metric").select("metric", "n1", "n0", "u", "z", F.round("p", 7).alias("p"))


@query("cohens_d", with_samples(_LONG + ", d AS (SELECT metric, count_if(label = 1) AS n1, count_if(label <> 1) AS n0, avg(value) FILTER (WHERE label = 1) AS m1, avg(value) FILTER (WHERE label <> 1) AS m0, var_samp(value) FILTER (WHERE label = 1) AS v1, var_samp(value) FILTER (WHERE label <> 1) AS v0 FROM u GROUP BY metric), e AS (SELECT *, coalesce(round((m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0), 6), 0) AS d FROM d) SELECT metric, n1, n0, d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM e"))
def cohens_d(spark, sf):
    return S.cohens_d(long_metrics(spark, sf), "value", positive(), "metric")


@query("effect_labels", with_samples(_FREQ + ", d AS (SELECT metric, round(2 * (u / (n1 * n0)) - 1, 6) AS delta FROM t) SELECT metric, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS effect FROM d"))
def effect_labels(spark, sf):
    return S.rank_test(long_metrics(spark, sf), "value", positive(), "metric").select("metric", "effect")


def _spearman_sql(x: str, y: str, source: str) -> str:
    rank = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2)"
    return f"SELECT count(*) AS n, round(corr({'rx'}, {'ry'}), 6) AS rho FROM (SELECT {rank.format(x)} AS rx, {rank.format(y)} AS ry FROM {source})"


@query("spearman_rho", with_samples(f", c AS ({_CODE}), m AS (SELECT {METRICS_SQL} FROM c) " + f"SELECT *, round({rho_p_sql('rho', 'n')}, 7) AS p FROM (" + _spearman_sql("sloc", "num_calls", "m") + ")"))
def spearman_rho(spark, sf):
    return S.spearman(measured(spark, sf), "sloc", "num_calls").select("n", "rho", F.round("p", 7).alias("p"))


@query("high_corr_pairs", with_samples(f", c AS ({_CODE}), m AS (SELECT {METRICS_SQL} FROM c), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, * FROM ({_spearman_sql(a, b, 'm')})" for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]) + ") SELECT * FROM p WHERE abs(rho) > 0.7"))
def high_corr_pairs(spark, sf):
    """One scan: every row gives one row per pair of metrics, and the counts of value pairs are per pair."""
    pairs = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]]
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("v"), F.col(b).alias("w")) for a, b in pairs))
    x = measured(spark, sf).select(F.explode(cells).alias("c")).select("c.*")
    return S.spearman(x, "v", "w", "a", "b").where(F.abs("rho") > 0.7).select("a", "b", "n", "rho")


_CHI = """, n AS ({0}), g AS (SELECT a.a, b.b, coalesce(n, 0) AS n FROM (SELECT DISTINCT a FROM n) a CROSS JOIN (SELECT DISTINCT b FROM n) b LEFT JOIN n USING (a, b)),
e AS (SELECT *, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM g),
x AS (SELECT sum(n)::BIGINT AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k, sum((n - e) * (n - e) / e) AS plain, sum(pow(greatest(abs(n - e) - 0.5::DOUBLE, 0), 2) / e) AS yates FROM e),
y AS (SELECT *, CASE WHEN r = 2 AND k = 2 THEN yates ELSE plain END AS chi2 FROM x)"""
_AB = "SELECT component AS a, cwe AS b, count(*) AS n FROM (SELECT component, CASE WHEN k < 10 THEN 'other_minor' ELSE cwe END AS cwe FROM samples JOIN (SELECT cwe, count(*) AS k FROM samples GROUP BY cwe) USING (cwe)) GROUP BY ALL"


def component_by_class(spark, sf):
    return S.contingency(corpus.rare_to(samples(spark, sf), "cwe", 10, "other_minor"), "component", "cwe")


@query("chi2_independence", with_samples(_CHI.format(_AB) + f" SELECT n, round(chi2, 6) AS chi2, (r - 1) * (k - 1) AS df, round({chi2_p_sql('round(chi2, 6)', '((r - 1) * (k - 1))')}, 7) AS p FROM y"))
def chi2_independence(spark, sf):
    return S.chi_square(component_by_class(spark, sf), "component", "cwe").select("n", "chi2", "df", F.round("p", 7).alias("p"))


@query("cramers_v", with_samples(_CHI.format(_AB) + " SELECT round(sqrt(greatest(chi2 / n - (k - 1) * (r - 1) / (n - 1), 0) / (least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1)), 6) AS v FROM y"))
def cramers_v(spark, sf):
    return S.chi_square(component_by_class(spark, sf), "component", "cwe").select("v")


@query("chi2_gof", with_samples(", n AS (SELECT cwe, count(*) AS n FROM samples GROUP BY cwe) SELECT *, round(" + chi2_p_sql("chi2", "(k - 1)") + ", 7) AS p FROM (SELECT count(*) AS k, round(sum((n * n)::DOUBLE) * count(*) / sum(n) - sum(n), 6) AS chi2 FROM n)"))
def chi2_gof(spark, sf):
    return S.goodness_of_fit(samples(spark, sf).groupBy("cwe").agg(F.count("*").alias("n")), "n").select("k", "chi2", F.round("p", 7).alias("p"))


@query("entropy_diversity", with_samples(", n AS (SELECT component, cwe, count(*) AS n FROM samples GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY component) AS p, row_number() OVER (PARTITION BY component ORDER BY n) AS i FROM n) SELECT component, count(*) AS classes, round(sum(-p * log2(p)), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN sum(-p * log2(p)) / log2(count(*)) ELSE 1 END, 6)::DOUBLE AS evenness, round(1 - sum(p * p), 6) AS gini_simpson, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM p GROUP BY component"))
def entropy_diversity(spark, sf):
    return S.diversity(samples(spark, sf).groupBy("component", "cwe").agg(F.count("*").alias("n")), "n", "component")


@query("gini_lorenz", with_samples(", n AS (SELECT cwe, count(*) AS n FROM samples GROUP BY cwe) SELECT 0 AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y UNION ALL SELECT row_number() OVER w, round(row_number() OVER w / count(*) OVER (), 6), round(sum(n) OVER w / sum(n) OVER (), 6) FROM n WINDOW w AS (ORDER BY n, cwe ROWS UNBOUNDED PRECEDING)"))
def gini_lorenz(spark, sf):
    return S.lorenz(samples(spark, sf).groupBy("cwe").agg(F.count("*").alias("n")), "n", "cwe")


_PMI = f", c AS ({_CODE}), f AS (SELECT cwe, {FEATURES_SQL} FROM c WHERE label = 1), u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, cwe, {n} AS has FROM f" for n in C.FEATURES) + "), j AS (SELECT feature, cwe, count_if(has) AS joint, count(*) AS n_cwe FROM u GROUP BY ALL), t AS (SELECT *, sum(joint) OVER (PARTITION BY feature) AS n_feature, sum(n_cwe) OVER (PARTITION BY feature) AS total FROM j) "


def pmi_table(spark, sf):
    j = long_features(spark, sf, "label", "cwe").where(positive()).groupBy("feature", "cwe").agg(F.count_if("has").alias("joint"), F.count("*").alias("n_cwe"))
    w = W.partitionBy("feature")
    j = j.withColumns({"n_feature": F.sum("joint").over(w), "total": F.sum("n_cwe").over(w)})
    return j.withColumn("pmi", S.pmi(F.col("joint"), F.col("n_feature"), F.col("n_cwe"), F.col("total")))


@query("pmi_matrix", with_samples(_PMI + "SELECT feature, cwe, joint, CASE WHEN joint = 0 OR n_feature = 0 THEN 0.0::DOUBLE ELSE round(log2(joint::DOUBLE * total / (n_feature * n_cwe)), 6) END AS pmi FROM t"))
def pmi_matrix(spark, sf):
    return pmi_table(spark, sf).select("feature", "cwe", "joint", "pmi")


@query("top_pmi", with_samples(_PMI + ", p AS (SELECT feature, cwe, joint, CASE WHEN joint = 0 OR n_feature = 0 THEN 0.0::DOUBLE ELSE round(log2(joint::DOUBLE * total / (n_feature * n_cwe)), 6) END AS pmi FROM t) SELECT * FROM p ORDER BY pmi DESC, feature, cwe LIMIT 20".replace(") , p AS", "), p AS")))
def top_pmi(spark, sf):
    return pmi_table(spark, sf).select("feature", "cwe", "joint", "pmi").orderBy(F.desc("pmi"), "feature", "cwe").limit(20)


def feature_tests(spark, sf):
    """2x2 cells, odds ratio and exact p of every feature against the label."""
    x = long_features(spark, sf, "label").where("label is not null")
    t = x.groupBy("feature").agg(*(F.count_if(h & p).alias(n) for n, h, p in (("a", F.col("has"), positive()), ("b", F.col("has"), ~positive()), ("c", ~F.col("has"), positive()), ("d", ~F.col("has"), ~positive()))))
    cells = [F.col(c).cast("double") for c in "abcd"]
    return t.withColumns(S.odds_ratio(*(F.col(c) for c in "abcd"))).withColumn("p", F.round(D.column(D.fisher_two_sided)(*cells), 9))



_CELLS = f", c AS ({_CODE}), f AS (SELECT label, {FEATURES_SQL} FROM c WHERE label IS NOT NULL), u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, label, {n} AS has FROM f" for n in C.FEATURES) + """), k AS (SELECT feature, count_if(has AND label = 1) AS a, count_if(has AND label <> 1) AS b, count_if(NOT has AND label = 1) AS c, count_if(NOT has AND label <> 1) AS d FROM u GROUP BY feature),
lf AS (SELECT feature, a, b, c, d, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS i FROM k),
lp AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS p FROM lf),
h AS (SELECT feature, p AS here FROM lp WHERE i = a), pv AS (SELECT feature, least(1.0::DOUBLE, round(sum(exp(p)), 9)) AS p FROM lp JOIN h USING (feature) WHERE p <= here + 1e-7 GROUP BY feature)"""


def exact_sql(key: str) -> str:
    """Table expressions pv (key, p) of exact tests on the cells k (key, a, b, c, d)."""
    return f"""
lf AS (SELECT {key}, a, b, c, d, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS i FROM k),
lp AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS p FROM lf),
h AS (SELECT {key}, p AS here FROM lp WHERE i = a), pv AS (SELECT {key}, least(1.0::DOUBLE, round(sum(exp(p)), 9)) AS p FROM lp JOIN h USING ({key}) WHERE p <= here + 1e-7 GROUP BY {key})"""


def holm_sql(key: str) -> str:
    """Table expression r (key, p_holm) over pv (key, p)."""
    return f"r AS (SELECT {key}, max(q) OVER (ORDER BY i) AS p_holm FROM (SELECT {key}, least(1.0::DOUBLE, p * (count(*) OVER () - row_number() OVER (ORDER BY p, {key}) + 1)) AS q, row_number() OVER (ORDER BY p, {key}) AS i FROM pv))"


def bh_sql(key: str) -> str:
    """Table expression r (key, p_bh) over pv (key, p)."""
    return f"r AS (SELECT {key}, min(q) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p_bh FROM (SELECT {key}, least(1.0::DOUBLE, p * count(*) OVER () / row_number() OVER (ORDER BY p, {key})) AS q, row_number() OVER (ORDER BY p, {key}) AS i FROM pv))"


@query("fisher_exact_p", with_samples(_CELLS + " SELECT feature, round(p, 7) AS p FROM pv"))
def fisher_exact_p(spark, sf):
    return feature_tests(spark, sf).select("feature", F.round("p", 7).alias("p"))


@query("odds_ratio", with_samples(_CELLS + f", o AS (SELECT feature, a + 0.5::DOUBLE AS a, b + 0.5::DOUBLE AS b, c + 0.5::DOUBLE AS c, d + 0.5::DOUBLE AS d FROM k) SELECT feature, {_ODDS} FROM o"))
def odds_ratio(spark, sf):
    return feature_tests(spark, sf).select("feature", "odds_ratio", "or_low", "or_high")


@query("holm_adjust", with_samples(_CELLS + ", r AS (SELECT feature, least(1.0::DOUBLE, p * (count(*) OVER () - row_number() OVER (ORDER BY p, feature) + 1)) AS q, row_number() OVER (ORDER BY p, feature) AS i FROM pv) SELECT feature, round(max(q) OVER (ORDER BY i), 7) AS p_holm FROM r"))
def holm_adjust(spark, sf):
    return S.holm(feature_tests(spark, sf), "p", "feature").select("feature", F.round("p_holm", 7).alias("p_holm"))


@query("bh_adjust", with_samples(_CELLS + ", r AS (SELECT feature, least(1.0::DOUBLE, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature)) AS q, row_number() OVER (ORDER BY p, feature) AS i FROM pv) SELECT feature, round(min(q) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 7) AS p_bh FROM r"))
def bh_adjust(spark, sf):
    return S.benjamini_hochberg(feature_tests(spark, sf), "p", "feature").select("feature", F.round("p_bh", 7).alias("p_bh"))


@query("two_prop_z", with_samples(_CELLS + ", z AS (SELECT *, (a + b) / (a + b + c + d) AS p FROM (SELECT feature, a, c AS c0, b, d, a AS x1, a + c AS n1, b AS x2, b + d AS n2, c FROM k)) SELECT feature, coalesce(round((x1 / n1 - x2 / n2) / nullif(sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 0), 6), 0) AS z FROM z"))
def two_prop_z(spark, sf):
    x = feature_tests(spark, sf)
    return x.select("feature", S.two_proportions(F.col("a"), F.col("a") + F.col("c"), F.col("b"), F.col("b") + F.col("d")).alias("z"))


_LAYERS = [("CWE-476", "resources"), ("CWE-401", "resources"), ("CWE-416", "resources"), ("CWE-362", "concurrency"), ("CWE-119", "input"), ("CWE-190", "input"), ("CWE-78", "input"), ("CWE-134", "input")]


@query("layer_rollup", with_samples(", d(cwe, layer) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _LAYERS) + ") SELECT coalesce(layer, 'unmapped') AS layer, count(*) AS n, count(DISTINCT cwe) AS classes, string_agg(DISTINCT cwe, ',' ORDER BY cwe) AS names FROM samples LEFT JOIN d USING (cwe) GROUP BY ALL"))
def layer_rollup(spark, sf):
    dim = spark.createDataFrame(_LAYERS, "cwe string, layer string")
    c = samples(spark, sf).groupBy("cwe").agg(F.count("*").alias("n")).join(F.broadcast(dim), "cwe", "left")  # eight rows
    return c.groupBy(F.coalesce("layer", F.lit("unmapped")).alias("layer")).agg(F.sum("n").alias("n"), F.count("*").alias("classes"), F.array_join(F.sort_array(F.collect_list("cwe")), ",").alias("names"))


@query("class_pattern_stats", with_samples(", c AS (SELECT cwe, repo, count(*) AS n FROM samples WHERE label = 1 GROUP BY ALL), r AS (SELECT cwe, string_agg(repo || ':' || n, ',' ORDER BY n DESC, repo) AS top_repos FROM (SELECT *, row_number() OVER (PARTITION BY cwe ORDER BY n DESC, repo) AS k FROM c) WHERE k <= 5 GROUP BY cwe) SELECT cwe, count(*) AS n, count(DISTINCT language) AS languages, count(DISTINCT severity) AS severities, top_repos FROM samples JOIN r USING (cwe) WHERE label = 1 GROUP BY ALL"))
def class_pattern_stats(spark, sf):
    x = samples(spark, sf).where(positive())
    r = x.groupBy("cwe", "repo").agg(F.count("*").alias("n"))
    r = r.withColumn("k", F.row_number().over(W.partitionBy("cwe").orderBy(F.desc("n"), "repo"))).where("k <= 5")
    r = r.groupBy("cwe").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.concat("repo", F.lit(":"), F.col("n").cast("string")).alias("t")))), lambda s: s["t"]), ",").alias("top_repos"))
    return x.groupBy("cwe").agg(F.count("*").alias("n"), F.count_distinct("language").alias("languages"), F.count_distinct("severity").alias("severities")).join(r, "cwe")


_MECH = {"callback": "executor", "pub_sub": "topics", "lifecycle": "lifecycle", "parameter": "parameters", "service": "services", "action": "actions", "tf": "transforms", "threading": "executor", "memory_mgmt": "resources", "ros_init": "lifecycle", "error_handling": "errors", "smart_ptr": "resources"}


@query("mechanism_groups", with_samples(f", c AS ({_CODE}), f AS (SELECT {FEATURES_SQL} FROM c), u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, '{_MECH[n]}' AS mechanism, count_if({n}) AS n FROM f" for n in C.FEATURES) + ") SELECT mechanism, string_agg(feature || ':' || n, ',' ORDER BY feature) AS features, sum(n)::BIGINT AS n FROM u GROUP BY mechanism"))
def mechanism_groups(spark, sf):
    dim = spark.createDataFrame(list(_MECH.items()), "feature string, mechanism string")
    n = long_features(spark, sf).groupBy("feature").agg(F.count_if("has").alias("n")).join(F.broadcast(dim), "feature")  # twelve rows
    return n.groupBy("mechanism").agg(F.array_join(F.sort_array(F.collect_list(F.concat("feature", F.lit(":"), F.col("n").cast("string")))), ",").alias("features"), F.sum("n").alias("n"))


@query("antipattern_tests", with_samples(f", c AS ({_CODE}), f AS (SELECT label, {ANTI_SQL} FROM c WHERE label IS NOT NULL), u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS pattern, label, {n} AS has FROM f" for n in ANTI) + f"), o AS (SELECT pattern, count_if(has AND label = 1) + 0.5::DOUBLE AS a, count_if(has AND label <> 1) + 0.5::DOUBLE AS b, count_if(NOT has AND label = 1) + 0.5::DOUBLE AS c, count_if(NOT has AND label <> 1) + 0.5::DOUBLE AS d FROM u GROUP BY pattern) SELECT pattern, {_ODDS} FROM o"))
def antipattern_tests(spark, sf):
    x = flagged(spark, sf).where("label is not null").unpivot(["label"], ANTI, "pattern", "has")
    t = x.groupBy("pattern").agg(*(F.count_if(h & p).alias(n) for n, h, p in (("a", F.col("has"), positive()), ("b", F.col("has"), ~positive()), ("c", ~F.col("has"), positive()), ("d", ~F.col("has"), ~positive()))))
    return t.select("pattern", *(e.alias(n) for n, e in S.odds_ratio(*(F.col(c) for c in "abcd")).items()))


# ---- resampling and models, checked by tests --------------------------------------------------------


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    counts = labelled(spark, sf).groupBy("component").agg(F.count_if(positive()).alias("positive"), F.count("*").alias("total"))
    return S.bootstrap_proportions(counts, "component", "positive", "total")


@query("bootstrap_mean_ci")
def bootstrap_mean_ci(spark, sf):
    return S.bootstrap_means(long_metrics(spark, sf), "value", "metric")


@query("bootstrap_delta_ci")
def bootstrap_delta_ci(spark, sf):
    return S.bootstrap_delta(long_metrics(spark, sf), "value", positive(), "metric")


@query("onehot_scaled", f"WITH d AS (SELECT doc_id, doc_kind, coalesce(n_chars, 0)::DOUBLE AS n_chars FROM documents), k AS (SELECT doc_kind, row_number() OVER (ORDER BY doc_kind) AS i FROM (SELECT DISTINCT doc_kind FROM documents WHERE doc_kind IS NOT NULL)) SELECT doc_id, round((n_chars - (SELECT avg(n_chars) FROM d)) / (SELECT stddev_pop(n_chars) FROM d), 6) AS n_chars, k.doc_kind AS level, (d.doc_kind IS NOT NULL AND d.doc_kind = k.doc_kind)::INT::DOUBLE AS indicator FROM d CROSS JOIN k WHERE k.i > 1")
def onehot_scaled(spark, sf):
    """Scaled lengths and the indicators of every level but the first, one row per document and level."""
    d = table(spark, sf, "documents").select("doc_id", "doc_kind", F.coalesce("n_chars", F.lit(0)).cast("double").alias("n_chars"))
    x, names = M.one_hot(M.standard_scale(d, ["n_chars"]), "doc_kind")
    cells = F.array(*(F.struct(F.lit(n.removeprefix("doc_kind=")).alias("level"), F.col(f"`{n}`").alias("indicator")) for n in names)).cast("array<struct<level: string, indicator: double>>")
    return x.select("doc_id", F.round("n_chars", 6).alias("n_chars"), F.explode(cells).alias("c")).select("doc_id", "n_chars", "c.level", "c.indicator")


@query("fold_assignment", with_samples("SELECT sample_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(sample_id), sample_id) - 1) % 5)::INT AS fold FROM samples WHERE label IS NOT NULL"))
def fold_assignment(spark, sf):
    return M.folds(labelled(spark, sf), "sample_id", "label").select("sample_id", "label", "fold")


def model_input(spark, sf):
    """Labelled samples with scaled metrics and 0/1 features; written once, as models read it many times."""
    from corpuslens.storage import materialise

    base = measured(spark, sf).where("label is not null").select("sample_id", "label", *(F.col(m).cast("double").alias(m) for m in METRICS), "max_nesting")
    flags = samples(spark, sf).select("sample_id", *(F.coalesce(e.cast("double"), F.lit(0.0)).alias(n) for n, e in C.features(F.coalesce("code", F.lit(""))).items()))
    x = base.withColumn("max_nesting", F.col("max_nesting").cast("double")).join(flags, "sample_id")
    return materialise(M.standard_scale(x, [*METRICS, "max_nesting"]), "model-input")


_COMPLEX = ["loc", "num_calls", "num_conditions", "num_pointers", "max_nesting"]
_API = ["threading", "memory_mgmt", "error_handling"]


@query("lr_wald")
def lr_wald(spark, sf):
    return M.wald(model_input(spark, sf), _COMPLEX, "label")


@query("lr_nested_test")
def lr_nested_test(spark, sf):
    return M.nested_tests(model_input(spark, sf), {"complexity": _COMPLEX, "api": _API}, "label")


@query("logistic_auc")
def logistic_auc(spark, sf):
    return M.cross_validated_auc(model_input(spark, sf), [*_COMPLEX, *_API], "label", "sample_id")


@query("rf_ranked_importance")
def rf_ranked_importance(spark, sf):
    return M.forest_importance(model_input(spark, sf), [*_COMPLEX, *_API], "label")
