"""Queries on building a corpus: projections, filters, explodes, deduplication, splits, code features."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import code as C
from corpuslens.functions import text as T
from corpuslens.operators import corpus, diff
from corpuslens.operators.running import places
from corpuslens.plans.catalogue import query
from corpuslens.plans.tables import FEATURES_SQL, samples, table, with_samples
from corpuslens.storage import spread

#: Comments and white space out, in lower case, in SQL.
_NORMAL = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(code, '//[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '#[^\n]*', '', 'g'), '\s+', '', 'g'))"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LINES = "string_split({0}, chr(10))"
_FILLED = r"list_filter(string_split({0}, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g') <> '')"
_MEANING = r"list_filter(list_transform(string_split({0}, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '' AND NOT starts_with(l, '//') AND NOT starts_with(l, '#') AND NOT starts_with(l, '*'))"
_BUCKET = "('0x' || left(md5({0}), 8))::UBIGINT % 100"


@query("label_partition_counts", with_samples("SELECT label, count(*) AS n, count(code) AS with_code, count(fixed_code) AS with_fix FROM samples GROUP BY label"))
def label_partition_counts(spark, sf):
    return samples(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.count("code").alias("with_code"), F.count("fixed_code").alias("with_fix"))


@query("dataset_summary", with_samples("SELECT count(*) AS total, count_if(label = 1) AS vulnerable, count_if(label = 0) AS clean, round(count_if(label = 1) / count(*), 6) AS ratio, count(DISTINCT repo) AS repos, count(DISTINCT cwe) AS classes, count(DISTINCT language) AS languages FROM samples"))
def dataset_summary(spark, sf):
    is_ = lambda v: F.count_if(F.col("label") == v)
    return samples(spark, sf).agg(F.count("*").alias("total"), is_(1).alias("vulnerable"), is_(0).alias("clean"), F.round(is_(1) / F.count("*"), 6).alias("ratio"), F.count_distinct("repo").alias("repos"), F.count_distinct("cwe").alias("classes"), F.count_distinct("language").alias("languages"))


@query("component_lookup_left_join", with_samples(", dim(component, layer) AS (VALUES ('core_middleware', 'platform'), ('application', 'behaviour'), ('perception', 'behaviour'), ('simulation', 'tooling')) SELECT coalesce(layer, 'other') AS layer, CASE WHEN contains(lower(repo), 'ros2') THEN 'ROS2' WHEN starts_with(repo, 'ros/') THEN 'ROS1' WHEN starts_with(repo, 'gazebosim/') THEN 'ROS2' WHEN repo = 'osrf/gazebo' THEN 'ROS1' ELSE 'other' END AS generation, count(*) AS n FROM samples LEFT JOIN dim USING (component) GROUP BY ALL"))
def component_lookup_left_join(spark, sf):
    dim = spark.createDataFrame([("core_middleware", "platform"), ("application", "behaviour"), ("perception", "behaviour"), ("simulation", "tooling")], "component string, layer string")
    x = samples(spark, sf).join(F.broadcast(dim), "component", "left")  # a dimension of four rows
    return x.groupBy(F.coalesce("layer", F.lit("other")).alias("layer"), C.version_of_repo(F.col("repo")).alias("generation")).agg(F.count("*").alias("n"))


@query("derived_columns", with_samples("SELECT sample_id, cwe, language, component, version, severity, repo, contains(version, '2') AS is_v2 FROM samples"))
def derived_columns(spark, sf):
    return samples(spark, sf).select("sample_id", "cwe", "language", "component", "version", "severity", "repo", F.col("version").contains("2").alias("is_v2"))


@query("alias_coalesce", "SELECT doc_id, coalesce(nullif(cwe_id, ''), nullif(doc_kind, ''), nullif(source, ''), 'none') AS name, 'sample_' || lpad(doc_id::VARCHAR, 8, '0') AS id FROM documents")
def alias_coalesce(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.coalesce(T.first_filled(F.col("cwe_id"), F.col("doc_kind"), F.col("source")), F.lit("none")).alias("name"), F.concat(F.lit("sample_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"))


def _quality_sql(rule: str) -> str:
    n, m = _FILLED.format("code"), _MEANING.format("code")
    keep = {"q1": f"len({n}) >= 3 AND length(code) >= 50", "q2": f"len({n}) BETWEEN 8 AND 80", "q3": f"len({m}) >= 3 AND length(code) >= 50"}[rule]
    return with_samples(f"SELECT label, count(*) AS total, count_if(coalesce({keep}, false)) AS kept, count_if(NOT coalesce({keep}, false)) AS removed FROM samples GROUP BY label")


def _quality(rule: str):
    def run(spark, sf):
        return corpus.filter_report(samples(spark, sf), corpus.quality(F.col("code"))[rule], "label")

    query(f"quality_filter_{rule}", _quality_sql(rule))(run)


for _rule in ("q1", "q2", "q3"):
    _quality(_rule)


@query("dedup_md5_first", with_samples(f"SELECT md5({_STRIP.format('code')}) AS h, min(sample_id) AS kept, count(*) AS copies FROM samples WHERE code IS NOT NULL GROUP BY h"))
def dedup_md5_first(spark, sf):
    x = samples(spark, sf).where("code is not null").withColumn("h", F.md5(T.strip(F.col("code"))))
    return x.groupBy("h").agg(F.min("sample_id").alias("kept"), F.count("*").alias("copies"))


@query("dedup_prefix_first", with_samples("SELECT sample_id, repo, h FROM (SELECT sample_id, repo, md5(repo || ':' || left(code, 200)) AS h, row_number() OVER (PARTITION BY md5(repo || ':' || left(code, 200)) ORDER BY sample_id) AS rn FROM samples WHERE code IS NOT NULL) WHERE rn = 1"))
def dedup_prefix_first(spark, sf):
    """The rule keys on the first 200 characters; the texts are not cut."""
    x = samples(spark, sf).where("code is not null").select("sample_id", "repo", F.md5(F.concat("repo", F.lit(":"), F.left("code", F.lit(200)))).alias("h"))
    return corpus.first_by(x, ["h"], ["sample_id"]).select("sample_id", "repo", "h")


@query("leakage_key", with_samples(f"SELECT sample_id, sha256({_NORMAL}) AS k FROM samples WHERE code IS NOT NULL"))
def leakage_key(spark, sf):
    return samples(spark, sf).where("code is not null").select("sample_id", F.sha2(T.normalised_code(F.col("code")), 256).alias("k"))


_LEAK = f", k AS (SELECT sample_id, origin, repo, sha256({_NORMAL}) AS k FROM samples WHERE code IS NOT NULL), te AS (SELECT * FROM k WHERE origin = 'test_v2'), tr AS (SELECT * FROM k WHERE origin = 'train_v2') "


def _sides(spark, sf):
    x = samples(spark, sf).where("code is not null").select("sample_id", "origin", "repo", F.sha2(T.normalised_code(F.col("code")), 256).alias("k"))
    return x.where("origin = 'test_v2'"), x.where("origin = 'train_v2'")


@query("leak_semi", with_samples(_LEAK + "SELECT DISTINCT k FROM te WHERE k IN (SELECT k FROM tr)"))
def leak_semi(spark, sf):
    return corpus.leakage(*_sides(spark, sf), "k")


@query("leak_anti", with_samples(_LEAK + "SELECT sample_id FROM te WHERE k NOT IN (SELECT k FROM tr)"))
def leak_anti(spark, sf):
    return corpus.without(*_sides(spark, sf), "k").select("sample_id")


@query("leak_repos_intersect", with_samples(_LEAK + "SELECT repo FROM te INTERSECT SELECT repo FROM tr"))
def leak_repos_intersect(spark, sf):
    a, b = _sides(spark, sf)
    return a.select("repo").intersect(b.select("repo"))


@query("hash_group_split", with_samples(f"SELECT repo, CASE WHEN {_BUCKET.format('repo')} < 60 THEN 'train' ELSE 'test' END AS part, count(*) AS n, count_if(label = 1) AS positive FROM samples GROUP BY ALL"))
def hash_group_split(spark, sf):
    return corpus.hash_split(samples(spark, sf), "repo").groupBy("repo", "part").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positive"))


@query("greedy_group_split", with_samples(", g AS (SELECT repo, count(*) AS n FROM samples GROUP BY repo), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n, repo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, sum(n) OVER () AS total, row_number() OVER (ORDER BY n, repo) AS i FROM g), f AS (SELECT DISTINCT min(i) AS i FROM o JOIN (SELECT DISTINCT repo, cwe FROM samples) USING (repo) GROUP BY cwe) SELECT repo, n, CASE WHEN ahead < 0.6::DOUBLE * total OR i IN (SELECT i FROM f) THEN 'train' ELSE 'test' END AS part FROM o"))
def greedy_group_split(spark, sf):
    return corpus.greedy_split(samples(spark, sf), "repo", "cwe")


@query("sample_cap_per_class", with_samples("SELECT sample_id, cwe FROM (SELECT sample_id, cwe, row_number() OVER (PARTITION BY cwe ORDER BY md5('42' || sample_id), sample_id) AS rn FROM samples) WHERE rn <= 15"))
def sample_cap_per_class(spark, sf):
    return corpus.sample_per_class(samples(spark, sf), "cwe", "sample_id", 15).select("sample_id", "cwe")


@query("shuffled_sample", with_samples("SELECT sample_id FROM samples ORDER BY md5('42' || sample_id), sample_id LIMIT 50"))
def shuffled_sample(spark, sf):
    return samples(spark, sf).orderBy(F.md5(F.concat(F.lit("42"), "sample_id")), "sample_id").limit(50).select("sample_id")


# ---- code features ------------------------------------------------------------------------------

_CODE = "SELECT sample_id, coalesce(code, '') AS code, label, cwe, repo, language, component, severity FROM samples"
_COUNT = "len(regexp_extract_all(code, '{0}'))"


def coded(spark, sf):
    return samples(spark, sf).withColumn("code", F.coalesce("code", F.lit("")))


def measured(spark, sf):
    return coded(spark, sf).select("sample_id", "label", "cwe", "repo", "language", "component", "severity", *(e.alias(n) for n, e in C.metrics(F.col("code")).items()))


METRICS_SQL = rf"""len({_LINES.format('code')}) AS loc, len(list_filter(list_transform({_LINES.format('code')}, lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '' AND NOT starts_with(l, '#') AND NOT starts_with(l, '//'))) AS sloc,
{_COUNT.format(C.CALL)} AS num_calls, {_COUNT.format(C.CONDITION)} AS num_conditions, {_COUNT.format(C.CONDITION)} + 1 AS cyclomatic, {_COUNT.format(C.POINTER)} AS num_pointers,
regexp_matches(code, '{C.ALLOCATION}') AS has_allocation, regexp_matches(code, '{C.THREADING}') AS has_threading"""

_NESTING = """list_reduce(list_prepend({'now': 0, 'most': 0}, list_transform(list_filter(string_split(code, ''), lambda b: b IN ('{', '}')), lambda b: {'now': CASE b WHEN '{' THEN 1 ELSE -1 END, 'most': 0})),
lambda a, b: {'now': greatest(a.now + b.now, 0), 'most': greatest(a.most, a.now + b.now)}).most AS max_nesting"""


@query("code_metrics", with_samples(f", c AS ({_CODE}) SELECT sample_id, {METRICS_SQL}, {_NESTING} FROM c"))
def code_metrics(spark, sf):
    return measured(spark, sf).select("sample_id", *C.metrics(F.col("code")))


@query("feature_flags", with_samples(f", c AS ({_CODE}) SELECT sample_id, {FEATURES_SQL} FROM c"))
def feature_flags(spark, sf):
    return coded(spark, sf).select("sample_id", *(e.alias(n) for n, e in C.features(F.col("code")).items()))


_PREV = f", c AS ({_CODE}), f AS (SELECT label, {FEATURES_SQL} FROM c WHERE label IS NOT NULL), u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, label, {n} AS has FROM f" for n in C.FEATURES) + ") "


def long_features(spark, sf, *keep: str):
    """(feature, has, keep...) of every sample and feature: one scan, unpivoted."""
    x = coded(spark, sf).select(*keep, *(e.alias(n) for n, e in C.features(F.col("code")).items()))
    return x.unpivot(list(keep), list(C.FEATURES), "feature", "has")


@query("feature_prevalence", with_samples(_PREV + "SELECT feature, count_if(has) AS n, count_if(has AND label = 1) AS vulnerable, count_if(has AND label = 0) AS clean, round(count_if(has) * 100.0 / count(*), 4) AS prevalence FROM u GROUP BY feature"))
def feature_prevalence(spark, sf):
    x = long_features(spark, sf, "label").where("label is not null")
    return x.groupBy("feature").agg(F.count_if("has").alias("n"), F.count_if(F.col("has") & (F.col("label") == 1)).alias("vulnerable"), F.count_if(F.col("has") & (F.col("label") == 0)).alias("clean"), F.round(F.count_if("has") * 100.0 / F.count("*"), 4).alias("prevalence"))


@query("feature_pair_theta_join", with_samples(f", c AS ({_CODE}), f AS (SELECT {FEATURES_SQL} FROM c) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count_if({a} AND {b}) AS both_, count_if({a} OR {b}) AS either, round(coalesce(count_if({a} AND {b}) / nullif(count_if({a} OR {b}), 0), 0), 6) AS jaccard FROM f" for i, a in enumerate(C.FEATURES) for b in list(C.FEATURES)[i + 1 :])))
def feature_pair_theta_join(spark, sf):
    """All pairs of features from one aggregate of 2 x 66 counts, not a self-join of rows."""
    f = C.features(F.col("code"))
    names = list(f)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    x = coded(spark, sf).select(*(e.alias(n) for n, e in f.items()))
    x = x.agg(*(e for a, b in pairs for e in (F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}|1"), F.count_if(F.col(a) | F.col(b)).alias(f"{a}|{b}|2"))))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}|1").alias("both_"), F.col(f"{a}|{b}|2").alias("either")) for a, b in pairs))
    return x.select(F.explode(rows).alias("r")).select("r.*").withColumn("jaccard", F.round(F.coalesce(F.try_divide("both_", "either"), F.lit(0.0)), 6))


_BARE = rf"len(list_filter(list_transform({_LINES.format('code')}, lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: regexp_matches(l, '{C.BARE_CALL}') AND NOT regexp_matches(l, '{C.CONTROL}'))) >= 2 AS unchecked_return"
ANTI_SQL = ", ".join([*(" AND ".join(f"regexp_matches(code, '{p}')" for p in need) + f" AND NOT regexp_matches(code, '{excuse}') AS {n}" for n, (need, excuse) in C.ANTIPATTERNS.items()), _BARE])
ANTI = [*C.ANTIPATTERNS, "unchecked_return"]


def flagged(spark, sf):
    return coded(spark, sf).select("sample_id", "label", "cwe", *(e.alias(n) for n, e in C.antipatterns(F.col("code")).items()))


@query("antipattern_counts", with_samples(f", c AS ({_CODE}), a AS (SELECT sample_id, label, {ANTI_SQL} FROM c) SELECT label, " + " + ".join(f"{n}::INT" for n in ANTI) + " AS patterns, count(*) AS n FROM a GROUP BY ALL"))
def antipattern_counts(spark, sf):
    n = sum((F.col(a).cast("int") for a in ANTI), F.lit(0))
    return flagged(spark, sf).groupBy("label", n.alias("patterns")).agg(F.count("*").alias("n"))


@query("antipattern_flags", with_samples(f", c AS ({_CODE}), a AS (SELECT sample_id, {ANTI_SQL} FROM c) SELECT sample_id, {', '.join(ANTI)}, " + " OR ".join(ANTI) + " AS any_pattern FROM a"))
def antipattern_flags(spark, sf):
    any_ = F.lit(False)
    for a in ANTI:
        any_ = any_ | F.col(a)
    return flagged(spark, sf).select("sample_id", *ANTI, any_.alias("any_pattern"))


TOKENS_SQL = "list_filter(regexp_split_to_array(lower(replace(regexp_replace(array_to_string(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), ' +'), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$'))"


@query("tokens_top_terms", f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 100")
def tokens_top_terms(spark, sf):
    """The hundred most frequent code tokens; counts per document come first, so a frequent term is combined before the shuffle."""
    x = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.code_tokens(F.col("text"))).alias("term"))
    x = x.groupBy("term", "doc_id").agg(F.count("*").alias("c")).groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))
    return x.orderBy(F.desc("n"), "term").limit(100)


@query("numbered_lines", with_samples(", c AS (SELECT sample_id, string_split(code, chr(10)) AS l FROM samples WHERE code IS NOT NULL) SELECT sample_id, array_to_string(list_transform(l, lambda x, i: 'L' || i || ': ' || x), chr(10)) AS text FROM c"))
def numbered_lines(spark, sf):
    return samples(spark, sf).where("code is not null").select("sample_id", T.numbered_lines(F.col("code")).alias("text"))


@query("string_suite", rf"""SELECT doc_id, {_STRIP.format('text')} AS stripped, length({_STRIP.format('text')}) AS n, len({_MEANING.format('text')}) AS meaningful, left(text, 200) AS head,
'Case 1 [' || coalesce(cwe_id, '?') || ', ' || coalesce(source, '?') || ']: ' || left(text, 200) AS case_line, nullif(regexp_extract(text, '(?i)CWE-([0-9]+)', 1), '') AS cwe_number,
concat_ws(chr(10) || chr(10), 'kind: ' || doc_kind, 'source: ' || source) AS facets FROM documents WHERE text IS NOT NULL""")
def string_suite(spark, sf):
    d, t = table(spark, sf, "documents").where("text is not null"), F.col("text")
    return d.select("doc_id", T.strip(t).alias("stripped"), F.length(T.strip(t)).alias("n"), F.size(T.meaningful_lines(t)).alias("meaningful"), F.left(t, F.lit(200)).alias("head"), T.case_line(F.lit(1), F.col("cwe_id"), F.col("source"), t).alias("case_line"), F.nullif(F.regexp_extract(t, "(?i)CWE-([0-9]+)", 1), F.lit("")).alias("cwe_number"), F.concat_ws("\n\n", F.concat(F.lit("kind: "), "doc_kind"), F.concat(F.lit("source: "), "source")).alias("facets"))


_LOW_GUESS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(code), '{w}')" for w in words) + f" THEN '{c}'" for words, c in C.GUESSES) + f" ELSE '{C.GUESS_ELSE}' END"
_SIGNALS = " + ".join(f"contains(code, '{s}')::INT" for s in C.PYTHON_SIGNALS)


@query("label_backfill", with_samples(f"SELECT sample_id, CASE WHEN label = 1 AND cwe = 'unknown' THEN {_LOW_GUESS} ELSE cwe END AS cwe, CASE WHEN label = 1 AND cwe = 'unknown' THEN 'guess' ELSE 'given' END AS cwe_source FROM samples WHERE code IS NOT NULL"))
def label_backfill(spark, sf):
    lacks = (F.col("label") == 1) & (F.col("cwe") == "unknown")
    return samples(spark, sf).where("code is not null").select("sample_id", F.when(lacks, C.guessed_class(F.col("code"))).otherwise(F.col("cwe")).alias("cwe"), F.when(lacks, "guess").otherwise("given").alias("cwe_source"))


_RISK = lambda reg: "list_concat(" + ", ".join(f"CASE WHEN contains(lower(c), '{n}') THEN [c || '>{r}'] ELSE [] END" for n, r in reg.items()) + ")"


@query("risky_calls", with_samples(f", c AS ({_CODE}), k AS (SELECT sample_id, ({_SIGNALS}) >= 2 AS py, regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1) AS calls FROM c) SELECT sample_id, CASE WHEN py THEN 'Python' ELSE 'C++' END AS guess, array_to_string(CASE WHEN py THEN flatten(list_transform(calls, lambda c: {_RISK(C.RISKY_PYTHON)})) ELSE flatten(list_transform(calls, lambda c: {_RISK(C.RISKY_C)})) END, ',') AS risky FROM k"))
def risky_calls(spark, sf):
    guess = C.language_guess(F.col("code"))
    found = F.transform(C.risky_calls(F.col("code"), F.col("guess")), lambda r: F.concat(r["function"], F.lit(">"), r["risk"]))
    return coded(spark, sf).withColumn("guess", guess).select("sample_id", "guess", F.array_join(found, ",").alias("risky"))


@query("structure_summary", with_samples(f", c AS ({_CODE}) SELECT sample_id, len(list_distinct(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1))) AS calls, " + " OR ".join(f"contains(code, '{w}')" for w in C.NULL_CHECKS) + " AS null_check, " + " OR ".join(f"contains(code, '{w}')" for w in C.BOUNDS_CHECKS) + " AS bounds_check, regexp_extract(code, '\\(([^)]{0,200})\\)', 1) AS parameters FROM c"))
def structure_summary(spark, sf):
    x = F.col("code")
    return coded(spark, sf).select("sample_id", F.size(F.array_distinct(F.regexp_extract_all(x, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))).alias("calls"), C.any_of(x, C.NULL_CHECKS).alias("null_check"), C.any_of(x, C.BOUNDS_CHECKS).alias("bounds_check"), F.regexp_extract(x, r"\(([^)]{0,200})\)", 1).alias("parameters"))


@query("commit_filter", with_samples("SELECT sample_id, " + "NOT (" + " OR ".join(f"contains(lower(commit_message), '{w}')" for w in C.NOISE_WORDS) + ") AND (" + " OR ".join(f"contains(lower(commit_message), '{w}')" for w in C.SECURITY_WORDS) + ") AS security, CASE WHEN regexp_matches(file_path, '\\.(c|cpp|cc|cxx|h|hpp)$') THEN 'C++' WHEN regexp_matches(file_path, '\\.py$') THEN 'Python' END AS path_language FROM samples WHERE repo NOT IN ('unknown')"))
def commit_filter(spark, sf):
    return samples(spark, sf).where(~F.col("repo").isin("unknown")).select("sample_id", C.security_message(F.col("commit_message")).alias("security"), C.language_of_path(F.col("file_path")).alias("path_language"))


_URL = "'^[a-z]+://[^/]+/([^/]+)/([^/]+)/commit/([0-9a-f]+)'"


@query("url_parts", f"SELECT DISTINCT cve_id, url, nullif(regexp_extract(url, {_URL}, 1), '') AS owner, nullif(regexp_extract(url, {_URL}, 2), '') AS name, nullif(regexp_extract(url, {_URL}, 3), '') AS sha FROM (SELECT cve_id, unnest(github_commit_urls) AS url FROM cve_records)")
def url_parts(spark, sf):
    x = table(spark, sf, "cve_records").select("cve_id", F.explode("github_commit_urls").alias("url")).distinct()
    return x.select("cve_id", "url", *(e.alias(n) for n, e in C.url_parts(F.col("url")).items()))


_TARGETS = "[" + ", ".join(f"'{c}'" for c in C.TARGET_CLASSES) + "]"


@query("nested_feed_flatten", f"SELECT DISTINCT cve_id, array_to_string(CASE WHEN len(list_filter(all_cwes, lambda c: list_contains({_TARGETS}, c))) > 0 THEN list_filter(all_cwes, lambda c: list_contains({_TARGETS}, c)) ELSE all_cwes[1:1] END, ',') AS classes, len(github_commit_urls) AS urls FROM cve_records WHERE len(github_commit_urls) > 0 AND all_cwes IS NOT NULL")
def nested_feed_flatten(spark, sf):
    """Wanted classes of every advisory with a commit, else the first named."""
    a = F.col("all_cwes")
    wanted = F.filter(a, lambda c: c.isin(*C.TARGET_CLASSES))
    x = table(spark, sf, "cve_records").where((F.size("github_commit_urls") > 0) & a.isNotNull())
    return x.select("cve_id", F.array_join(F.when(F.size(wanted) > 0, wanted).otherwise(F.slice(a, 1, 1)), ",").alias("classes"), F.size("github_commit_urls").alias("urls")).distinct()


# ---- diffs ------------------------------------------------------------------------------------------


def patches(spark, sf):
    """A patch per sample: two hunks whose lines are in turn context, removed and added."""
    mark = lambda c: F.array_join(F.transform(T.lines(c), lambda l, i: F.concat(F.element_at(F.array(F.lit(" "), F.lit("-"), F.lit("+")), (i % 3 + 1).cast("int")), l)), "\n")
    x = samples(spark, sf).where("code is not null")
    second = F.coalesce(F.concat(F.lit("\n@@ -9 +9 @@\n"), mark(F.col("fixed_code"))), F.lit(""))
    return x.select("sample_id", F.concat(F.lit("@@ -1 +1 @@\n"), mark(F.col("code")), second).alias("patch"))


_MARK = "array_to_string(list_transform(string_split({0}, chr(10)), lambda l, i: [' ', '-', '+'][(i - 1) % 3 + 1] || l), chr(10))"
_SIDE = r"regexp_replace(array_to_string(list_transform(list_filter(string_split(h, chr(10)), lambda l: NOT starts_with(l, '@@') AND NOT starts_with(l, '{0}')), lambda l: CASE WHEN starts_with(l, '{1}') OR starts_with(l, ' ') THEN substr(l, 2) ELSE l END), chr(10)), '^\s+|\s+$', '', 'g')"
_PAIRS = f""", p AS (SELECT sample_id, 0 AS hunk_no, '@@ -1 +1 @@' || chr(10) || {_MARK.format('code')} AS h FROM samples WHERE code IS NOT NULL UNION ALL
SELECT sample_id, 1, '@@ -9 +9 @@' || chr(10) || {_MARK.format('fixed_code')} FROM samples WHERE code IS NOT NULL AND fixed_code IS NOT NULL),
s AS (SELECT sample_id, hunk_no, {_SIDE.format('+', '-')} AS before, {_SIDE.format('-', '+')} AS after FROM p),
k AS (SELECT * FROM s WHERE len({_FILLED.format('before')}) BETWEEN 8 AND 80 AND len({_FILLED.format('after')}) BETWEEN 8 AND 80 AND before <> after) """


@query("diff_explode_pairs", with_samples(_PAIRS + "SELECT sample_id, hunk_no, md5(before) AS before_md5, md5(after) AS after_md5 FROM k"))
def diff_explode_pairs(spark, sf):
    x = diff.explode_pairs(patches(spark, sf), "patch")
    return x.select("sample_id", "hunk_no", F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"))


@query("diff_labelled_rows", with_samples(_PAIRS + "SELECT sample_id, hunk_no, 1 AS label, md5(before) AS code_md5 FROM k UNION ALL SELECT sample_id, hunk_no, 0, md5(after) FROM k"))
def diff_labelled_rows(spark, sf):
    return diff.labelled(diff.explode_pairs(patches(spark, sf), "patch")).select("sample_id", "hunk_no", "label", F.md5("code").alias("code_md5"))


_OVERLAP = r"list_distinct(list_transform(list_filter(string_split(coalesce({0}, ''), chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g') <> ''), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')))"


@query("line_similarity", with_samples(f", x AS (SELECT sample_id, {_OVERLAP.format('code')} AS a, {_OVERLAP.format('fixed_code')} AS b FROM samples) SELECT sample_id, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)) END, 6)::DOUBLE AS similarity FROM x"))
def line_similarity(spark, sf):
    return samples(spark, sf).select("sample_id", F.round(T.line_overlap(F.col("code"), F.col("fixed_code")), 6).alias("similarity"))


# ---- sets and resumption -----------------------------------------------------------------------------


@query("union_by_name", "SELECT doc_id, lang, NULL AS source FROM documents UNION ALL SELECT doc_id, NULL, source FROM documents")
def union_by_name(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang").unionByName(d.select("doc_id", "source"), allowMissingColumns=True)


@query("key_union_distinct", "SELECT cve_id FROM test_v2 WHERE cve_id IS NOT NULL UNION SELECT cve_id FROM train_v2 WHERE cve_id IS NOT NULL UNION SELECT cve_id FROM cve_records WHERE cve_id IS NOT NULL")
def key_union_distinct(spark, sf):
    a, b, c = (table(spark, sf, t).select("cve_id").where("cve_id is not null") for t in ("test_v2", "train_v2", "cve_records"))
    return a.union(b).union(c).distinct()


@query("resume_anti_join", "SELECT DISTINCT sample_id FROM test_v2 WHERE sample_id NOT IN (SELECT sample_id FROM predictions WHERE sample_id IS NOT NULL AND error IS NULL)")
def resume_anti_join(spark, sf):
    from corpuslens.sources.files import pending

    done = table(spark, sf, "predictions").where("sample_id is not null and error is null")
    return pending(table(spark, sf, "test_v2").where("sample_id is not null").select("sample_id").distinct(), done, "sample_id")


@query("advisory_join", "SELECT t.sample_id, t.cve_id, c.n_records FROM (SELECT DISTINCT sample_id, cve_id FROM test_v2 WHERE cve_id IS NOT NULL) t JOIN (SELECT cve_id, count(*) AS n_records FROM cve_records GROUP BY cve_id) c USING (cve_id)")
def advisory_join(spark, sf):
    c = table(spark, sf, "cve_records").groupBy("cve_id").agg(F.count("*").alias("n_records"))
    return table(spark, sf, "test_v2").where("cve_id is not null").select("sample_id", "cve_id").distinct().join(c, "cve_id").select("sample_id", "cve_id", "n_records")


@query("most_common_first_seen", with_samples("SELECT cwe, count(*) AS n, min(sample_id) AS first_seen, row_number() OVER (ORDER BY count(*) DESC, min(sample_id)) AS place FROM samples GROUP BY cwe"))
def most_common_first_seen(spark, sf):
    x = samples(spark, sf).groupBy("cwe").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_seen"))
    return places(x, [F.desc("n"), "first_seen"])


_ERR = "CASE event_type WHEN 'error' THEN 'runtime error: shift exponent' WHEN 'click' THEN 'ERROR: AddressSanitizer: heap-use-after-free on address' WHEN 'signup' THEN 'WARNING: ThreadSanitizer: data race (pid=1)' WHEN 'purchase' THEN 'undefined reference to main' ELSE 'done' END"


@query("sanitizer_log_scan", f"WITH l AS (SELECT event_id, {_ERR} AS log FROM events) SELECT event_id, " + ", ".join("(" + " OR ".join(f"contains(log, '{w}')" for w in ws) + f") AS {n}" for n, ws in (("asan", C.ASAN), ("tsan", C.TSAN), ("ubsan", C.UBSAN), ("leak", C.LEAKS))) + ", CASE " + " ".join(f"WHEN contains(log, '{w}') THEN '{w}'" for ws in (C.ASAN, C.TSAN, C.UBSAN, C.LEAKS) for w in ws) + " END AS keyword, " + " OR ".join(f"contains(lower(log), '{w}')" for w in C.RESIDUAL) + " AS still_vulnerable FROM l")
def sanitizer_log_scan(spark, sf):
    t = F.col("event_type")
    log = F.when(t == "error", "runtime error: shift exponent").when(t == "click", "ERROR: AddressSanitizer: heap-use-after-free on address").when(t == "signup", "WARNING: ThreadSanitizer: data race (pid=1)").when(t == "purchase", "undefined reference to main").otherwise("done")
    x = table(spark, sf, "events").select("event_id", log.alias("log"))
    return x.select("event_id", *(e.alias(n) for n, e in C.sanitizer_flags(F.col("log")).items()), C.still_vulnerable(F.col("log")).alias("still_vulnerable"))
