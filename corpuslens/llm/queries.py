"""The queries p1_ to p10_ and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm import reading_level
from corpuslens.llm.cross_split import OverlapConfig, cross_split_overlap, overlap_report
from corpuslens.llm.formatting_duplicates import collapsed, formatting_duplicates
from corpuslens.llm.group_split import group_split, repo_name
from corpuslens.llm.leakage import LeakConfig, leaked_items
from corpuslens.llm.near_duplicates import NearDupConfig, NearDuplicates, near_duplicates
from corpuslens.llm.quota_sample import quota_sample
from corpuslens.llm.syntax_check import check_syntax, damaged, syntax_rates
from corpuslens.llm.term_frequency import marked, term_frequency
from corpuslens.llm.tokenizer import encode_texts
from corpuslens.storage import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CODE = ["vulnerable_code", "fixed_code"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- 1: near-duplicate records -------------------------------------------------------------


def _near(spark, sf_dir) -> NearDuplicates:
    return near_duplicates(table(spark, sf_dir, "test_v2"), "sample_id", CODE, NearDupConfig(words=3, threshold=0.7))


@query
def p1_found(spark, sf_dir):
    """Pairs of records similar on one code field, copies included."""
    return _near(spark, sf_dir).pairs()


@query
def p1_groups(spark, sf_dir):
    """Every record and field with its class of near-duplicates and its number of links."""
    return _near(spark, sf_dir).groups()


# ---- 4: overlap of evaluation splits with the training split ------------------------------


def _overlap(spark, sf_dir):
    held_out, train = table(spark, sf_dir, "test_v2"), table(spark, sf_dir, "train_v2")
    return held_out, cross_split_overlap(held_out, train, "sample_id", CODE, OverlapConfig(words=3, threshold=0.7))


@query
def p4_found(spark, sf_dir):
    """Pairs of a held-out and a training record that share an id or similar code."""
    return _overlap(spark, sf_dir)[1].select("sample_id", "train_id")


@query
def p4_overlaps(spark, sf_dir):
    """Overlapping records per split and source of the held-out table."""
    held_out, pairs = _overlap(spark, sf_dir)
    return overlap_report(pairs, held_out, "sample_id", "split", "source")


# ---- 2: duplicates hidden by formatting ---------------------------------------------------

_WORDS = "regexp_extract_all({0}, '[A-Za-z0-9_]+')"
_BAG = f"""
WITH r AS (SELECT DISTINCT sample_id, list_sort(list_transform({_WORDS.format('vulnerable_code')}, lambda w: lower(w))) AS bag
  FROM test_v2 WHERE sample_id IS NOT NULL AND len({_WORDS.format('vulnerable_code')}) > 0),
s AS (SELECT bag, min(sample_id) AS kept_id, count(*) AS n FROM r GROUP BY bag)"""
SQL["p2_found"] = _BAG + " SELECT kept_id, sample_id AS copy_id FROM r JOIN s USING (bag) WHERE sample_id <> kept_id"
SQL["p2_collapsed"] = _BAG + """, k AS (SELECT sample_id, kept_id, n FROM r JOIN s USING (bag))
SELECT i.sample_id AS kept_id, coalesce(n, 1) AS n_copies FROM (SELECT DISTINCT sample_id FROM test_v2 WHERE sample_id IS NOT NULL) i
LEFT JOIN k USING (sample_id) WHERE kept_id IS NULL OR kept_id = i.sample_id"""


@query
def p2_found(spark, sf_dir):
    """The kept record of every set of equal snippets with each of its copies."""
    sets = formatting_duplicates(table(spark, sf_dir, "test_v2"), "sample_id", "vulnerable_code")
    return sets.where("set_id <> id").select(F.col("set_id").alias("kept_id"), F.col("id").alias("copy_id"))


@query
def p2_collapsed(spark, sf_dir):
    """One record per snippet up to formatting, with its number of copies."""
    return collapsed(table(spark, sf_dir, "test_v2"), "sample_id", "vulnerable_code")


# ---- 3: frequency of values ---------------------------------------------------------------

FIELDS = ["cwe_id", "repo", "language"]
_TERMS = " UNION ALL ".join(f"SELECT '{f}' AS field_name, sample_id, unnest(regexp_split_to_array({f}, '[;,|]')) AS t FROM test_v2 WHERE sample_id IS NOT NULL" for f in FIELDS)
_FREQ = f"""
WITH t AS (SELECT field_name, sample_id, lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS term FROM ({_TERMS})),
f AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT sample_id) AS records FROM t WHERE term <> '' GROUP BY ALL),
m AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records * 20 > (SELECT count(DISTINCT sample_id) FROM test_v2) THEN 'common' END AS mark FROM f)"""
SQL["p3_found"] = _FREQ + " SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL"
SQL["p3_counts"] = _FREQ + " SELECT field_name, term, occurrences, records, mark FROM m"


@query
def p3_found(spark, sf_dir):
    """Terms of cwe_id, repo and language that are too rare or too common."""
    return p3_counts(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


@query
def p3_counts(spark, sf_dir):
    """Every term with its occurrences, its records and its mark."""
    df = table(spark, sf_dir, "test_v2")
    return marked(term_frequency(df, "sample_id", FIELDS), df, "sample_id")


# ---- 7: sample with target shares ----------------------------------------------------------


def _quota(spark, sf_dir):
    records = table(spark, sf_dir, "test_v2")
    size = records.agg(F.count_distinct("sample_id")).first()[0] // 4
    keys = {"cwe_id": F.upper(F.regexp_replace("cwe_id", r"^\s+|\s+$", "")), "label": F.col("label")}
    return quota_sample(records, "sample_id", keys, table(spark, sf_dir, "cwe_targets"), "share_permille", "min_rows", size)


@query
def p7_found(spark, sf_dir):
    """Targets that the sample could not meet."""
    return _quota(spark, sf_dir).report.where("unmet").select("cwe_id", "label")


@query
def p7_report(spark, sf_dir):
    """Every target with the records wanted, available and taken, and the residual imbalance."""
    return _quota(spark, sf_dir).report


@query
def p7_sample(spark, sf_dir):
    """The sample."""
    return _quota(spark, sf_dir).sample


_QUOTA = """
WITH n AS (SELECT count(DISTINCT sample_id) // 4 AS n FROM test_v2),
r AS (SELECT DISTINCT sample_id, upper(regexp_replace(cwe_id, '^\\s+|\\s+$', '', 'g')) AS cwe_id, label FROM test_v2 WHERE sample_id IS NOT NULL),
q AS (SELECT t.cwe_id, t.label, greatest(min_rows, n * share_permille // 1000) AS wanted, count(r.sample_id) AS available
  FROM cwe_targets t CROSS JOIN n LEFT JOIN r ON r.cwe_id = t.cwe_id AND r.label = t.label GROUP BY ALL)"""
SQL["p7_found"] = _QUOTA + " SELECT cwe_id, label FROM q WHERE available < wanted"
SQL["p7_report"] = _QUOTA + " SELECT cwe_id, label, wanted, available, least(wanted, available) AS taken, 0 AS residual, available < wanted AS unmet FROM q"


# ---- 8: token ids ---------------------------------------------------------------------------


@query
def p8_ids(spark, sf_dir):
    """Token ids of every document by byte_bpe_50k, without special tokens."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


# ---- 9: leaked evaluation items ------------------------------------------------------------


def _leaks(spark, sf_dir, rest):
    items, docs = table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents")
    return leaked_items(items, "item_id", "item_text", docs, "doc_id", "text", LeakConfig(words=3, rest=rest))


@query
def p9_found(spark, sf_dir):
    """Items and the documents that hold 12 or more consecutive words of them: fingerprints within the radius, then the words."""
    return _leaks(spark, sf_dir, False).where("exact").select("item_id", "doc_id")


@query
def p9_leaks(spark, sf_dir):
    """Leaks with the number of similar windows, the best similarity and whether one is exact, also beyond the radius of the fingerprints."""
    return _leaks(spark, sf_dir, True)


# ---- 10: reading level ----------------------------------------------------------------------

_LEVELS = reading_level.sql("documents", "doc_id", "text")
SQL["p10_levels"] = _LEVELS
SQL["p10_profile"] = f"SELECT level, count(*) AS documents, CAST(sum(n_words) AS BIGINT) AS words, CAST(sum(n_sentences) AS BIGINT) AS sentences FROM ({_LEVELS}) GROUP BY level"
SQL["p10_ratings"] = f"""
SELECT rated, level, count(*) AS documents FROM (SELECT doc_id, median(level) AS rated FROM doc_levels WHERE level IS NOT NULL GROUP BY doc_id)
JOIN ({_LEVELS}) USING (doc_id) GROUP BY rated, level"""


@query
def p10_levels(spark, sf_dir):
    """Reading level of every document with the counts it is computed from."""
    return reading_level.reading_levels(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def p10_profile(spark, sf_dir):
    """Documents, words and sentences by level."""
    return p10_levels(spark, sf_dir).groupBy("level").agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"), F.sum("n_sentences").alias("sentences"))


@query
def p10_ratings(spark, sf_dir):
    """Documents by the median of their human ratings and their computed level."""
    rated = table(spark, sf_dir, "doc_levels").where("level is not null").groupBy("doc_id").agg(F.median("level").alias("rated"))
    return p10_levels(spark, sf_dir).join(rated, "doc_id").groupBy("rated", "level").agg(F.count("*").alias("documents"))


# ---- 5: splits that keep repositories together ----------------------------------------------


def _groups(spark, sf_dir, records, previous=None):
    keys = {"repo": F.nullif(repo_name(F.col("repo")), F.lit("unknown"))}
    return group_split(records, "sample_id", keys, "label", table(spark, sf_dir, "split_targets"), previous)


def _split(spark, sf_dir):
    records = table(spark, sf_dir, "test_v2")
    return records, _groups(spark, sf_dir, records).records.withColumnRenamed("id", "sample_id")


@query
def p5_splits(spark, sf_dir):
    """Every record with its component and its split."""
    return _split(spark, sf_dir)[1]


@query
def p5_shares(spark, sf_dir):
    """Records and share of all records of every split and label, and the share asked for."""
    records, splits = _split(spark, sf_dir)
    labels = records.where("sample_id is not null").groupBy("sample_id").agg(F.min("label").alias("label"))
    by = labels.join(splits, "sample_id").groupBy("split_name", "label").agg(F.count("*").alias("records"))
    share = F.col("records") * 1000 / F.sum("records").over(W.partitionBy("label"))
    return by.withColumn("permille", F.round(share, 3)).join(F.broadcast(table(spark, sf_dir, "split_targets")), "split_name", "left")


@query
def p5_increment(spark, sf_dir):
    """Every record with its split and status (kept, new or quarantined) when the whole table follows its earlier half, whose component table is stored and read again."""
    records = table(spark, sf_dir, "test_v2")
    at = F.col("fetched_at").cast("timestamp").cast("double")
    half = records.agg(F.percentile_approx(at, 0.5)).first()[0]
    first = records.where(at <= F.lit(half).cast("double"))
    previous = materialise(_groups(spark, sf_dir, first).components, "split-table")
    return _groups(spark, sf_dir, records, previous).records.withColumnRenamed("id", "sample_id")


# ---- 6: files that do not parse ---------------------------------------------------------------


def _checked(spark, sf_dir):
    return check_syntax(table(spark, sf_dir, "test_v2"), "sample_id", "vulnerable_code", "language", repo_name(F.col("repo")))


@query
def p6_found(spark, sf_dir):
    """Records whose code is not valid syntax of its language."""
    return damaged(_checked(spark, sf_dir)).select(F.col("id").alias("sample_id")).where("sample_id is not null").distinct()


@query
def p6_files(spark, sf_dir):
    """Every checked record with its verdict and, if flagged, the failing token and line."""
    return _checked(spark, sf_dir).withColumnRenamed("id", "sample_id")


@query
def p6_rates(spark, sf_dir):
    """Files, damaged files and their rate by repository and language."""
    return syntax_rates(_checked(spark, sf_dir))
