"""Test tables and the derived views that queries and SQL share.

Every view has one definition in DataFrame form and the same one as a SQL
common table expression, so that a query and its SQL read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import code as C
from corpuslens.operators import corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct records of both code tables with the defaults of absent values."""
    cols = ["sample_id", "repo", "ros_component", "ros_version", "language", "label", "cwe_id", "vulnerable_code", "fixed_code", "source", "severity", "split", "fetched_at", "commit_message", "file_path", "cve_id"]
    both = table(spark, sf_dir, "test_v2").select(*cols, F.lit("test_v2").alias("origin")).unionByName(table(spark, sf_dir, "train_v2").select(*cols, F.lit("train_v2").alias("origin")))
    return corpus.first_by(both, ["sample_id"], ["fetched_at", "origin"]).transform(corpus.with_defaults)


SAMPLES = """
both_tables AS (SELECT *, 'test_v2' AS origin FROM test_v2 UNION ALL BY NAME SELECT *, 'train_v2' AS origin FROM train_v2),
samples AS (SELECT sample_id, label, vulnerable_code AS code, fixed_code, source, split, fetched_at, commit_message, file_path, cve_id, origin,
  coalesce(nullif(upper(trim(cwe_id)), ''), 'unknown') AS cwe, coalesce(nullif(lower(trim(language)), ''), 'unknown') AS language,
  coalesce(nullif(ros_component, ''), 'other') AS component, coalesce(nullif(ros_version, ''), 'other') AS version,
  coalesce(nullif(severity, ''), 'MEDIUM') AS severity, coalesce(nullif(lower(trim(repo)), ''), 'unknown') AS repo
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY fetched_at, origin) AS rn FROM both_tables) WHERE rn = 1)"""


def with_samples(body: str) -> str:
    """SQL over the view `samples`; a body may begin with further table expressions and a comma between."""
    return f"WITH {SAMPLES}{body if body.lstrip().startswith(',') else chr(10) + body}"


FEATURES_SQL = ", ".join(f"regexp_matches(code, '{p}') AS {n}" for n, p in C.FEATURES.items())


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One opinion per record and run configuration, the latest run; failed runs have none."""
    p = table(spark, sf_dir, "predictions").where("predicted_vuln is not null and sample_id is not null and run_config is not null")
    p = p.groupBy("sample_id", "run_config").agg(F.max_by(F.struct("predicted_vuln", "confidence", "predicted_cwe", "true_label", "true_cwe", "raw_predicted_vuln", "verification_status", "elapsed"), F.struct("run_at", "elapsed", "confidence", "predicted_cwe")).alias("p"))
    return p.select("sample_id", F.col("run_config").alias("persona"), F.col("p.predicted_vuln").alias("has_vuln"), "p.confidence", F.nullif(F.trim(F.split("p.predicted_cwe", ":")[0]), F.lit("")).alias("cwe"), F.concat(F.lit("by "), "run_config").alias("reason"), "p.true_label", "p.true_cwe", "p.raw_predicted_vuln", "p.verification_status", "p.elapsed")


OPINIONS = """
opinions AS (SELECT sample_id, run_config AS persona, predicted_vuln AS has_vuln, confidence, nullif(trim(split_part(predicted_cwe, ':', 1)), '') AS cwe, 'by ' || run_config AS reason, true_label, true_cwe, raw_predicted_vuln, verification_status, elapsed
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, run_config ORDER BY run_at DESC NULLS LAST, elapsed DESC NULLS LAST, confidence DESC NULLS LAST, predicted_cwe DESC NULLS LAST) AS rn FROM predictions WHERE predicted_vuln IS NOT NULL AND sample_id IS NOT NULL AND run_config IS NOT NULL) WHERE rn = 1)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions as model answers: plain, fenced, wrapped in prose, or broken JSON, by the hash of record and persona."""
    o = opinions(spark, sf_dir)
    kind = (F.conv(F.left(F.md5(F.concat("sample_id", "persona")), F.lit(8)), 16, 10).cast("bigint") % 4).cast("int")
    text = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d))
    body = F.concat(F.lit('{"has_vulnerability": '), text("has_vuln", "false"), F.lit(', "vulnerability_type": "'), text("cwe", ""), F.lit('", "confidence": '), text("confidence", "0.5"), F.lit(', "primary": "'), text("cwe", "none"), F.lit('"}'))
    answer = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("The verdict is: "), body, F.lit(" as asked."))).otherwise(F.concat(F.lit("No object for "), text("cwe", "this"), F.lit(" here {")))
    return o.select("sample_id", "persona", kind.alias("kind"), answer.alias("answer"))


RESPONSES = OPINIONS + """,
shaped AS (SELECT *, ('0x' || left(md5(sample_id || persona), 8))::UBIGINT % 4 AS kind, '{"has_vulnerability": ' || coalesce(has_vuln::VARCHAR, 'false') || ', "vulnerability_type": "' || coalesce(cwe, '') || '", "confidence": ' || coalesce(confidence::VARCHAR, '0.5') || ', "primary": "' || coalesce(cwe, 'none') || '"}' AS body FROM opinions),
responses AS (SELECT *, CASE kind WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'The verdict is: ' || body || ' as asked.' ELSE 'No object for ' || coalesce(cwe, 'this') || ' here {' END AS answer FROM shaped)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and hour as verification attempts in the order of time."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "ts", "event_type", "value")
    n = F.row_number().over(W.partitionBy("user_id", "hour").orderBy("ts", "event_id"))
    is_ = lambda t: F.col("event_type") == t
    return e.select("user_id", "hour", n.alias("attempt"), is_("error").alias("compile_failed"), is_("click").alias("evidence"), is_("purchase").alias("timed_out"), F.when(is_("signup"), 1).otherwise(0).alias("exit_code"), "value", "event_type")


ATTEMPTS = """
attempts AS (SELECT user_id, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS attempt,
  event_type = 'error' AS compile_failed, event_type = 'click' AS evidence, event_type = 'purchase' AS timed_out, CASE event_type WHEN 'signup' THEN 1 ELSE 0 END AS exit_code, value, event_type FROM events)"""
