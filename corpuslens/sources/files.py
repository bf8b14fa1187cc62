"""File sources and sinks: JSON lines, label sheets, analyser reports and resumable output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslens.functions import code as C
from corpuslens.storage import materialise


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType, missing_ok: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a bad line raises, a missing path gives no rows if that is allowed."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def as_documents(df: DataFrame) -> DataFrame:
    """Every row as one JSON document in the column `value`, ready for a text sink."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


#: Answers of a label sheet that mean yes and no.
YES, NO = ("y", "yes", "1", "true", "correct", "ok"), ("n", "no", "0", "false", "wrong", "incorrect")


BOM = "\ufeff"


def write_label_sheet(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with a header for a spreadsheet, which knows UTF-8 by the mark that every file begins with; line feeds stay inside quotes."""
    marked = df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if bom else df
    marked.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def read_label_audit(spark: SparkSession, path: str, verdict: str = "verdict") -> DataFrame:
    """A label sheet with `marked`: true, false, or null where the verdict is neither."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.withColumnRenamed(df.columns[0], df.columns[0].removeprefix(BOM)) if df.columns else df
    v = F.lower(F.trim(F.col(verdict)))
    return df.withColumn("marked", F.when(v.isin(*YES), True).when(v.isin(*NO), False))


def audit_accuracy(audit: DataFrame) -> DataFrame:
    """One row (rows, marked_rows, correct, accuracy)."""
    x = audit.agg(F.count("*").alias("rows"), F.count("marked").alias("marked_rows"), F.count_if(F.coalesce("marked", F.lit(False))).alias("correct"))
    return x.withColumn("accuracy", F.round(F.coalesce(F.try_divide("correct", "marked_rows"), F.lit(0.0)), 4))


XML_ISSUE = "id string, severity string, msg string, cwe string"


def parse_xml_issues(reports: DataFrame, xml: str) -> DataFrame:
    """Issues of analyser reports held in a column; a report that doesn't parse has none."""
    schema = "errors STRUCT<error: ARRAY<STRUCT<_id: STRING, _severity: STRING, _msg: STRING, _cwe: STRING>>>"
    keep = [c for c in reports.columns if c != xml]
    x = reports.select(*keep, F.explode(F.from_xml(F.col(xml), schema)["errors"]["error"]).alias("_e"))
    return x.select(*keep, F.col("_e._id").alias("id"), F.col("_e._severity").alias("severity"), F.col("_e._msg").alias("msg"), F.col("_e._cwe").alias("cwe"))


def read_xml_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues of the `error` elements of analyser reports."""
    df = spark.read.format("xml").option("rowTag", "error").schema("_id string, _severity string, _msg string, _cwe string").load(path)
    return df.toDF("id", "severity", "msg", "cwe")


def severity_gate(issues: DataFrame) -> DataFrame:
    """Issues that count: errors and warnings, without those that are never a finding, with the class the issue stands for and the one reported."""
    x = issues.where(F.col("severity").isin(*C.GATE_SEVERITIES) & ~F.coalesce(F.col("id"), F.lit("")).isin(*C.GATE_EXCLUDED))
    classes = F.create_map(*(F.lit(v) for kv in C.ISSUE_CLASSES.items() for v in kv))
    return x.withColumns({"cwe_mapped": F.try_element_at(classes, F.col("id")), "cwe_reported": F.when(F.col("cwe") != "", F.concat(F.lit("CWE-"), F.col("cwe")))})


def pending(df: DataFrame, done: DataFrame, key: str, quota: int | None = None) -> DataFrame:
    """Rows whose key isn't done yet; a quota counts the done rows too."""
    x = df.join(done.select(key).distinct(), key, "left_anti")
    return x if quota is None else x.orderBy(key).limit(max(0, quota - done.select(key).distinct().count()))


def append_new(df: DataFrame, path: str, key: str, buckets: int = 256) -> int:
    """Append the rows whose key the table at path lacks, one row per key; returns how many. Safe to run again after a failure.

    The table is partitioned by `_bucket`, a hash of the key, and only the
    buckets that occur in df are read, of these only the key column.  The new
    rows are stored first, so the table is read once and never counted.
    """
    spark = df.sparkSession
    new = df.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if exists(spark, path):
        new = materialise(new, "append-batch")
        hit = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most `buckets` rows
        done = spark.read.parquet(path).where(F.col("_bucket").isin(hit)).select(key, "_bucket")
        new = new.join(done, [key, "_bucket"], "left_anti")
    new = materialise(new, "append-rows")
    n = new.count()
    if n or not exists(spark, path):
        new.repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(path)
    return n


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Experiment results: one JSON document per file, those with metrics."""
    df = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return df.where(F.col("metrics").isNotNull()) if "metrics" in df.columns else df.limit(0)
