"""The same operators on the star schema and the event stream, and round trips through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import stats as S
from corpuslens.plans.catalogue import query
from corpuslens.plans.stats_queries import density_sql
from corpuslens.plans.tables import table
from corpuslens.sources import files
from corpuslens.storage import table_path
from corpuslens.streaming import events as EV


@query("orders_density_by_priority", density_sql("WITH o AS (SELECT o_orderpriority AS priority, o_orderstatus FROM orders)", "o", "priority", "o_orderstatus = 'F'"))
def orders_density_by_priority(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    return S.density(o, "priority", F.col("o_orderstatus") == "F")


@query("lineitem_flag_matrix", "WITH n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT a.l_returnflag, b.l_linestatus, coalesce(n, 0) AS n FROM (SELECT DISTINCT l_returnflag FROM n) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM n) b LEFT JOIN n USING (l_returnflag, l_linestatus)")
def lineitem_flag_matrix(spark, sf):
    return S.contingency(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("lineitem_totals", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def lineitem_totals(spark, sf):
    x = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("customer_gini", "WITH n AS (SELECT c_nationkey, o_custkey, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY c_nationkey) AS p, row_number() OVER (PARTITION BY c_nationkey ORDER BY n) AS i FROM n) SELECT c_nationkey, count(*) AS customers, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM p GROUP BY c_nationkey")
def customer_gini(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    x = o.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return S.diversity(x, "n", "c_nationkey").select("c_nationkey", F.col("classes").alias("customers"), "gini")


@query("event_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, sf):
    return EV.windowed(table(spark, sf, "events"), "1 hour", None, "event_type")


@query("event_sliding", "WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def event_sliding(spark, sf):
    return EV.windowed(table(spark, sf, "events"), "1 hour", "30 minutes", "event_type")


@query("event_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k")
def event_session(spark, sf):
    return EV.sessions(table(spark, sf, "events"), "30 minutes", "user_id")


@query("props_json_extract", "SELECT event_type, count(*) AS n, CAST(sum(TRY_CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def props_json_extract(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("last_event_per_user", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def last_event_per_user(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


@query("streamed_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streamed_counts(spark, sf):
    """Events read as a stream, appended once by key, and counted."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source, out, state = f"{sf}/events.parquet", table_path(spark, "stream"), table_path(spark, "stream-state")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(source)
    EV.append_once(stream, out, state, "event_id").awaitTermination()
    return spark.read.schema(schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("json_round_trip", "SELECT DISTINCT cve_id, description, len(github_commit_urls) AS urls, published FROM cve_records")
def json_round_trip(spark, sf):
    """Advisories written as JSON lines and read again under their schema."""
    df, path = table(spark, sf, "cve_records"), table_path(spark, "json")
    files.write_json_lines(df, path)
    x = files.read_json_lines(spark, path, df.schema)
    return x.select("cve_id", "description", F.when(F.col("github_commit_urls").isNotNull(), F.size("github_commit_urls")).alias("urls"), "published").distinct()


@query("csv_label_audit", "SELECT count(*) AS rows, count_if(verdict IN ('yes', 'no')) AS marked_rows, count_if(verdict = 'yes') AS correct, round(count_if(verdict = 'yes') / count_if(verdict IN ('yes', 'no')), 4) AS accuracy FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unsure' END AS verdict FROM documents WHERE text IS NOT NULL)")
def csv_label_audit(spark, sf):
    """A label sheet with texts of several lines, written, read and scored."""
    d = table(spark, sf, "documents").where("text is not null")
    verdict = F.when(F.col("doc_id") % 3 == 0, " Yes ").when(F.col("doc_id") % 3 == 1, "NO").otherwise("unsure")
    path = table_path(spark, "csv")
    files.write_label_sheet(d.select("doc_id", "text", verdict.alias("verdict")), path)
    return files.audit_accuracy(files.read_label_audit(spark, path))


@query("xml_issue_scan", "SELECT CASE event_type WHEN 'error' THEN 'nullPointer' ELSE 'style-' || event_type END AS id, CASE event_type WHEN 'error' THEN 'error' ELSE 'style' END AS severity, count(*) AS n FROM events GROUP BY ALL")
def xml_issue_scan(spark, sf):
    """Analyser reports held as text, one element per event."""
    t = F.col("event_type")
    name, level = F.when(t == "error", "nullPointer").otherwise(F.concat(F.lit("style-"), t)), F.when(t == "error", "error").otherwise("style")
    xml = F.concat(F.lit('<results><errors><error id="'), name, F.lit('" severity="'), level, F.lit('" msg="m" cwe="476"/></errors></results>'))
    x = table(spark, sf, "events").select("event_id", xml.alias("report"))
    return files.parse_xml_issues(x, "report").groupBy("id", "severity").agg(F.count("*").alias("n"))


@query("json_documents", "SELECT event_id, event_type, user_id FROM events")
def json_documents(spark, sf):
    """Rows as JSON documents and back."""
    docs = files.as_documents(table(spark, sf, "events").select("event_id", "event_type", "user_id"))
    return docs.select(F.from_json("value", "event_id bigint, event_type string, user_id bigint").alias("r")).select("r.*")
