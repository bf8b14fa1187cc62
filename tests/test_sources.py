"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from corpuslens.sources import files
from corpuslens.sources.feed import FeedDataSource
from corpuslens.streaming import events as EV


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("ä", 1), (None, 2)], "a string, b int")
    files.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(r.b for r in files.read_json_lines(spark, str(tmp_path / "j"), "a string, b int").collect()) == [1, 2]
    assert files.read_json_lines(spark, str(tmp_path / "none"), "a string", missing_ok=True).count() == 0
    (tmp_path / "bad.json").write_text('{"a": 1}\n{broken')
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path / "bad.json"), "a int").collect()


def test_append_new_is_repeatable(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(5)], "id int")
    path = str(tmp_path / "t")
    assert files.append_new(df.where("id < 3"), path, "id") == 3
    assert files.append_new(df, path, "id") == 2
    assert files.append_new(df, path, "id") == 0
    assert files.append_new(df.union(df).selectExpr("id + 4 AS id"), path, "id") == 4  # keys that repeat within a batch count once
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(9))
    assert files.pending(df, df.where("id < 2"), "id", 4).count() == 2


def test_audit_and_xml(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", "Yes"), ('q"x', "no "), ("z", None)], "code string, verdict string")
    files.write_label_sheet(df, str(tmp_path / "c"))
    r = files.audit_accuracy(files.read_label_audit(spark, str(tmp_path / "c"))).first()
    assert (r.rows, r.marked_rows, r.correct, r.accuracy) == (3, 2, 1, 0.5)
    part = next((tmp_path / "c").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfcode,verdict")
    (tmp_path / "r.xml").write_text('<results><errors><error id="n" severity="error" msg="m" cwe="476"/><error id="s" severity="style" msg="k"/></errors></results>')
    assert {(r.id, r.cwe) for r in files.read_xml_issues(spark, str(tmp_path / "r.xml")).collect()} == {("n", "476"), ("s", None)}


def test_severity_gate_and_results(spark, tmp_path):
    rows = [("nullPointer", "error", "m", "476"), ("x", "warning", "m", ""), ("noValidConfiguration", "error", "m", None), ("memleak", "style", "m", "401"), (None, "error", "m", None)]
    got = [(r.id, r.cwe_mapped, r.cwe_reported) for r in files.severity_gate(spark.createDataFrame(rows, "id string, severity string, msg string, cwe string")).collect()]
    assert got == [("nullPointer", "CWE-476", "CWE-476"), ("x", None, None), (None, None, None)]
    (tmp_path / "a.json").write_text(json.dumps({"config": "a", "metrics": {"f1": 0.5}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"config": "b"}))
    assert [(r.config, r.metrics.f1) for r in files.read_results(spark, str(tmp_path)).collect()] == [("a", 0.5)]


def test_commit_source(spark, tmp_path):
    import base64

    from corpuslens.sources.commits import CommitDataSource

    repo = tmp_path / "o" / "r"
    for d in ("contents-s1/src", "contents-s1^/src"):
        (repo / d).mkdir(parents=True)
    commit = lambda sha, m: {"sha": sha, "commit": {"message": m}}
    (repo / "commits-1.json").write_text(json.dumps([commit("s1", "Fix buffer overflow"), commit("s2", "Merge branch x: buffer overflow"), commit("s1", "Fix buffer overflow")]))
    (repo / "commits-2.json").write_text(json.dumps([commit("s3", "fix memory leak")]))
    (repo / "commits-s1.json").write_text(json.dumps({"files": [{"filename": "src/a.c", "patch": "@@\n-x\n+y"}, {"filename": "README.md", "patch": "@@"}, {"filename": "b.c"}]}))
    (repo / "contents-s1^/src/a.c.json").write_text(json.dumps({"encoding": "base64", "content": base64.b64encode("x ä".encode()).decode()}))
    (repo / "contents-s1/src/a.c.json").write_text(json.dumps({"encoding": "none", "content": "z"}))
    spark.dataSource.register(CommitDataSource)
    rows = spark.read.format("corpuslens_commits").option("base", str(tmp_path)).option("repos", "o/r,o/none").option("contents", "true").load().collect()
    assert [(r.repo, r.sha, r.filename, r.before, r.after) for r in rows] == [("o/r", "s1", "src/a.c", "x ä", None)]


def test_feed_source(spark, tmp_path):
    item = lambda i: {"cve": {"id": f"CVE-{i}", "weaknesses": [{"description": [{"value": "CWE-1"}, {"value": "CWE-78"}]}], "references": [{"url": "https://x/o/r/commit/ab"}, {"url": "https://x"}], "descriptions": [{"lang": "de", "value": "d"}, {"lang": "en", "value": "e"}], "published": "2030"}}
    (tmp_path / "ros-0.json").write_text(json.dumps({"totalResults": 3, "vulnerabilities": [item(1), item(2)]}))
    (tmp_path / "ros-2.json").write_text(json.dumps({"totalResults": 3, "vulnerabilities": [item(3)]}))
    spark.dataSource.register(FeedDataSource)
    df = spark.read.format("corpuslens_feed").option("base", str(tmp_path)).option("keywords", "ros,none").option("page", 2).option("targets", "CWE-78").load()
    rows = df.orderBy("cve_id").collect()
    assert [r.cve_id for r in rows] == ["CVE-1", "CVE-2", "CVE-3"] and rows[0].cwe_ids == ["CWE-78"] and rows[0].description == "e" and len(rows[0].urls) == 1


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2030-01-01 00:{i:02d}:00", "a" if i % 2 else "b", 1.0) for i in range(30)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    stream = EV.read_events(spark, str(tmp_path / "in"), df.schema)
    EV.append_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "event_id").awaitTermination()
    EV.append_once(stream, str(tmp_path / "out"), str(tmp_path / "cp2"), "event_id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    q = EV.windowed(stream, "10 minutes", None, "event_type", delay="1 minute").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from w").collect()} == {tuple(r) for r in EV.windowed(df, "10 minutes", None, "event_type").collect()}
    assert EV.sessions(df, "5 minutes", "event_type").count() == 2
    assert EV.deduplicated(df, "event_type").count() == 2
