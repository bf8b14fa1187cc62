"""Index, rendering and presets."""

import base64

import pytest
from pyspark.sql import functions as F

from corpuslens.plans.presets import CONFIGURATIONS, PRESETS, Preset, estimated_seconds, retrieve, staged
from corpuslens.sources import render
from corpuslens.sources.index import VectorIndex, decoded


def test_vector_index(spark, tmp_path):
    ix = VectorIndex(spark, str(tmp_path / "ix"), ("lang",))
    assert not ix.is_ready() and ix.count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0], "c"), (2, [0.6, 0.8], "c"), (3, [0.0, 1.0], "py")], "id int, embedding array<float>, lang string")
    ix.reset(rows.limit(2))
    ix.add(rows.where("id = 3"))
    assert ix.count() == 3 and ix.read(lang="py").count() == 1
    q = spark.createDataFrame([(9, [0.0, 1.0])], "id int, embedding array<float>")
    assert [r.vec_id for r in ix.search(q, 2).orderBy("rank").collect()] == [3, 2]
    assert [r.vec_id for r in ix.search(q, 2, lang="c").orderBy("rank").collect()] == [2, 1]


def test_vector_index_of_cells(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    ix = VectorIndex(spark, str(tmp_path / "ix"), cells=8)
    ix.reset(e.where("id % 2 = 0"))
    ix.add(e.where("id % 2 = 1"))
    q = e.where("id % 100 = 0")
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    exact, near = pairs(ix.search(q, 5)), pairs(ix.search_near(q, 5, 6))
    assert ix.count() == e.count() and len(exact & near) >= 0.9 * len(exact) and pairs(ix.search_near(q, 5, 8)) == exact


def test_decoded(spark):
    rows = [(base64.b64encode("ä\n".encode()).decode(),), ("!!",), (None,)]
    assert [r.t for r in spark.createDataFrame(rows, "c string").select(decoded(F.col("c")).alias("t")).collect()] == ["ä\n", None, None]


def test_render(spark):
    df = spark.createDataFrame([("a|b_", 0.123456), (None, None)], "n string, v double")
    assert render.markdown(df).splitlines()[2:] == ["| a\\|b_ | 0.1235 |", "|  |  |"]
    assert r"a|b\_ & 0.1235 \\" in render.latex(df, "c", "t")
    with pytest.raises(ValueError):
        render.markdown(spark.range(3000).toDF("n"))


def test_presets(spark):
    assert PRESETS["full"].detector == "plan" and PRESETS["dual_vote"].detector == "vote" and PRESETS["naive"].detector == "plain"
    with pytest.raises(ValueError):
        PRESETS.register(Preset("full"))
    with pytest.raises(ValueError):
        Preset("x", "other")
    lst = lambda ids: spark.createDataFrame([(1, d, 1.0 / r, r) for r, d in enumerate(ids, 1)], "query_id int, doc_id int, score double, rank int")
    texts = spark.createDataFrame([(1, d, "alpha beta", "alpha" if d == 7 else "gamma") for d in range(10)], "query_id int, doc_id int, query string, text string")
    a, b = lst([1, 2, 3, 4, 5, 6]), lst([7, 2, 8])
    assert retrieve(PRESETS["naive"], a, b) is None
    assert retrieve(PRESETS["lexical"], a, b).count() == 5
    assert retrieve(PRESETS["hybrid"], a, b).orderBy("rank").first().doc_id == 2
    assert retrieve(PRESETS["dual"], a, b, texts).orderBy("rank").first().doc_id == 7


def test_configurations_and_estimates():
    assert len(CONFIGURATIONS) == 33 and CONFIGURATIONS["kl_rag_ast_voting"].detector == "structure" and CONFIGURATIONS["9_full_with_debate"].retry
    assert CONFIGURATIONS["ON_06_kl_rag_plan"].retrieval == "topical" and CONFIGURATIONS["agent_only"].retrieval == "none" and CONFIGURATIONS["2_rag_basic"].retrieval == "lexical"
    assert estimated_seconds("ON_07_kl_rag_verifier", 161) == 8050 and estimated_seconds("full", 10) is None
    with pytest.raises(ValueError):
        staged("x", "hybrid other")


def test_figures():
    from xml.etree import ElementTree

    from corpuslens.sources import figures as V

    drawn = [V.bars("a<b", ["x", "y"], [1, -2.0], [0.5, 1.0]), V.lines("t", [0, 1], [0, 1], True), V.intervals("t", ["x"], [1.0], [0.5], [2.0], 1.0), V.heat("t", ["a", "b"], ["c", "c"], [1, -2]), V.tiles("t", ["a", "b"], [3, 1])]
    for svg in drawn + [V.bars("t", [], []), V.lines("t", [], []), V.intervals("t", ["x"], [None], [1], [2]), V.heat("t", [], [], []), V.tiles("t", [], [])]:
        assert ElementTree.fromstring(svg).tag.endswith("svg")


def test_reports_and_command_line(spark, sf, tmp_path, capsys):
    from corpuslens.__main__ import main
    from corpuslens.plans import reports

    assert reports.selected("3,1") == [1, 3] and reports.selected() == list(range(1, 11)) and len(reports.TABLES) == 8 and len(reports.FIGURES) == 15
    with pytest.raises(ValueError):
        reports.selected("11")
    text = reports.markdown(spark, sf, [7])
    assert "## R7" in text and "### report_r7_tests" in text and "| severity |" in text
    assert reports.figure(spark, sf, "severity_levels").startswith("<svg")
    assert main(["eta", "ON_01_naive", "--samples", "10"]) == 0 and "80 s" in capsys.readouterr().out
    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert main(["run", "lineitem_totals", "--data", sf, "--out", str(tmp_path / "o.md"), "--format", "markdown"]) == 0
    assert (tmp_path / "o.md").read_text().startswith("| ")
    with pytest.raises(SystemExit):
        main(["run", "unknown", "--data", sf])
