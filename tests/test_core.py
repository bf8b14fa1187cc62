"""Core operators on literal rows and against closed forms."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.functions import code as C
from corpuslens.functions import distributions as D
from corpuslens.functions import text as T
from corpuslens.operators import corpus, diff, judge, retrieval
from corpuslens.operators import model as M
from corpuslens.operators import stats as S
from corpuslens.operators.running import places, running_sum


def one(spark, schema, rows, **exprs):
    return spark.createDataFrame(rows, schema).select(*(e.alias(n) for n, e in exprs.items())).collect()


def test_text_functions(spark):
    rows = [("\t a b \n",), ("",), (None,), ("MyValue_x2 12 i parseHTTP",)]
    got = one(spark, "t string", rows, s=T.strip(F.col("t")), n=T.line_count(F.col("t")), k=T.code_tokens(F.col("t")))
    assert [r.s for r in got] == ["a b", "", None, "MyValue_x2 12 i parseHTTP"]
    assert [r.n for r in got][:2] == [2, 1]
    assert [r.k for r in got][2:] == [[], ["my", "value", "x2", "parse", "http"]]


def test_line_overlap_and_json(spark):
    rows = [("a\nb", "b\n c"), (None, None), ("a", None)]
    assert [r.v for r in one(spark, "a string, b string", rows, v=T.line_overlap(F.col("a"), F.col("b")))] == [0.5, 1.0, 0.0]
    rows = [('{"a": 1}',), ('```json\n{"a": 1}\n```',), ('x {"a": 1} y',), ("broken {",), (None,)]
    assert [r.v and r.v.replace("\n", "") for r in one(spark, "t string", rows, v=T.json_object(F.col("t")))] == ['{"a": 1}'] * 3 + [None, None]


def test_code_metrics(spark):
    code = "// c\nint f(int a) {\n  if (a) { g(*p); }\n}\n}"
    r = one(spark, "t string", [(code,)], **C.metrics(F.col("t")))[0]
    assert (r.loc, r.sloc, r.num_calls, r.max_nesting, r.num_conditions, r.cyclomatic, r.num_pointers) == (5, 4, 3, 2, 1, 2, 1)
    r = one(spark, "t string", [("x->y(); foo(a);\nbar(b);",)], **C.antipatterns(F.col("t")))[0]
    assert r.missing_null_check and not r.missing_lock


def test_class_names_match_whole_numbers(spark):
    got = one(spark, "t string", [("cwe-787 only",), ("see CWE-78.",), (None,)], c=C.named_class(F.col("t")))
    assert [r.c for r in got] == [None, "CWE-78", None]


def test_first_by_is_deterministic_and_null_safe(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 0, "w")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    assert {(r.k, r.v) for r in corpus.first_by(df, ["k"], ["o"]).collect()} == {("a", "y"), (None, "w")}
    assert corpus.first_by(df.limit(0), ["k"], ["o"]).count() == 0


def test_splits_keep_groups_together(spark):
    rows = [(f"r{i % 7}", "c", i) for i in range(100)] + [(f"r{i % 7}", "d", i) for i in range(50)]
    df = spark.createDataFrame(rows, "repo string, cwe string, i int")
    h = corpus.hash_split(df, "repo").groupBy("repo").agg(F.count_distinct("part").alias("n")).collect()
    assert all(r.n == 1 for r in h)
    g = {r.repo: r.part for r in corpus.greedy_split(df, "repo", "cwe").collect()}
    assert set(g.values()) == {"train", "test"} and len(g) == 7


def test_diff_pairs(spark):
    body = "\n".join(f" line {i}" for i in range(8))
    patch = f"@@ -1 +1 @@\n{body}\n-old\n+new\n@@ -9 +9 @@\n short"
    df = spark.createDataFrame([("c", patch), ("n", None), ("e", "")], "id string, patch string")
    got = diff.explode_pairs(df, "patch").collect()
    assert [(r.id, r.before.split("\n")[-1], r.after.split("\n")[-1]) for r in got] == [("c", "old", "new")]
    assert [(r.label, r.code[-3:]) for r in diff.labelled(diff.explode_pairs(df, "patch")).collect()] == [(1, "old"), (0, "new")]
    whole = one(spark, "p string", [("--- a\n+++ b\n-x\n+y\n z",)], b=diff.patch_sides(F.col("p"))[0], a=diff.patch_sides(F.col("p"))[1])[0]
    assert (whole.b, whole.a) == ("--- a\n+++ b\nx\nz", "--- a\n+++ b\ny\nz")


def test_bm25_against_plain_python(spark):
    docs = [(1, "alpha beta beta"), (2, "beta gamma"), (3, None), (4, ""), (5, "delta delta alpha")]
    queries = [(10, "beta beta alpha"), (11, ""), (12, "unknown")]
    got = retrieval.bm25(spark.createDataFrame(docs, "d int, t string"), "d", "t", spark.createDataFrame(queries, "q int, t string"), "q", "t", 5).collect()
    texts = {d: t.split() for d, t in docs if t}
    avg = sum(map(len, texts.values())) / len(texts)

    def score(q, d):
        s = 0
        for term in q.split():
            df = sum(term in x for x in texts.values())
            tf = texts[d].count(term)
            s += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(texts[d]) / avg)) if tf else 0
        return s

    assert {(r.query_id, r.doc_id): r.score for r in got} == {(10, d): pytest.approx(score(queries[0][1], d), abs=1e-6) for d in (1, 2, 5)}


def test_rrf_of_one_list_keeps_its_order(spark):
    lst = spark.createDataFrame([(1, d, r) for r, d in enumerate([5, 3, 9], 1)], "query_id int, doc_id int, rank int")
    assert [r.doc_id for r in retrieval.rrf([(lst, 1.0)], 3).orderBy("rank").collect()] == [5, 3, 9]
    both = retrieval.rrf([(lst, 1.0), (lst.limit(0), 1.0)], 3)
    assert both.count() == 3


def test_votes_and_verification(spark):
    rows = [("a", 0, True, 0.8, "C1", "r0"), ("a", 1, True, 0.6, "C2", "r1"), ("a", 2, False, 0.9, None, "r2"), ("b", 0, True, 0.5, "C1", "x"), ("b", 1, None, None, None, "y")]
    df = spark.createDataFrame(rows, "id string, persona int, has_vuln boolean, confidence double, cwe string, reason string")
    v = {r.id: r for r in judge.vote(df, ["id"]).collect()}
    assert (v["a"].has_vulnerability, v["a"].vulnerability_type, v["a"].confidence, v["a"].reason) == (True, "C1", round(0.7 * 2 / 3, 4), "r0")
    assert v["b"].has_vulnerability is False and v["b"].reason == "y"
    rows = [("a", 1, True, False, False, 0), ("a", 2, False, False, True, 0), ("b", 1, False, False, False, 0), ("c", 1, True, False, False, 0)]
    df = spark.createDataFrame(rows, "id string, n int, compile_failed boolean, evidence boolean, timed_out boolean, exit_code int")
    v = {r.id: (r.verified, r.attempts) for r in judge.verify(df, ["id"], "n").collect()}
    assert v == {"a": ("suspected", 2), "b": ("not_reproduced", 1), "c": ("unverifiable", 1)}
    rows = [("a", 1, True, True, True), ("a", 2, True, False, True), ("b", 1, False, False, True)]
    df = spark.createDataFrame(rows, "id string, n int, compiled boolean, still_vulnerable boolean, approved boolean")
    v = {r.id: (r.status, r.rounds_used) for r in judge.repair_rounds(df, ["id"], "n").collect()}
    assert v == {"a": ("verified_fixed", 2), "b": ("compilation_failed", 1)}


def test_published_values(spark):
    n = [141, 136, 127, 49, 21, 16, 12, 6, 1]
    counts = spark.createDataFrame([(f"c{i}", v) for i, v in enumerate(n)], "c string, n long")
    d = S.diversity(counts, "n").first()
    assert (round(d.entropy, 3), round(d.evenness, 3), round(d.gini_simpson, 3), round(d.gini, 3)) == (2.414, 0.761, 0.777, 0.53)
    assert round(S.goodness_of_fit(counts, "n").first().chi2, 2) == 512.74
    t = spark.createDataFrame([(431, 244, 78, 112)], "a int, b int, c int, d int").withColumns(S.odds_ratio(*(F.col(c) for c in "abcd"))).first()
    assert (round(t.odds_ratio, 2), round(t.or_low, 2), round(t.or_high, 2)) == (2.53, 1.82, 3.51)


def test_distribution_tails():
    assert D.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert D.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert D.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert D.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert D.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-6)
    assert D.fisher_two_sided(0, 0, 0, 0) == 1.0


def test_exact_test_equals_the_sum_over_all_tables():
    rng = random.Random(4)
    tables = [tuple(rng.randint(0, n) for _ in range(4)) for n in (1, 3, 10, 60) for _ in range(60)]
    for a, b, c, d in tables:
        n, row, col = a + b + c + d, a + b, a + c
        ways = {k: math.comb(row, k) * math.comb(n - row, col - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
        want = sum(w for w in ways.values() if w <= ways[a] * (1 + 1e-7)) / math.comb(n, col)
        assert D.fisher_two_sided(a, b, c, d) == pytest.approx(want, rel=1e-9), (a, b, c, d)
    assert 0 < D.fisher_two_sided(10**9, 10**9 + 40_000, 10**9, 10**9) < 1  # steps in the order of the deviation, not of the margins


def test_running_sums_by_range_equal_one_window(spark):
    rng = random.Random(8)
    rows = [(f"g{rng.randrange(3)}", i, rng.randrange(5)) for i in rng.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "g string, o int, n int")
    for by in ((), ("g",)):
        whole, cut = ({r.o: r.ahead for r in running_sum(df, "n", ["o"], "ahead", by, single).collect()} for single in (10_000, 10))
        want = {o: sum(m for h, p, m in rows if p < o and (not by or h == g)) for g, o, _ in rows}
        assert whole == cut == want
    assert [r.place for r in places(df.limit(5), [F.desc("o")], single=1).orderBy(F.desc("o")).collect()] == [1, 2, 3, 4, 5]
    assert running_sum(df.limit(0), "n", ["o"], single=1).count() == 0


def test_medians_and_correlations_beyond_one_window(spark, monkeypatch):
    from corpuslens.operators import running

    monkeypatch.setattr(running, "SINGLE", 3)
    rng = random.Random(2)
    rows = [("a", rng.randint(0, 30), rng.randint(0, 30)) for _ in range(101)] + [("b", 4, 4), ("b", 7, 9), ("c", 5, None), ("c", None, 1)]
    df = spark.createDataFrame(rows, "g string, v int, w int")
    got = {r.g: (r.n, r["median"], r["std"]) for r in S.describe(df, "v", "g").collect()}
    import statistics

    v = [x for g, x, _ in rows if g == "a"]
    assert got["a"] == (101, statistics.median(v), pytest.approx(statistics.stdev(v), abs=1e-6)) and got["b"][1] == 5.5 and got["c"] == (1, 5, 0.0)
    rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    x, y = rank(v), rank([w for g, _, w in rows if g == "a"])
    rho = {r.g: r.rho for r in S.spearman(df, "v", "w", "g").collect()}
    assert rho["a"] == pytest.approx(statistics.correlation(x, y), abs=1e-6) and rho["b"] == 1.0


def test_bca_intervals(spark):
    import numpy as np

    data = np.array([1] * 12 + [0] * 48)
    left = np.array([np.delete(data, i).mean() for i in range(len(data))])
    d = left.mean() - left
    assert S.proportion_acceleration(12, 60) == pytest.approx((d**3).sum() / (6 * (d**2).sum() ** 1.5))
    assert S.proportion_acceleration(0, 5) == S.proportion_acceleration(1, 1) == 0
    draws = np.random.default_rng(1).binomial(60, 0.2, 10_000) / 60
    low, high = S.bca_bounds(draws, 0.2, S.proportion_acceleration(12, 60))
    assert 0.05 < low < 0.2 < high < 0.35
    normal = np.random.default_rng(2).normal(size=20_000)
    for point, a in ((0.0, 0.0), (0.3, 0.0), (0.0, 0.05)):  # the bounds are the quantiles that the definition names
        from statistics import NormalDist

        z0 = NormalDist().inv_cdf(float((normal < point).mean()))
        want = [NormalDist().cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (-1.959963984540054, 1.959963984540054)]
        assert S.bca_bounds(normal, point, a) == pytest.approx(np.quantile(normal, want), abs=1e-9)
    assert S.bca_bounds(draws, -1.0, 0.0) == tuple(np.percentile(draws, [2.5, 97.5]))
    counts = spark.createDataFrame([("a", 12, 60), ("b", 0, 0), ("c", 5, 5)], "k string, x long, n long")
    got = {r.k: (r.proportion, r.boot_low, r.boot_high) for r in S.bootstrap_proportions(counts, "k", "x", "n").collect()}
    assert got["a"][1:] == pytest.approx((low, high), abs=0.02) and got["b"] == (0, 0, 0) and got["c"] == (1, 1, 1)
    rows = spark.createDataFrame([("a", v) for v in data.tolist()] + [("a", None)], "k string, v int")
    m = S.bootstrap_means(rows, "v", "k").first()
    assert (m.mean, m.boot_low, m.boot_high) == pytest.approx((0.2, low, high), abs=0.02)
    with pytest.raises(ValueError):
        S.bootstrap_proportions(counts, "k", "x", "n", method="other")


def test_best_keeps_the_smallest_ids_of_ties():
    import numpy as np

    best = retrieval.Best(2, 3)
    for ids in ([9, 8, 7, 6, 5], [4, 3, 2, 1, 9]):
        best.add(np.array(ids), np.array([[1.0, i] for i in ids]), np.array([0, 1]))
    q, ids, score = best.rows(["x", "y"])
    assert ids == [1, 2, 3, 9, 8, 7] and q == ["x"] * 3 + ["y"] * 3 and score[:3] == [1.0] * 3


def test_dense_search_edges_and_recall_of_cells(spark, sf, monkeypatch):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.6, 0.8], None), (3, None, "a"), (4, [1.0], "a"), (5, [None, 1.0], "a"), (6, [1.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (6, [1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "id int, v array<double>, c string")
    assert [(r.query_id, r.vec_id, r.score) for r in retrieval.dense(df, "id", "v", df.where("id = 1"), 5).orderBy("rank").collect()] == [(1, 6, 1.0), (1, 2, 0.6)]
    assert [r.vec_id for r in retrieval.dense(df, "id", "v", df.where("id = 1"), 5, "c").collect()] == [6]
    assert retrieval.dense(df, "id", "v", df.limit(0), 5).count() == 0 and retrieval.dense(df.limit(0), "id", "v", df, 5).count() == 0
    e = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    q = e.where("vec_id % 100 = 0")
    exact = {(r.query_id, r.vec_id) for r in retrieval.dense(e, "vec_id", "embedding", q, 10).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert exact == {(r.query_id, r.vec_id) for r in retrieval.dense(e, "vec_id", "embedding", q, 10).collect()}
    centres = retrieval.fit_cells(e, "embedding", 16)
    near = retrieval.assign_cells(e, "embedding", centres)
    assert near.where("cell between 0 and 15").count() == e.count()
    probes = retrieval.tune_probes(near, "vec_id", "embedding", q, 10, centres)
    assert 1 < probes < 16
    got = {(r.query_id, r.vec_id) for r in retrieval.dense_ann(near, "vec_id", "embedding", q, 10, centres, probes).collect()}
    assert len(got & exact) >= 0.9 * len(exact)
    assert retrieval.tune_probes(near, "vec_id", "embedding", q.limit(0), 10, centres) == 16


def test_lexical_search_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "x"), (1, "alpha alpha", "x"), (2, None, "x"), (None, "alpha", "x"), (3, "alpha gamma", None)], "d int, t string, c string")
    q = spark.createDataFrame([(7, "alpha beta beta", "x"), (8, None, "x"), (None, "alpha", "x")], "q int, t string, c string")
    assert {(r.query_id, r.doc_id) for r in retrieval.bm25(docs, "d", "t", q, "q", "t", 5).collect()} == {(7, 1), (7, 3)}
    assert [(r.query_id, r.doc_id, r.score) for r in retrieval.shared_terms(docs, "d", "t", q, "q", "t", 5, "c").collect()] == [(7, 1, 2.0)]
    assert retrieval.bm25(docs.limit(0), "d", "t", q, "q", "t", 5).count() == 0 and retrieval.bm25(docs, "d", "t", q.limit(0), "q", "t", 5).count() == 0


def test_reranking_by_a_scorer_and_by_answers(spark):
    hits = spark.createDataFrame([(1, d, d, "q", "x" * d) for d in range(1, 5)], "query_id int, doc_id int, rank int, query string, text string")
    assert [r.doc_id for r in retrieval.rerank_by(hits, 2, lambda qs, ts: [len(t) for t in ts]).orderBy("new_rank").collect()] == [4, 3]
    answers = spark.createDataFrame([(1, 1, "2"), (1, 2, "none"), (1, 3, " 9 of 10"), (1, 4, "99")], "query_id int, doc_id int, answer string")
    assert [r.doc_id for r in retrieval.rerank_by_answers(hits, answers, 3).orderBy("new_rank").collect()] == [4, 3, 2]
    assert retrieval.rerank_by(hits.limit(0), 2, lambda qs, ts: []).count() == 0


def test_facets_structure_and_builds(spark):
    full = '{"functional_semantics": " a ", "root_cause": "b", "trigger_condition": "c", "fix_pattern": "d", "more": 1}'
    rows = [(full,), (f"```json\n{full}\n```",), (f"Here: {full} so.",), (full.replace('"b"', "3"),), (full.replace('"c"', '"  "'),), (full.replace('"fix_pattern"', '"other"'),), ("none",), (None,)]
    got = [r.k for r in one(spark, "t string", rows, k=T.knowledge_facets(F.col("t")))]
    assert [k and k.functional_semantics for k in got] == ["a"] * 3 + [None] * 5
    text = one(spark, "t string", [("void f(char *a, int b) {\n strcpy(x, a);\n if (a != NULL) free(a);\n}",)], s=C.structure_text(F.col("t"), F.lit("C++")))[0].s.split("\n")
    assert text[0] == "=== Code Structure Analysis ===" and any("strcpy() " in x for x in text) and "Parameters (potential external input): char *a, int b" in text and "Lines of code: 4" in text
    logs = [("a: error: b", 1), ("a: error: b", 0), ("AddressSanitizer error: b", 1), (None, 1)]
    assert [r.f for r in one(spark, "l string, e int", logs, f=C.compile_failed(F.col("l"), F.col("e")))] == [True, False, False, False]


def test_rank_statistics_match_pairs(spark):
    rng = random.Random(3)
    x, y = [rng.randint(0, 9) for _ in range(40)], [rng.randint(2, 12) for _ in range(30)]
    df = spark.createDataFrame([(1, v) for v in x] + [(0, v) for v in y] + [(None, 3), (1, None)], "label int, v int")
    r = S.rank_test(df.withColumn("g", F.lit("g")), "v", F.col("label") == 1, "g").first()
    delta = sum((a > b) - (a < b) for a in x for b in y) / (len(x) * len(y))
    assert r.delta == pytest.approx(delta, abs=1e-6) and r.a == pytest.approx((delta + 1) / 2, abs=1e-6) and 0 <= r.p <= 1
    few = S.rank_test(df.limit(2).withColumn("g", F.lit("g")), "v", F.col("label") == 1, "g").first()
    assert few.p is None and few.delta == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=8))
def test_adjusted_p_order(spark, ps):
    df = spark.createDataFrame([(f"t{i}", p) for i, p in enumerate(ps)], "t string, p double")
    for r in S.benjamini_hochberg(S.holm(df, "p", "t"), "p", "t").collect():
        assert r.p_holm >= r.p_bh - 1e-12 and r.p_bh >= r.p - 1e-12 and r.p_holm <= 1


def test_bootstrap_and_models(spark):
    counts = spark.createDataFrame([("a", 30, 100), ("b", 0, 0)], "k string, x long, n long")
    b = {r.k: r for r in S.bootstrap_proportions(counts, "k", "x", "n", 2000).collect()}
    assert b["a"].boot_low < 0.3 < b["a"].boot_high and b["b"].proportion == 0
    rng = random.Random(1)
    rows = [(str(i), rng.gauss(i % 2, 1.0), rng.gauss(0, 1), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, x double, z double, label int")
    w = {r.feature: r for r in M.wald(M.standard_scale(df, ["x", "z"]), ["x", "z"], "label").collect()}
    assert w["x"].p < 0.01 and w["x"].coef > 0 and w["x"].pseudo_r2 > 0
    assert all(r.auc > 0.6 for r in M.cross_validated_auc(df, ["x", "z"], "label", "id", 3).collect())
    assert M.forest_importance(df, ["x", "z"], "label", 10).orderBy("rank").first().feature == "x"
    assert M.wald(df.limit(3), ["x"], "label").count() == 0
