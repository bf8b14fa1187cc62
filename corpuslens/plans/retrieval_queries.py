"""Queries on lexical and dense search, fusion, reranking and corrective retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import retrieval as R
from corpuslens.plans.catalogue import query
from corpuslens.plans.corpus_queries import TOKENS_SQL
from corpuslens.plans.tables import table

K = 10

_BM25 = f"""
t AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS toks FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, toks, len(toks) AS length FROM t WHERE len(toks) > 0),
st AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM d),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS_SQL.format('item_text')}) AS term FROM eval_items) GROUP BY ALL),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, length, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, ln(1 + (n_docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf, avg_length FROM tf, st GROUP BY term, n_docs, avg_length),
s AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length))), 6) AS score FROM q JOIN w USING (term) JOIN tf USING (term) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {K})"""

#: Second list: documents of the query's class by the number of shared tokens.
_TOPIC = f"""
m AS (SELECT e.item_id AS query_id, d.doc_id, len(list_intersect(list_distinct(d.toks), list_distinct({TOKENS_SQL.format('e.item_text')})))::DOUBLE AS score FROM eval_items e JOIN (SELECT doc_id, cwe_id, {TOKENS_SQL.format('text')} AS toks FROM documents WHERE text IS NOT NULL) d ON d.cwe_id = e.cwe_id),
topic AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m WHERE score > 0) WHERE rank <= {K})"""


def lexical(spark, sf, k: int = K):
    docs = table(spark, sf, "documents").where("text is not null")
    return R.bm25(docs, "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "item_text", k)


def topical(spark, sf, k: int = K):
    """Documents of the query's class by shared tokens: the class is an equality before the search."""
    return R.shared_terms(table(spark, sf, "documents").where("text is not null"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "item_text", k, "cwe_id")


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM lex")
def bm25_topk(spark, sf):
    return lexical(spark, sf)


@query("topic_topk", f"WITH {_TOPIC} SELECT query_id, doc_id, score, rank FROM topic")
def topic_topk(spark, sf):
    return topical(spark, sf)


@query("score_cut_topk", f"WITH {_BM25} SELECT l.query_id, l.doc_id, l.score, row_number() OVER (PARTITION BY l.query_id ORDER BY l.score DESC, l.doc_id) AS rank FROM lex l JOIN documents d USING (doc_id) WHERE d.cwe_id IS NOT NULL")
def score_cut_topk(spark, sf):
    """The class filter after ranking: what is left of the k best."""
    hits = lexical(spark, sf).drop("rank")
    kept = table(spark, sf, "documents").where("cwe_id is not null").select("doc_id")
    return R.top_k(hits.join(kept, "doc_id", "left_semi"), ["query_id"], "score", "doc_id", K).select("query_id", "doc_id", "score", "rank")


_DENSE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.e, q.e), 6) AS score FROM v JOIN v q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id {0}),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10)"""


def _dense(spark, sf, same=None):
    e = table(spark, sf, "embeddings")
    return R.dense(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), K, same).select("query_id", "vec_id", "score", "rank")


@query("dense_topk", f"WITH {_DENSE.format('')} SELECT query_id, vec_id, score, rank FROM dense")
def dense_topk(spark, sf):
    """The stated query set, every hundredth vector, against all vectors."""
    return _dense(spark, sf)


@query("dense_topk_filtered", f"WITH {_DENSE.format('AND q.label = v.label')} SELECT query_id, vec_id, score, rank FROM dense")
def dense_topk_filtered(spark, sf):
    return _dense(spark, sf, "label")


CELLS = 16


@query("dense_ann_topk")
def dense_ann_topk(spark, sf):
    """Approximate search: the same query set against the nearest cells only; the recall is measured in the tests."""
    e = table(spark, sf, "embeddings")
    centres, q = R.fit_cells(e, "embedding", CELLS), e.where("vec_id % 100 = 0")
    near = R.assign_cells(e, "embedding", centres)
    return R.dense_ann(near, "vec_id", "embedding", q, K, centres, R.tune_probes(near, "vec_id", "embedding", q, K, centres)).select("query_id", "vec_id", "score", "rank")


def _fuse_sql(a: float, b: float) -> str:
    return f"""WITH {_BM25}, {_TOPIC},
u AS (SELECT query_id, doc_id, {a}::DOUBLE / (60 + rank) AS s FROM lex UNION ALL SELECT query_id, doc_id, {b}::DOUBLE / (60 + rank) FROM topic),
f AS (SELECT query_id, doc_id, round(sum(s), 6) AS score, count(*) AS lists FROM u GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= {K}"""


def fused(spark, sf, a=1.0, b=1.0):
    return R.rrf([(lexical(spark, sf), a), (topical(spark, sf), b)], K)


@query("rrf_fuse", _fuse_sql(1.0, 1.0))
def rrf_fuse(spark, sf):
    return fused(spark, sf)


@query("weighted_rrf", _fuse_sql(0.7, 0.3))
def weighted_rrf(spark, sf):
    return fused(spark, sf, 0.7, 0.3)


@query("rank_list_outer_merge", f"WITH {_BM25}, {_TOPIC} SELECT coalesce(l.query_id, t.query_id) AS query_id, coalesce(l.doc_id, t.doc_id) AS doc_id, l.rank AS lexical_rank, t.rank AS topic_rank FROM lex l FULL JOIN topic t ON l.query_id = t.query_id AND l.doc_id = t.doc_id")
def rank_list_outer_merge(spark, sf):
    a = lexical(spark, sf).select("query_id", "doc_id", F.col("rank").alias("lexical_rank"))
    b = topical(spark, sf).select("query_id", "doc_id", F.col("rank").alias("topic_rank"))
    return a.join(b, ["query_id", "doc_id"], "full")


_SCORER = f"""
sc AS (SELECT f.query_id, f.doc_id, f.rank, list_distinct({TOKENS_SQL.format('left(e.item_text, 512)')}) AS a, list_distinct({TOKENS_SQL.format('left(d.text, 512)')}) AS b FROM lex f JOIN eval_items e ON e.item_id = f.query_id JOIN documents d USING (doc_id)),
o AS (SELECT query_id, doc_id, rank, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b))::DOUBLE / len(a), 6) ELSE 0.0::DOUBLE END AS new_score, count(*) OVER (PARTITION BY query_id) AS n FROM sc)"""


def _with_texts(spark, sf, hits):
    items = table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), "item_text")
    return hits.join(items, "query_id").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query("rerank_topk", f"WITH {_BM25}, {_SCORER} SELECT query_id, doc_id, rank, new_score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 5 THEN -rank ELSE new_score END DESC, rank, doc_id) AS new_rank FROM o) WHERE new_rank <= 5")
def rerank_topk(spark, sf):
    x = _with_texts(spark, sf, lexical(spark, sf))
    return R.rerank(x, 5, R.token_overlap(F.col("item_text"), F.col("text"))).select("query_id", "doc_id", "rank", "new_score", "new_rank")


_CORRECT = f"""{_BM25}, {_TOPIC}, best AS (SELECT e.item_id AS query_id, CASE WHEN max(score) >= 6 THEN 'HIGH' WHEN max(score) >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS quality FROM eval_items e LEFT JOIN topic t ON t.query_id = e.item_id GROUP BY ALL)"""


@query("corrective_retry", f"WITH {_CORRECT} SELECT query_id, doc_id, score, rank, 1 AS attempts FROM topic WHERE query_id NOT IN (SELECT query_id FROM best WHERE quality = 'LOW') UNION ALL SELECT query_id, doc_id, score, rank, 2 FROM lex WHERE query_id IN (SELECT query_id FROM best WHERE quality = 'LOW')")
def corrective_retry(spark, sf):
    """Where the list restricted to the query's class is poor, the unrestricted list takes its place."""
    items = table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"))
    inside = topical(spark, sf)
    top = F.max("score")
    quality = items.join(inside, "query_id", "left").groupBy("query_id").agg(F.when(top >= 6, "HIGH").when(top >= 4, "MEDIUM").otherwise("LOW").alias("quality"))
    cols = ["query_id", "doc_id", "score", "rank"]
    return R.corrective(inside.select(*cols), lexical(spark, sf).select(*cols), quality)


_REWRITTEN = "rewritten AS (SELECT item_id, coalesce(task || ' ' || cwe_id || ' ' || item_text, item_text) AS item_text FROM eval_items), " + _BM25.replace("FROM eval_items)", "FROM rewritten)")


@query("rewritten_retrieval", f"WITH {_REWRITTEN} SELECT query_id, doc_id, score, rank FROM lex")
def rewritten_retrieval(spark, sf):
    """Queries replaced by rewritten ones where there is a rewrite."""
    docs, items = table(spark, sf, "documents").where("text is not null"), table(spark, sf, "eval_items")
    rewrites = items.select("item_id", F.concat("task", F.lit(" "), "cwe_id", F.lit(" "), "item_text").alias("rewrite"))
    queries = items.join(rewrites, "item_id", "left").select("item_id", F.coalesce("rewrite", "item_text").alias("item_text"))
    return R.bm25(docs, "doc_id", "text", queries, "item_id", "item_text", K)


@query("retrieval_plan", f"WITH {_BM25}, {_TOPIC}, u AS (SELECT query_id, doc_id, 0.7::DOUBLE / (60 + rank) AS s FROM topic UNION ALL SELECT query_id, doc_id, 0.3::DOUBLE / (60 + rank) FROM lex), f AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM u GROUP BY ALL) SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 5")
def retrieval_plan(spark, sf):
    """Two lists, weighted fusion, the five best."""
    return R.rrf([(topical(spark, sf), 0.7), (lexical(spark, sf), 0.3)], 5).drop("lists")


@query("fence_and_number_decode", "SELECT doc_id, CASE WHEN contains(upper(text), 'HIGH') THEN 'HIGH' WHEN contains(upper(text), 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END AS quality, CASE WHEN n_chars IS NULL THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(10.0::DOUBLE, n_chars::DOUBLE)) / 10 END AS score, regexp_matches(lower(text), 'passed|yes|true') AS passed FROM documents WHERE text IS NOT NULL")
def fence_and_number_decode(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", R.quality_word(F.col("text")).alias("quality"), R.leading_score(F.concat(F.col("n_chars").cast("string"), F.lit(" of it"))).alias("score"), F.lower("text").rlike("passed|yes|true").alias("passed"))
