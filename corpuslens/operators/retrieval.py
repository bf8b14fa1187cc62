"""Lexical and dense top-k search, rank fusion, reranking and corrective retries.

A search is a scan: the queries, a stated set, go to the tasks in blocks of
bounded size, each task scores batches of documents against a block by one
product of matrices and keeps the k best per query, so what is shuffled is k
rows per query and task.  Corpora are never collected or joined with queries,
and neither a common term nor a large class is a key of a join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuslens.functions import text as T
from corpuslens.storage import materialise, spread

#: Queries that are sent to the tasks in one piece; more are more blocks of the same scan.
QUERY_BLOCK = 2_000
#: Cells of a block's matrix of terms and queries; blocks of long queries are smaller.
MAX_CELLS = 8_000_000


def top_k(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per group with their rank from 1; ties go to the smaller `tie`."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), F.asc(tie)))).where(F.col("rank") <= k)


@dataclass(frozen=True)
class BM25:
    """Okapi parameters; idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""

    k1: float = 1.5
    b: float = 0.75


class Best:
    """The k best documents of each query so far; ties go to the smaller id, and an id counts once."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.least = np.full(queries, -np.inf)
        self.score: list[np.ndarray] = [np.zeros(0)] * queries
        self.ids: list[np.ndarray | None] = [None] * queries

    def add(self, ids: np.ndarray, scores: np.ndarray, columns: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """scores: documents x columns, the numbers of queries; allowed: which of them may count."""
        if not len(ids) or not len(columns):
            return
        may = scores >= self.least[columns]
        may = may if allowed is None else may & allowed
        for j in np.flatnonzero(may.any(axis=0)).tolist():
            at, q = np.flatnonzero(may[:, j]), int(columns[j])
            s, i = scores[at, j], ids[at]
            if len(at) > 4 * self.k:  # no more than what can be among the k best, with its ties
                top = s >= np.partition(s, -self.k)[-self.k]
                s, i = s[top], i[top]
            if self.ids[q] is not None:
                s, i = np.append(s, self.score[q]), np.append(i, self.ids[q])
            order = np.lexsort((i, -s))
            s, i = s[order], i[order]
            _, first = np.unique(i, return_index=True)
            keep = np.sort(first)[: self.k]
            self.score[q], self.ids[q] = s[keep], i[keep]
            if len(keep) == self.k:
                self.least[q] = s[keep[-1]]

    def rows(self, query_ids: list) -> tuple[list, list, list]:
        out: tuple[list, list, list] = ([], [], [])
        for q, ids, score in zip(query_ids, self.ids, self.score):
            if ids is not None:
                out[0].extend([q] * len(ids))
                out[1].extend(ids.tolist())
                out[2].extend(score.tolist())
        return out


def _ids(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist())


def _scan(rows: DataFrame, blocks: list, score: Callable, query_type, doc_type, k: int, names: tuple[str, str]) -> DataFrame:
    """(query, document, score) with the k best of each task; score(batch, block) yields (rows of the batch, scores, columns, allowed)."""
    kinds = [to_arrow_type(query_type), to_arrow_type(doc_type), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(b.value["ids"]), k) for b in blocks]
        for batch in batches:
            ids = _ids(batch.column(0))
            for b, keep in zip(blocks, best):
                for at, scores, columns, allowed in score(batch, b.value):
                    keep.add(ids[at], scores, columns, allowed)
        for b, keep in zip(blocks, best):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(keep.rows(b.value["ids"]), kinds)], names=[*names, "score"])

    return rows.mapInArrow(run, f"{names[0]} {query_type.simpleString()}, {names[1]} {doc_type.simpleString()}, score double")


def _top(hits: DataFrame, doc: str, k: int) -> DataFrame:
    """The k best of all tasks; an id that several tasks have counts once."""
    best = hits.groupBy("query_id", doc).agg(F.max("score").alias("score"))
    return top_k(best, ["query_id"], "score", doc, k)


def _query_blocks(queries: DataFrame) -> Iterator[list]:
    """Rows of a query set in blocks of about QUERY_BLOCK, each collected on its own."""
    some = queries.limit(QUERY_BLOCK + 1).collect()
    if len(some) <= QUERY_BLOCK:
        yield some
        return
    queries = materialise(queries, "search-queries")
    parts = -(-queries.count() // QUERY_BLOCK)
    for n in range(parts):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == n).collect()  # about QUERY_BLOCK rows


_IDENTIFIER, _HUMP = re.compile("[A-Za-z_][A-Za-z0-9_]*"), re.compile("([a-z0-9])([A-Z])")


class _Identifiers(dict):
    """Number of an identifier; of each number the terms it has as `text.code_tokens` cuts it, and those of a vocabulary.

    Forgets all between batches when it holds more than `bound`, so its memory is bounded.
    """

    def __init__(self, vocabulary: dict[str, int], bound: int = 300_000) -> None:
        super().__init__()
        self.vocabulary, self.bound, self.size, self.known = vocabulary, bound, [], []

    def __missing__(self, name: str) -> int:
        parts = [p for p in _HUMP.sub(r"\1 \2", name).replace("_", " ").lower().split(" ") if len(p) >= 2 and not p.isdigit()]
        self.size.append(len(parts))
        self.known.append([self.vocabulary[p] for p in parts if p in self.vocabulary])
        self[name] = n = len(self.size) - 1
        return n

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text in all, and text, term and occurrences of those of the vocabulary."""
        if len(self) > self.bound:
            self.clear()
            self.size, self.known = [], []
        flat: list[int] = []
        ends = [0]
        for t in texts:
            flat.extend(map(self.__getitem__, _IDENTIFIER.findall(t)))
            ends.append(len(flat))
        number, owner = np.array(flat, np.int64), np.repeat(np.arange(len(texts)), np.diff(ends))
        size = np.bincount(owner, np.array(self.size, float)[number], len(texts)).astype(np.int32) if flat else np.zeros(len(texts), np.int32)
        many = np.array([len(k) for k in self.known], np.int64)
        terms, first = np.array([t for k in self.known for t in k], np.int64), np.cumsum(many) - many
        n = many[number] if flat else number
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[number] if flat else number, n)
        width = max(1, len(self.vocabulary))
        pair, tf = np.unique(np.repeat(owner, n) * width + terms[at] if len(at) else at, return_counts=True)
        return size, pair // width, pair % width, tf


def _term_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, same, length, terms, tfs) of all documents that have tokens: only terms of the vocabulary are stored, by number."""
    kind = docs.schema["doc_id"].dataType.simpleString(), docs.schema["same"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifiers = _Identifiers(vocabulary.value)
        for b in batches:
            size, owner, term, tf = identifiers.count(b.column(2).to_pylist())
            ends = pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32))
            terms, tfs = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf))
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), terms, tfs], names=["doc_id", "same", "length", "terms", "tfs"])
            yield out.filter(pa.array(size > 0))

    return docs.where("text is not null").select("doc_id", "same", "text").mapInArrow(run, f"doc_id {kind[0]}, same {kind[1]}, length int, terms array<int>, tfs array<int>")


def _document_frequencies(counts: DataFrame) -> DataFrame:
    """(term, documents), counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(b.column(0).flatten().to_numpy(), minlength=len(total))
            n[: len(total)] += total
            total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["t", "n"])

    return counts.select("terms").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def _products(weigh: Callable):
    """Scores of a batch of term counts: one sum of weighted rows of the block's matrix per document, class by class where classes must agree."""

    def score(batch: pa.RecordBatch, block: dict):
        terms, tfs = batch.column(3), batch.column(4)
        offsets = terms.offsets.to_numpy()
        t, tf = terms.values.to_numpy(), tfs.values.to_numpy().astype(float)
        row = np.full(block["terms"], -1)
        row[block["rows"]] = np.arange(len(block["rows"]))
        weight = weigh(tf, np.repeat(batch.column(2).to_numpy(), np.diff(offsets)), block) if len(tf) else tf
        at = row[t]
        classes = batch.column(1).to_pylist() if block["same"] is not None else [None] * batch.num_rows
        for c in set(classes):
            columns = np.arange(len(block["ids"])) if block["same"] is None else np.flatnonzero([c is not None and c == x for x in block["same"]])
            mine = np.array([i for i, x in enumerate(classes) if x == c]) if block["same"] is not None else np.arange(batch.num_rows)
            if not len(columns):
                continue
            matrix = block["matrix"] if block["same"] is None else block["matrix"][:, columns]
            step = max(1, MAX_CELLS // max(1, len(columns)))
            for a in range(0, len(mine), step):
                part = mine[a : a + step]
                scores = np.zeros((len(part), len(columns)))
                for i, d in enumerate(part.tolist()):
                    x, z = offsets[d], offsets[d + 1]
                    r, w = at[x:z], weight[x:z]
                    scores[i] = w[r >= 0] @ matrix[r[r >= 0]]
                yield part, np.round(scores, 6), columns, scores > 5e-7

    return score


def _lexical(docs: DataFrame, queries: DataFrame, k: int, weigh: Callable, cell: Callable, params: dict, with_idf: bool) -> DataFrame:
    """Top k by sums over common terms; docs (doc_id, same, text), queries (query_id, same, text); nothing is weighed by class where `same` is null type."""
    spark, classed = docs.sparkSession, docs.schema["same"].dataType.typeName() != "void"
    doc_type, query_type = docs.schema["doc_id"].dataType, queries.schema["query_id"].dataType
    docs = docs.where("doc_id is not null").withColumn("same", F.col("same").cast("string"))
    queries = queries.where("query_id is not null")
    out = None
    for rows in _query_blocks(queries.select("query_id", F.col("same").cast("string").alias("same"), T.code_tokens(F.col("text")).alias("toks")).where(F.size("toks") > 0)):
        names = sorted({t for r in rows for t in r.toks})
        number = {t: i for i, t in enumerate(names)}
        counts = materialise(_term_counts(spread(docs), spark.sparkContext.broadcast(number)), "search-counts")
        stats = {}
        if with_idf:
            n, length = counts.agg(F.count("*"), F.avg("length")).first()
            df = np.zeros(len(names))
            for t, m in _document_frequencies(counts).collect():  # a row per term of the block's queries
                df[t] = m
            stats = {"idf": np.log(1 + (n - df + 0.5) / (df + 0.5)), "average": length}
        blocks, at = [], 0
        while at < len(rows):
            part, used = [], set()
            while at < len(rows) and (not part or (len(part) + 1) * len(used | set(rows[at].toks)) <= MAX_CELLS):
                used |= set(rows[at].toks)
                part.append(rows[at])
                at += 1
            use = np.array(sorted(number[t] for t in used))
            place = {int(t): i for i, t in enumerate(use)}
            matrix = np.zeros((len(use), len(part)))
            for j, r in enumerate(part):
                for t in r.toks:
                    i = place[number[t]]
                    matrix[i, j] = cell(matrix[i, j], number[t], stats)
            blocks.append(spark.sparkContext.broadcast({"ids": [r.query_id for r in part], "same": [r.same for r in part] if classed else None, "rows": use, "terms": len(names), "matrix": matrix, **params, "average": stats.get("average")}))
        if blocks:
            hits = _scan(counts, blocks, _products(weigh), query_type, doc_type, k, ("query_id", "doc_id"))
            out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], f"query_id {query_type.simpleString()}, doc_id {doc_type.simpleString()}, score double")
    return _top(out, "doc_id", k)


def bm25(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, k: int, params: BM25 = BM25()) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents per query with a score above 0.

    The corpus is read once per block of queries; of each document its length
    and the counts of the queries' terms are stored, from which the document
    frequencies and then the scores come.  A query's repeated terms count each.
    """
    weigh = lambda tf, length, p: tf * (p["k1"] + 1) / (tf + p["k1"] * (1 - p["b"] + p["b"] * length / p["average"]))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.lit(None).alias("same"), F.col(text).alias("text"))
    q = queries.select(F.col(query_id).alias("query_id"), F.lit(None).alias("same"), F.col(query_text).alias("text"))
    return _lexical(d, q, k, weigh, lambda x, t, s: x + s["idf"][t], {"k1": params.k1, "b": params.b}, True)


def shared_terms(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, k: int, same: str) -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents of the query's class, a column of both sides, with the most distinct terms in common."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(same).alias("same"), F.col(text).alias("text"))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(same).alias("same"), F.col(query_text).alias("text"))
    return _lexical(d, q, k, lambda tf, length, p: np.ones(len(tf)), lambda x, t, s: 1.0, {}, False)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a vector of this width without nulls, and the vectors in double precision."""
    size = np.diff(column.offsets.to_numpy())
    at = np.flatnonzero((size == width) & np.asarray(column.is_valid()))
    if not len(at) or not width:
        return at[:0], np.zeros((0, width))
    x = np.array([v.values.to_numpy(zero_copy_only=False) for v in column.take(pa.array(at))], float)
    sound = ~np.isnan(x).any(axis=1)
    return at[sound], x[sound]


def _dense_blocks(queries: DataFrame, extra: Callable[[np.ndarray], dict] | None = None) -> list:
    """Broadcasts of the queries (query_id, vec, same), block by block."""
    spark, blocks = queries.sparkSession, []
    for rows in _query_blocks(queries.where("query_id is not null and vec is not null")):
        width = max((len(r.vec) for r in rows), default=0)
        rows = [r for r in rows if len(r.vec) == width and None not in r.vec]
        vectors = np.array([r.vec for r in rows], float).reshape(len(rows), width)
        blocks.append(spark.sparkContext.broadcast({"ids": [r.query_id for r in rows], "own": np.array([r.query_id for r in rows]), "same": [r.same for r in rows], "vectors": vectors, **(extra(vectors) if extra else {})}))
    return blocks


def _dots(classed: bool):
    def score(batch: pa.RecordBatch, block: dict):
        if not block["ids"]:
            return
        at, x = _matrix(batch.column(2), block["vectors"].shape[1])
        ids, columns = _ids(batch.column(0)), np.arange(len(block["ids"]))
        same = np.array(batch.column(1).to_pylist(), object)[at] if classed else None
        theirs = np.array(block["same"], object)
        step = max(1, MAX_CELLS // len(columns))
        for a in range(0, len(at), step):
            part = at[a : a + step]
            allowed = ids[part][:, None] != block["own"][None, :]
            if classed:
                allowed &= (same[a : a + step][:, None] == theirs[None, :]) & np.array([s is not None for s in same[a : a + step]])[:, None]
            yield part, np.round(x[a : a + step] @ block["vectors"].T, 6), columns, allowed

    return score


def dense(corpus: DataFrame, vec_id: str, vector: str, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k most similar vectors per query by dot product, the query itself left out.

    same: a column that must be equal on both sides, applied before the search.
    Null vectors, vectors with a null and vectors of another length than the
    queries' match nothing.  The corpus is read once, whatever the number of queries.
    """
    label = F.lit(None).cast("string") if same is None else F.col(same).cast("string")
    q = queries.select(F.col(vec_id).alias("query_id"), F.col(vector).alias("vec"), label.alias("same"))
    rows = spread(corpus.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("vec_id"), label.alias("same"), F.col(vector).alias("vec")))
    hits = _scan(rows, _dense_blocks(q), _dots(same is not None), queries.schema[vec_id].dataType, corpus.schema[vec_id].dataType, k, ("query_id", "vec_id"))
    return _top(hits, "vec_id", k)


# ---- approximate search by coarse cells ------------------------------------------------------------


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the n centres with the largest dot product, nearest first."""
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n]


def fit_cells(corpus: DataFrame, vector: str, cells: int, sample: int = 20_000, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Centres of `cells` cells by spherical k-means on at most `sample` vectors, a documented bound of the fit; every row is indexed afterwards."""
    total = corpus.count()
    some = corpus.select(vector).where(F.col(vector).isNotNull())
    some = some.sample(min(1.0, 1.2 * sample / max(1, total)), seed=seed).limit(sample) if total > sample else some
    rows = [r[0] for r in some.collect() if None not in r[0]]  # at most `sample` vectors
    x = np.array(rows, float).reshape(len(rows), -1)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def assign_cells(corpus: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """corpus with `cell`, the nearest centre of every row; -1 without a vector of the centres' width."""
    shared = corpus.sparkSession.sparkContext.broadcast(centres)
    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType([*corpus.schema.fields, StructField("cell", IntegerType())])
    place = corpus.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            at, x = _matrix(b.column(place), c.shape[1])
            cell = np.full(b.num_rows, -1, np.int32)
            if len(at):
                cell[at] = _nearest(x, c)[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    return corpus.mapInArrow(run, schema)


def dense_ann(indexed: DataFrame, vec_id: str, vector: str, queries: DataFrame, k: int, centres: np.ndarray, probes: int) -> DataFrame:
    """As `dense`, but each query is compared with the vectors of its `probes` nearest cells only; indexed has the column `cell`.

    Cells that no query asks for are filtered before the scan, which skips their
    folders where the table is partitioned by `cell`.
    """
    q = queries.select(F.col(vec_id).alias("query_id"), F.col(vector).alias("vec"), F.lit(None).cast("string").alias("same"))
    blocks = _dense_blocks(q, lambda v: {"cells": _nearest(v, centres, probes)} if len(v) else {"cells": np.zeros((0, probes), int)})
    asked = sorted({int(c) for b in blocks for c in np.unique(b.value["cells"])})

    def score(batch: pa.RecordBatch, block: dict):
        cell = batch.column(1).to_numpy()
        at, x = _matrix(batch.column(2), block["vectors"].shape[1])
        ids = _ids(batch.column(0))
        for c in np.unique(cell[at]).tolist():
            columns, mine = np.flatnonzero((block["cells"] == c).any(axis=1)), np.flatnonzero(cell[at] == c)
            step = max(1, MAX_CELLS // max(1, len(columns)))
            for a in range(0, len(mine) if len(columns) else 0, step):
                m = mine[a : a + step]
                yield at[m], np.round(x[m] @ block["vectors"][columns].T, 6), columns, ids[at[m]][:, None] != block["own"][columns][None, :]

    rows = spread(indexed.where(F.col(vec_id).isNotNull() & F.col("cell").isin(asked)).select(F.col(vec_id).alias("vec_id"), "cell", F.col(vector).alias("vec")))
    hits = _scan(rows, blocks, score, queries.schema[vec_id].dataType, indexed.schema[vec_id].dataType, k, ("query_id", "vec_id"))
    return _top(hits, "vec_id", k)


def tune_probes(indexed: DataFrame, vec_id: str, vector: str, queries: DataFrame, k: int, centres: np.ndarray, recall: float = 0.95, sample: int = 200) -> int:
    """The fewest probes that find the share `recall` of the exact k best of at most `sample` queries, a documented bound.

    One exact scan gives the best vectors of the sample; a vector is found if its
    cell is among the probed ones.
    """
    some = queries.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).limit(sample)
    asked = {r[0]: r[1] for r in some.select(vec_id, vector).collect() if None not in r[1] and len(r[1]) == centres.shape[1]}
    best = dense(indexed, vec_id, vector, some, k).select("query_id", "vec_id")  # at most sample * k rows
    hits = indexed.select(F.col(vec_id).alias("vec_id"), "cell").join(F.broadcast(best), "vec_id").distinct().collect()
    ids = list(asked)
    order = _nearest(np.array([asked[i] for i in ids], float).reshape(len(ids), -1), centres, len(centres)) if ids else np.zeros((0, len(centres)), int)
    at = {i: {int(c): n for n, c in enumerate(row)} for i, row in zip(ids, order)}
    ranks = np.sort([at[h.query_id][h.cell] for h in hits if h.query_id in at])
    return len(centres) if not len(ranks) else int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def rrf(lists: list[tuple[DataFrame, float]], k: int, damp: int = 60, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, lists, rank): reciprocal rank fusion of ranked lists with weights; `lists` counts the lists that have the document."""
    parts = [df.select("query_id", "doc_id", (F.lit(w) / (damp + F.col("rank"))).alias("s")) for df, w in lists]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), digits).alias("score"), F.count("*").alias("lists"))
    return top_k(fused, ["query_id"], "score", "doc_id", k)


def token_overlap(a: Column, b: Column, width: int = 512) -> Column:
    """Share of the first text's distinct tokens that the second has, both cut to `width` characters: the default scorer."""
    x, y = (F.array_distinct(T.code_tokens(F.left(c, F.lit(width)))) for c in (a, b))
    return F.when(F.size(x) > 0, F.round(F.size(F.array_intersect(x, y)) / F.when(F.size(x) > 0, F.size(x)), 6)).otherwise(0.0)


def rerank(candidates: DataFrame, k: int, score: Column) -> DataFrame:
    """Candidates (query_id, doc_id, rank, ...) ordered anew by a score; a query with at most k candidates keeps its order."""
    n = F.count("*").over(W.partitionBy("query_id"))
    x = candidates.withColumns({"_n": n, "new_score": score})
    key = F.when(F.col("_n") <= k, -F.col("rank").cast("double")).otherwise(F.col("new_score"))
    order = W.partitionBy("query_id").orderBy(key.desc(), "rank", "doc_id")
    return x.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).drop("_n")


def rerank_by(candidates: DataFrame, k: int, scorer: Callable[[list[str], list[str]], list[float]], query: str = "query", text: str = "text", width: int = 512) -> DataFrame:
    """`rerank` by a scorer object, called once per Arrow batch with the queries and the texts, both cut to `width` characters as a cross-encoder reads them.

    The scorer is shipped to the tasks; null texts score as empty ones.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    cut = candidates.withColumns({"_q": F.left(F.coalesce(F.col(query), F.lit("")), F.lit(width)), "_t": F.left(F.coalesce(F.col(text), F.lit("")), F.lit(width))})
    at = cut.columns.index("_q"), cut.columns.index("_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = scorer(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist()) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([float(s) for s in scores], pa.float64())], names=[*b.schema.names, "_score"])

    scored = cut.mapInArrow(run, StructType([*cut.schema.fields, StructField("_score", DoubleType())]))
    return rerank(scored, k, F.col("_score")).drop("_q", "_t", "_score")


def rerank_by_answers(candidates: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """`rerank` by a judge's answers (query_id, doc_id, answer) from 0 to 10; a pair without a readable answer scores 0.5."""
    x = candidates.join(answers.select("query_id", "doc_id", "answer"), ["query_id", "doc_id"], "left")
    return rerank(x, k, F.coalesce(leading_score(F.col("answer")), F.lit(0.5))).drop("answer")


def corrective(filtered: DataFrame, unfiltered: DataFrame, quality: DataFrame) -> DataFrame:
    """The filtered list of each query, or the unfiltered one where the quality (query_id, quality) is LOW, with the number of attempts."""
    low = quality.where("quality = 'LOW'").select("query_id")
    a = filtered.join(low, "query_id", "left_anti").withColumn("attempts", F.lit(1))
    b = unfiltered.join(low, "query_id", "left_semi").withColumn("attempts", F.lit(2))
    return a.unionByName(b)


def quality_word(answer: Column) -> Column:
    """HIGH, else MEDIUM, else LOW, by the words of an answer."""
    up = F.upper(answer)
    return F.when(up.contains("HIGH"), "HIGH").when(up.contains("MEDIUM"), "MEDIUM").otherwise("LOW")


def leading_score(answer: Column, top: float = 10.0, default: float = 0.5) -> Column:
    """The number a text begins with, cut to 0..top and divided by top; `default` if there is none."""
    first = F.regexp_extract(answer, r"^\s*(\S+)", 1)
    return F.coalesce(T.clamp(first.try_cast("double"), 0.0, top) / top, F.lit(default))
