"""Near-duplicate texts by multi-index hashing.

Fingerprint.  A text is the set of its n-word shingles.  Its fingerprint has
`segments` x `width` symbols of 16 bits; symbol i is the low half of the
smallest shingle hash under the i-th hash function, so two texts of similarity
J agree in a symbol with probability J, and the Hamming distance (number of
differing symbols) estimates 1 - J.

Index.  Two fingerprints within distance 2 * segments - 1 have a segment with
at most one differing symbol (pigeonhole).  The Hamming ball of radius 1 of
every segment is therefore enumerated, as the `width` patterns with one symbol
left out, and texts that meet in any pattern are candidates.  Beyond that
distance a pair is still found with high probability: with 12 segments of 6,
0.9986 at J = 0.70, 0.9999 at 0.75 and more above.

Verification.  Candidates whose complete distance exceeds `max_distance` are
dropped (at J = 0.7 that is more than five standard deviations away), the rest
are compared exactly on their shingle sets.

Cost and skew.  Texts of a field with the same words in the same order are one
row, found by aggregation before any pattern is made, so copies multiply
nothing: patterns, blocks and candidates are of different texts, and records
come back by membership.  Patterns are counted with map-side partial counts;
patterns of one text vanish there, patterns of two texts give their pair from
the minimum and the maximum at once, and only larger ones are looked up again.
A pattern with more than `block` texts is never gathered: its members are
spread over blocks, and each pair of blocks is a task of bounded size that
returns only pairs within the distance, each from the first pattern that the
two share.  No pattern, partner or candidate is capped.

Edge cases.  Null texts and texts of fewer than n words have no shingles and
take part in nothing.  Repeated rows count once.  Empty tables give empty
results.  Other columns of the input are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import text as X
from corpuslens.llm.components import connected_components
from corpuslens.llm.joins import HOT_ROWS, is_small, join_hot
from corpuslens.storage import discard, materialise, spread


@dataclass(frozen=True)
class NearDupConfig:
    """words: shingle length; threshold: least similarity; segments, width: shape of the fingerprint."""

    words: int = 5
    threshold: float = 0.8
    segments: int = 12
    width: int = 6
    max_distance: int = 46
    block: int = 256
    #: up to so many keys of candidate texts are broadcast (8 bytes, some 50 in the JVM's hash table), more are joined by shuffle
    broadcast_keys: int = 100_000

    @property
    def symbols(self) -> int:
        return self.segments * self.width


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprints(h: np.ndarray, offsets: np.ndarray, symbols: int) -> np.ndarray:
    """16-bit minima per text; every text must have at least one shingle."""
    out = np.empty((len(offsets) - 1, symbols), np.uint16)
    for i, (a, b) in enumerate(zip(_odd(symbols, 7), _odd(symbols, 8))):
        v = ((h ^ b) * a) >> np.uint64(24)
        out[:, i] = np.minimum.reduceat(v, offsets[:-1]).astype(np.uint16) if len(out) else 0
    return out


def patterns(fp: np.ndarray, groups: np.ndarray, cfg: NearDupConfig) -> np.ndarray:
    """Hashes of the radius-1 patterns, texts x (segments * width); groups keeps fields apart."""
    place = _odd(cfg.symbols, 9)
    terms = X.mix((fp.astype(np.uint64) + np.uint64(1)) * place)
    by = terms.reshape(len(fp), cfg.segments, cfg.width)
    total = by.sum(axis=2, dtype=np.uint64)
    left_out = _odd(cfg.symbols, 10).reshape(cfg.segments, cfg.width)
    return X.mix(total[:, :, None] - by + left_out[None] + groups[:, None, None]).reshape(len(fp), cfg.symbols)


def _gkey(field: str, words: list[bytes]) -> bytes:
    """Key of all texts of a field that have the same words in the same order."""
    return xxhash.xxh3_128_digest(b"\0".join([field.encode(), *words]))


def _short(gkey: bytes) -> int:
    return int.from_bytes(gkey[:8], "little", signed=True)


def _keyed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [_gkey(f, X.words(t)) for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(map(_short, keys), pa.int64()), pa.array(keys, pa.binary()), b.column(1)], names=["k", "gkey", "text"])


def _features(cfg: NearDupConfig):
    schema = "code_field string, sample_id string, gkey binary, k long, fp binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            lists, flat, offsets = X.batch_words(b.column(2).to_pylist())
            h, owner = X.batch_shingles(flat, offsets, cfg.words)
            h, at = X.distinct_per_text(h, owner, len(lists))
            has = np.flatnonzero(np.diff(at))
            starts = np.append(at[has], len(h))
            fp = fingerprints(h, starts, cfg.symbols)
            keys = [_gkey(fields[i], lists[i]) for i in has]
            k = np.array([_short(x) for x in keys], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([fields[i] for i in has], pa.string()),
                    pa.array([ids[i] for i in has], pa.string()),
                    pa.array(keys, pa.binary()),
                    pa.array(k, pa.int64()),
                    pa.array([r.tobytes() for r in fp], pa.binary()),
                ],
                names=["code_field", "sample_id", "gkey", "k", "fp"],
            )

    return run, schema


def _fp_matrix(column: pa.Array, cfg: NearDupConfig) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, cfg.symbols)


def _pattern_rows(cfg: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            groups = np.array([xxhash.xxh3_64_intdigest(x) for x in b.column(0).to_pylist()], np.uint64)
            p = patterns(_fp_matrix(b.column(2), cfg), groups, cfg)
            k = np.repeat(b.column(1).to_numpy(), p.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(p.ravel().view(np.int64)), pa.array(k)], names=["pattern", "k"])

    return run, "pattern long, k long"


def _close(cfg: NearDupConfig):
    """Keeps candidate pairs within the complete Hamming distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = (_fp_matrix(b.column(2), cfg) != _fp_matrix(b.column(3), cfg)).sum(axis=1)
                yield b.select([0, 1, 4, 5]).filter(pa.array(d <= cfg.max_distance))

    return run, "gkey_a binary, gkey_b binary, ka long, kb long"


def _exact(cfg: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (X.shingle_sets(b.column(i).to_pylist(), cfg.words) for i in (2, 3))
            sim = [X.jaccard(x, y) for x, y in zip(left, right)]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim, pa.float64())], names=["gkey_a", "gkey_b", "similarity"])
            yield out.filter(pa.array([s >= cfg.threshold - 1e-12 for s in sim], pa.bool_()))

    return run, "gkey_a binary, gkey_b binary, similarity double"


def _block_pairs(cfg: NearDupConfig):
    """Pairs within the distance between two blocks of one hot pattern, or within one block; each pair at the first pattern it shares."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = np.array([xxhash.xxh3_64_intdigest(pdf.code_field.iloc[0])], np.uint64)
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        same = bool((pdf.i == pdf.j).all())
        right = left if same else right
        a, b = (np.frombuffer(b"".join(x.fp), np.uint16).reshape(-1, cfg.symbols) for x in (left, right))
        pa_, pb = (patterns(x, np.repeat(group, len(x)), cfg) for x in (a, b))
        this = np.uint64(int(pdf.pattern.iloc[0]) & 0xFFFFFFFFFFFFFFFF)
        ka, kb = left.k.to_numpy(), right.k.to_numpy()
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in range(len(a)):
            hit = np.flatnonzero((b != a[n]).sum(axis=1) <= cfg.max_distance)
            hit = hit[kb[hit] > ka[n]] if same else hit[kb[hit] != ka[n]]
            shared = pb[hit] == pa_[n]
            hit = hit[pa_[n][shared.argmax(axis=1)] == this] if len(hit) else hit
            out_a.append(np.minimum(kb[hit], ka[n]))
            out_b.append(np.maximum(kb[hit], ka[n]))
        return pd.DataFrame({"ka": np.concatenate(out_a), "kb": np.concatenate(out_b)})

    return run, "ka long, kb long"


@dataclass
class NearDuplicates:
    """members: gkey of every record and field; texts: gkey of every different text; links: verified pairs of them (gkey_a < gkey_b); patterns: texts per shared pattern."""

    members: DataFrame
    texts: DataFrame
    links: DataFrame
    patterns: DataFrame

    def pairs(self) -> DataFrame:
        """(code_field, id_a, id_b): every pair of different records, id_a < id_b, copies included."""
        m = self.members
        a, b = (m.select(F.col("gkey").alias(f"gkey_{x}"), F.col("sample_id").alias(f"id_{x}"), *([F.col("code_field")] if x == "a" else [])) for x in "ab")
        copies = a.join(b.withColumnRenamed("gkey_b", "gkey_a"), "gkey_a").where("id_a < id_b").select("code_field", "id_a", "id_b")
        near = self.links.join(a, "gkey_a").join(b, "gkey_b").where("id_a <> id_b")
        near = near.select("code_field", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        return copies.unionByName(near).distinct()

    def groups(self) -> DataFrame:
        """(code_field, sample_id, group_id, n_links): one row per record and field with its class.

        group_id is the smallest sample_id of the connected class, n_links the
        number of different texts linked to the record's own.
        """
        key = lambda c: F.hex(c)
        links = self.links.select(key("gkey_a").alias("a"), key("gkey_b").alias("b"))
        comp = connected_components(links, "a", "b")
        degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("n_links"))
        # one row per text; records, of which one text may have very many, are joined once at the end
        t = self.texts.select("code_field", key("gkey").alias("a"), "first_id").join(comp.withColumnRenamed("node", "a"), "a", "left").join(degree, "a", "left")
        t = materialise(t.withColumn("component", F.coalesce("component", "a")), "near-classes")
        names = t.groupBy("component").agg(F.min("first_id").alias("group_id"))
        t = join_hot(t, names, "component", "a").select("a", "group_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        m = self.members.select("code_field", "sample_id", key("gkey").alias("a"))
        return join_hot(m, t, "a", "sample_id").select("code_field", "sample_id", "group_id", "n_links").distinct()


def near_duplicates(df: DataFrame, id_col: str, fields: list[str], cfg: NearDupConfig = NearDupConfig()) -> NearDuplicates:
    """Near-duplicates among the texts of each field on its own; see the module's notes."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("string").alias("sample_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("code_field"), F.col(f).alias("text")) for f in fields))).alias("x"))
    rows = spread(rows.select("x.code_field", "sample_id", "x.text").where("sample_id is not null and text is not null"))
    run, schema = _features(cfg)
    feats = materialise(rows.mapInArrow(run, schema), "near-features")
    members = feats.select("code_field", "sample_id", "gkey").distinct()
    one = feats.groupBy("gkey").agg(F.first("code_field").alias("code_field"), F.first("k").alias("k"), F.first("fp").alias("fp"), F.min("sample_id").alias("first_id"))
    one = materialise(one, "near-texts")

    run, schema = _pattern_rows(cfg)
    pats = one.select("code_field", "k", "fp").mapInArrow(run, schema)
    count = pats.groupBy("pattern").agg(F.count("*").alias("n"), F.min("k").alias("ka"), F.max("k").alias("kb")).where("ka <> kb")
    count = materialise(count, "near-patterns")
    pairs = count.where("n = 2").select("ka", "kb")

    shared = count.where("n > 2").select("pattern", "n")
    many = join_hot(pats, shared, "pattern", "k", "inner", shared.where(F.col("n") > HOT_ROWS).select("pattern")).select("pattern", "k", "n")
    cold = many.where(F.col("n") <= cfg.block).groupBy("pattern").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    cold = cold.select(F.posexplode("ks").alias("at", "ka"), "ks").select("ka", F.explode(F.slice("ks", F.col("at") + 2, F.size("ks"))).alias("kb"))
    pairs = pairs.union(cold)

    if count.where(F.col("n") > cfg.block).limit(1).count():
        blocks = F.ceil(F.col("n") / F.lit(cfg.block)).cast("int")
        hot = many.where(F.col("n") > cfg.block).withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
        hot = hot.join(one.select("k", "code_field", "fp"), "k")
        keep = ("pattern", "code_field", "k", "fp")
        here = hot.select(*keep, F.lit(0).alias("side"), "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
        there = hot.where("i > 0").select(*keep, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("x"), F.col("i").alias("j")).withColumnRenamed("x", "i")
        run, schema = _block_pairs(cfg)
        pairs = pairs.union(here.unionByName(there).groupBy("pattern", "i", "j").applyInPandas(run, schema))
    pairs = pairs.distinct()

    a, b = (one.select(F.col("k").alias(f"k{x}"), F.col("gkey").alias(f"gkey_{x}"), F.col("fp").alias(f"fp_{x}")) for x in "ab")
    run, schema = _close(cfg)
    close = pairs.join(a, "ka").join(b, "kb").select("gkey_a", "gkey_b", "fp_a", "fp_b", "ka", "kb").mapInArrow(run, schema)
    close = materialise(close, "near-candidates")
    # only texts that are in a candidate pair are read again for the exact comparison
    need = close.select(F.col("ka").alias("k")).union(close.select("kb")).distinct()
    need = F.broadcast(need) if is_small(need, cfg.broadcast_keys) else need
    texts = rows.select("code_field", "text").mapInArrow(_keyed_texts, "k long, gkey binary, text string")
    texts = texts.join(need, "k", "left_semi").groupBy("gkey").agg(F.first("text").alias("text"))
    run, schema = _exact(cfg)
    links = close.join(texts.toDF("gkey_a", "text_a"), "gkey_a").join(texts.toDF("gkey_b", "text_b"), "gkey_b")
    links = links.select("gkey_a", "gkey_b", "text_a", "text_b").mapInArrow(run, schema)
    links = materialise(links, "near-links")
    discard(close)
    return NearDuplicates(members, one.select("code_field", "gkey", "first_id"), links, count.select("pattern", "n"))
