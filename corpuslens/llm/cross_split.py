"""Records of evaluation splits that occur again in the training split.

Method.  The words of a text are cut into content-defined chunks: a rolling
hash over `window` words ends a chunk wherever it is 0 modulo `mean`, so an
edit changes the chunks it touches and no others.  A chunk's digest hashes its
words, its weight is their number.  The overlap fraction of two texts is the
weight of their shared chunks divided by the larger text's weight.

Candidates, without loss.  No overlap fraction is certain at a similarity: one
edit ends the one or two chunks of a short text, and texts with the same
shingles can differ in length and order (repeats) and share no chunk.  So a
pair is a candidate by its shingles: with n distinct ones and the similarity t
it shares one of the n - t n + 1 rarest of each text (prefix filter), and only
those are joined across the splits.  Rarity is read from a histogram of fixed
size (COUNTERS, over all distinct shingles of both splits), which gives one
global order at any corpus size: shingles that very many records share come
last in every text, so a hot shingle that a third of all rows hold joins
nothing unless a text consists of such shingles; then its pairs are spread over
several tasks, and equal texts of a side are one row.  Sizes and the shingles still
to come prune further, and so do bitmaps of shingle parities, whose distance
is no more than the number of shingles that are in only one of the two texts;
all without loss.

Verification.  Candidates are compared exactly on the sets of their n-word
shingles; the overlap fraction of the pairs found is summed over all chunks.

Edge cases.  Null texts and texts of fewer than n words match nothing by text;
their records can still match by id.  Repeated rows count once.  Empty tables
give empty results.  Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import text as X
from corpuslens.llm.joins import is_small
from corpuslens.storage import materialise, spread

COUNTERS = 1 << 18
SALT = 32
#: bits of a bitmap of shingle parities
BITS = 512
_C = np.uint64(0x9E3779B97F4A7C15)
_D = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class OverlapConfig:
    """words, threshold: shingle length and least similarity; window, mean, longest: cutting of chunks for the overlap fraction."""

    words: int = 5
    threshold: float = 0.8
    window: int = 2
    mean: int = 4
    longest: int = 15
    #: up to so many keys of matched texts go to every task as a broadcast (some 100 bytes each in the JVM), more are joined by shuffle
    broadcast_keys: int = 100_000
    #: shingles in a bucket of more than so many are joined by several tasks
    hot_rows: int = 1_000_000


def chunk(flat: np.ndarray, offsets: np.ndarray, cfg: OverlapConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, lengths in words and text numbers of the chunks of a batch."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(n) - offsets[owner]
    roll = np.zeros(n, np.uint64)
    for i in range(cfg.window):  # words before the text's start count as 0
        roll[i:] += np.where(at[i:] >= i, flat[: n - i], np.uint64(0)) * (_C + np.uint64(2 * i))
    ends = (X.mix(roll) >> np.uint64(33)) % np.uint64(cfg.mean) == 0
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    # no chunk is longer than `longest`: long stretches without an end are cut at its multiples
    stop = np.flatnonzero(ends)
    start = np.concatenate([[0], stop[:-1] + 1])
    where = np.arange(n) - np.repeat(start, stop - start + 1)
    ends |= where % cfg.longest == cfg.longest - 1
    stop = np.flatnonzero(ends)
    start = np.concatenate([[0], stop[:-1] + 1])
    length = stop - start + 1
    inside = np.arange(n) - np.repeat(start, length)
    digest = np.add.reduceat(X.mix(flat + _D * (inside.astype(np.uint64) + np.uint64(1))), start)
    return X.mix(digest + length.astype(np.uint64)), length, owner[start]


def _distinct_chunks(flat, offsets, cfg):
    """Distinct chunks of each text: digest, length, text, ordered by text and digest."""
    d, length, owner = chunk(flat, offsets, cfg)
    order = np.lexsort((d, owner))
    d, length, owner = d[order], length[order], owner[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (owner[1:] != owner[:-1])
    return d[first], length[first], owner[first]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _histogram(cfg: OverlapConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            lists, flat, offsets = X.batch_words(b.column(0).to_pylist())
            h, _ = X.distinct_per_text(*X.batch_shingles(flat, offsets, cfg.words), len(lists))
            total += np.bincount(_bucket(h), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return run, "bucket int, n long"


def _features(cfg: OverlapConfig, counts: np.ndarray):
    """Number of distinct shingles of each text, the rarest of them in the global order, and the bitmap of all."""
    schema = "side int, sample_id string, k long, gkey binary, n_shingles int, prefix binary, bitmap binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, flat, offsets = X.batch_words(b.column(2).to_pylist())
            h, owner = X.batch_shingles(flat, offsets, cfg.words)
            h, at = X.distinct_per_text(h, owner, len(lists))
            n = np.diff(at)
            owner = np.repeat(np.arange(len(lists)), n)
            h = h[np.lexsort((h, counts[_bucket(h)], owner))]
            bit = np.bincount(owner * BITS + (h % np.uint64(BITS)).astype(np.int64), minlength=len(lists) * BITS) & 1
            bitmap = np.packbits(bit.astype(np.uint8).reshape(-1, BITS), axis=1)
            keep = n - np.ceil(cfg.threshold * n - 1e-9).astype(np.int64) + 1
            has = np.flatnonzero(n)
            keys = [xxhash.xxh3_128_digest(b"\0".join(lists[i])) for i in has]
            take = pa.array(has)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(take),
                    b.column(1).take(take),
                    pa.array([int.from_bytes(x[:8], "little", signed=True) for x in keys], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(n[has].astype(np.int32)),
                    pa.array([h[at[i] : at[i] + keep[i]].tobytes() for i in has], pa.binary()),
                    pa.array([bitmap[i].tobytes() for i in has], pa.binary()),
                ],
                names=["side", "sample_id", "k", "gkey", "n_shingles", "prefix", "bitmap"],
            )

    return run, schema


def _prefixes(hot: np.ndarray, spread_side: bool):
    """Rows of the rarest shingles of each text; rest is the number from this shingle on, in the global order.

    The key is the shingle; those of hot buckets have a salt by the text mixed in
    on one side and all salts on the other, so that the pairs of one shingle are
    found by SALT tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            parts = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            size = np.array([len(x) for x in parts])
            before = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            n, k, digest = np.repeat(n, size), np.repeat(k, size), np.concatenate(parts)
            is_hot = hot[_bucket(digest.view(np.uint64))]
            salt = np.where(is_hot, k % SALT, 0)
            if not spread_side and is_hot.any():
                at = np.repeat(np.arange(len(digest)), np.where(is_hot, SALT, 1))
                digest, k, n, before, salt = digest[at], k[at], n[at], before[at], np.arange(len(at)) - np.searchsorted(at, at)
            key = (digest.view(np.uint64) + salt.astype(np.uint64) * _D).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(k), pa.array((n - before).astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "k", "rest", "n"])

    return run, "key long, k long, rest int, n int"


def _parity(cfg: OverlapConfig):
    """Pairs that the bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (4, 5))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            both = b.column(2).to_numpy() + b.column(3).to_numpy()
            near = apart <= (1 - cfg.threshold) / (1 + cfg.threshold) * both + 1e-6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["ka", "kb"]).filter(pa.array(near))

    return run, "ka long, kb long"


def _fraction(a: tuple, b: tuple, cfg: OverlapConfig) -> list[float]:
    """Overlap fractions of the chunks of texts in pairs; a and b are flat words and offsets."""
    out, sides = [], []
    for flat, offsets in (a, b):
        d, length, owner = _distinct_chunks(flat, offsets, cfg)
        sides.append((d, length, np.searchsorted(owner, np.arange(len(offsets)))))
    (da, la, ta), (db, lb, tb) = sides
    for i in range(len(ta) - 1):
        x, y = slice(ta[i], ta[i + 1]), slice(tb[i], tb[i + 1])
        out.append(int(la[x][np.isin(da[x], db[y], assume_unique=True)].sum()) / max(int(la[x].sum()), int(lb[y].sum())))
    return out


def _keys():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            keys = [xxhash.xxh3_128_digest(b"\0".join(X.words(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(x[:8], "little", signed=True) for x in keys], pa.int64()), pa.array(keys, pa.binary()), b.column(0)], names=["k", "gkey", "text"])

    return run, "k long, gkey binary, text string"


def _exact(cfg: OverlapConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (X.shingle_sets(b.column(i).to_pylist(), cfg.words) for i in (2, 3))
            sim = np.array([X.jaccard(x, y) for x, y in zip(a, c)], np.float64)
            near = np.flatnonzero(sim >= cfg.threshold - 1e-12)
            b = b.take(pa.array(near))
            x, y = (X.batch_words(b.column(i).to_pylist())[1:] for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_fraction(x, y, cfg), pa.float64()), pa.array(sim[near])], names=["gkey_a", "gkey_b", "overlap", "similarity"])

    return run, "gkey_a binary, gkey_b binary, overlap double, similarity double"


def _texts(df: DataFrame, side: int, id_col: str, fields: list[str]) -> DataFrame:
    x = df.select(F.lit(side).alias("side"), F.col(id_col).cast("string").alias("sample_id"), F.explode(F.array(*(F.col(f) for f in fields))).alias("text"))
    return spread(x.where("sample_id is not null and text is not null"))


def cross_split_overlap(held_out: DataFrame, train: DataFrame, id_col: str, fields: list[str], cfg: OverlapConfig = OverlapConfig()) -> DataFrame:
    """(sample_id, train_id, same_id, overlap, similarity) of every overlapping pair of records.

    A pair overlaps if the ids are equal (same_id) or any text of the one and
    any text of the other are similar; overlap and similarity are those of the
    most similar pair of texts, null if only the ids agree.
    """
    texts = _texts(held_out, 0, id_col, fields).unionByName(_texts(train, 1, id_col, fields))
    run, schema = _histogram(cfg)
    counts = np.zeros(COUNTERS, np.int64)
    for bucket, n in texts.select("text").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n")).collect():  # at most COUNTERS rows
        counts[bucket] = n
    run, schema = _features(cfg, counts)
    feats = materialise(texts.mapInArrow(run, schema), "overlap-features")

    once = lambda s, c: feats.where(F.col("side") == s).groupBy("gkey").agg(F.first("k").alias("k"), F.first("n_shingles").alias("n"), F.first(c).alias(c)).drop("gkey")
    sides = [_prefixes(counts > cfg.hot_rows, s == 0) for s in (0, 1)]
    a, b = (once(s, "prefix").mapInArrow(*sides[s]).select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("k", "rest", "n"))) for s, x in enumerate("ab"))
    shared = cfg.threshold / (1 + cfg.threshold) * (F.col("n_a") + F.col("n_b")) - 1e-6
    close = (F.least("n_a", "n_b") >= cfg.threshold * F.greatest("n_a", "n_b") - 1e-6) & (F.least("rest_a", "rest_b") >= shared)
    pairs = a.join(b, "key").where(close).select(F.col("k_a").alias("ka"), F.col("k_b").alias("kb")).distinct()

    run, schema = _parity(cfg)
    wide = pairs.join(once(0, "bitmap").toDF("ka", "na", "ba"), "ka").join(once(1, "bitmap").toDF("kb", "nb", "bb"), "kb")
    pairs = materialise(wide.select("ka", "kb", "na", "nb", "ba", "bb").mapInArrow(run, schema), "overlap-pairs")

    need = pairs.select(F.col("ka").alias("k")).union(pairs.select("kb")).distinct()
    need = F.broadcast(need) if is_small(need, cfg.broadcast_keys) else need
    run, schema = _keys()
    found = texts.select("text").mapInArrow(run, schema).join(need, "k", "left_semi")
    found = found.repartition("k").groupBy("k", "gkey").agg(F.first("text").alias("text"))
    run, schema = _exact(cfg)
    wide = pairs.join(found.toDF("ka", "gkey_a", "ta"), "ka").join(found.toDF("kb", "gkey_b", "tb"), "kb")
    links = wide.select("gkey_a", "gkey_b", "ta", "tb").mapInArrow(run, schema)

    left, right = (feats.where(F.col("side") == s).select(F.col("gkey").alias(f"gkey_{x}"), F.col("sample_id").alias(c)).distinct() for s, x, c in ((0, "a", "sample_id"), (1, "b", "train_id")))
    by_text = links.join(left, "gkey_a").join(right, "gkey_b").select("sample_id", "train_id", F.lit(False).alias("same_id"), "overlap", "similarity")
    ids = [d.select(F.col(id_col).cast("string").alias("sample_id")).where("sample_id is not null").distinct() for d in (held_out, train)]
    by_id = ids[0].join(ids[1], "sample_id").select("sample_id", F.col("sample_id").alias("train_id"), F.lit(True).alias("same_id"), F.lit(None).cast("double").alias("overlap"), F.lit(None).cast("double").alias("similarity"))
    return by_text.unionByName(by_id).groupBy("sample_id", "train_id").agg(F.max("same_id").alias("same_id"), F.max("overlap").alias("overlap"), F.max("similarity").alias("similarity"))


def overlap_report(pairs: DataFrame, held_out: DataFrame, id_col: str, split_col: str, source_col: str) -> DataFrame:
    """Per split and source of the held-out records: records, how many overlap, by id and by text, and pairs.

    Splits and sources are trimmed and put in lower case, null and blank ones are `unknown`.  A record
    delivered several times counts once, under the smallest of its splits and sources.
    """
    name = lambda c: F.coalesce(F.nullif(F.lower(F.trim(F.col(c))), F.lit("")), F.lit("unknown"))
    records = held_out.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("sample_id")).agg(F.min(name(split_col)).alias("split"), F.min(name(source_col)).alias("source"))
    hits = pairs.groupBy("sample_id").agg(F.count("*").alias("pairs"), F.max("same_id").alias("by_id"), F.max(F.col("similarity").isNotNull()).alias("by_text"))
    n = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return records.join(hits, "sample_id", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("pairs").alias("overlapping"), n("by_id").alias("by_id"), n("by_text").alias("by_text"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
