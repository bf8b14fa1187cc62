"""Evaluation items whose text occurs in a training corpus.

Windows.  A passage is a window of `window` consecutive words, on both sides.
Besides, an item as a whole is compared with the windows of a document that
have as many words as the item, or with the document if that is shorter.  A
window is the weighted set of its n-word shingles, a shingle weighing as much
as its words have letters; the similarity of two windows is the weight of the
shared shingles by the weight of all, and pairs of at least `similarity` count.

Windows that can count.  The shared weight of a pair is at least `similarity`
times the weight of either window.  So the items' shingles tell, per document
and item, from running sums in which a shingle counts once, how much of every
window's weight the item has; windows below that bound are out, without loss,
and only the few that are left get a fingerprint.

Candidates.  A window's SimHash is the 64 signs of the weighted sum of its
shingles' bits.  Item windows are stored by each of four blocks of 16 bits, and
a window looks up the Hamming ball of radius 1 of each of its blocks: two
fingerprints within `RADIUS` = 7 have a block with at most one differing bit
(pigeonhole), so all of them are found, and the complete distance is checked.
Passages with the same words have distance 0: exact passages are found with
certainty.  Others of similarity 0.8 lie some 8 bits apart and no distance is a
bound for them, so `rest` adds an exact way for the pairs beyond the radius: of
each window the first shingles that weigh more than 1 - `similarity` of it, one
of which must be shared, are looked up in an inverted index.  With `rest` every
similar pair is found, and `fingerprint_pairs` tells how many were within the
radius.

Verification.  Candidates are compared on their weighted shingle sets; pairs of
passages with the same words in the same order are marked exact.

Cost and skew.  The corpus is read once at any number of items and never
shuffled; only hits leave a task.  The items are indexed in blocks of about
`block_words` words, one at a time on the driver, each a broadcast that a task
loads, uses on a batch of documents and drops, so neither the driver nor a task
holds more than one block.  Shingles that many items share give many hits;
these are worked off some items at a time.  Items that occur in very many
documents only make more rows.

Edge cases.  Null texts and texts of fewer than `window` words give nothing,
on either side.  Repeated rows give one row; of an item id with several texts
the counts are summed.  Empty tables give an empty result.  Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import text as X
from corpuslens.storage import materialise, spread

BLOCKS, RADIUS = 4, 7
_BITS = np.arange(64, dtype=np.uint64)
#: A block's own value and those with one bit changed.
_BALL = np.array([0, *(1 << i for i in range(16))])


@dataclass(frozen=True)
class LeakConfig:
    """words: shingle length; window: words of a passage; hits: shingle hits of a document batch that are worked off at a time; rest: also pairs beyond RADIUS and whole items."""

    words: int = 5
    window: int = 12
    similarity: float = 0.8
    block_words: int = 200_000
    hits: int = 500_000
    rest: bool = True


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges lo to hi - 1, with the number of their range."""
    n = hi - lo
    return np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)


def _running(places: np.ndarray, prev: np.ndarray, weights: np.ndarray, per: int, count: int) -> np.ndarray:
    """Weight of the distinct shingles among `places` in each window of `per` shingles, by its first place."""
    first = np.maximum(np.maximum(prev + 1, places - per + 1), 0)
    change = np.bincount(first, weights, count + 1) - np.bincount(places + 1, weights, count + 1)
    return np.cumsum(change)[:count]


class Windows:
    """Shingles of a batch of texts by place (the number of their first word), and the places where a window starts."""

    def __init__(self, texts: list[str | None], cfg: LeakConfig) -> None:
        lists, self.flat, self.offsets = X.batch_words(texts)
        m = max(0, len(self.flat) - cfg.words + 1)
        letters = np.fromiter((len(w) for ws in lists for w in ws), np.int64, count=len(self.flat))
        h, self.weights = np.zeros(m, np.uint64), np.zeros(m, np.int64)
        for i in range(cfg.words):
            h += self.flat[i : i + m] * X._PLACE[i]
            self.weights += letters[i : i + m]
        self.shingles = X.mix(h)
        self.owner = np.repeat(np.arange(len(lists)), np.diff(self.offsets))
        long = (np.diff(self.offsets) >= cfg.window)[self.owner]
        #: places whose shingle is of one text of at least `window` words
        self.inside = long[:m] & (self.owner[:m] == self.owner[cfg.words - 1 : cfg.words - 1 + m])
        self.starts = np.zeros(m, bool)
        count = max(0, len(self.flat) - cfg.window + 1)
        self.starts[:count] = self.owner[:count] == self.owner[cfg.window - 1 : cfg.window - 1 + count]
        #: place of the shingle's occurrence before in the same text, else -1
        self.prev = np.full(m, -1, np.int64)
        order = np.argsort(self.shingles, kind="stable")
        x, y = order[:-1], order[1:]
        same = (self.shingles[x] == self.shingles[y]) & (self.owner[x] == self.owner[y])
        self.prev[y[same]] = x[same]

    def sets(self, at: np.ndarray, cfg: LeakConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, shingles and weights of the windows `at`; a shingle's repeats within a window weigh 0."""
        places = at[:, None] + np.arange(cfg.window - cfg.words + 1)
        return places, self.shingles[places], np.where(self.prev[places] < at[:, None], self.weights[places], 0)

    def same_words(self, at: np.ndarray, other: Windows, there: np.ndarray, cfg: LeakConfig) -> np.ndarray:
        span = np.arange(cfg.window)
        return (self.flat[at[:, None] + span] == other.flat[there[:, None] + span]).all(axis=1)


def fingerprints(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingles."""
    out = np.empty(len(shingles), np.uint64)
    for a in range(0, len(shingles), 4096):
        bits = (shingles[a : a + 4096, :, None] >> _BITS & np.uint64(1)).astype(np.int32)
        up = ((2 * bits - 1) * weights[a : a + 4096, :, None].astype(np.int32)).sum(axis=1) > 0
        out[a : a + 4096] = np.packbits(up, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


class ItemIndex:
    """Fingerprints of the items' windows by block, and an inverted index: the items of each shingle, and the places of each shingle in each item."""

    def __init__(self, texts: list[str | None], cfg: LeakConfig) -> None:
        self.cfg, self.items, self.n = cfg, Windows(texts, cfg), len(texts)
        x = self.items
        places = np.flatnonzero(x.inside)
        self.known, rank = np.unique(x.shingles[places], return_inverse=True)
        key = rank * self.n + x.owner[places]
        order = np.argsort(key, kind="stable")
        self.places = places[order]
        #: an entry is a shingle of an item: rank of the shingle * items + item
        self.entries, first = np.unique(key[order], return_index=True)
        self.bounds = np.append(first, len(places))
        new = places[x.prev[places] < 0]
        self.weight = np.bincount(x.owner[new], x.weights[new], self.n)
        #: item windows and their fingerprints; per block of bits the windows in the order of its value, and where each value begins
        self.windows = np.flatnonzero(x.starts)
        self.fp = fingerprints(*x.sets(self.windows, cfg)[1:]) if len(self.windows) else np.zeros(0, np.uint64)
        value = self.fp.view(np.uint16).reshape(-1, BLOCKS)
        self.order = [np.argsort(value[:, b], kind="stable").astype(np.int32) for b in range(BLOCKS)]
        self.begins = [np.searchsorted(value[o, b], np.arange(65_537)).astype(np.int32) for b, o in enumerate(self.order)]

    def within_radius(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (row of fp, place of an item window) within RADIUS."""
        value, found = fp.view(np.uint16).reshape(-1, BLOCKS), []
        for b in range(BLOCKS):
            v = (value[:, b, None] ^ _BALL.astype(np.uint16)).astype(np.int64)
            at, i = _ranges(self.begins[b][v.ravel()], self.begins[b][v.ravel() + 1])
            row, i = at // len(_BALL), self.order[b][i]
            near = np.bitwise_count(fp[row] ^ self.fp[i]) <= RADIUS
            found.append(row[near] * max(1, len(self.fp)) + i[near])
        row, i = np.divmod(np.unique(np.concatenate(found)), max(1, len(self.fp)))
        return row, self.windows[i]

    def passages(self, docs: Windows, rank: np.ndarray, place: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Document, item, similarity, exactness and nearness of similar passages, given all hits of some items."""
        cfg, m = self.cfg, len(docs.shingles)
        if not len(self.windows):
            return
        per = cfg.window - cfg.words + 1
        whole = _running(np.arange(m), docs.prev, docs.weights, per, m)
        at, start = _ranges(np.maximum(np.maximum(docs.prev[place] + 1, place - per + 1), 0), place + 1)
        ok = docs.starts[start]
        key, inverse = np.unique(item[at[ok]] * m + start[ok], return_inverse=True)
        item, start = np.divmod(key, max(1, m))
        near = np.bincount(inverse, docs.weights[place[at[ok]]], len(key)) >= cfg.similarity * whole[start] - 1e-9
        item, start = item[near], start[near]
        # one look-up of the fingerprint per window, whatever the items it may belong to
        once, which = np.unique(start, return_inverse=True)
        m2 = len(self.items.shingles)
        for a in range(0, len(once), 4096):
            s = once[a : a + 4096]
            places, sh, w = docs.sets(s, cfg)
            row, y = self.within_radius(fingerprints(sh, w))
            pairs, near = row * m2 + y, np.ones(len(row), bool)
            if cfg.rest:
                mine = (which >= a) & (which < a + 4096)
                more = np.setdiff1d(self._beyond(rank, places, w, which[mine] - a, item[mine]), pairs)
                pairs, near = np.append(pairs, more), np.append(near, np.zeros(len(more), bool))
            row, y = np.divmod(pairs, m2)
            for b in range(0, len(row), 65_536):
                i, d, n = y[b : b + 65_536], s[row[b : b + 65_536]], near[b : b + 65_536]
                (_, sa, wa), (_, sb, wb) = docs.sets(d, cfg), self.items.sets(i, cfg)
                both = np.where((sa[:, :, None] == sb[:, None, :]) & (wb[:, None, :] > 0), wa[:, :, None], 0).sum(axis=(1, 2))
                similar = both / np.maximum(1, wa.sum(axis=1) + wb.sum(axis=1) - both)
                keep = similar >= cfg.similarity - 1e-12
                d, i = d[keep], i[keep]
                yield docs.owner[d], self.items.owner[i], similar[keep], docs.same_words(d, self.items, i, cfg), n[keep]

    def _beyond(self, rank: np.ndarray, places: np.ndarray, w: np.ndarray, row: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Pairs (row of places, place of a window of item t) that share one of the row's first shingles, as one number each."""
        cfg, m2 = self.cfg, len(self.items.shingles)
        per, first = cfg.window - cfg.words + 1, np.cumsum(w, axis=1) - w <= (1 - cfg.similarity) * w.sum(axis=1, keepdims=True) + 1e-9
        ask = ((w > 0) & first & (rank[places] >= 0))[row]
        r, col = np.nonzero(ask)
        wanted = rank[places[row[r], col]] * self.n + t[r]
        e = np.minimum(np.searchsorted(self.entries, wanted), len(self.entries) - 1)
        has = self.entries[e] == wanted
        r, e = r[has], e[has]
        x, q = _ranges(self.bounds[e], self.bounds[e + 1])
        r, q = r[x], self.places[q]
        x, y = _ranges(np.maximum(q - per + 1, 0), q + 1)
        ok = self.items.starts[y] & (self.items.owner[y] == t[r[x]])
        return np.unique(row[r[x[ok]]] * m2 + y[ok])

    def wholes(self, docs: Windows, place: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """Document, item, number of item-sized windows similar to the item and their best similarity, given all hits of some items."""
        cfg = self.cfg
        pair = docs.owner[place] * self.n + item
        order = np.argsort(pair, kind="stable")
        place, pair = place[order], pair[order]
        pairs, first = np.unique(pair, return_index=True)
        weight = np.add.reduceat(np.where(docs.prev[place] < 0, docs.weights[place], 0), first) if len(first) else first
        for k in np.flatnonzero(weight >= cfg.similarity * self.weight[pairs % self.n] - 1e-9).tolist():
            d, t = divmod(int(pairs[k]), self.n)
            a, z = int(docs.offsets[d]), int(docs.offsets[d + 1]) - cfg.words + 1
            per = min(z - a, int(self.items.offsets[t + 1] - self.items.offsets[t]) - cfg.words + 1)
            prev, hit = np.maximum(docs.prev[a:z] - a, -1), place[first[k] : first[k + 1] if k + 1 < len(first) else None] - a
            whole = _running(np.arange(z - a), prev, docs.weights[a:z], per, z - a)[: z - a - per + 1]
            both = _running(hit, prev[hit], docs.weights[a:z][hit], per, z - a)[: z - a - per + 1]
            similar = both / (whole + self.weight[t] - both)
            if n := int((similar >= cfg.similarity - 1e-12).sum()):
                yield d, t, n, float(similar.max())

    def search(self, docs: Windows) -> dict[tuple[int, int], list]:
        """By document and item: pairs of similar passages, best similarity, whether passages are the same, similar item-sized windows, pairs within the radius."""
        best: dict[tuple[int, int], list] = {}
        rank = np.full(len(docs.shingles), -1, np.int64)
        if len(self.known):
            near = np.minimum(np.searchsorted(self.known, docs.shingles), len(self.known) - 1)
            rank = np.where(docs.inside & (self.known[near] == docs.shingles), near, -1)
        place = np.flatnonzero(rank >= 0)
        at, e = _ranges(np.searchsorted(self.entries, rank[place] * self.n), np.searchsorted(self.entries, (rank[place] + 1) * self.n))
        place, item = place[at], self.entries[e] % max(1, self.n)
        order = np.argsort(item, kind="stable")
        place, item = place[order], item[order]
        a = 0
        while a < len(item):  # all hits of an item stay together
            z = int(np.searchsorted(item, item[min(a + self.cfg.hits, len(item)) - 1], "right"))
            mine = set(range(int(item[a]), int(item[z - 1]) + 1))
            for found in self.passages(docs, rank, place[a:z], item[a:z]):
                for d, t, s, e, n in zip(*(x.tolist() for x in found)):
                    if t in mine:  # fingerprints also meet windows of other items, which have their own turn
                        row = best.setdefault((d, t), [0, 0.0, False, 0, 0])
                        row[0] += 1
                        row[1], row[2] = max(row[1], s), row[2] or e
                        row[4] += n
            if self.cfg.rest:
                for d, t, n, s in self.wholes(docs, place[a:z], item[a:z]):
                    row = best.setdefault((d, t), [0, 0.0, False, 0, 0])
                    row[1], row[3] = max(row[1], s), n
            a = z
        return best


_KINDS = {"window_pairs": pa.int64(), "similarity": pa.float64(), "exact": pa.bool_(), "item_windows": pa.int64(), "fingerprint_pairs": pa.int64()}


def _scan(blocks: list, cfg: LeakConfig, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 256 if len(blocks) == 1 else 2048  # several blocks are loaded anew for every batch
        for whole in batches:
            for a in range(0, whole.num_rows, size):
                b = whole.slice(a, size)
                docs = Windows(b.column(1).to_pylist(), cfg)
                for n, block in enumerate(blocks):
                    ids, index = block.value
                    best = index.search(docs)
                    if best:
                        columns = [pa.array(c, kind) for c, kind in zip(zip(*best.values()), _KINDS.values())]
                        yield pa.RecordBatch.from_arrays([pa.array([ids[t] for _, t in best], id_type), b.column(0).take(pa.array([d for d, _ in best])), pa.array([n << 32 | t for _, t in best], pa.int64()), *columns], names=["item_id", "doc_id", "item_no", *_KINDS])
                    if len(blocks) > 1:
                        block.__dict__.pop("_value", None)  # one block in memory at a time

    return run


def _words(column: str) -> Column:
    return F.size(F.regexp_extract_all(F.col(column), F.lit("[A-Za-z0-9_]+"), F.lit(0)))


def leaked_items(items: DataFrame, item_id: str, item_text: str, docs: DataFrame, doc_id: str, doc_text: str, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """(item_id, doc_id, window_pairs, similarity, exact, item_windows, fingerprint_pairs) of every item and document with similar windows.

    window_pairs counts the pairs of similar passages, fingerprint_pairs those
    of them within RADIUS, item_windows the item-sized windows similar to the
    whole item, similarity is the best of both, exact tells whether `window` or
    more words agree in order.  Without `rest` only pairs within RADIUS count.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = items.sparkSession
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).where("item_id is not null and t is not null").distinct()
    items = materialise(items.withColumn("n", _words("t")).where(F.col("n") >= cfg.window), "leak-items")
    parts = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // cfg.block_words))
    corpus = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("t")).where("doc_id is not null and t is not null"))
    kinds = {c: items.schema["item_id"].dataType if c == "item_id" else corpus.schema["doc_id"].dataType for c in ("item_id", "doc_id")}
    blocks = []
    for n in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(parts)) == n).collect()  # about block_words words
        blocks.append(spark.sparkContext.broadcast(([r.item_id for r in rows], ItemIndex([r.t for r in rows], cfg))))
    schema = f"item_id {kinds['item_id'].simpleString()}, doc_id {kinds['doc_id'].simpleString()}, item_no long, window_pairs long, similarity double, exact boolean, item_windows long, fingerprint_pairs long"
    hits = corpus.mapInArrow(_scan(blocks, cfg, to_arrow_type(kinds["item_id"])), schema)
    each = hits.groupBy("item_id", "doc_id", "item_no").agg(*(F.max(c).alias(c) for c in _KINDS))
    counts = ("window_pairs", "item_windows", "fingerprint_pairs")
    return each.groupBy("item_id", "doc_id").agg(*((F.sum if c in counts else F.max)(c).alias(c) for c in _KINDS))
