"""Byte-level BPE encoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the tokenizer's pattern.  The bytes of a
pre-token form a doubly linked list of tokens; every adjacent pair whose bytes
together are a vocabulary entry waits in the bucket of that entry's merge rank.
The buckets in use are marked in a bitmap of three levels of 64-bit words, in
which find-first-set gives the smallest rank in three steps at any vocabulary
size up to 262 144.  The leftmost position of that bucket is merged, its two
new neighbours are queued, and entries that a merge has made out of date are
skipped when they come up.  A pre-token of n bytes takes O(n log n) at most,
where the usual rescan for the smallest rank takes O(n^2), so a megabyte
without a break encodes as fast per byte as prose.

Distinct pre-tokens are remembered in a memo of bounded size.

Defined cases: null and empty texts give an empty list of ids; strings of
special tokens are ordinary text; whole texts are encoded, whatever their
length; repeated rows give repeated rows.  The vocabulary file's path is a
parameter; the driver reads it (at most `MAX_VOCABULARY` bytes) and ships its
ranks to the tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.storage import spread

#: The pre-token pattern of the public byte-level vocabulary, with white space spelt out as
#: Unicode's property, since `regex` counts the four information separators as white space too.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
MAX_VOCABULARY = 64 * 1024 * 1024


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank of a file with lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class RankQueue:
    """Smallest-rank-first queue of positions: bitmap of 64 x 64 x 64 ranks over position heaps."""

    __slots__ = ("top", "mid", "low", "at")

    def __init__(self) -> None:
        self.top = 0
        self.mid = [0] * 64
        self.low = [0] * 4096
        self.at: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.at.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.at[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, int] | None:
        """The smallest rank and its leftmost position, or None."""
        top = self.top
        if not top:
            return None
        block = (top & -top).bit_length() - 1
        bits = self.mid[block]
        word = block << 6 | ((bits & -bits).bit_length() - 1)
        bits = self.low[word]
        rank = word << 6 | ((bits & -bits).bit_length() - 1)
        bucket = self.at[rank]
        position = heappop(bucket)
        if not bucket:
            del self.at[rank]
            self.low[word] &= ~(1 << (rank & 63))
            if not self.low[word]:
                self.mid[block] &= ~(1 << (word & 63))
                if not self.mid[block]:
                    self.top &= ~(1 << block)
        return rank, position


class Encoder:
    """Encodes texts by a table of ranks; the id of a token is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remember: int = 300_000) -> None:
        if max(ranks.values(), default=0) >= 64**3:
            raise ValueError("ranks beyond 262143 don't fit the queue")
        self.ranks, self.split, self.remember = ranks, regex.compile(pattern), remember
        self.queue = RankQueue()
        self.memo: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n, get, queue = len(piece), ranks.get, self.queue
        token: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [-1] * n  # the rank under which a position's pair waits; entries that differ are stale
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                waiting[i] = rank
                queue.push(rank, i)
        while (smallest := queue.pop()) is not None:
            rank, i = smallest
            if waiting[i] != rank:
                continue
            j = after[i]
            token[i] += token[j]
            token[j], waiting[j] = None, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = get(token[i] + token[k])
                waiting[i] = -1 if rank is None else rank
                if rank is not None:
                    queue.push(rank, i)
            else:
                waiting[i] = -1
            h = before[i]
            if h >= 0:
                rank = get(token[h] + token[i])
                waiting[h] = -1 if rank is None else rank
                if rank is not None:
                    queue.push(rank, h)
        return [ranks[t] for t in token if t is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        if not text:
            return []
        out: list[int] = []
        memo = self.memo
        for piece in self.split.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(memo) >= self.remember:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


_encoders: dict[tuple[int, str], Encoder] = {}


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(id_col, ids) of every row of df; see the module's notes for nulls and empty texts."""
    path = Path(vocabulary or default_vocabulary())
    if path.stat().st_size > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than a vocabulary may be ({MAX_VOCABULARY} bytes)")
    data = df.sparkSession.sparkContext.broadcast(path.read_bytes())
    key = (hash(path.read_bytes()), pattern)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(key)
        if encoder is None:
            encoder = _encoders[key] = Encoder(read_ranks(data.value), pattern)
        for b in batches:
            ids = [encoder.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((i for x in ids for i in x), np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"])

    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)
