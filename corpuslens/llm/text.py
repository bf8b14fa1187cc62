"""Word and shingle hashing shared by the operators on texts.

A *word* is a longest run of ASCII letters, digits and underscores, in lower
case; everything else separates words.  Only ASCII is folded: ``bytes.lower``
on UTF-8 leaves letters such as the Kelvin sign alone, which ``str.lower``
would turn into an ASCII ``k``.

All functions work on whole Arrow batches: the texts of a batch are cut into
one flat array of word hashes with offsets, and windows, shingles and minima
are computed on that array with NumPy.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import xxhash

WORD = re.compile(rb"[A-Za-z0-9_]+")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: Odd multipliers for the places within a shingle (up to 8 words).
_PLACE = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3)) | 1 for i in range(8)], dtype=object)
_PLACE = np.array([int(x) & 0xFFFFFFFFFFFFFFFF for x in _PLACE], dtype=np.uint64)


class _WordHashes(dict):
    """Memo of 64-bit word hashes; emptied when it holds `bound` words, so its memory is bounded."""

    bound = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def words(text: str | None) -> list[bytes]:
    """Words of one text; null has none."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S33)
    h = h * _M2
    return h ^ (h >> _S33)


def hash_words(ws: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, ws), dtype=np.uint64, count=len(ws))


def batch_words(texts: Iterable[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Word lists, flat word hashes and offsets (one more than texts)."""
    lists = [words(t) for t in texts]
    offsets = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((_HASHES[w] for ws in lists for w in ws), dtype=np.uint64, count=int(offsets[-1]))
    return lists, flat, offsets


def batch_shingles(flat: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of every text, repeats kept, and their text numbers."""
    m = len(flat) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h += flat[i : i + m] * _PLACE[i]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = owner[:m] == owner[n - 1 : n - 1 + m]
    return mix(h[keep]), owner[:m][keep]


def distinct_per_text(h: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, ascending within the text, and offsets."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    offsets = np.zeros(texts + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=texts), out=offsets[1:])
    return h, offsets


def shingle_sets(texts: Sequence[str | None], n: int) -> list[np.ndarray]:
    """The distinct n-word shingles of each text as sorted hashes."""
    _, flat, offsets = batch_words(texts)
    h, owner = batch_shingles(flat, offsets, n)
    h, at = distinct_per_text(h, owner, len(offsets) - 1)
    return [h[a:b] for a, b in zip(at[:-1], at[1:])]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """|A and B| / |A or B| of two sorted distinct arrays; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
