"""Records that are equal apart from formatting: white space, case, punctuation and order of fields.

Two texts are equal if they hold the same words, each equally often, in any
order.  Progressive partition refinement finds the classes of equal texts: all
records are partitioned by the length of the text without formatting first,
classes with several members then by the letter histogram, and only what is
still together by the digest of the sorted words, the costly key.  A record
alone in its class is dropped at once and never pays for the costly key.

Cost and skew.  Records are reduced to one row per (length, histogram) class
with map-side partial aggregation (a class that a third of all rows belong to
is one row per task), and the refinement by length and then by histogram goes
on over that table of classes, never over records.  Classes that stay select
the records whose text is read again for the costly key, so no shuffle carries
a text; records meet class tables by joins that spread hot keys.  The digest
is 128 bits.

Edge cases.  Null and blank texts, texts without any word and records without
an id belong to no set.  Rows that repeat an id and its text count once; an id
delivered with different texts takes part with each.  Empty tables give empty
results.  Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import text as X
from corpuslens.llm.joins import HOT_ROWS, join_hot
from corpuslens.storage import materialise, spread

#: Bytes of words in lower case; all others are deleted.
_WORD_BYTES = bytes(c for c in range(128) if chr(c).isalnum() or c == ord("_"))
_OTHERS = bytes(set(range(256)) - set(_WORD_BYTES))
_FOLD = bytes(range(256)).lower()


def cheap_keys(text: str) -> tuple[int, int] | None:
    """Length of the text without formatting and hash of its letter histogram; None without a word."""
    stripped = text.encode("utf-8", "surrogatepass").translate(_FOLD, _OTHERS)
    if not stripped:
        return None
    histogram = np.bincount(np.frombuffer(stripped, np.uint8), minlength=128)
    return len(stripped), xxhash.xxh3_64_intdigest(histogram.tobytes()) - (1 << 63)


def _cheap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the cheap keys and drops texts without a word."""
    for b in batches:
        keys = [cheap_keys(t) for t in b.column(1).to_pylist()]
        has = pa.array([k is not None for k in keys], pa.bool_())
        k1, k2 = (pa.array([k[i] if k else None for k in keys], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([b.column(0), k1, k2, b.column(1)], names=["id", "k1", "k2", "text"]).filter(has)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [xxhash.xxh3_128_digest(b"\0".join(sorted(X.words(t)))) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "digest"])


def formatting_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(set_id, id, n_copies): each record of a set of two or more, the set's smallest id and its size."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    keyed = spread(rows).mapInArrow(_cheap, "id string, k1 long, k2 long, text string")
    # one row per class; a class has several members if its smallest and largest id differ
    classes = keyed.groupBy("k1", "k2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
    classes = materialise(classes, "format-classes")
    lengths = classes.groupBy("k1").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a <> b").select("k1")
    stay = join_hot(classes, lengths, "k1", "k2", "left_semi").where("lo <> hi").select(_pair("k1", "k2"), "n")
    stay = materialise(stay, "format-candidates")
    hot = stay.where(F.col("n") > HOT_ROWS).select("class_key")
    last = join_hot(keyed.select("id", _pair("k1", "k2"), "text"), stay.select("class_key"), "class_key", "id", "left_semi", hot)
    last = materialise(last.select("id", "text").mapInArrow(_digests, "id string, digest binary").distinct(), "format-digests")
    sets = last.groupBy("digest").agg(F.min("id").alias("set_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return join_hot(last, materialise(sets, "format-sets"), "digest", "id", "inner").select("set_id", "id", "n_copies")


def _pair(a: str, b: str) -> Column:
    return F.struct(a, b).alias("class_key")


def collapsed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(kept_id, n_copies): one row per distinct text up to formatting, with the number of records that have it.

    Records without words are kept as they are, with one copy each.
    """
    ids = df.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
    sets = formatting_duplicates(df, id_col, text_col)
    return ids.join(sets, "id", "left").where("set_id is null or set_id = id").select(F.col("id").alias("kept_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
