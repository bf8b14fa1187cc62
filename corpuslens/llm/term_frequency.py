"""Frequency of every distinct value or term by an external sort and run-length scans.

The (field, term, record) triples of all rows are range-partitioned and sorted
by all three columns; every partition is then scanned once in order, and runs
of equal terms give the occurrences and, from runs of equal records within
them, the distinct records.  Nothing is held but the current run's counts, so
a term of any frequency needs no memory; the sort spills to disk.

Skew.  Equal triples fall in one partition, while a term that a third of all
rows hold is split over many partitions by its records, each of which returns
one partial count that is summed at the end.  Repeats within a batch are
combined before the shuffle.

Edge cases.  Null values and empty terms are left out.  Rows without a record
id have no record to count: they are left out as well.  Rows that repeat a
record count as further occurrences, but the record counts once.  Fields that
the table lacks raise.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms_of(column: Column, separators: str = "[;,|]") -> Column:
    """Terms of a value: split at the separators, trimmed of white space, in lower case, empty ones left out."""
    parts = F.split(column, separators)
    parts = F.transform(parts, lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.filter(parts, lambda x: x != "")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up repeats of a triple within a batch."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["field_name", "term", "record"]).aggregate([([], "count_all")])
        yield from t.rename_columns(["field_name", "term", "record", "n"]).to_batches()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths over sorted triples; the run that a batch ends with goes on in the next."""
    names = ["field_name", "term", "occurrences", "records"]
    open_run: tuple[str, str] | None = None
    last_record, occurrences, records = None, 0, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        field, term, record = b.column(0), b.column(1), b.column(2)
        count = b.column(3).to_numpy()

        def changes(c: pa.Array) -> np.ndarray:
            out = np.ones(n, bool)
            if n > 1:
                out[1:] = pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            return out

        new_term = changes(field) | changes(term)
        new_record = new_term | changes(record)
        if open_run == (field[0].as_py(), term[0].as_py()):
            new_record[0] = record[0].as_py() != last_record
        start = np.flatnonzero(new_term)
        occ = np.add.reduceat(count, start)
        rec = np.add.reduceat(new_record.astype(np.int64), start)
        keys = list(zip(field.take(pa.array(start)).to_pylist(), term.take(pa.array(start)).to_pylist()))
        runs = [[*k, int(o), int(r)] for k, o, r in zip(keys, occ, rec)]
        if open_run == keys[0]:
            runs[0][2] += occurrences
            runs[0][3] += records
        elif open_run is not None:
            runs.insert(0, [*open_run, occurrences, records])
        *done, (f, t, occurrences, records) = runs
        open_run, last_record = (f, t), record[n - 1].as_py()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*done), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=names)
    if open_run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((*open_run, occurrences, records), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=names)


def term_frequency(df: DataFrame, id_col: str, fields: list[str], separators: str = "[;,|]") -> DataFrame:
    """(field_name, term, occurrences, records) of every distinct term of each field."""
    terms = F.array(*(F.struct(F.lit(f).alias("field_name"), F.coalesce(terms_of(F.col(f), separators), F.array().cast("array<string>")).alias("terms")) for f in fields))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("record"), F.explode(terms).alias("x"))
    rows = rows.select("x.field_name", F.explode("x.terms").alias("term"), "record")
    rows = rows.mapInArrow(_combine, "field_name string, term string, record string, n long")
    keys = ["field_name", "term", "record"]
    runs = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_scan, "field_name string, term string, occurrences long, records long")
    return runs.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(freq: DataFrame, records: DataFrame, id_col: str, rare: int = 2, common_share: int = 20) -> DataFrame:
    """freq with `mark`: rare (at most `rare` records), else common (more than 1/common_share of all), else null."""
    total = records.agg(F.count_distinct(id_col).alias("total_records"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * common_share > F.col("total_records"), "common")
    return freq.join(F.broadcast(total)).withColumn("mark", mark).drop("total_records")  # one row
