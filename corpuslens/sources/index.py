"""A table of vectors with metadata, as an index that can be reset, appended to and searched."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import retrieval
from corpuslens.sources.files import exists


class VectorIndex:
    """Parquet table (id, embedding, metadata columns); partition it by columns that searches filter on.

    With `cells` the table is an approximate index as well: cells are fitted on
    a bounded sample when the index is reset, every row is stored in the folder
    of its cell, and `search_near` reads only the cells nearest to the queries.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = (), cells: int = 0, vector: str = "embedding") -> None:
        self.spark, self.path, self.cells, self.vector = spark, path, cells, vector
        self.partition_by = (*partition_by, "cell") if cells else partition_by

    def _centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}-cells").orderBy("cell").collect()  # one row per cell
        return np.array([r.centre for r in rows], float)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return retrieval.assign_cells(rows, self.vector, self._centres()) if self.cells else rows

    def reset(self, rows: DataFrame) -> None:
        if self.cells:
            centres = retrieval.fit_cells(rows, self.vector, self.cells)
            table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
            table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}-cells")
        self._placed(rows).write.mode("overwrite").partitionBy(*self.partition_by).parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        self._placed(rows).write.mode("append").partitionBy(*self.partition_by).parquet(self.path)

    def search_near(self, queries: DataFrame, k: int, probes: int, id_col: str = "id", **equal) -> DataFrame:
        """The k best of each query among the vectors of its `probes` nearest cells; queries have the same columns as the index."""
        return retrieval.dense_ann(self.read(**equal), id_col, self.vector, queries, k, self._centres(), probes)

    def is_ready(self) -> bool:
        return exists(self.spark, self.path)

    def count(self) -> int:
        return self.spark.read.parquet(self.path).count() if self.is_ready() else 0

    def read(self, **equal) -> DataFrame:
        """Rows whose metadata equal the given values; the filter reaches the scan, and the folders of partition columns."""
        df = self.spark.read.parquet(self.path)
        for column, value in equal.items():
            df = df.where(F.col(column) == value)
        return df

    def search(self, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding", **equal) -> DataFrame:
        return retrieval.dense(self.read(**equal), id_col, vector, queries, k)


def decoded(content: Column) -> Column:
    """Text of base64 content; bytes that aren't UTF-8 become replacement characters, null if it isn't base64."""
    return F.decode(F.try_to_binary(F.regexp_replace(content, r"\s+", ""), F.lit("base64")), "UTF-8")
