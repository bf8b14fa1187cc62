"""Named queries over the test tables: QUERIES[name](spark, sf_dir) and SQL[name]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def counted(sql: str) -> str:
    """sql with every count_if(x) as a filtered count, whose type is BIGINT as in Spark."""
    out, at = "", 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, end = 1, i + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:i] + f"count(*) FILTER (WHERE {sql[i + len('count_if(') : end - 1]})"
        at = end
    return out + sql[at:]


def query(name: str, sql: str | None = None):
    """Register a query under `name`; a name can be taken once."""

    def wrap(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = counted(sql)
        return build

    return wrap
