"""Splits in which all records of one repository, author or other entity stay together.

Components.  Each record has keys (any number of entity columns) and an id;
records that share a key or an id belong together.  Keys that occur on one
record, or on deliveries of one id, are edges of a graph over keys; its
components are found by minimum labels with pointer jumping.  Records are no
nodes: a key that a third of all rows carry is one node, and a graph over
10^9 records is only as large as the number of keys that meet another key.

Increments.  The component table (key, component, split_name) of an earlier
run can be given: its components stay connected and keep their split.  A new
component fills the splits' deficits.  A component that joins earlier ones of
different splits is quarantined: its records get no split and the status
`quarantined`, so that neither side leaks into the other.

Balance.  The sizes of new components by label are aggregated; components of
at least 1/1000 of all records (so at most 1000) are placed on the driver,
largest first, where they reduce the squared deviation from the targets of all
labels most.  The others are ordered by hash within the label most of their
records have, and the running total of records is cut at the remaining
deficits of that label, by a two-step prefix sum over hash buckets, so no
list of components is ever gathered.

Edge cases.  Null and blank keys link nothing; a record without keys is a
component of its own.  Null labels are a label of their own.  Rows that repeat
an id are one record with the smallest of its labels.  Null ids are left out.
Shares must add up to more than 0.  Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.components import connected_components
from corpuslens.llm.joins import join_hot
from corpuslens.storage import materialise

HEAVY = 1000
BUCKETS = 1024
MAX_LABELS = 64


def repo_name(column: Column) -> Column:
    """One spelling of a repository: address, ending and case left out, null and blank ones `unknown`."""
    x = F.lower(F.regexp_replace(column, r"\s+", ""))
    x = F.regexp_replace(x, r"^(git\+)?[a-z]+://[^/]*/|^git@[^:/]+[:/]", "")
    x = F.regexp_replace(x, r"([.]git)?/*$", "")
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown"))


@dataclass
class GroupSplit:
    """records: (id, component, split_name, status); components: (key, component, split_name), to be kept for the next run."""

    records: DataFrame
    components: DataFrame


def _place(sizes: list[tuple[str, list[int]]], want: dict[str, list[float]], have: dict[str, list[int]]) -> dict[str, str]:
    """Split of each heavy component, largest first; `have` is updated."""
    out = {}
    for name, n in sorted(sizes, key=lambda x: (-sum(x[1]), x[0])):
        total = [sum(n), *n]

        def worse(s: str) -> float:
            w, h = [sum(want[s]), *want[s]], [sum(have[s]), *have[s]]
            return sum(((h[i] + total[i] - w[i]) ** 2 - (h[i] - w[i]) ** 2) / max(w[i], 1.0) for i in range(len(w)))

        best = min(sorted(want), key=worse)
        have[best] = [a + b for a, b in zip(have[best], n)]
        out[name] = best
    return out


def group_split(records: DataFrame, id_col: str, keys: dict[str, Column], label_col: str, targets: DataFrame, previous: DataFrame | None = None) -> GroupSplit:
    """Assign every record to a split of targets (split_name, share_permille); keys: entity name to its expression."""
    spark = records.sparkSession
    shares = {r[0]: float(r[1]) for r in targets.where("split_name is not null").groupBy("split_name").agg(F.sum("share_permille").cast("double")).limit(1001).collect() if r[1]}
    if not shares or len(shares) > 1000:
        raise ValueError("between 1 and 1000 splits with a share are needed")
    named = F.array(*(F.when(F.trim(e) != "", F.concat(F.lit(f"{n}:"), e)) for n, e in keys.items()))
    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(label_col).cast("string"), F.lit("null")).alias("label"), F.explode_outer(F.filter(named, lambda x: x.isNotNull())).alias("key"))
    one = rows.groupBy("id").agg(F.min("label").alias("label"), F.min("key").alias("anchor"), F.collect_set("key").alias("keys"))
    one = materialise(one.withColumn("anchor", F.coalesce("anchor", F.concat(F.lit("id:"), "id"))), "split-records")

    edges = one.where(F.size("keys") > 1).select("anchor", F.explode("keys").alias("key")).where("anchor <> key")
    if previous is not None:
        edges = edges.union(previous.where("key <> component").select("component", "key"))
    comp = connected_components(edges, "anchor", "key").select(F.col("node").alias("anchor"), "component")
    placed = join_hot(one.select("id", "label", "anchor"), comp, "anchor", "id").withColumn("component", F.coalesce("component", "anchor"))
    placed = materialise(placed, "split-components")

    labels = sorted(r[0] for r in placed.select("label").distinct().limit(MAX_LABELS + 1).collect()) or ["null"]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    cols = [f"n{i}" for i in range(len(labels))]
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == x).alias(c) for x, c in zip(labels, cols)))
    if previous is not None:
        old = join_hot(previous.select(F.col("key").alias("anchor"), "split_name"), comp, "anchor", "anchor").withColumn("component", F.coalesce("component", "anchor"))
        old = old.groupBy("component").agg(F.min("split_name").alias("lo"), F.max("split_name").alias("hi"))
        sizes = sizes.join(old, "component", "left")
    else:
        sizes = sizes.withColumns({"lo": F.lit(None).cast("string"), "hi": F.lit(None).cast("string")})
    kept = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    status = F.when(F.col("lo").isNull(), "new").when(kept.isNull(), "quarantined").otherwise("kept")
    sizes = materialise(sizes.withColumn("split_name", kept).withColumn("status", status).drop("lo", "hi"), "split-sizes")

    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols]
    whole = sizes.agg(*sums, F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    want = {s: [whole[c] * share / sum(shares.values()) for c in cols] for s, share in shares.items()}
    have = {s: [0] * len(cols) for s in shares}
    for r in sizes.where("status = 'kept'").groupBy("split_name").agg(*sums).collect():  # one row per split
        have.setdefault(r.split_name, [0] * len(cols))
        have[r.split_name] = [r[c] for c in cols]
    new = sizes.where("status = 'new'")
    is_heavy = F.col("n") * HEAVY >= F.lit(max(whole["n"], 1))
    heavy = _place([(r.component, [r[c] for c in cols]) for r in new.where(is_heavy).collect()], want, have)  # at most HEAVY rows
    schema = "component string, split_name string"
    answers = [spark.createDataFrame(list(heavy.items()), schema), sizes.where("status <> 'new'").select("component", "split_name")]

    # the rest: stratum = most frequent label, cut at the deficits that are left
    if cols:
        top = F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
        stratum = F.coalesce(*(F.when(F.col(c) == top, F.lit(i)) for i, c in enumerate(cols)))
        rest = new.where(~is_heavy).withColumns({"stratum": stratum, "h": F.xxhash64("component")}).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
        sums_ = rest.groupBy("stratum", "bucket").agg(F.sum("n").alias("n"))  # at most MAX_LABELS * BUCKETS rows
        before = W.partitionBy("stratum").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        sums_ = sums_.select("stratum", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(W.partitionBy("stratum")).alias("all"))
        inside = W.partitionBy("stratum", "bucket").orderBy("h", "component").rowsBetween(W.unboundedPreceding, -1)
        rest = rest.join(F.broadcast(sums_), ["stratum", "bucket"]).withColumn("at", (F.col("ahead") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("n") / 2) / F.col("all"))
        choice = F.lit(None).cast("string")
        for i in range(len(cols)):
            left = {s: max(want[s][i] - have[s][i], 0.0) for s in sorted(want)}
            total = sum(left.values()) or 1.0
            if not sum(left.values()):
                left = {s: want[s][i] for s in left}
                total = sum(left.values()) or 1.0
            bounds, run = [], 0.0
            for s, share in left.items():
                if share:
                    run += share / total
                    bounds.append((run, s))
            pick = F.lit(bounds[-1][1]) if bounds else F.lit(sorted(want)[0])
            for high, s in reversed(bounds[:-1]):
                pick = F.when(F.col("at") < high, F.lit(s)).otherwise(pick)
            choice = F.when(F.col("stratum") == i, pick).otherwise(choice)
        answers.append(rest.select("component", choice.alias("split_name")))
    answer = answers[0]
    for a in answers[1:]:
        answer = answer.union(a)
    answer = answer.join(sizes.select("component", "status"), "component")
    answer = materialise(answer, "split-answer")
    out = join_hot(placed.select("id", "component"), answer, "component", "id").select("id", "component", "split_name", "status")
    table = one.select(F.explode("keys").alias("anchor")).distinct()
    table = join_hot(table, comp, "anchor", "anchor").select(F.col("anchor").alias("key"), F.coalesce("component", "anchor").alias("component"))
    table = join_hot(table, answer.select("component", "split_name"), "component", "key")
    if previous is not None:
        was = join_hot(previous.select(F.col("key").alias("anchor"), F.col("split_name").alias("old")), comp, "anchor", "anchor").select(F.col("anchor").alias("key"), F.coalesce("component", "anchor").alias("component"), "old")
        was = was.join(table.select("key"), "key", "left_anti")
        quarantined = answer.where("status = 'quarantined'").select("component", F.lit(True).alias("q"))
        was = join_hot(was, quarantined, "component", "key").select("key", "component", F.when(F.col("q").isNull(), F.col("old")).alias("split_name"))
        table = table.unionByName(was)
    return GroupSplit(out, table.select("key", "component", "split_name"))
