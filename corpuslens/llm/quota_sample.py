"""Samples with given category shares by the cube method.

Every record of a category gets the inclusion probability target / records
(1 where the category has no more records than its target).  The flight phase
of the cube method walks these probabilities to 0 or 1 while the sums of the
balancing variables, the category indicators, stay what they were: among any
p + 1 undecided records of p categories there is a direction in which all sums
are constant, and each step decides at least one record.  Flights run on
bounded partitions in parallel; each leaves at most p records undecided, which
merge upward, `fan` partitions into one, until one flight is left; the landing
phase decides the rest by dropping balancing variables from the last one on.
As targets are whole numbers, all category sizes come out exactly; the report
gives the residual imbalance all the same.

Categories are few (the targets table is a parameter of the sample; its size
is checked against `MAX_CATEGORIES`) and are sent to the tasks.  Records are
partitioned by a hash of their id into parts of about `part_rows`, so results
don't depend on how the table is stored, and a category of a third of all rows
is spread over all parts.

Edge cases.  Records whose category has no target, or with a null in a
category column, are never drawn.  Rows that repeat an id count once (its
smallest category).  A category without records gets an empty sample and is
reported as unmet.  Null targets and minima count as 0.  Empty tables give an
empty sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.storage import materialise

MAX_CATEGORIES = 10_000
EPS = 1e-9


def flight(prob: np.ndarray, category: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after a flight phase balanced on category indicators.

    In a window of undecided records the null space of the indicators is spanned
    by differences of two records of one category, so a step moves one of these.
    """
    p = prob.copy()
    waiting: dict[int, int] = {}
    for i in rng.permutation(len(p)):
        while EPS < p[i] < 1 - EPS:
            j = waiting.pop(int(category[i]), None)
            if j is None:
                waiting[int(category[i])] = int(i)
                break
            up, down = min(1 - p[i], p[j]), min(p[i], 1 - p[j])
            if rng.random() * (up + down) < down:
                p[i], p[j] = p[i] + up, p[j] - up
            else:
                p[i], p[j] = p[i] - down, p[j] + down
            if EPS < p[j] < 1 - EPS:
                i = j
    p[p <= EPS] = 0.0
    p[p >= 1 - EPS] = 1.0
    return p


def land(prob: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides what a flight left: one record per category at most, each by its own probability."""
    open_ = (prob > 0) & (prob < 1)
    out = prob.copy()
    out[open_] = (rng.random(int(open_.sum())) < prob[open_]).astype(float)
    return out


@dataclass
class QuotaSample:
    """sample: (id, key columns); report: one row per target with what was asked and what was drawn."""

    sample: DataFrame
    report: DataFrame


def quota_sample(records: DataFrame, id_col: str, keys: dict[str, F.Column], targets: DataFrame, share: str, minimum: str, size: int, seed: int = 17, part_rows: int = 20_000, fan: int = 16) -> QuotaSample:
    """Draw about `size` records with the shares (per mille) of `targets`, at least `minimum` of each category.

    keys: the category columns of targets, each with its expression on records.
    """
    names = list(keys)
    spec = targets.select(*names, F.coalesce(F.col(share), F.lit(0)).cast("long").alias("s"), F.coalesce(F.col(minimum), F.lit(0)).cast("long").alias("m"))
    rows = spec.limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    spark = records.sparkSession
    wanted = sorted({tuple(r[:-2]): max(r.m, size * r.s // 1000) for r in rows}.items(), key=str)
    kinds = ", ".join(f"{n} {targets.schema[n].dataType.simpleString()}" for n in names)
    cats = spark.createDataFrame([(i, n, *k) for i, (k, n) in enumerate(wanted)], f"category int, wanted long, {kinds}")
    pop = records.select(F.col(id_col).alias("id"), *(e.alias(n) for n, e in keys.items())).where("id is not null")
    pop = pop.join(F.broadcast(cats.drop("wanted")), names)  # at most MAX_CATEGORIES rows
    pop = materialise(pop.groupBy("id").agg(F.min("category").alias("category")), "quota-population")
    counts = pop.groupBy("category").agg(F.count("*").alias("available"))
    known = {r.category: r.available for r in counts.collect()}  # at most MAX_CATEGORIES rows
    prob = {i: min(1.0, n / known[i]) for i, (_, n) in enumerate(wanted) if known.get(i)}
    total = sum(known.values())

    def fly(level: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", ignore_index=True)
            rng = np.random.default_rng([seed, level, int(pdf.part.iloc[0])])
            p = flight(pdf.p.to_numpy(float), pdf.category.to_numpy(), rng)
            return pdf.assign(p=land(p, rng) if last else p)

        return run

    schema = f"id {pop.schema['id'].dataType.simpleString()}, category int, p double, part long"
    probs = spark.createDataFrame(list(prob.items()), "category int, p double")
    parts = max(1, -(-total // part_rows))
    state = pop.join(F.broadcast(probs), "category").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("long")).select("id", "category", "p", "part")
    drawn, level = None, 0
    while True:
        last = parts == 1
        state = materialise(state.groupBy("part").applyInPandas(fly(level, last), schema), f"quota-flight-{level}")
        now = state.where("p = 1").select("id", "category")
        drawn = now if drawn is None else drawn.unionByName(now)
        if last:
            break
        parts, level = -(-parts // fan), level + 1
        state = state.where("p > 0 and p < 1").withColumn("part", F.floor(F.col("part") / fan))
    taken = drawn.groupBy("category").agg(F.count("*").alias("taken"))
    report = cats.join(counts, "category", "left").join(taken, "category", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    report = report.select(*names, "wanted", n("available").alias("available"), n("taken").alias("taken"))
    report = report.withColumn("residual", F.col("taken") - F.least("wanted", "available")).withColumn("unmet", F.col("taken") < F.col("wanted"))
    return QuotaSample(drawn.join(F.broadcast(cats), "category").select(F.col("id").alias(id_col), *names), report)
