"""Connected components by minimum labels and pointer jumping.

Every round lets each node take the smallest label in its neighbourhood and
then follows the label's own label (pointer jumping), so that path lengths
halve; the number of rounds grows with the logarithm of the longest path.
Each round's labels are written to the shared folder, which keeps lineage
short and survives lost executors.

Skew.  A node with very many neighbours (a hub that a third of all edges have)
and the label of a giant component are hot keys of the two joins of a round:
both spread such keys over several tasks.  The minima after them are reduced
in every task before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.joins import hot_keys, join_hot
from corpuslens.storage import discard, materialise


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Null ends are ignored, loops and repeated edges do no harm, an empty table
    gives an empty result.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    e = materialise(e.union(e.select("y", "x")).distinct(), "cc-edges")
    label = materialise(e.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), "cc-labels-0")
    stored, hubs = label, materialise(hot_keys(e, "y"), "cc-hubs")
    for n in range(1, max_rounds + 1):
        near = join_hot(e, label.withColumnRenamed("node", "y"), "y", "x", "inner", hubs).groupBy("x").agg(F.min("component").alias("m"))
        low = label.join(near.withColumnRenamed("x", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("p"))
        jump = label.select(F.col("node").alias("p"), F.col("component").alias("pp"))
        new = materialise(join_hot(low, jump, "p", "node").select("node", "old", F.least("p", F.coalesce("pp", "p")).alias("component")), f"cc-labels-{n}")
        discard(stored)
        if not new.where("old <> component").limit(1).count():
            discard(e)
            discard(hubs)
            return new.select("node", "component")
        stored, label = new, new.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
