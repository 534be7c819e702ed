"""Connected components of a table of edges, by joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.llm.storage import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b).

    Each round takes the least label among neighbours and then the label of the label, so long chains shorten quickly.
    Every step is a join or a minimum with partial aggregation: no component or neighbourhood is gathered anywhere.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(most_rounds):
        seen = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("m"))
        low = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        low = stored(low, "labels")
        up = low.select(F.col("node").alias("new"), F.col("new").alias("above"))
        after = stored(low.join(up, "new").select("node", "old", F.col("above").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
