"""Connected components by joins and minima; nothing is gathered."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back.

    A checkpoint would cut the lineage too, but keeps the constraints of the plan that made it, and these double with each
    round of an iteration.
    """
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for the nodes of edges (a, b)."""
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    for _ in range(most_rounds):
        seen = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("m"))
        low = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("via"))
        up = low.select(F.col("node").alias("via"), F.col("via").alias("component"))
        after = cut_lineage(low.join(up, "via").select("node", "old", "component"))
        labels = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
