"""Incremental ingest of scene files: what is there is taken up once, and a rerun takes only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from solargrid.schemas import SCENES


def scene_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCENES).parquet(path)


def take_up(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append new scenes to the series table, by target bucket, and end."""
    rows = stream.withColumn("bucket", F.pmod("pid", F.lit(64)))
    return rows.writeStream.format("parquet").partitionBy("bucket").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).outputMode("append").start()


def pending(targets: DataFrame, ledger: DataFrame) -> DataFrame:
    """Targets that no run has pulled; an empty pull is in the ledger with n_scenes = 0 and does not come again."""
    return targets.join(ledger.select("pid").distinct(), "pid", "left_anti")


def ledger_rows(targets: DataFrame, series: DataFrame) -> DataFrame:
    return targets.select("pid").join(series.groupBy("pid").agg(F.count("*").alias("n_scenes")), "pid", "left").fillna(0, ["n_scenes"])
