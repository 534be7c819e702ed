"""Scores of predicted pixels against masks and installations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pixels: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, IoU and F1 on pixels whose mask is not -1."""
    p, t = F.col("prob") >= threshold, F.col("mask") == 1
    c = pixels.where("mask <> -1").groupBy(*(by or [])).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return c.withColumn("iou", F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).withColumn("f1", 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))


def recall_by_size(installations: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Share of installations with a predicted pixel, by size bucket."""
    a = F.col("area_m2")
    bucket = F.when(a >= 1000, "1000+").when(a >= 500, "500-1000").when(a >= 250, "250-500").otherwise("0-250")
    j = installations.join(hits.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return j.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count("hit").alias("found"))


def regression(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    e = F.col(predicted) - F.col(truth)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.pow(F.corr(predicted, truth), 2).alias("r2"), (F.sum(F.col(predicted) * F.col(truth)) / F.sum(F.col(truth) * F.col(truth))).alias("slope"), F.avg(e).alias("bias"))


def strategy_iou(pixels: DataFrame, strategies: DataFrame) -> DataFrame:
    """IoU of many threshold and gate strategies over the same pixels in one pass. strategies: strategy, threshold, gate."""
    s = strategies.select("strategy", "threshold", "gate").collect()  # a short list of settings
    p = lambda r: (F.col("prob") >= r["threshold"]) & (F.col("gate") >= r["gate"])
    t = F.col("mask") == 1
    counts = pixels.where("mask <> -1").agg(*[f(p(r)).alias(f"{n}_{k}") for k, r in enumerate(s) for n, f in (("i", lambda x: F.count_if(x & t)), ("u", lambda x: F.count_if(x | t)))])
    rows = F.explode(F.array(*[F.struct(F.lit(r["strategy"]).alias("strategy"), F.col(f"i_{k}").alias("shared"), F.col(f"u_{k}").alias("either")) for k, r in enumerate(s)]))
    return counts.select(rows.alias("x")).select("x.*").withColumn("iou", F.col("shared") / F.nullif(F.col("either"), F.lit(0)))


def cohens_d(df: DataFrame, value: str, positive: str, least: tuple[int, int] = (5, 20), by: list[str] | None = None) -> DataFrame:
    """Difference of means in pooled deviations (n - 1); null with too few rows, 0 without spread."""
    a, b = F.when(F.col(positive), F.col(value)), F.when(~F.col(positive), F.col(value))
    s = df.groupBy(*(by or [])).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    sd = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    enough = (F.col("n1") >= least[0]) & (F.col("n2") >= least[1])
    return s.withColumn("d", F.when(enough, F.when(sd > 0, (F.col("m1") - F.col("m2")) / sd).otherwise(0.0))).drop("v1", "v2")


def rmse(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.agg(F.sqrt(F.avg(d * d)).alias("rmse"))
