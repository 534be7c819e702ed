"""Writers: tables, GeoJSON lines, review feeds, payloads and resumable partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solargrid.functions import business as B


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """A header and no geometry."""
    df.drop(geometry).write.mode("overwrite").option("header", True).csv(path)


def point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def polygon(rings: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))


def features(df: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """A GeoJSON feature in each row's text."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_geojson(df: DataFrame, path: str, geometry: Column, properties: list[str]) -> None:
    """One feature a line."""
    features(df, geometry, properties).write.mode("overwrite").text(path)


def review_tasks(df: DataFrame) -> DataFrame:
    """One FeatureCollection a line, in rank order, with instruction and map link."""
    props = F.struct(
        F.col("candidate_id"), F.col("rank"), F.round("area_m2", 1).alias("area_m2"), F.round("confidence", 3).alias("confidence"),
        B.instruction(F.col("area_m2"), F.col("confidence")).alias("instruction"), B.map_link(F.col("lat"), F.col("lon")).alias("link"),
    )
    feature = F.struct(F.lit("Feature").alias("type"), point(F.col("lon"), F.col("lat")).alias("geometry"), props.alias("properties"))
    return df.orderBy("rank").select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("value"))


def negative_centres(df: DataFrame, evidence: Column) -> DataFrame:
    """Rows for hard-negative chips, with the columns among the known ones that are there."""
    have = [c for c in ("candidate_id", "lon", "lat", "area_m2", "max_ndvi", "ndvi_p95") if c in df.columns]
    return df.select(*have, evidence.alias("evidence"))


def write_metadata(spark: SparkSession, path: str, params: dict, totals: DataFrame) -> None:
    """Parameters and totals (one row) as one JSON line."""
    fixed = [F.lit(v).alias(k) for k, v in params.items()]
    totals.select(F.to_json(F.struct(F.struct(*fixed).alias("params"), F.struct(*totals.columns).alias("totals"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def unfinished(cells: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Cells that still have to be computed."""
    return cells if force else cells.join(done.select("cell").distinct(), "cell", "left_anti")


def write_partials(df: DataFrame, path: str) -> None:
    """Replace only the cells at hand; the commit protocol makes each write whole or nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(path)


def atlas_payload(cells: DataFrame, regions: DataFrame, calibrated: bool) -> DataFrame:
    """Cells, provinces in order of the primary measure, bounds and totals as one JSON document.

    The document is for a page; it holds the grid's nonzero cells, some thousand for a country.
    """
    m = "cal_mwp" if calibrated else "det_mwp"
    c = cells.where(F.col(m) > 0).agg(F.array_sort(F.collect_list(F.struct("ix", "iy", F.round(m, 3).alias("mwp")))).alias("cells"), F.min("lon0").alias("west"), F.min("lat0").alias("south"), F.max("lon0").alias("east"), F.max("lat0").alias("north"), F.round(F.sum(m), 3).alias("total"))
    r = regions.agg(F.array_sort(F.collect_list(F.struct((-F.col(m)).alias("o"), "region_name", F.round(m, 3).alias("mwp")))).alias("r")).select(F.transform("r", lambda x: F.struct(x["region_name"], x["mwp"])).alias("provinces"))
    return c.join(r, F.lit(True)).select(F.to_json(F.struct("cells", "provinces", "west", "south", "east", "north", "total")).alias("value"))  # one row each


def share_payload(hexes: DataFrame) -> DataFrame:
    return hexes.select(F.to_json(F.struct("hex", F.round("share", 3).alias("reference"), F.round("own", 3).alias("own"), F.round("difference", 3).alias("difference"))).alias("value"))


def cell_payload(cells: DataFrame, measures: list[str]) -> DataFrame:
    """A JSON line for each cell with something in it: its key, the corner of its box, and the measures to three decimals."""
    some = F.greatest(*[F.coalesce(m, F.lit(0.0)) for m in measures]) if len(measures) > 1 else F.coalesce(measures[0], F.lit(0.0))
    props = [F.round(F.coalesce(m, F.lit(0.0)), 3).alias(m) for m in measures]
    return cells.where(some > 0).select(F.to_json(F.struct("cell", F.round("lon0", 6).alias("lon"), F.round("lat0", 6).alias("lat"), *props)).alias("value"))


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Rows of a file of features, one a line: geometry (JSON text) and the properties by their schema."""
    f = spark.read.schema(f"geometry string, properties struct<{properties}>").json(path)
    return f.select("geometry", "properties.*")


def write_calibration(table: DataFrame, path: str) -> None:
    """All counts stay with the rates, so posteriors can be drawn again from the table alone."""
    table.coalesce(1).write.mode("overwrite").parquet(path)
