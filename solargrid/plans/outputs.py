"""Queries that write what the engine hands on and read it back: each result is what a reader of the files finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from solargrid.functions import geometry as G
from solargrid.functions import shapes
from solargrid.operators import candidates as C
from solargrid.operators import density as D
from solargrid.operators.components import fresh_path
from solargrid.plans import polygons as Y
from solargrid.plans.common import GRID, scaled, sql_scaled
from solargrid.plans.grid import _HIST, _IX, _IY
from solargrid.sources import sinks, tables
from solargrid.sources.fixtures import fixture, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(*views, sql=sql)
        return f

    return add


@query(f"WITH {Y._CAND}, s AS (SELECT id, sum(px*qy - qx*py)/2 AS deg2 FROM (SELECT e.id, e.ax-c.lon AS px, e.ay-c.lat AS py, e.bx-c.lon AS qx, e.by-c.lat AS qy FROM ce e JOIN fx_candidates c ON c.cand_id = e.id) GROUP BY id) SELECT cand_id, {sql_scaled('confidence', 'confidence', '1E3')}, {sql_scaled('deg2*111320.0E0*111320.0E0*cos(radians(lat))', 'm2', '10')} FROM fx_candidates JOIN s ON id = cand_id", "fx_candidates")
def features_read_back(spark, sf_dir):
    """Candidates' outlines written as GeoJSON features and read again, with their areas on the plane."""
    c, path = Y._candidates(spark, sf_dir), fresh_path(spark, "features")
    closed = F.transform("rings", lambda r: F.concat(r, F.slice(r, 1, 1)))
    sinks.write_geojson(c, path, sinks.polygon(closed), ["cand_id", "confidence", "lat"])
    back = sinks.read_features(spark, path, "cand_id bigint, confidence double, lat double").withColumn("rings", tables.geojson_rings(F.col("geometry")))
    m2 = shapes.intersection_area("rings", "rings") * G.lon_metres(F.col("lat")) * G.DEGREE_M
    return back.select("cand_id", scaled("confidence", 1000).alias("confidence"), scaled(m2, 10).alias("m2"))


@query(f"WITH h AS ({_HIST}) SELECT printf('%04d_%04d', ix, iy) AS cell, CASE WHEN ix >= 10 THEN 2 ELSE 1 END AS run, n_buildings, {sql_scaled('roof', 'roof_m2', '10')} FROM h", "fx_buildings")
def partials_read_back(spark, sf_dir):
    """Cells written by partition, the eastern ones computed and written again: the others stay as they were."""
    path = fresh_path(spark, "partials")
    cells = D.cell_histogram(fixture(spark, sf_dir, "fx_buildings"), GRID).withColumn("cell", G.cell_key(F.col("ix"), F.col("iy")))
    sinks.write_partials(cells.where("ix < 10").withColumn("run", F.lit(1)), path)
    done = spark.read.parquet(path).select(F.col("cell").cast("string").alias("cell"))
    todo = sinks.unfinished(cells, done).withColumn("run", F.lit(2))
    sinks.write_partials(todo, path)
    back = spark.read.schema("ix int, iy int, n_buildings long, roof_area_m2 double, run int, cell string").parquet(path)
    return back.select("cell", "run", "n_buildings", scaled("roof_area_m2", 10).alias("roof_m2"))


@query(f"WITH h AS ({_HIST}), c AS (SELECT {_IX} AS ix, {_IY} AS iy, sum(area_m2)*0.0002E0 AS mwp FROM fx_candidates GROUP BY 1, 2) SELECT printf('%04d_%04d', ix, iy) AS cell, {sql_scaled('60.0E0 + ix*0.1E0', 'lon', '1E3')}, {sql_scaled('24.0E0 + iy*0.1E0', 'lat', '1E3')}, {sql_scaled('round_even(mwp*1000, 0)/1000', 'mwp', '1E2')}, n_buildings FROM h JOIN c USING (ix, iy)", "fx_buildings", "fx_candidates")
def cells_read_back(spark, sf_dir):
    """The payload of density cells written as JSON lines and read again."""
    path = fresh_path(spark, "cells")
    b = D.cell_histogram(fixture(spark, sf_dir, "fx_buildings"), GRID)
    c = D.with_cell(fixture(spark, sf_dir, "fx_candidates"), GRID).groupBy("ix", "iy").agg((F.sum("area_m2") * 0.0002).alias("mwp"))
    j = b.join(c, ["ix", "iy"]).withColumn("cell", G.cell_key(F.col("ix"), F.col("iy"))).withColumn("lon0", GRID.x0 + F.col("ix") * GRID.size).withColumn("lat0", GRID.y0 + F.col("iy") * GRID.size)
    sinks.cell_payload(j, ["mwp", "n_buildings"]).write.text(path)
    back = spark.read.schema("cell string, lon double, lat double, mwp double, n_buildings double").json(path)
    return back.select("cell", scaled("lon", 1000).alias("lon"), scaled("lat", 1000).alias("lat"), scaled("mwp", 100).alias("mwp"), F.col("n_buildings").cast("long").alias("n_buildings"))


@query("SELECT cand_id, row_number() OVER (ORDER BY confidence DESC, cand_id) AS rank, printf('fx-pv-%06d', row_number() OVER (ORDER BY confidence DESC, cand_id) - 1) AS candidate_id, printf('https://www.openstreetmap.org/#map=19/%.5f/%.5f', lat, lon) AS link FROM fx_candidates", "fx_candidates")
def review_feed_read_back(spark, sf_dir):
    """The feed of review tasks, one collection a line, written and read again; a candidate is found by its rank."""
    path = fresh_path(spark, "tasks")
    c = fixture(spark, sf_dir, "fx_candidates")
    ranked = C.with_rank(c, F.col("confidence"), "fx")
    sinks.review_tasks(ranked).write.text(path)
    schema = "features array<struct<properties:struct<candidate_id:string,rank:bigint,link:string>>>"
    back = spark.read.schema(schema).json(path).select(F.explode("features.properties").alias("p")).select("p.*")
    return back.join(ranked.select("cand_id", "candidate_id"), "candidate_id").select("cand_id", "rank", "candidate_id", "link")


@query(f"SELECT osm_id, {sql_scaled('area_m2', 'area_m2', '10')}, placement FROM fx_mapped", "fx_mapped")
def csv_read_back(spark, sf_dir):
    """Mapped features written as CSV without their outlines, and read again."""
    path = fresh_path(spark, "csv")
    sinks.write_csv(Y._mapped(spark, sf_dir), path, "rings")
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("osm_id").cast("long").alias("osm_id"), scaled(F.col("area_m2").cast("double"), 10).alias("area_m2"), "placement")
