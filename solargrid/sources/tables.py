"""Readers and normalisers of the engine's inputs."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solargrid.functions import business as B
from solargrid.functions import geometry as G
from solargrid.operators.components import cut_lineage
from solargrid.schemas import POINT


def bbox_filter(box: dict[str, float], col: str = "bbox") -> Column:
    """Closed overlap with a box struct; each comparison is on one nested column, so it reaches the parquet scan."""
    c = lambda n: F.col(f"{col}.{n}")
    return (c("xmin") <= box["xmax"]) & (c("xmax") >= box["xmin"]) & (c("ymin") <= box["ymax"]) & (c("ymax") >= box["ymin"])


def buildings(spark: SparkSession, path: str, box: dict[str, float], least_m2: float = 0.0) -> DataFrame:
    """Footprints that overlap a box, with ids made from their shape."""
    df = spark.read.parquet(path).where(bbox_filter(box))
    if least_m2:
        df = df.where(F.col("area_in_meters") >= least_m2)
    return df.select(F.xxhash64("geometry").cast("string").alias("id"), F.col("area_in_meters").alias("area_m2"), F.col("confidence").alias("bf_confidence"), "geometry", "bbox")


def building_points(spark: SparkSession, path: str, box: dict[str, float]) -> DataFrame:
    """Box centres; the geometry column is never read."""
    mid = lambda a: ((F.col(f"bbox.{a}min") + F.col(f"bbox.{a}max")) / 2)
    return spark.read.parquet(path).where(bbox_filter(box)).select(mid("x").alias("lon"), mid("y").alias("lat"))


def approximate_area(col: str = "bbox", degree_m: float = 111_320.0) -> Column:
    c = lambda n: F.col(f"{col}.{n}")
    return (c("xmax") - c("xmin")) * (c("ymax") - c("ymin")) * degree_m**2 * F.cos(F.radians((c("ymin") + c("ymax")) / 2))


def near_cells(points: DataFrame, reach_m: float = 2000.0, size: float = 0.1) -> DataFrame:
    """The grid cells that rows' boxes (xmin..) touch when grown by reach_m."""
    r = reach_m / 111_320
    span = lambda a: F.explode(F.sequence(F.floor((F.col(f"{a}min") - r) / size), F.floor((F.col(f"{a}max") + r) / size)))
    return points.withColumn("kx", span("x")).withColumn("ky", span("y")).select("kx", "ky").distinct()


def restricted(df: DataFrame, cells: DataFrame, size: float = 0.1) -> DataFrame:
    """Rows whose point lies in one of the cells."""
    return df.withColumn("kx", F.floor(F.col("lon") / size)).withColumn("ky", F.floor(F.col("lat") / size)).join(cells, ["kx", "ky"], "left_semi").drop("kx", "ky")


def first_available(*sources: Callable[[], DataFrame | None]) -> DataFrame | None:
    """The first source that is there and has rows; sources are read in order of precedence."""
    for read in sources:
        df = read()
        if df is not None and not df.isEmpty():
            return df
    return None


def solar_features(elements: DataFrame) -> DataFrame:
    """Elements with JSON tags of a solar generator or plant, with kind and placement by tags."""
    tag = lambda k: F.get_json_object("tags", f"$['{k}']")
    plant = F.coalesce(tag("plant:source") == "solar", F.lit(False))
    e = elements.where(plant | F.coalesce(tag("generator:source") == "solar", F.lit(False)))
    kind = F.when(plant, "plant").otherwise("generator")
    return e.withColumn("kind", kind).withColumn("placement", B.tag_placement(F.coalesce(tag("location"), F.lit("")), F.coalesce(tag("generator:place"), F.lit("")), kind))


def solar_from_tag_map(df: DataFrame) -> DataFrame:
    """The same from a map column source_tags, with the classes that hold power features."""
    t = lambda k: F.try_element_at("source_tags", F.lit(k))
    keep = (F.col("subtype") == "power") & F.col("class").isin("generator", "plant", "power_plant") & ((t("generator:source") == "solar") | (t("plant:source") == "solar"))
    return df.where(keep).withColumn("kind", F.when(t("plant:source") == "solar", "plant").otherwise("generator"))


def osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """Rows of saved OSM JSON: id, tags and rings. Nodes are points, closed ways of four points or more polygons, other ways
    their middle vertex; of relations the outer members' rings."""
    schema = "elements array<struct<type:string,id:bigint,lat:double,lon:double,geometry:array<struct<lat:double,lon:double>>,members:array<struct<role:string,geometry:array<struct<lat:double,lon:double>>>>,tags:map<string,string>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    ring = lambda g: F.transform(g, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    closed = (F.size("geometry") >= 4) & (F.element_at("geometry", 1) == F.element_at("geometry", -1))
    middle = F.get("geometry", F.floor(F.size("geometry") / 2).cast("int"))
    outer = stitched(F.transform(F.filter("members", lambda m: (m["role"] == "outer") & (F.size(m["geometry"]) >= 2)), lambda m: ring(m["geometry"])))
    rings = F.when(F.col("type") == "node", F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))))
    rings = rings.when((F.col("type") == "way") & closed, F.array(ring(F.col("geometry")))).when((F.col("type") == "way") & (F.size("geometry") >= 2), F.array(ring(F.array(middle)))).when(F.col("type") == "relation", outer)
    kind = F.when((F.col("type") == "relation") | ((F.col("type") == "way") & closed), "polygon").otherwise("point")
    return e.select(F.concat_ws("/", F.lit("osm"), "type", "id").alias("osm_id"), "tags", rings.alias("rings"), kind.alias("geometry_kind")).where("size(rings) > 0")


def labels_of(curated: DataFrame, other: DataFrame, least_m2: float = 400.0) -> DataFrame:
    """Curated ones are rooftop; other large polygons not among them are ground; small ones are small, curated or not."""
    cols = [c for c in other.columns if c != "placement"]
    big = other.where(F.col("area_m2") >= least_m2).join(curated.select("osm_id"), "osm_id", "left_anti")
    small = other.where(F.col("area_m2") < least_m2)
    parts = [(curated, "rooftop"), (big, "ground"), (small, "small")]
    frames = [d.select(*cols).withColumn("placement", F.lit(p)) for d, p in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def geojson_rings(geometry: Column) -> Column:
    """Rings of a GeoJSON polygon or multipolygon in a string; null for other kinds."""
    kind, coordinates = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """bin_label and verdict of a manual review, from CSV or GeoJSON by the file's name."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True).select("bin_label", "verdict")
    f = spark.read.schema("features array<struct<properties:struct<bin_label:string,verdict:string>>>").json(path, multiLine=True)
    return f.select(F.explode("features.properties").alias("p")).select("p.bin_label", "p.verdict")


def stitched(pieces: Column) -> Column:
    """Lines (arrays of points) joined end to end into closed rings; what does not close is left out."""
    return _stitched(F.to_json(pieces))  # lines differ in length, which nested arrays do not bear on their way to pandas


@F.pandas_udf(T.ArrayType(T.ArrayType(POINT)))
def _stitched(pieces: pd.Series) -> pd.Series:
    def rings(text: str | None) -> list:
        left, out = [[(p["x"], p["y"]) for p in line] for line in json.loads(text or "[]") if len(line) > 1], []
        while left:
            ring = left.pop()
            while ring[0] != ring[-1]:
                at = next((k for k, line in enumerate(left) if ring[-1] in (line[0], line[-1])), None)
                if at is None:
                    break
                line = left.pop(at)
                ring += line[1:] if line[0] == ring[-1] else line[-2::-1]
            if ring[0] == ring[-1] and len(ring) > 3:
                out.append([{"x": x, "y": y} for x, y in ring])
        return out

    return pd.Series([rings(x) for x in pieces])


def divisions(spark: SparkSession, path: str, country: str, subtype: str, name: str | None = None) -> DataFrame:
    """Admin areas of a level, or those with a name in any language."""
    df = spark.read.parquet(path).where((F.col("country") == country) & (F.col("subtype") == subtype))
    return df if name is None else df.where((F.col("names.primary") == name) | F.array_contains(F.map_values("names.common"), name))


def admin_geojson(spark: SparkSession, path: str, iso3: str) -> DataFrame:
    schema = "features array<struct<properties:struct<shapeID:string,shapeName:string,shapeGroup:string>,geometry:string>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return f.select(F.col("f.properties.shapeID").alias("region_id"), F.col("f.properties.shapeName").alias("name"), F.coalesce("f.properties.shapeGroup", F.lit(iso3)).alias("country"), geojson_rings(F.col("f.geometry")).alias("rings"))


def municipalities(df: DataFrame | None, districts: DataFrame | None = None, size: float = 0.01) -> DataFrame:
    """ags and rings of each municipality, its parts dissolved: only land areas if the table marks them, keys padded to eight
    digits. Without municipalities the districts stand in, by keys of five digits. size: about the length of an edge, in degrees."""
    from solargrid.operators import outlines

    width, rows = (8, df) if df is not None else (5, districts)
    if df is not None and "GF" in df.columns and not df.where("GF = 4").isEmpty():
        rows = df.where("GF = 4")
    whole = outlines.polygons(outlines.dissolved(rows.select(F.col("ags").cast("long").alias("key"), "rings"), size), "key")
    return whole.select(F.lpad(F.col("key").cast("string"), width, "0").alias("ags"), "rings")


def hexagons(spark: SparkSession, path: str) -> DataFrame:
    """Reference values and their share of the total in percent; geometry is JSON in a string."""
    rows = spark.read.schema("name string, value array<double>, geojson string").json(path, multiLine=True)
    v = F.coalesce(F.get("value", F.lit(0)), F.lit(0.0))
    total = F.sum("value").over(Window.partitionBy())  # some thousand hexagons at most
    return rows.withColumn("value", v).withColumn("share", 100 * F.col("value") / total).withColumn("rings", geojson_rings(F.col("geojson")))


def scene_series(series: DataFrame, pulled: DataFrame) -> DataFrame:
    """Scenes of the targets that were pulled; one without scenes stays with nulls, one never pulled is left out."""
    return pulled.select("pid").distinct().join(series, "pid", "left")


def register_units(spark: SparkSession, path: str, cutoff: str) -> DataFrame:
    cols = ["ags", "art", "kw", "status", "commissioned", "decommissioned"]
    return spark.read.parquet(path).select(*cols).where(F.col("commissioned") <= F.lit(cutoff).cast("date"))


def pixel_tiles(spark: SparkSession, path: str, tiles: list[str] | None = None) -> DataFrame:
    """Probabilities from 8-bit values; the tile column partitions the files."""
    df = spark.read.parquet(path)
    return (df if tiles is None else df.where(F.col("tile").isin(tiles))).withColumn("prob", F.col("v") / 255.0)


def tile_catalog(pixels: DataFrame, pixel_deg: float) -> DataFrame:
    """A box for each tile from its pixels' corners (x and y of the lower left corner)."""
    return pixels.groupBy("tile").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), (F.max("x") + pixel_deg).alias("xmax"), (F.max("y") + pixel_deg).alias("ymax"))


def building_grid(df: DataFrame, x0: float, y0: float, dx: float, dy: float, least_m2: float) -> DataFrame:
    d = df.where(F.col("area_m2") >= least_m2)
    return d.groupBy(G.cell(F.col("lon"), x0, dx).alias("gx"), G.cell(F.col("lat"), y0, dy).alias("gy")).agg(F.count("*").alias("n"), F.max("area_m2").alias("max_area"))


def angle_nodes(views: DataFrame, band: int = 3) -> DataFrame:
    """Mean view vector of each node over the detectors with finite angles. views: scene, band, detector, row, col, zen, az."""
    from solargrid.functions import solar

    v = views.where(F.col("band") == band).where(~F.isnan("zen") & ~F.isnan("az"))
    e, n, u = solar.unit_enu("zen", "az")
    return v.groupBy("scene", "row", "col").agg(F.avg(e).alias("e"), F.avg(n).alias("n"), F.avg(u).alias("u"))


def angle_grid(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col and value of the nodes of an angle grid. lines has keys, row and text: a grid line's values, NaN for none."""
    cells = lines.select(*keys, "row", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("col", "v"))
    return cells.select(*keys, "row", "col", F.col("v").try_cast("double").alias("value")).where(~F.isnan("value") & F.col("value").isNotNull())


def angle_at(points: DataFrame, nodes: DataFrame, step_m: float) -> DataFrame:
    """The node nearest to each point (scene, x_m, y_m from the upper left corner); if it has no angles, the nearest that has.

    nodes has scene, row, col and whatever is to be known at the points. Points without a node of their own look into the cells
    around them, of a side that doubles for those that have found nothing so near that no other cell can hold a nearer one.
    """
    at = lambda c: F.greatest(F.bround(F.col(c) / step_m), F.lit(0)).cast("int")
    want = points.withColumn("row", at("y_m")).withColumn("col", at("x_m"))
    more = [c for c in nodes.columns if c not in ("scene", "row", "col")]
    out = want.join(nodes, ["scene", "row", "col"]).select(*want.columns, *more)
    lost = cut_lineage(want.join(nodes.select("scene", "row", "col"), ["scene", "row", "col"], "left_anti").join(nodes.select("scene").distinct(), "scene", "left_semi"))
    if lost.isEmpty():
        return out
    span = nodes.agg(F.max("row"), F.max("col")).first()
    edge = lost.agg(F.max("row"), F.max("col")).first()
    farthest, side = 1 + max(*span, *edge), 2
    n = nodes.select("scene", F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.struct(*more).alias("n_more"))
    cell = lambda c, k: F.floor(F.col(c) / k)
    around = lambda c, k: F.explode(F.sequence(cell(c, k) - 1, cell(c, k) + 1))
    while True:
        keyed = n.withColumn("k_r", cell("n_row", side)).withColumn("k_c", cell("n_col", side))
        near = lost.withColumn("k_r", around("row", side)).withColumn("k_c", around("col", side)).join(keyed, ["scene", "k_r", "k_c"])
        near = near.withColumn("d2", F.pow(F.col("row") - F.col("n_row"), 2) + F.pow(F.col("col") - F.col("n_col"), 2))
        best = near.groupBy(*lost.columns).agg(F.min_by("n_more", F.struct("d2", "n_row", "n_col")).alias("b"), F.min("d2").alias("d2"))
        if side < farthest:
            best = best.where(F.col("d2") <= side * side)
        found = cut_lineage(best.select(*lost.columns, "b.*"))
        out = out.unionByName(found)
        if side >= farthest:
            return out
        lost = cut_lineage(lost.join(found.select(*lost.columns), lost.columns, "left_anti"))
        if lost.isEmpty():
            return out
        side *= 2


def calibration_table(spark: SparkSession, path: str) -> DataFrame:
    """Bins with their counts; an error if the edges are not the study's."""
    t = spark.read.parquet(path)
    lo = F.element_at(F.array(F.lit(0.0), *[F.lit(e) for e in B.EDGES]), F.col("bin") + 1)
    return t.where(F.assert_true(F.col("lo") == lo, F.lit("bin edges differ from the study's")).isNull())


def mapped_reference(*parts: DataFrame) -> DataFrame | None:
    """All snapshots of known features together; None if there are none."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def boundary(own: DataFrame | None, source_regions: DataFrame | None, level_one: DataFrame | None, name: str) -> DataFrame | None:
    """The study area: its own polygon, else the source region's, else the admin polygon of that name; None means its box."""
    named = None if level_one is None else level_one.where(B.folded(F.col("name")) == B.folded(F.lit(name)))
    return first_available(lambda: own, lambda: source_regions, lambda: named)


def scene_angles(spark: SparkSession, path: str, row_tag: str = "Values") -> DataFrame:
    """Rows of node values from saved angle XML, one for each grid line."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)
