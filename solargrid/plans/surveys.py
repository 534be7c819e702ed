"""Queries over places, studies and training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.functions import business as B
from solargrid.functions import geometry as G
from solargrid.functions import shapes
from solargrid.functions import solar
from solargrid.operators import candidates as C
from solargrid.operators import density as D
from solargrid.operators import evaluate as E
from solargrid.operators import glint
from solargrid.operators import pixels as P
from solargrid.operators import spatial as S
from solargrid.operators import studies as T
from solargrid.operators import training as N
from solargrid.plans import api, series
from solargrid.plans.common import GRID, scale, scaled, sql_scaled
from solargrid.plans.grid import _BIN, _CLOSE, _GAP, _IX, _IY, _SHARED
from solargrid.plans.pixels import PX, _pixels
from solargrid.sources import tables
from solargrid.sources.fixtures import fixture, with_views

#: A box in the study area, and the lower left corner of its grid.
X0, Y0 = GRID.x0, GRID.y0
BOX = {"xmin": 60.5, "ymin": 24.2, "xmax": 61.2, "ymax": 24.7}


def _buildings(spark, sf_dir) -> DataFrame:
    return fixture(spark, sf_dir, "fx_buildings")


def _candidates(spark, sf_dir) -> DataFrame:
    return fixture(spark, sf_dir, "fx_candidates")


def _fits(spark, sf_dir) -> DataFrame:
    """A fit for each candidate."""
    c = _candidates(spark, sf_dir)
    id_ = F.col("cand_id")
    return c.select(
        id_.alias("pid"), "area_m2", (id_ % 9).alias("n_spikes"), F.col("glint_consistent").cast("long").alias("n_consistent"), (20 + id_ % 5).alias("n_scenes"),
        F.when(id_ % 4 > 0, (id_ % 40).cast("double")).alias("fit_tilt"), F.when(id_ % 4 > 0, (id_ * 37 % 360).cast("double")).alias("fit_az"),
    )


_FITS = "f AS (SELECT cand_id AS pid, area_m2, cand_id % 9 AS n_spikes, CAST(glint_consistent AS BIGINT) AS n_consistent, 20 + cand_id % 5 AS n_scenes, CASE WHEN cand_id % 4 > 0 THEN CAST(cand_id % 40 AS DOUBLE) END AS fit_tilt, CASE WHEN cand_id % 4 > 0 THEN CAST(cand_id * 37 % 360 AS DOUBLE) END AS fit_az FROM fx_candidates)"
_RBIN = "CASE WHEN area_m2 <= 100 THEN 0 WHEN area_m2 <= 500 THEN 1 WHEN area_m2 <= 1000 THEN 2 WHEN area_m2 <= 5000 THEN 3 WHEN area_m2 <= 50000 THEN 4 ELSE 5 END"
_HX, _HY = "sqrt(area_m2)/2/(111320.0E0*cos(radians(lat)))", "sqrt(area_m2)/2/111320.0E0"
_PX = "px AS (SELECT *, prob_u8/255.0E0 AS prob FROM fx_pixels)"
_QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function as a query, with its SQL over the named views."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(*views, sql=sql) if views else sql
        return f

    return add


# Geometry


def _sql_equal_area() -> tuple[str, str]:
    import math

    k0 = math.cos(math.radians(30)) / math.sqrt(1 - G.E2 * math.sin(math.radians(30)) ** 2)
    s = "sin(radians({lat}))"
    q = f"((1-{G.E2!r})*({s}/(1-{G.E2!r}*{s}*{s}) - ln((1-{G.E1!r}*{s})/(1+{G.E1!r}*{s}))/(2*{G.E1!r})))"
    return f"radians({{lon}})*{G.A * k0!r}", f"{q}*{G.A / (2 * k0)!r}"


_EX, _EY = _sql_equal_area()


@query(f"SELECT id, {sql_scaled(_EX.format(lon='lon'), 'x', '10')}, {sql_scaled(_EY.format(lat='lat'), 'y', '10')}, 32600 + CAST(floor((lon+180)/6) AS INT) + 1 AS utm, {sql_scaled('2*6371008.8E0*asin(sqrt(least(1.0E0, pow(sin(radians(24.5E0-lat)/2), 2) + cos(radians(lat))*cos(radians(24.5E0))*pow(sin(radians(61.0E0-lon)/2), 2))))', 'away_m', '10')} FROM fx_buildings", "fx_buildings")
def point_measures(spark, sf_dir):
    x, y = G.equal_area(F.col("lon"), F.col("lat"))
    away = G.haversine_m(F.col("lon"), F.col("lat"), F.lit(61.0), F.lit(24.5))
    return _buildings(spark, sf_dir).select("id", scaled(x, 10).alias("x"), scaled(y, 10).alias("y"), G.utm_code(F.col("lon"), F.col("lat")).alias("utm"), scaled(away, 10).alias("away_m"))


@query(f"SELECT id, {sql_scaled('(' + _EX.format(lon=f'(lon+{_HX})') + ' - ' + _EX.format(lon=f'(lon-{_HX})') + ')*(' + _EY.format(lat=f'(lat+{_HY})') + ' - ' + _EY.format(lat=f'(lat-{_HY})') + ')', 'area', '10')}, {sql_scaled('lon', 'cx', '1E5')}, {sql_scaled('lat', 'cy', '1E5')}, {sql_scaled('lon', 'px', '1E5')}, {sql_scaled('lat', 'py', '1E5')}, {sql_scaled(f'lon-{_HX}', 'xmin')}, {sql_scaled(f'lat+{_HY}', 'ymax')} FROM fx_buildings", "fx_buildings")
def footprint_measures(spark, sf_dir):
    """Area on the ellipsoid, centroid, a point inside and bounds of every footprint."""
    b = _buildings(spark, sf_dir).withColumn("rings", G.box_rings(F.col("lon"), F.col("lat"), F.col("area_m2")))
    m = b.select("id", shapes.measures("rings").alias("m")).select("id", "m.*")
    by = {"area_m2": 10, "cx": 100_000, "cy": 100_000, "px": 100_000, "py": 100_000, "xmin": 1_000_000, "ymax": 1_000_000}
    return m.select("id", *[scaled(c, k).alias(c.removesuffix("_m2")) for c, k in by.items()])


def _sql_utm() -> tuple[str, str]:
    import math

    n, radius, forward, _, _ = G._krueger()
    k = 2 * math.sqrt(n) / (1 + n)
    t = f"sinh(atanh(sin(radians(lat))) - {k!r}*atanh({k!r}*sin(radians(lat))))"
    d = "radians(lon - ((CAST(floor((lon+180)/6) AS INT))*6 - 177))"
    e = "eta" + "".join(f" + {a!r}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(forward, 1))
    y = "xi" + "".join(f" + {a!r}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(forward, 1))
    return f"WITH q AS (SELECT id, lon, lat, {t} AS t, {d} AS d FROM fx_buildings), z AS (SELECT id, atan2(t, cos(d)) AS xi, atanh(sin(d)/sqrt(1+t*t)) AS eta FROM q)", f"{sql_scaled(f'500000 + {0.9996 * radius!r}*({e})', 'east', '10')}, {sql_scaled(f'{0.9996 * radius!r}*({y})', 'north', '10')}"


@query(f"{_sql_utm()[0]} SELECT id, {_sql_utm()[1]}, true AS back FROM z", "fx_buildings")
def utm_points(spark, sf_dir):
    """UTM metres of every building, and whether they lead back to it."""
    b = _buildings(spark, sf_dir).withColumn("code", G.utm_code(F.col("lon"), F.col("lat")))
    e, n = G.to_utm(F.col("lon"), F.col("lat"), F.col("code"))
    b = b.withColumn("east", e).withColumn("north", n)
    lon, lat = G.from_utm(F.col("east"), F.col("north"), F.col("code"))
    return b.select("id", scaled("east", 10).alias("east"), scaled("north", 10).alias("north"), ((F.abs(lon - F.col("lon")) < 1e-8) & (F.abs(lat - F.col("lat")) < 1e-8)).alias("back"))


#: Corners of a hexagon in a region's box, as shares of its width and height.
HEXAGON = ((0.25, 0.0), (0.75, 0.0), (1.0, 0.5), (0.75, 1.0), (0.25, 1.0), (0.0, 0.5))


def _hexagons(spark, sf_dir) -> DataFrame:
    """A hexagon in the middle of each county, with a reference value."""
    r = fixture(spark, sf_dir, "fx_regions").where("level = 'county'")
    at = lambda a, k: F.col(f"{a}min") + k * (F.col(f"{a}max") - F.col(f"{a}min"))
    corners = [F.struct(at("x", x).alias("x"), at("y", y).alias("y")) for x, y in (*HEXAGON, HEXAGON[0])]
    return r.select(F.col("region_id").alias("hex"), F.array(F.array(*corners)).alias("rings"), (1.0 + F.col("region_id") % 7).alias("value"))


def _sql_in_hexagon(lon: str = "b.lon", lat: str = "b.lat") -> str:
    at = lambda a, k: f"(h.{a}min + {k!r}*(h.{a}max - h.{a}min))"
    edges = zip(HEXAGON, (*HEXAGON[1:], HEXAGON[0]), strict=True)
    one = lambda a, b: f"CASE WHEN ({at('y', a[1])} > {lat}) <> ({at('y', b[1])} > {lat}) THEN CASE WHEN {lon} < ({at('x', b[0])}-{at('x', a[0])})*({lat}-{at('y', a[1])})/nullif({at('y', b[1])}-{at('y', a[1])}, 0) + {at('x', a[0])} THEN 1 ELSE 0 END ELSE 0 END"
    return f"(({' + '.join(one(a, b) for a, b in edges)}) % 2 = 1)"


_HEX = "h AS (SELECT * FROM fx_regions WHERE level = 'county')"


@query(f"WITH {_HEX}, j AS (SELECT h.region_id AS hex, count(*) AS n, sum(area_m2) AS m2 FROM fx_buildings b JOIN h ON b.lon BETWEEN h.xmin AND h.xmax AND b.lat BETWEEN h.ymin AND h.ymax AND {_sql_in_hexagon()} GROUP BY 1) SELECT h.region_id AS hex, coalesce(n, 0) AS n, {sql_scaled('coalesce(m2, 0)', 'roof_m2', '10')} FROM h LEFT JOIN j ON j.hex = h.region_id", "fx_buildings", "fx_regions")
def hexagon_roofs(spark, sf_dir):
    """Buildings and roof area inside each hexagon."""
    b = _buildings(spark, sf_dir).withColumn("n", F.lit(1))
    hexes = _hexagons(spark, sf_dir)
    return S.polygon_sums(b, hexes, "id", "hex", "n", "area_m2").select("hex", F.col("n").cast("long").alias("n"), scaled("area_m2", 10).alias("roof_m2"))


@query(f"WITH {_HEX}, c AS (SELECT {_IX} AS ix, {_IY} AS iy, sum(area_m2)*0.0002E0 AS mwp FROM fx_candidates GROUP BY 1, 2), b AS (SELECT *, 60.0E0+(ix+0.5E0)*0.1E0 AS lon, 24.0E0+(iy+0.5E0)*0.1E0 AS lat FROM c), j AS (SELECT h.region_id AS hex, sum(mwp) AS mwp FROM b JOIN h ON b.lon BETWEEN h.xmin AND h.xmax AND b.lat BETWEEN h.ymin AND h.ymax AND {_sql_in_hexagon()} GROUP BY 1), o AS (SELECT h.region_id AS hex, coalesce(mwp, 0) AS mwp, 1.0E0 + h.region_id % 7 AS value FROM h LEFT JOIN j ON j.hex = h.region_id) SELECT hex, {sql_scaled('100*mwp/(SELECT sum(mwp) FROM o) - 100*value/(SELECT sum(value) FROM o)', 'difference', '1E4')} FROM o", "fx_candidates", "fx_regions")
def hexagon_share_difference(spark, sf_dir):
    """Own share of capacity minus a reference share, by hexagon of the cells' centres."""
    cells = D.with_cell(_candidates(spark, sf_dir), GRID).groupBy("ix", "iy").agg((F.sum("area_m2") * 0.0002).alias("mwp"))
    cells = cells.withColumn("cell", G.cell_key(F.col("ix"), F.col("iy"))).withColumn("lon", X0 + (F.col("ix") + 0.5) * 0.1).withColumn("lat", Y0 + (F.col("iy") + 0.5) * 0.1)
    hexes = _hexagons(spark, sf_dir)
    return T.share_difference(cells, hexes.drop("rings"), S.in_polygons(cells, hexes, "cell", "hex")).select("hex", scaled("difference", 10_000).alias("difference"))


@query(f"WITH {_HEX} SELECT b.cand_id, (SELECT min(h.region_id) FROM h WHERE b.lon BETWEEN h.xmin AND h.xmax AND b.lat BETWEEN h.ymin AND h.ymax AND {_sql_in_hexagon()}) AS hex FROM fx_candidates b", "fx_candidates", "fx_regions")
def candidate_polygon(spark, sf_dir):
    """The first polygon that holds each candidate, if any."""
    return S.first_polygon(_candidates(spark, sf_dir), _hexagons(spark, sf_dir), "cand_id", "hex").select("cand_id", "hex")


_AB = "a AS (SELECT *, {hx} AS hx, {hy} AS hy FROM fx_candidates), b AS (SELECT *, {hx} AS hx, {hy} AS hy FROM fx_buildings)".format(hx=_HX, hy=_HY)
_CUT = "greatest(least(a.{c}+a.h{k}, b.{c}+b.h{k}) - greatest(a.{c}-a.h{k}, b.{c}-b.h{k}), 0)"


@query(f"WITH {_AB}, j AS (SELECT a.cand_id, b.id, {_CUT.format(c='lon', k='x')}*{_CUT.format(c='lat', k='y')} AS shared FROM a JOIN b ON abs(a.lon-b.lon) <= a.hx+b.hx AND abs(a.lat-b.lat) <= a.hy+b.hy) SELECT cand_id, id, {sql_scaled('shared', 'shared', '1E11')} FROM j WHERE shared > 0", "fx_candidates", "fx_buildings")
def polygon_overlap(spark, sf_dir):
    """Shared area of candidates and buildings, both as polygons."""
    rings = lambda df: df.withColumn("rings", G.box_rings(F.col("lon"), F.col("lat"), F.col("area_m2")))
    return S.polygon_overlaps(rings(_candidates(spark, sf_dir)), rings(_buildings(spark, sf_dir)), "cand_id", "id").select("cand_id", "id", scaled("shared", 100_000_000_000).alias("shared"))


@query(f"WITH s AS (SELECT a.cand_id, b.id, {_SHARED}/a.area_m2 AS share FROM fx_candidates a JOIN fx_buildings b ON {_CLOSE} WHERE {_SHARED} > 0), t AS (SELECT cand_id, max(share) AS share, arg_max(id, {{'s': share, 'i': -id}}) AS building_id FROM s GROUP BY cand_id) SELECT c.cand_id, building_id, CASE WHEN share >= 0.3E0 THEN 'rooftop' WHEN share IS NOT NULL THEN 'ground_adjacent' ELSE 'no_building' END AS placement FROM fx_candidates c LEFT JOIN t USING (cand_id)", "fx_candidates", "fx_buildings")
def best_overlap_building(spark, sf_dir):
    """The building that shares most with each candidate."""
    return C.best_overlap(_candidates(spark, sf_dir), _buildings(spark, sf_dir)).select("cand_id", "building_id", "placement")


@query(f"WITH m AS (SELECT osm_id, lon, lat, area_m2 FROM fx_mapped), n AS (SELECT a.osm_id, arg_min(b.cand_id, {{'d': {_GAP}, 'i': b.cand_id}}) AS near_id, min({_GAP}) AS gap FROM m a JOIN fx_candidates b ON {_CLOSE} AND {_GAP} <= 15 GROUP BY a.osm_id) SELECT m.osm_id, gap IS NOT NULL AS is_matched, near_id FROM m LEFT JOIN n USING (osm_id)", "fx_candidates", "fx_mapped")
def ground_truth_match(spark, sf_dir):
    """The nearest candidate within 15 m of each mapped feature, and whether there is one."""
    m = fixture(spark, sf_dir, "fx_mapped")
    n = S.nearest(m, _candidates(spark, sf_dir), "osm_id", "cand_id", 15.0, overlap=False)
    return m.select("osm_id").join(n.select("osm_id", "near_id"), "osm_id", "left").withColumn("is_matched", F.col("near_id").isNotNull())


@query(f"WITH n AS (SELECT a.cand_id, min({_GAP}) AS d FROM fx_candidates a JOIN fx_buildings b ON {_CLOSE} AND {_GAP} <= 60 GROUP BY a.cand_id) SELECT cand_id, {sql_scaled('d', 'dist_m', '1E3')} FROM n", "fx_candidates", "fx_buildings")
def roof_within_60m(spark, sf_dir):
    return scale(S.nearest(_candidates(spark, sf_dir), _buildings(spark, sf_dir), "cand_id", "id", 60.0, overlap=False).select("cand_id", "dist_m"), "dist_m", by=1000)


# Places and tiles


def _tiles(spark, sf_dir) -> DataFrame:
    t = fixture(spark, sf_dir, "fx_tiles")
    return t.select("file", (X0 + F.col("ix") * 0.1).alias("xmin"), (Y0 + F.col("iy") * 0.1).alias("ymin"), (X0 + (F.col("ix") + 1) * 0.1).alias("xmax"), (Y0 + (F.col("iy") + 1) * 0.1).alias("ymax"))


_TILES = "t AS (SELECT file, 60.0E0+ix*0.1E0 AS xmin, 24.0E0+iy*0.1E0 AS ymin, 60.0E0+(ix+1)*0.1E0 AS xmax, 24.0E0+(iy+1)*0.1E0 AS ymax FROM fx_tiles)"
_IN_TILE = "lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax"


@query(f"WITH {_TILES} SELECT id FROM fx_buildings WHERE EXISTS (SELECT 1 FROM t WHERE {_IN_TILE})", "fx_buildings", "fx_tiles")
def covered_buildings(spark, sf_dir):
    return S.in_coverage(_buildings(spark, sf_dir), _tiles(spark, sf_dir), "id").select("id")


@query(f"WITH {_TILES} SELECT id, min(file) AS first_file, max(file) AS last_file FROM fx_buildings JOIN t ON {_IN_TILE} GROUP BY id", "fx_buildings", "fx_tiles")
def building_tile(spark, sf_dir):
    """The first tile of each building by path, and the last one, which overwrites."""
    b, t = _buildings(spark, sf_dir), _tiles(spark, sf_dir)
    return S.one_tile(b, t, "id").select("id", F.col("file").alias("first_file")).join(S.one_tile(b, t, "id", first=False).select("id", F.col("file").alias("last_file")), "id")


@query(f"WITH {_TILES} SELECT cand_id, min(file) AS file, count(*) AS n_covering FROM fx_candidates JOIN t ON xmin <= lon-{_HX} AND xmax >= lon+{_HX} AND ymin <= lat-{_HY} AND ymax >= lat+{_HY} GROUP BY cand_id", "fx_candidates", "fx_tiles")
def single_tile_cover(spark, sf_dir):
    return S.covered_by_one(S.with_box(_candidates(spark, sf_dir)), _tiles(spark, sf_dir), "cand_id")


@query("SELECT id, CAST(floor(area_m2) AS BIGINT) AS m2 FROM fx_buildings WHERE lon-0.0001E0 <= 61.2E0 AND lon+0.0001E0 >= 60.5E0 AND lat-0.0001E0 <= 24.7E0 AND lat+0.0001E0 >= 24.2E0 AND area_m2 >= 100", "fx_buildings")
def bbox_scan(spark, sf_dir):
    """Footprints that overlap a box, by comparisons on the nested box alone."""
    corner = F.struct((F.col("lon") - 0.0001).alias("xmin"), (F.col("lat") - 0.0001).alias("ymin"), (F.col("lon") + 0.0001).alias("xmax"), (F.col("lat") + 0.0001).alias("ymax"))
    b = _buildings(spark, sf_dir).withColumn("bbox", corner)
    return b.where(tables.bbox_filter(BOX)).where("area_m2 >= 100").select("id", F.floor("area_m2").alias("m2"))


@query(f"WITH b AS (SELECT id, lat, lon-{_HX} AS x1, lon+{_HX} AS x2, lat-{_HY} AS y1, lat+{_HY} AS y2 FROM fx_buildings), q AS (SELECT id, (x2-x1)*(y2-y1)*111320.0E0*111320.0E0*cos(radians((y1+y2)/2)) AS m2 FROM b) SELECT id, {sql_scaled('m2', 'm2', '10')} FROM q WHERE m2 >= 1000.5E0", "fx_buildings")
def large_boxes(spark, sf_dir):
    """Buildings by the approximate area of their boxes."""
    b = S.with_box(_buildings(spark, sf_dir)).withColumn("bbox", F.struct("xmin", "ymin", "xmax", "ymax")).withColumn("m2", tables.approximate_area())
    return b.where("m2 >= 1000.5").select("id", scaled("m2", 10).alias("m2"))


@query(f"WITH m AS (SELECT lon-{_HX} AS xmin, lon+{_HX} AS xmax, lat-{_HY} AS ymin, lat+{_HY} AS ymax FROM fx_mapped WHERE area_m2 >= 8000), k AS (SELECT unnest(range(CAST(floor((xmin-2000.0E0/111320)/0.1E0) AS BIGINT), CAST(floor((xmax+2000.0E0/111320)/0.1E0) AS BIGINT)+1)) AS kx, ymin, ymax FROM m), c AS (SELECT DISTINCT kx, unnest(range(CAST(floor((ymin-2000.0E0/111320)/0.1E0) AS BIGINT), CAST(floor((ymax+2000.0E0/111320)/0.1E0) AS BIGINT)+1)) AS ky FROM k) SELECT id FROM fx_buildings WHERE (CAST(floor(lon/0.1E0) AS BIGINT), CAST(floor(lat/0.1E0) AS BIGINT)) IN (SELECT (kx, ky) FROM c)", "fx_mapped", "fx_buildings")
def near_mapped_cells(spark, sf_dir):
    """Buildings in the cells around large mapped features."""
    m = S.with_box(fixture(spark, sf_dir, "fx_mapped").where("area_m2 >= 8000"))
    return tables.restricted(_buildings(spark, sf_dir), tables.near_cells(m)).select("id")


@query("SELECT osm_id, CASE WHEN osm_id % 5 = 0 THEN 'rooftop' ELSE 'ground' END AS placement FROM fx_mapped WHERE osm_id % 5 = 0 OR area_m2 >= 400 UNION ALL SELECT osm_id, 'small' FROM fx_mapped WHERE area_m2 < 400", "fx_mapped")
def curated_labels(spark, sf_dir):
    m = fixture(spark, sf_dir, "fx_mapped")
    return tables.labels_of(m.where("osm_id % 5 = 0"), m).select("osm_id", "placement")


@query("SELECT osm_id, CASE WHEN area_m2 < 400 THEN 'small' WHEN placement = 'small' THEN 'ground' ELSE placement END AS placement FROM fx_mapped", "fx_mapped")
def live_labels(spark, sf_dir):
    m = fixture(spark, sf_dir, "fx_mapped").withColumn("placement", F.when(F.col("placement") == "small", "unknown").otherwise(F.col("placement")))
    return m.select("osm_id", B.label_placement(F.col("placement"), F.col("area_m2")).alias("placement"))


@query(f"WITH p AS (SELECT ix, iy, 60.0E0+(ix*64+c)*(0.1E0/64) AS x, 24.0E0+(iy*64+r)*(0.1E0/64) AS y FROM fx_pixels) SELECT ix, iy, {sql_scaled('min(x)', 'xmin')}, {sql_scaled('min(y)', 'ymin')}, {sql_scaled('max(x)+0.1E0/64', 'xmax')}, {sql_scaled('max(y)+0.1E0/64', 'ymax')} FROM p GROUP BY ix, iy", "fx_pixels")
def raster_catalog(spark, sf_dir):
    """The box of every tile from its pixels."""
    p = _pixels(spark, sf_dir).withColumn("tile", F.struct("ix", "iy")).withColumn("x", X0 + (F.col("ix") * 64 + F.col("c")) * PX).withColumn("y", Y0 + (F.col("iy") * 64 + F.col("r")) * PX)
    return scale(tables.tile_catalog(p, PX).select("tile.ix", "tile.iy", *S.BOX), *S.BOX)


@query("SELECT p.pid, count(item) AS n, max(item) AS last_item FROM (SELECT DISTINCT pid FROM fx_scenes UNION SELECT region_id + 1000 FROM fx_regions WHERE level = 'region') p LEFT JOIN fx_scenes s ON s.pid = p.pid AND s.cloud < 40 GROUP BY p.pid", "fx_scenes", "fx_regions")
def pulled_series(spark, sf_dir):
    """Scenes of all targets that were pulled, also of those without one."""
    s = fixture(spark, sf_dir, "fx_scenes")
    pulled = s.select("pid").union(fixture(spark, sf_dir, "fx_regions").where("level = 'region'").select((F.col("region_id") + 1000).cast("long")))
    return tables.scene_series(s.where("cloud < 40").select("pid", "item"), pulled).groupBy("pid").agg(F.count("item").alias("n"), F.max("item").alias("last_item"))


@query("SELECT count(*) AS n, count(DISTINCT key) AS n_keys, count(area_m2) AS n_areas FROM (SELECT osm_id AS key, area_m2 FROM fx_mapped UNION ALL SELECT cand_id, area_m2 FROM fx_candidates WHERE glint_consistent >= 3 UNION ALL SELECT el_id, NULL FROM fx_osm)", "fx_mapped", "fx_candidates", "fx_osm")
def mapped_reference(spark, sf_dir):
    """Snapshots of known features together, by name of their columns."""
    parts = fixture(spark, sf_dir, "fx_mapped").select(F.col("osm_id").alias("key"), "area_m2"), _candidates(spark, sf_dir).where("glint_consistent >= 3").select(F.col("cand_id").alias("key"), "area_m2"), fixture(spark, sf_dir, "fx_osm").select(F.col("el_id").alias("key"))
    return tables.mapped_reference(*parts).agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"), F.count("area_m2").alias("n_areas"))


@query("SELECT cand_id, CASE WHEN cand_id % 3 = 0 THEN '' WHEN cand_id % 10 < 5 THEN 'already visible in the earlier epoch' WHEN cand_id % 10 >= 9 THEN 'new since the earlier epoch' ELSE 'unclear in the earlier epoch' END AS note, printf('https://www.openstreetmap.org/#map=19/%.5f/%.5f', lat, lon) AS link, printf('Check for solar panels: about %.0f m2, confidence %.2f', area_m2, confidence) AS task FROM fx_candidates", "fx_candidates")
def review_texts(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    note = B.epoch_note(F.col("cand_id") % 3 > 0, F.col("cand_id") % 10 / 10)
    return c.select("cand_id", note.alias("note"), B.map_link(F.col("lat"), F.col("lon")).alias("link"), B.instruction(F.col("area_m2"), F.col("confidence")).alias("task"))


_BOOST = "CASE WHEN glint_consistent < 2 THEN 1.0E0 ELSE 1 + (greatest(1.0E0, least(4.0E0, r)) - 1)*greatest(0.0E0, least(1.0E0, glint_consistent/4)) END"


@query(f"WITH c AS (SELECT *, list_extract([0.025E0,0.088E0,0.162E0,0.306E0,0.293E0,0.261E0], {_BIN} + 1)/0.087E0 AS r FROM fx_candidates) SELECT cand_id, {sql_scaled('confidence*(0.5E0 + 0.5E0*coalesce(CASE WHEN cand_id % 4 > 0 THEN (cand_id % 10)/10.0E0 END, 1.0E0))', 'score', '1E3')}, {sql_scaled(_BOOST, 'boost', '1E4')} FROM c", "fx_candidates")
def score_factors(spark, sf_dir):
    """Scores under the epoch prior (unknown for some), and the reward for consistent glints."""
    c = _candidates(spark, sf_dir)
    score = B.epoch_factor(F.col("confidence"), F.when(F.col("cand_id") % 4 > 0, F.col("cand_id") % 10 / 10))
    boost = B.glint_boost(F.col("glint_consistent"), B.likelihood_ratio(B.size_bin(F.col("area_m2"))))
    return c.select("cand_id", scaled(score, 1000).alias("score"), scaled(boost, 10_000).alias("boost"))


@query(f"SELECT osm_id, {sql_scaled('lon - 1.5E0/111.32E0/cos(radians(lat))', 'xmin')}, {sql_scaled('lat + 1.5E0/111.32E0', 'ymax')}, {sql_scaled('60.05E0 + floor((lon-60.05E0)/0.1E0)*0.1E0', 'origin')}, substr(sha1(printf('%.5f_%.5f', lon, lat)), 1, 12) AS chip_id, {sql_scaled('least(abs((osm_id%180+90)%360-180), abs((osm_id%180+270)%360-180))', 'gap', '10')} FROM fx_mapped", "fx_mapped")
def chip_boxes(spark, sf_dir):
    """A city box, the grid origin under a chip, its id, and the south gap of an axis, for every mapped feature."""
    m = fixture(spark, sf_dir, "fx_mapped")
    box = G.city_box(F.col("lon"), F.col("lat"), 1.5)
    return m.select("osm_id", scaled(box["xmin"]).alias("xmin"), scaled(box["ymax"]).alias("ymax"), scaled(G.snapped_origin(F.col("lon"), F.lit(60.05))).alias("origin"), G.chip_id(F.col("lon"), F.col("lat")).alias("chip_id"), scaled(G.south_gap((F.col("osm_id") % 180).cast("double")), 10).alias("gap"))


@query("SELECT count(*) AS n, min(n_name) AS first_name FROM nation WHERE lower(strip_accents(n_name)) IN ('germany', 'peru')")
def folded_names(spark, sf_dir):
    """Names that are equal without case and accents."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    hit = n.where((B.folded(F.col("n_name")) == B.folded(F.lit("Gérmany"))) | (B.folded(F.col("n_name")) == B.folded(F.lit("perú"))))
    return hit.agg(F.count("*").alias("n"), F.min("n_name").alias("first_name"))


# Rasters


def _wide_candidates(spark, sf_dir) -> DataFrame:
    b = S.with_box(_candidates(spark, sf_dir))
    wide = b.withColumns({"xmin": F.col("xmin") - PX, "ymin": F.col("ymin") - PX, "xmax": F.col("xmax") + PX, "ymax": F.col("ymax") + PX})
    return P.footprints_to_pixels(wide, PX, X0, Y0, ["cand_id"])


_P = "(0.1E0/64)"
_CFEET = f"""bx AS (SELECT cand_id, area_m2, lon-{_HX}-{_P} AS xmin, lon+{_HX}+{_P} AS xmax, lat-{_HY}-{_P} AS ymin, lat+{_HY}+{_P} AS ymax FROM fx_candidates),
fs AS (SELECT cand_id, unnest(range(CAST(ceil((xmin-60)/{_P}-0.5E0) AS BIGINT), CAST(ceil((xmax-60)/{_P}-0.5E0) AS BIGINT))) AS gx, ymin, ymax FROM bx), ft AS (SELECT cand_id, gx, unnest(range(CAST(ceil((ymin-24)/{_P}-0.5E0) AS BIGINT), CAST(ceil((ymax-24)/{_P}-0.5E0) AS BIGINT))) AS gy FROM fs),
fp AS (SELECT f.cand_id, p.prob FROM ft f JOIN px p ON p.ix = f.gx//64 AND p.iy = f.gy//64 AND p.r = f.gy%64 AND p.c = f.gx%64)"""


@query(f"WITH {_PX}, {_CFEET}, z AS (SELECT cand_id, avg(prob) AS p FROM fp GROUP BY cand_id) SELECT c.cand_id, p IS NOT NULL AS epoch_checked, {sql_scaled('CASE WHEN p IS NOT NULL THEN greatest(0.0E0, least(1.0E0, 1-p)) END', 'epoch_prior', '1E2')} FROM fx_candidates c LEFT JOIN z USING (cand_id)", "fx_pixels", "fx_candidates")
def epoch_prior(spark, sf_dir):
    """Mean probability of the earlier epoch over each candidate; unchecked where no pixel was read."""
    z = P.zonal_mean(_wide_candidates(spark, sf_dir), _pixels(spark, sf_dir).drop("id"), _candidates(spark, sf_dir).select("cand_id"), "cand_id")
    p = F.when(F.col("epoch_checked"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("old_prob"))))
    return z.select("cand_id", "epoch_checked", scaled(p, 100).alias("epoch_prior"))


@query(f"WITH {_PX}, {_CFEET}, z AS (SELECT cand_id, sum(CASE WHEN prob >= 0.05E0 THEN prob ELSE 0 END)*100 AS e FROM fp GROUP BY cand_id), q AS (SELECT c.cand_id, area_m2, least(CASE WHEN c.cand_id % 3 = 0 THEN area_m2*1.5E0 ELSE 0 END, area_m2) AS det, least(coalesce(e, 0), area_m2) AS e FROM fx_candidates c LEFT JOIN z USING (cand_id)) SELECT cand_id, {sql_scaled('det', 'det_m2', '10')}, {sql_scaled('e', 'exp_m2', '10')}, {sql_scaled('det', 'cal_m2', '10')} FROM q WHERE det > 0 OR e >= 10", "fx_pixels", "fx_candidates")
def signal_roofs(spark, sf_dir):
    """Roofs with something detected or enough expected, areas capped, calibrated area filled from the detected one."""
    e = P.zonal(_wide_candidates(spark, sf_dir), _pixels(spark, sf_dir).drop("id"), "cand_id").select("cand_id", "exp_m2")
    c = _candidates(spark, sf_dir).join(e, "cand_id", "left").fillna(0.0, ["exp_m2"]).withColumn("det_m2", F.when(F.col("cand_id") % 3 == 0, F.col("area_m2") * 1.5).otherwise(0.0)).withColumn("cal_m2", F.lit(None).cast("double"))
    return scale(D.backfilled(D.with_signal(c), {"cal_m2": "det_m2"}).select("cand_id", "det_m2", "exp_m2", "cal_m2"), "det_m2", "exp_m2", "cal_m2", by=10)


@query(f"SELECT ix, iy, r, c, {sql_scaled('60.0E0+(ix*64+c+0.5E0)*(0.1E0/64)', 'lon')}, {sql_scaled('24.0E0+(iy*64+r+0.5E0)*(0.1E0/64)', 'lat')} FROM fx_pixels", "fx_pixels")
def pixel_points(spark, sf_dir):
    p = P.pixel_points(_pixels(spark, sf_dir), PX, X0, Y0)
    return scale(p.select("ix", "iy", "r", "c", "lon", "lat"), "lon", "lat")


_CC8 = """m AS (SELECT CAST(iy*64+r AS BIGINT)*100000 + ix*64 + c AS id, ix*64+c AS x, iy*64+r AS y FROM v GROUP BY ALL),
e0 AS (SELECT a.id AS a, b.id AS b FROM m a JOIN (SELECT * FROM (VALUES (1,0),(0,1),(1,1),(-1,1)) AS s(dx,dy)) s ON true JOIN m b ON b.x = a.x + s.dx AND b.y = a.y + s.dy), e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
l AS (SELECT id, id AS l FROM m UNION SELECT e.b, l.l FROM l JOIN e ON e.a = l.id), k AS (SELECT id, min(l) AS component FROM l GROUP BY id)"""


@query(f"WITH RECURSIVE v AS (SELECT p.* FROM fx_pixels p JOIN (SELECT ix, iy, r//2 AS hr, c//2 AS hc, max(prob_u8) % 9 AS scl FROM fx_pixels GROUP BY ALL) h ON h.ix = p.ix AND h.iy = p.iy AND h.hr = p.r//2 AND h.hc = p.c//2 WHERE scl IN (4,5,6,7)), {_CC8} SELECT component, count(*) AS n_px FROM k GROUP BY component HAVING count(*) >= 2", "fx_pixels")
def coherent_clusters(spark, sf_dir):
    """Clusters, corners included, of the pixels that a class grid of twice the pixel size leaves clear."""
    p = _pixels(spark, sf_dir).withColumn("item", F.lit(1))
    classes = p.groupBy("ix", "iy", "item", F.floor(F.col("r") / 2).cast("int").alias("hr"), F.floor(F.col("c") / 2).cast("int").alias("hc")).agg((F.max("prob_u8") % 9).alias("scl")).withColumnsRenamed({"hr": "r", "hc": "c"})
    return P.clusters(P.class_masked(p, classes, least=1).select("id", "ix", "iy", "r", "c"))


ORACLES["coherent_clusters"] = ORACLES["coherent_clusters"].replace("WITH fx_pixels", "WITH RECURSIVE fx_pixels", 1).replace(", RECURSIVE v", ", v", 1)


@query(f"WITH b AS (SELECT osm_id, lon-{_HX} AS xmin, lon+{_HX} AS xmax, lat-{_HY} AS ymin, lat+{_HY} AS ymax FROM fx_mapped), s AS (SELECT ymin, ymax, unnest(range(CAST(ceil((xmin-60)/({_P}/10)-0.5E0) AS BIGINT), CAST(ceil((xmax-60)/({_P}/10)-0.5E0) AS BIGINT))) AS gx FROM b), t AS (SELECT gx, unnest(range(CAST(ceil((ymin-24)/({_P}/10)-0.5E0) AS BIGINT), CAST(ceil((ymax-24)/({_P}/10)-0.5E0) AS BIGINT))) AS gy FROM s) SELECT CAST(floor(gx/10.0E0) AS INT) AS px, CAST(floor(gy/10.0E0) AS INT) AS py, count(DISTINCT (gx, gy)) AS n_parts FROM t GROUP BY 1, 2", "fx_mapped")
def coverage_fractions(spark, sf_dir):
    """Hundredths of each pixel that mapped features cover."""
    f = P.coverage_fraction(S.with_box(fixture(spark, sf_dir, "fx_mapped")), PX, X0, Y0, ["osm_id"])
    return f.select("px", "py", F.round(F.col("fraction") * 100).cast("long").alias("n_parts"))


@query("WITH p AS (SELECT r, c, printf('%04d_%04d', ix, iy) AS tile, prob_u8 % 50 AS v FROM fx_pixels) SELECT r, c, CAST(coalesce(arg_min(CASE WHEN v <> 0 THEN v END, CASE WHEN v <> 0 THEN tile END), 0) AS INT) AS v FROM p GROUP BY r, c", "fx_pixels")
def tile_mosaic(spark, sf_dir):
    """Per pixel the value of the first tile that has one, all tiles laid over each other."""
    p = fixture(spark, sf_dir, "fx_pixels").select("r", "c", G.cell_key(F.col("ix"), F.col("iy")).alias("tile"), (F.col("prob_u8") % 50).alias("v"))
    return P.mosaic(p).withColumn("v", F.col("v").cast("int"))


@query("WITH s AS (SELECT r, c, max(prob_u8) AS v FROM fx_pixels GROUP BY r, c), t AS (SELECT r, c, count(*) AS n FROM fx_pixels GROUP BY r, c) SELECT t.r, t.c, t.n, CASE WHEN s.v <> 0 THEN s.v END AS v FROM t LEFT JOIN s ON s.r = CAST(floor(t.r*0.5E0+0.25E0) AS INT) AND s.c = CAST(floor(t.c*0.5E0+0.25E0) AS INT)", "fx_pixels")
def nearest_regrid(spark, sf_dir):
    p = fixture(spark, sf_dir, "fx_pixels")
    return P.regrid(p.groupBy("r", "c").agg(F.count("*").alias("n")), p.groupBy("r", "c").agg(F.max("prob_u8").alias("v")), 0.5, 0.25, 0.25)


@query(f"WITH t AS (SELECT osm_id, {_IX} AS ix, {_IY} AS iy, (lon-60)/{_P} AS gx, (lat-24)/{_P} AS gy FROM fx_mapped WHERE area_m2 >= 5000), q AS (SELECT osm_id, ix, iy, gx-64*ix-1 AS x1, gx-64*ix+1 AS x2, gy-64*iy-1 AS y1, gy-64*iy+1 AS y2 FROM t), j AS (SELECT osm_id, r, c, c+1 > x1 AND c < x2 AND r+1 > y1 AND r < y2 AS truth FROM fx_pixels JOIN q USING (ix, iy) WHERE c >= floor(x1)-4 AND c <= floor(x2)+4 AND r >= floor(y1)-4 AND r <= floor(y2)+4) SELECT osm_id, r, c, truth FROM j WHERE osm_id IN (SELECT osm_id FROM j WHERE truth)", "fx_mapped", "fx_pixels")
def target_pixels(spark, sf_dir):
    """Pixels around large targets, with those that the target touches."""
    m = D.with_cell(fixture(spark, sf_dir, "fx_mapped").where("area_m2 >= 5000"), GRID)
    x, y = (F.col("lon") - X0) / PX - 64 * F.col("ix"), (F.col("lat") - Y0) / PX - 64 * F.col("iy")
    t = m.select("osm_id", "ix", "iy", (x - 1).alias("x1"), (y - 1).alias("y1"), (x + 1).alias("x2"), (y + 1).alias("y2"))
    return P.around(t, fixture(spark, sf_dir, "fx_pixels").drop("prob_u8"), "osm_id", 4).select("osm_id", "r", "c", "truth")


@query(f"WITH s AS (SELECT pid, npx, max(p98_b08) AS peak, arg_max(item, {{'v': p98_b08, 'i': -item}}) AS peak_item FROM fx_scenes GROUP BY ALL) SELECT pid, npx, {sql_scaled('peak', 'peak', '100')}, peak_item FROM s", "fx_scenes")
def max_composite(spark, sf_dir):
    return scale(P.max_composite(fixture(spark, sf_dir, "fx_scenes"), ["pid", "npx"], "p98_b08"), "peak", by=100)


@query(f"WITH q AS (SELECT pid, quantile_cont(p98_b03, 0.9E0) FILTER (view_az < 200) AS p, median(p98_b03) FILTER (view_az >= 200) AS m, count(*) FILTER (view_az < 200) AS npx, count(*) FILTER (view_az >= 200) AS nring FROM fx_scenes GROUP BY pid) SELECT pid, npx, {sql_scaled('CASE WHEN npx >= 5 AND nring >= 8 THEN p END', 'inside', '100')}, {sql_scaled('CASE WHEN npx >= 5 AND nring >= 8 THEN m END', 'ring', '100')} FROM q", "fx_scenes")
def cell_scene_statistics(spark, sf_dir):
    """90th percentile inside a zone and median of its ring, where both have enough readings."""
    s = fixture(spark, sf_dir, "fx_scenes").withColumn("zone", F.when(F.col("view_az") < 200, "inside").otherwise("ring"))
    return scale(P.inside_and_ring(s, ["pid"], "p98_b03", 0.9, 5, 8).select("pid", "npx", "inside", "ring"), "inside", "ring", by=100)


@query(f"WITH w AS (SELECT pid, npx, max(p98_b03) FILTER (item % 2 = 0) AS b3, max(p98_b03) FILTER (item % 2 = 1) AS b8 FROM fx_scenes GROUP BY ALL) SELECT pid, npx, {sql_scaled('b3', 'even', '100')}, {sql_scaled('b8', 'odd', '100')} FROM w WHERE b3 IS NOT NULL AND b8 IS NOT NULL", "fx_scenes")
def pixel_cube(spark, sf_dir):
    """Readings by band in columns; what lacks a band is dropped."""
    s = fixture(spark, sf_dir, "fx_scenes").select("pid", "npx", F.when(F.col("item") % 2 == 0, "even").otherwise("odd").alias("band"), F.col("p98_b03").alias("v"))
    return scale(P.cube(s.groupBy("pid", "npx", "band").agg(F.max("v").alias("v")), ["pid", "npx"], ["even", "odd"]), "even", "odd", by=100)


_BATCH = f"t AS (SELECT osm_id AS pid, {_IX} AS ix, {_IY} AS iy, CAST(floor((lat-24)/{_P}) AS BIGINT) % 64 AS r0, CAST(floor((lon-60)/{_P}) AS BIGINT) % 64 AS c0 FROM fx_mapped), sp AS (SELECT ix, iy, r, c, CAST(prob_u8 % 3 AS BIGINT) AS item, TIMESTAMP '2024-01-01' + INTERVAL 30 SECOND * (prob_u8 % 3) AS time, CAST(prob_u8 AS DOUBLE) AS v FROM fx_pixels)"


@query(f"WITH {_BATCH}, j AS (SELECT pid, item, time, v, greatest(abs(r-r0), abs(c-c0)) AS far FROM sp JOIN t USING (ix, iy) WHERE greatest(abs(r-r0), abs(c-c0)) <= 9), s AS (SELECT pid, item, time, quantile_cont(v, 0.98E0) FILTER (far <= 3) AS p98, median(v) FILTER (far > 3) AS ring, count(*) FILTER (far <= 3) AS npx FROM j GROUP BY ALL) SELECT pid, item, npx, {sql_scaled('p98', 'p98', '100')}, {sql_scaled('ring', 'ring', '100')} FROM s WHERE npx > 0 QUALIFY row_number() OVER (PARTITION BY pid, date_trunc('minute', time) ORDER BY npx DESC, item) = 1", "fx_mapped", "fx_pixels")
def target_batch(spark, sf_dir):
    """Series of all mapped targets from the scene pixels of their tiles, in one pass."""
    m = D.with_cell(fixture(spark, sf_dir, "fx_mapped"), GRID)
    t = m.select(F.col("osm_id").alias("pid"), "ix", "iy", (F.floor((F.col("lat") - Y0) / PX) % 64).alias("r0"), (F.floor((F.col("lon") - X0) / PX) % 64).alias("c0"), F.lit(3).alias("half"))
    item = (F.col("prob_u8") % 3).cast("long")
    sp = fixture(spark, sf_dir, "fx_pixels").select("ix", "iy", "r", "c", item.alias("item"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, 30) * (prob_u8 % 3)").alias("time"), F.col("prob_u8").cast("double").alias("v"))
    return scale(glint.batch_series(t, sp).select("pid", "item", "npx", "p98", "ring"), "p98", "ring", by=100)


# Studies


@query(f"WITH {_FITS}, q AS (SELECT pid, area_m2, n_consistent, n_spikes, CASE WHEN pid % 3 = 0 THEN 'control' ELSE 'missed' END AS role FROM f) SELECT {_RBIN} AS bucket, {sql_scaled('''avg(CASE WHEN role = 'missed' THEN CASE WHEN n_consistent >= 2 THEN 1 ELSE 0 END END)''', 'missed_rate')}, {sql_scaled('''avg(CASE WHEN role = 'control' THEN CASE WHEN n_consistent >= 2 THEN 1 ELSE 0 END END)''', 'control_rate')}, {sql_scaled('''sum(CASE WHEN role = 'missed' AND n_consistent >= 2 THEN area_m2 ELSE 0 END)''', 'recovered_m2', '10')} FROM q GROUP BY 1", "fx_candidates")
def missed_recovery(spark, sf_dir):
    t = _fits(spark, sf_dir).withColumn("role", F.when(F.col("pid") % 3 == 0, "control").otherwise("missed"))
    return scale(scale(T.missed_recovery(t), "missed_rate", "control_rate"), "recovered_m2", by=10)


_CELLS = f"g AS (SELECT {_IX} AS ix, {_IY} AS iy, count(*) AS n, sum(area_m2) AS area_m2, sum(glint_consistent) AS spikes FROM fx_candidates GROUP BY 1, 2)"


def _study_cells(spark, sf_dir) -> DataFrame:
    return D.with_cell(_candidates(spark, sf_dir), GRID).groupBy("ix", "iy").agg(F.count("*").alias("n"), F.sum("area_m2").alias("area_m2"), F.sum("glint_consistent").alias("spikes"))


@query(f"WITH {_CELLS} SELECT {sql_scaled('corr(spikes, area_m2)', 'r_area', '1E5')}, {sql_scaled('corr(spikes, n)', 'r_n', '1E5')}, {sql_scaled('corr(spikes, ln(1+area_m2))', 'r_log', '1E5')} FROM g", "fx_candidates")
def cell_correlations(spark, sf_dir):
    return scale(T.cell_correlations(_study_cells(spark, sf_dir)), "r_area", "r_n", "r_log", by=100_000)


@query(f"WITH {_CELLS} SELECT CAST(n % 4 AS BIGINT) AS stratum, count(*) AS n, {sql_scaled('avg(spikes)', 'mean', '1E3')}, {sql_scaled('median(spikes)', 'median', '1E3')} FROM g GROUP BY 1", "fx_candidates")
def cell_strata_summary(spark, sf_dir):
    return scale(T.strata(_study_cells(spark, sf_dir).withColumn("stratum", F.col("n") % 4), "stratum", "spikes"), "mean", "median", by=1000)


@query(f"WITH s AS (SELECT pid, p98_b03/ring_b03 AS ratio FROM fx_scenes), a AS (SELECT pid, median(ratio) AS med, count(*) AS n FROM s GROUP BY pid), b AS (SELECT pid, median(abs(ratio-med)) AS mad FROM s JOIN a USING (pid) GROUP BY pid) SELECT pid, any_value(n) AS n, {sql_scaled('CASE WHEN any_value(n) >= 5 THEN avg(CASE WHEN ratio > med + 3*greatest(1.4826E0*mad, 0.05E0) THEN 1 ELSE 0 END) END', 'rate')} FROM s JOIN a USING (pid) JOIN b USING (pid) GROUP BY pid", "fx_scenes")
def enhancement_rate(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_scenes").withColumnsRenamed({"p98_b03": "inside", "ring_b03": "ring"})
    return scale(T.enhancement(s, ["pid"]), "rate")


@query(f"SELECT {sql_scaled('quantile_cont(w/m, 0.25E0)', 'q1', '1E3')}, {sql_scaled('quantile_cont(w/m, 0.5E0)', 'q2', '1E3')}, {sql_scaled('quantile_cont(w/m, 0.75E0)', 'q3', '1E3')} FROM (SELECT p_retailprice/3 AS w, 1.0E0 + p_size/50.0E0 AS m FROM part) WHERE w BETWEEN 350 AND 600")
def module_density(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_retailprice") / 3).alias("stc_w"), (1.0 + F.col("p_size") / 50.0).alias("area_m2"))
    return T.module_density(m).select(*[scaled(F.col("q")[k], 1000).alias(f"q{k + 1}") for k in range(3)])


_REGION = "r AS (SELECT g.region_id, sum(area_m2)*0.0002E0 AS mwp FROM fx_candidates c JOIN fx_regions g ON g.level = 'county' AND lon >= xmin AND lon < xmax AND lat >= ymin AND lat < ymax GROUP BY 1)"


def _county_mwp(spark, sf_dir) -> DataFrame:
    r = fixture(spark, sf_dir, "fx_regions").where("level = 'county'")
    return S.attach_region(_candidates(spark, sf_dir), r, key="cand_id").groupBy("region_id").agg((F.sum("area_m2") * 0.0002).alias("mwp"))


@query(f"WITH {_REGION}, y AS (SELECT region_id, 1500.0E0 + region_id AS k FROM fx_regions WHERE level = 'county' AND region_id % 3 > 0) SELECT r.region_id, {sql_scaled('mwp*k/1000', 'gwh', '1E3')} FROM r LEFT JOIN y ON y.region_id = r.region_id", "fx_candidates", "fx_regions")
def yearly_yield(spark, sf_dir):
    y = fixture(spark, sf_dir, "fx_regions").where("level = 'county' AND region_id % 3 > 0").select("region_id", (1500.0 + F.col("region_id")).alias("kwh_per_kwp"))
    return D.yearly_yield(_county_mwp(spark, sf_dir), y).select("region_id", scaled("gwh", 1000).alias("gwh"))


_GROW = "o AS (SELECT region_id, mwp*(region_id % 5)/5 AS old FROM r), j AS (SELECT r.region_id, mwp, round_even(mwp - coalesce(old, 0), 4) AS d FROM r LEFT JOIN o USING (region_id))"


@query(f"WITH {_REGION}, {_GROW} SELECT region_id, {sql_scaled('d', 'mwp_delta', '1E3')} FROM j ORDER BY d DESC, region_id LIMIT 10", "fx_candidates", "fx_regions")
def top_growth(spark, sf_dir):
    """The ten counties that grew most."""
    now = _county_mwp(spark, sf_dir)
    old = now.withColumn("mwp", F.col("mwp") * (F.col("region_id") % 5) / 5)
    _, top = T.growth_totals(D.growth(now, old, ["region_id"], ["mwp"]), old, "mwp")
    return top.select("region_id", scaled("mwp_delta", 1000).alias("mwp_delta"))


@query(f"WITH {_REGION} SELECT count(*) AS n, {sql_scaled('sum(mwp)', 'mwp', '1E3')} FROM r", "fx_candidates", "fx_regions")
def national_totals(spark, sf_dir):
    return _county_mwp(spark, sf_dir).agg(F.count("*").alias("n"), scaled(F.sum("mwp"), 1000).alias("mwp"))


@query(f"SELECT {', '.join(sql_scaled(f'quantile_cont(area_m2, {q}E0)', f'q{k}', '100') for k, q in enumerate((0.0, 0.25, 0.5, 0.75, 0.9, 1.0)))} FROM fx_buildings", "fx_buildings")
def distance_quantiles(spark, sf_dir):
    return T.distances(_buildings(spark, sf_dir), "area_m2").select(*[scaled(F.col("q")[k], 100).alias(f"q{k}") for k in range(6)])


@query(f"WITH {_FITS} SELECT CAST(n_spikes AS BIGINT) AS n_spikes, count(*) AS n, count(fit_tilt) AS n_fitted, {sql_scaled('median(fit_tilt)', 'med_tilt', '10')}, {sql_scaled('median(fit_az)', 'med_az', '10')} FROM f GROUP BY 1", "fx_candidates")
def orientation_summary(spark, sf_dir):
    return scale(T.orientations(_fits(spark, sf_dir), "n_spikes"), "med_tilt", "med_az", by=10)


@query(f"WITH {_FITS}, q AS (SELECT {_RBIN} AS bucket, CASE WHEN n_consistent >= 2 THEN 1 ELSE 0 END AS ok, pid % 3 > 0 AS is_mapped FROM f) SELECT bucket, count(*) AS n, {sql_scaled('avg(CASE WHEN is_mapped THEN ok END)', 'recall')}, {sql_scaled('avg(CASE WHEN NOT is_mapped THEN ok END)', 'flagged')} FROM q GROUP BY GROUPING SETS ((bucket), ())", "fx_candidates")
def detection_report(spark, sf_dir):
    return scale(T.detection_report(_fits(spark, sf_dir).withColumn("is_mapped", F.col("pid") % 3 > 0)), "recall", "flagged")


@query(f"WITH {_FITS}, q AS (SELECT {_RBIN} AS bucket, count(*) AS n, avg(CASE WHEN n_consistent >= 2 THEN 100 ELSE 0 END) AS pct FROM (SELECT f.* FROM f JOIN fx_candidates p ON p.cand_id = f.pid AND p.lon < 61) GROUP BY 1), k AS (SELECT bin AS bucket, 100.0E0*sens_k/sens_n AS country FROM fx_bins) SELECT q.bucket, n, {sql_scaled('pct', 'box_pct', '1E3')}, {sql_scaled('country', 'country_pct', '1E3')}, {sql_scaled('pct-country', 'difference', '1E3')} FROM q LEFT JOIN k USING (bucket)", "fx_candidates", "fx_bins")
def box_rates(spark, sf_dir):
    """Validated share by size among half of the targets, beside the study's."""
    country = fixture(spark, sf_dir, "fx_bins").select(F.col("bin").alias("bucket"), (100.0 * F.col("sens_k") / F.col("sens_n")).alias("pct"))
    west = _fits(spark, sf_dir).join(_candidates(spark, sf_dir).where("lon < 61").select(F.col("cand_id").alias("pid")), "pid")
    return scale(T.box_against_country(west, country), "box_pct", "country_pct", "difference", by=1000)


@query(f"WITH {_FITS} SELECT pid, CAST(floor(fit_az/15.0E0) AS BIGINT) AS az_bin, CAST((fit_az+90) % 180 AS BIGINT) AS row_axis FROM f WHERE fit_az IS NOT NULL QUALIFY row_number() OVER (PARTITION BY floor(fit_az/15.0E0) ORDER BY n_consistent DESC, n_spikes DESC, pid) <= 3", "fx_candidates")
def azimuth_picks(spark, sf_dir):
    return T.azimuth_picks(_fits(spark, sf_dir)).select("pid", F.col("az_bin").cast("long").alias("az_bin"), F.col("row_axis").cast("long").alias("row_axis"))


@query(f"WITH {_FITS} SELECT {_RBIN} AS bucket, arg_max(pid, {{'a': n_consistent, 'b': n_spikes, 'c': -pid}}) AS pid FROM f GROUP BY 1", "fx_candidates")
def best_examples(spark, sf_dir):
    return C.best_examples(_fits(spark, sf_dir))


@query("WITH q AS (SELECT quantile_cont(area_m2, 1/3) AS a, quantile_cont(area_m2, 2/3) AS b FROM fx_buildings), t AS (SELECT id, CASE WHEN area_m2 > a THEN 1 ELSE 0 END + CASE WHEN area_m2 > b THEN 1 ELSE 0 END AS stratum FROM fx_buildings, q) SELECT id, stratum FROM t QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY (id*7919) % 10007, id) <= 20", "fx_buildings")
def tercile_sample(spark, sf_dir):
    return T.terciles(_buildings(spark, sf_dir), 60, "id").select("id", "stratum")


_GRID = f"c AS (SELECT a.ix, a.iy, coalesce(g.m2, 0) AS area_m2, a.ix*10000 + a.iy AS k FROM (SELECT unnest(range(20)) AS ix, iy FROM (SELECT unnest(range(10)) AS iy)) a LEFT JOIN (SELECT {_IX} AS ix, {_IY} AS iy, sum(area_m2) AS m2 FROM fx_candidates WHERE confidence >= 0.9E0 AND area_m2 < 3000 GROUP BY 1, 2) g USING (ix, iy))"


@query(f"WITH {_GRID}, d AS (SELECT ix, iy, k FROM c WHERE area_m2 > 0 ORDER BY area_m2 DESC, k LIMIT 15), m AS (SELECT ix, iy FROM c WHERE k NOT IN (SELECT k FROM d) AND area_m2 BETWEEN 500 AND 3000 ORDER BY (k*7919) % 10007, k LIMIT 10), z AS (SELECT ix, iy FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.area_m2 > 0 AND abs(o.ix-c.ix) <= 1 AND abs(o.iy-c.iy) <= 1) ORDER BY (k*7919) % 10007, k LIMIT 15) SELECT CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, stratum FROM (SELECT ix, iy, 'dense' AS stratum FROM d UNION ALL SELECT ix, iy, 'mid' FROM m UNION ALL SELECT ix, iy, 'zero' FROM z)", "fx_candidates")
def cell_sample(spark, sf_dir):
    """Cells for a study: the fullest, some in the middle, and empty ones."""
    grid = spark.range(200).select((F.col("id") % 20).cast("int").alias("ix"), F.floor(F.col("id") / 20).cast("int").alias("iy"))
    own = D.with_cell(_candidates(spark, sf_dir).where("confidence >= 0.9 AND area_m2 < 3000"), GRID).groupBy("ix", "iy").agg(F.sum("area_m2").alias("area_m2"))
    s = C.cell_strata(grid.join(own, ["ix", "iy"], "left").fillna(0.0, ["area_m2"]))
    return s.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), "stratum")


@query("SELECT osm_id, placement || '-' || lpad(CAST(k AS VARCHAR), 2, '0') AS target FROM (SELECT *, row_number() OVER (PARTITION BY placement ORDER BY area_m2 DESC, osm_id) AS k FROM fx_mapped WHERE area_m2 >= 400) WHERE k <= 25", "fx_mapped")
def largest_targets(spark, sf_dir):
    return C.largest(fixture(spark, sf_dir, "fx_mapped"), "placement", 25, 400.0, "osm_id").select("osm_id", "target")


@query("SELECT osm_id FROM fx_mapped ORDER BY (osm_id*7919) % 10007, osm_id LIMIT 40", "fx_mapped")
def random_targets(spark, sf_dir):
    return C.random_targets(fixture(spark, sf_dir, "fx_mapped"), 40, "osm_id").select("osm_id")


@query("SELECT cand_id FROM fx_candidates WHERE cand_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", "fx_candidates")
def resume_set(spark, sf_dir):
    """Candidates that a resumed study has not scored yet."""
    done = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("cand_id"))
    ranked = _candidates(spark, sf_dir).withColumn("rank", F.col("cand_id"))
    return C.not_yet_scored(ranked, done).select("cand_id")


@query(f"SELECT {_IX} AS ix, {_IY} AS iy, count(*) AS n_labels FROM fx_mapped WHERE area_m2 >= 400 GROUP BY 1, 2 ORDER BY n_labels DESC, ix, iy LIMIT 25", "fx_mapped")
def top_label_cells(spark, sf_dir):
    return D.top_cells(fixture(spark, sf_dir, "fx_mapped"), 25, GRID)


@query("SELECT osm_id AS key FROM fx_mapped INTERSECT SELECT cand_id FROM fx_candidates", "fx_mapped", "fx_candidates")
def keys_in_both(spark, sf_dir):
    m, c = fixture(spark, sf_dir, "fx_mapped").select(F.col("osm_id").alias("key")), _candidates(spark, sf_dir).select(F.col("cand_id").alias("key"))
    return T.in_both(T.required(m, ["key"]), c, "key")


@query(f"SELECT {sql_scaled('sqrt(avg((p-t)*(p-t)))', 'rmse', '1E3')}, {sql_scaled('avg(abs(p-t))', 'mae', '1E3')}, {sql_scaled('corr(p,t)*corr(p,t)', 'r2', '1E5')}, {sql_scaled('sum(p*t)/sum(t*t)', 'slope', '1E5')}, {sql_scaled('avg(p-t)', 'bias', '1E3')} FROM (SELECT area_m2 AS t, area_m2*(0.5E0 + confidence) AS p FROM fx_candidates)", "fx_candidates")
def regression_metrics(spark, sf_dir):
    c = _candidates(spark, sf_dir).select(F.col("area_m2").alias("t"), (F.col("area_m2") * (0.5 + F.col("confidence"))).alias("p"))
    return scale(scale(E.regression(c, "p", "t"), "rmse", "mae", "bias", by=1000), "r2", "slope", by=100_000)


# Glint


_ANNOTATED = series._annotated(True)


def _annotated(spark, sf_dir) -> DataFrame:
    return glint.annotated(series._series(spark, sf_dir), series.BANDS)


@query(f"WITH {_ANNOTATED}, t AS (SELECT pid, item, time, row_number() OVER (PARTITION BY pid ORDER BY p98_b03-ring_b03 DESC, item) AS k FROM a WHERE is_spike), u AS (SELECT * FROM t WHERE k <= 6), mm AS (SELECT pid, median(epoch_us(time)/1E6) AS mid FROM u GROUP BY pid), bb AS (SELECT a.pid, item, row_number() OVER (PARTITION BY a.pid ORDER BY abs(epoch_us(time)/1E6 - mid), item) AS k FROM a JOIN mm USING (pid) WHERE is_clear AND NOT is_spike) SELECT pid, item, CAST(k AS INT) AS k, 'spike' AS role FROM u UNION ALL SELECT pid, item, CAST(k AS INT), 'base' FROM bb WHERE k <= 8", "fx_scenes")
def strongest_spikes(spark, sf_dir):
    return glint.strongest(_annotated(spark, sf_dir), "b03")


@query(f"WITH {_FITS}, c AS (SELECT cand_id, area_m2, confidence, list_extract([0.025E0,0.088E0,0.162E0,0.306E0,0.293E0,0.261E0], {_BIN} + 1)/0.087E0 AS r FROM fx_candidates), j AS (SELECT cand_id, confidence, r, coalesce(n_spikes, 0) AS s, coalesce(n_consistent, 0) AS glint_consistent FROM c LEFT JOIN (SELECT pid, n_spikes, n_consistent FROM f WHERE n_scenes >= 22) f ON pid = cand_id) SELECT cand_id, CAST(s AS BIGINT) AS glint_spikes, CAST(glint_consistent AS BIGINT) AS glint_consistent, {sql_scaled(_BOOST, 'glint_prior', '1E4')} FROM j", "fx_candidates")
def glint_prior(spark, sf_dir):
    """Candidates with the reward of their fit; those never queried keep zeros."""
    c = _candidates(spark, sf_dir).withColumn("rank_score", F.col("confidence"))
    out = glint.glint_prior(c, _fits(spark, sf_dir).where("n_scenes >= 22"))
    return out.select("cand_id", F.col("glint_spikes").cast("long").alias("glint_spikes"), F.col("glint_consistent").cast("long").alias("glint_consistent"), scaled("glint_prior", 10_000).alias("glint_prior"))


@query(f"WITH {_ANNOTATED}, ss AS (SELECT a.pid, a.item, epoch_us(a.time)/86400E6 AS t FROM a WHERE is_spike), p AS (SELECT pid, epoch_us(time)/86400E6 AS t, CAST(item % 9 AS DOUBLE) AS mis, time FROM fx_scenes WHERE cloud < 40), j AS (SELECT ss.pid, ss.item, abs(ss.t-p.t) AS gap, mis, time FROM ss JOIN p USING (pid) WHERE abs(ss.t-p.t) <= 2) SELECT pid, item, {sql_scaled('gap', 'gap', '1E6')}, mis <= 3 AS hit FROM j QUALIFY row_number() OVER (PARTITION BY pid, item ORDER BY gap, time) = 1", "fx_scenes")
def spike_passes(spark, sf_dir):
    """Each spike with the nearest pass of its target within two days."""
    passes = fixture(spark, sf_dir, "fx_scenes").where("cloud < 40").select("pid", "time", (F.col("item") % 9).cast("double").alias("misalignment"))
    return glint.nearest_pass(_annotated(spark, sf_dir).where("is_spike"), passes).select("pid", "item", scaled("gap").alias("gap"), "hit")


@query(f"SELECT item, CAST(p98_b03 + CASE WHEN item % 2 = 0 THEN 1000 ELSE 0 END AS BIGINT) AS dn, {sql_scaled('(sun_az - view_az + 180) - 360*floor((sun_az - view_az + 180)/360) - 180', 'turn', '10')} FROM fx_scenes", "fx_scenes")
def provider_offsets(spark, sf_dir):
    """Digital numbers on one footing, and the signed turn from the view to the sun."""
    s = fixture(spark, sf_dir, "fx_scenes")
    return s.select("item", solar.with_provider_offset("p98_b03", F.col("item") % 2 == 0).cast("long").alias("dn"), scaled(solar.circular_difference("sun_az", "view_az"), 10).alias("turn"))


@query(f"WITH {_FITS}, q AS (SELECT *, CASE WHEN pid % 3 = 0 THEN 'plant' ELSE 'generator' END AS kind FROM f) SELECT kind, count(*) AS n, {sql_scaled('median(area_m2)', 'med_area', '10')}, {sql_scaled('median(n_scenes)', 'med_scenes', '10')}, {sql_scaled('avg(CASE WHEN n_spikes >= 1 THEN 100 ELSE 0 END)', 'pct_detected', '10')}, {sql_scaled('avg(CASE WHEN n_consistent >= 2 THEN 100 ELSE 0 END)', 'pct_validated', '10')}, {sql_scaled('median(CASE WHEN n_spikes >= 1 THEN n_spikes END)', 'med_spikes', '10')} FROM q GROUP BY kind", "fx_candidates")
def study_by_kind(spark, sf_dir):
    f = _fits(spark, sf_dir).withColumn("kind", F.when(F.col("pid") % 3 == 0, "plant").otherwise("generator"))
    return scale(T.by_group(f, "kind"), "med_area", "med_scenes", "pct_detected", "pct_validated", "med_spikes", by=10)


@query("SELECT id FROM fx_buildings WHERE area_m2 BETWEEN 80 AND 2000 AND bf_confidence >= 0.75E0", "fx_buildings")
def size_band(spark, sf_dir):
    return C.in_band(_buildings(spark, sf_dir), 80.0, 2000.0, ("bf_confidence", 0.75)).select("id")


@query(f"WITH {_TILES} SELECT id FROM fx_buildings a WHERE area_m2 >= 400 AND EXISTS (SELECT 1 FROM t WHERE {_IN_TILE}) AND NOT EXISTS (SELECT 1 FROM fx_mapped b WHERE {_CLOSE} AND {_GAP} <= 75)", "fx_buildings", "fx_tiles", "fx_mapped")
def free_large_roofs(spark, sf_dir):
    """Large roofs in the coverage and away from mapped features."""
    return S.away_from(_buildings(spark, sf_dir).where("area_m2 >= 400"), _tiles(spark, sf_dir), fixture(spark, sf_dir, "fx_mapped"), "id", 75.0).select("id")


@query("SELECT cand_id FROM fx_candidates WHERE (cand_id % 50)/100.0E0 > 0.35E0 OR (cand_id % 70)/100.0E0 > 0.35E0", "fx_candidates")
def vegetation_negatives(spark, sf_dir):
    """Candidates vetoed by their greenness in composites or over the year."""
    c = _candidates(spark, sf_dir).select("cand_id", (F.col("cand_id") % 50 / 100).alias("max_ndvi"), (F.col("cand_id") % 70 / 100).alias("ndvi_p95"), (F.col("cand_id") % 100 / 100).alias("epoch_prior"))
    return N.vegetation_negatives(C.veto(c)).select("cand_id")


@query(f"WITH a AS (SELECT {_IX} AS ix, {_IY} AS iy, count(*) AS n FROM fx_buildings GROUP BY 1, 2), b AS (SELECT {_IX} AS ix, {_IY} AS iy, count(*) AS k FROM fx_candidates GROUP BY 1, 2) SELECT a.ix, a.iy, n, k FROM a JOIN b ON b.ix = a.ix + 3 AND b.iy = a.iy + 2", "fx_buildings", "fx_candidates")
def linked_cells(spark, sf_dir):
    """Cells with those of a grid that is numbered further by three and two."""
    count = lambda df, n: D.with_cell(df, GRID).groupBy("ix", "iy").agg(F.count("*").alias(n))
    return N.linked_cells(count(_buildings(spark, sf_dir), "n"), count(_candidates(spark, sf_dir), "k"), 3, 2).select("ix", "iy", "n", F.col("o_k").alias("k"))


@query("WITH r AS (SELECT ags, sum(CASE WHEN art='building' THEN kw ELSE 0 END) AS kw_roof FROM fx_register WHERE commissioned <= DATE '1996-01-01' AND (status = 'operating' OR coalesce(decommissioned > DATE '1996-01-01', false)) GROUP BY ags), g AS (SELECT DISTINCT lpad(CAST(region_id + CASE WHEN level = 'county' THEN 5 ELSE 0 END AS VARCHAR), 8, '0') AS ags FROM fx_regions), l AS (SELECT lpad(CAST(osm_id % 25 AS VARCHAR), 8, '0') AS ags, sum(area_m2) AS m2 FROM fx_mapped WHERE placement = 'rooftop' GROUP BY 1), j AS (SELECT ags, coalesce(kw_roof, 0) AS kw_roof, coalesce(m2, 0) AS m2 FROM g LEFT JOIN r USING (ags) LEFT JOIN l USING (ags)) SELECT ags, round_even(m2*0.2E0/greatest(kw_roof, 1E-6), 4) >= 0.6E0 AND kw_roof >= 50 AS well_mapped, " + sql_scaled("kw_roof", "kw_roof", "1E3") + " FROM j", "fx_register", "fx_regions", "fx_mapped")
def completeness_everywhere(spark, sf_dir):
    """Completeness of all municipalities, also of those without units."""
    from solargrid.operators import calibration as K

    areas = fixture(spark, sf_dir, "fx_regions").select(F.lpad((F.col("region_id") + F.when(F.col("level") == "county", 5).otherwise(0)).cast("int").cast("string"), 8, "0").alias("ags"))
    labels = fixture(spark, sf_dir, "fx_mapped").where("placement = 'rooftop'").groupBy(F.lpad((F.col("osm_id") % 25).cast("string"), 8, "0").alias("ags")).agg(F.sum("area_m2").alias("label_m2"))
    c = K.completeness(labels, K.register_by_area(fixture(spark, sf_dir, "fx_register"), "1996-01-01"), areas=areas)
    return c.select("ags", "well_mapped", scaled("kw_roof", 1000).alias("kw_roof"))


_AXIS = "least(abs(((r*7+c)%180+90)%360-180), abs(((r*7+c)%180+270)%360-180))"


@query(f"WITH {_PX}, q AS (SELECT prob, {_AXIS} AS gap, CASE WHEN (r+c)%5 = 0 THEN 1 ELSE 0 END AS t FROM px), s AS (SELECT label, 0.2E0 + bin/10 AS threshold FROM fx_bins) SELECT label AS strategy, count(*) FILTER (prob >= threshold AND gap <= 35 AND t = 1) AS shared, count(*) FILTER ((prob >= threshold AND gap <= 35) OR t = 1) AS either FROM q, s GROUP BY label", "fx_pixels", "fx_bins")
def roof_axis_iou(spark, sf_dir):
    """IoU of thresholds on pixels whose roof axis lets a side face south within 35 degrees."""
    axis = ((F.col("r") * 7 + F.col("c")) % 180).cast("double")
    m = _pixels(spark, sf_dir).withColumn("mask", F.when((F.col("r") + F.col("c")) % 5 == 0, 1).otherwise(0)).withColumn("gate", 35 - G.south_gap(axis))
    s = fixture(spark, sf_dir, "fx_bins").select(F.col("label").alias("strategy"), (F.lit(0.2) + F.col("bin") / 10).alias("threshold"), F.lit(0.0).alias("gate"))
    return E.strategy_iou(m, s).select("strategy", "shared", "either")


@query(f"WITH {_ANNOTATED}, {series._fit('a')}, d AS (SELECT a.pid, median(CASE WHEN is_spike THEN p98_b03-ring_b03 END) AS amp FROM a GROUP BY a.pid) SELECT z.pid, n_spikes, n_consistent, {sql_scaled('amp', 'amplitude')} FROM z JOIN d USING (pid)".replace(", d AS (SELECT a.pid, median(CASE", ", dd AS (SELECT a.pid, median(CASE").replace("FROM z JOIN d USING", "FROM z JOIN dd USING"), "fx_scenes")
def fit_diagnostics(spark, sf_dir):
    return glint.fit_diagnostics(_annotated(spark, sf_dir), "b03").select("pid", "n_spikes", "n_consistent", scaled("amplitude").alias("amplitude"))


@query(f"WITH {_ANNOTATED}, {series._fit('a')}, e AS (SELECT pid, count(*) AS n_events FROM a WHERE is_spike GROUP BY pid HAVING count(*) >= 2) SELECT pid, n_events, z.n_consistent FROM e JOIN z USING (pid) WHERE z.n_consistent >= 2", "fx_scenes")
def oriented_pixels(spark, sf_dir):
    """Pixels (a series each) whose anomalies agree on one orientation."""
    return P.oriented(_annotated(spark, sf_dir).where("is_spike"), "pid").select("pid", "n_events", "n_consistent")


@query("WITH t AS (SELECT printf('%04d_%04d', ix, iy) AS tile, r, c, max(prob_u8) AS v FROM fx_pixels GROUP BY ALL), p AS (SELECT tile, arg_max({'r': r, 'c': c}, {'v': v, 'r': -r, 'c': -c}) AS p FROM t GROUP BY tile) SELECT tile, CAST(p.r AS INT) AS r, CAST(p.c AS INT) AS c, " + sql_scaled("sqrt((p.r-32)*(p.r-32) + (p.c-32)*(p.c-32))*10", "offset_m", "10") + " FROM p", "fx_pixels")
def peak_offsets(spark, sf_dir):
    """The brightest pixel of each tile and its distance from the centre."""
    p = fixture(spark, sf_dir, "fx_pixels").withColumn("tile", G.cell_key(F.col("ix"), F.col("iy")))
    centres = p.select("tile").distinct().select("tile", F.lit(32).alias("r0"), F.lit(32).alias("c0"))
    return P.peak_offset(p, centres, "tile", "prob_u8").select("tile", "r", "c", scaled("offset_m", 10).alias("offset_m"))


@query("SELECT region_id, 1 AS n_rings, " + sql_scaled("xmin", "xmin", "1E4") + ", " + sql_scaled("ymax", "ymax", "1E4") + " FROM fx_regions WHERE level = 'county'", "fx_regions")
def geojson_regions(spark, sf_dir):
    """Regions as GeoJSON texts, read back as rings."""
    r = fixture(spark, sf_dir, "fx_regions").where("level = 'county'")
    text = F.format_string('{"type":"Polygon","coordinates":[[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]}', *[F.col(f"{a}{m}").cast("string") for x, y in (("min", "min"), ("max", "min"), ("max", "max"), ("min", "max"), ("min", "min")) for a, m in (("x", x), ("y", y))])
    rings = tables.geojson_rings(text)
    box = G.bounds(rings)
    return r.select("region_id", F.size(rings).alias("n_rings"), scaled(box["xmin"], 10_000).alias("xmin"), scaled(box["ymax"], 10_000).alias("ymax"))


# Training


@query("SELECT chip, arg_min(id, {'h': (id*7919) % 10007, 'i': id}) AS id FROM (SELECT id, CAST(round_even(lon/0.02E0, 0) AS BIGINT)*100000 + CAST(round_even(lat/0.02E0, 0) AS BIGINT) AS chip FROM fx_buildings) GROUP BY chip", "fx_buildings")
def one_chip_per_place(spark, sf_dir):
    c = N.one_per_place(_buildings(spark, sf_dir), "id")
    return c.select((F.bround(F.col("lon") / 0.02).cast("long") * 100_000 + F.bround(F.col("lat") / 0.02).cast("long")).alias("chip"), "id")


@query(f"WITH {_PX} SELECT printf('%04d_%04d', ix, iy) AS chip_id, CASE WHEN ix % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) FILTER (prob_u8 >= 128) AS pv_pixels, {sql_scaled('sum(CASE WHEN prob_u8 >= 128 THEN prob ELSE 0 END)', 'pv_frac_sum', '1E3')} FROM px GROUP BY ix, iy", "fx_pixels")
def chip_label_counts(spark, sf_dir):
    p = _pixels(spark, sf_dir).select(G.cell_key(F.col("ix"), F.col("iy")).alias("chip_id"), F.when(F.col("ix") % 5 == 0, "val").otherwise("train").alias("split"), (F.col("prob_u8") >= 128).cast("int").alias("mask"), F.col("prob").alias("fraction"))
    return scale(N.chip_counts(p), "pv_frac_sum", by=1000)


@query(f"WITH {_TILES}, c AS (SELECT DISTINCT * FROM t) SELECT file AS chip_id, osm_id FROM fx_mapped JOIN c ON lon-{_HX} <= xmax AND lon+{_HX} >= xmin AND lat-{_HY} <= ymax AND lat+{_HY} >= ymin", "fx_mapped", "fx_tiles")
def labels_in_chips(spark, sf_dir):
    chips = _tiles(spark, sf_dir).withColumnRenamed("file", "chip_id").distinct()
    return N.labels_in_chips(S.with_box(fixture(spark, sf_dir, "fx_mapped")), chips)


@query("SELECT count(*) AS negatives, count(*) FILTER (prob_u8 > 200) AS contaminated FROM fx_pixels WHERE r % 3 > 0", "fx_pixels")
def contaminated_negatives(spark, sf_dir):
    p = fixture(spark, sf_dir, "fx_pixels").select(F.when(F.col("r") % 3 == 0, "positive").otherwise("near_negative").alias("kind"), F.greatest(F.col("prob_u8") - 200, F.lit(0)).alias("pv_pixels"))
    return N.contaminated(p)


@query("SELECT osm_id AS chip_id, 'new' AS origin FROM fx_mapped WHERE osm_id % 3 = 0 UNION ALL SELECT cand_id, 'old' FROM fx_candidates WHERE cand_id NOT IN (SELECT osm_id FROM fx_mapped WHERE osm_id % 3 = 0)", "fx_mapped", "fx_candidates")
def merged_chip_index(spark, sf_dir):
    new = fixture(spark, sf_dir, "fx_mapped").where("osm_id % 3 = 0").select(F.col("osm_id").alias("chip_id"), F.lit("new").alias("origin"))
    return N.merged_index(_candidates(spark, sf_dir).select(F.col("cand_id").alias("chip_id"), F.lit("old").alias("origin")), new)


@query("WITH m AS (SELECT osm_id AS key, area_m2, 'missed' AS role FROM fx_mapped WHERE osm_id NOT IN (SELECT cand_id FROM fx_candidates WHERE glint_consistent > 1)), q AS (SELECT id AS key, area_m2, 'control' AS role FROM fx_buildings WHERE id % 4 > 0 AND area_m2 BETWEEN 50 AND 5000), u AS (SELECT * FROM m WHERE area_m2 < 5000 UNION ALL SELECT * FROM q) SELECT key, role FROM m WHERE area_m2 >= 5000 UNION ALL (SELECT key, role FROM u QUALIFY row_number() OVER (PARTITION BY role, " + _RBIN + " ORDER BY (key*7919) % 10007, key) <= 15)", "fx_mapped", "fx_candidates", "fx_buildings")
def missed_and_controls(spark, sf_dir):
    b = _buildings(spark, sf_dir)
    hits = _candidates(spark, sf_dir).where("glint_consistent > 1").select(F.col("cand_id").alias("osm_id"))
    return N.missed_and_controls(fixture(spark, sf_dir, "fx_mapped"), b, hits, b.where("id % 4 = 0"), 15).select("key", "role")


# Chains


@query(f"WITH h AS (SELECT {_IX} AS ix, {_IY} AS iy, count(*) AS n FROM fx_buildings GROUP BY 1, 2), l AS (SELECT {_IX} AS ix, {_IY} AS iy, count(*) AS k FROM fx_mapped WHERE placement = 'ground' GROUP BY 1, 2) SELECT ix, iy, coalesce(n, 0) AS n_buildings, coalesce(k, 0) AS n_labels FROM h FULL JOIN l USING (ix, iy) WHERE coalesce(n, 0) >= 70 OR coalesce(k, 0) > 0", "fx_buildings", "fx_mapped")
def compose_cells(spark, sf_dir):
    return api.compose(_buildings(spark, sf_dir), fixture(spark, sf_dir, "fx_mapped").where("placement = 'ground'"), 70, GRID)




# Angle grids

_NODES = "nd AS (SELECT ix*100 + iy AS scene, r AS n_row, c AS n_col, prob_u8 AS v FROM fx_pixels WHERE prob_u8 >= 60)"
_POINTS = "pt AS (SELECT id, CAST(floor((lon-60.0E0)/0.1E0) AS INT)*100 + CAST(floor((lat-24.0E0)/0.1E0) AS INT) AS scene, (lon - 60.0E0 - floor((lon-60.0E0)/0.1E0)*0.1E0)*6300 AS x_m, (lat - 24.0E0 - floor((lat-24.0E0)/0.1E0)*0.1E0)*6300 AS y_m FROM fx_buildings)"


@query(f"WITH {_NODES}, {_POINTS}, w AS (SELECT *, CAST(greatest(round_even(x_m/10, 0), 0) AS INT) AS col, CAST(greatest(round_even(y_m/10, 0), 0) AS INT) AS row FROM pt), j AS (SELECT id, pow(row-n_row, 2) + pow(col-n_col, 2) AS d2, n_row, n_col, v FROM w JOIN nd USING (scene)) SELECT id, CAST(arg_min(v, {{'d': d2, 'r': n_row, 'c': n_col}}) AS BIGINT) AS angle, CAST(min(d2) = 0 AS BOOLEAN) AS own_node FROM j GROUP BY id", "fx_pixels", "fx_buildings")
def view_angles(spark, sf_dir):
    """The angle at every building from its tile's grid, which comes as lines of text with gaps."""
    px = fixture(spark, sf_dir, "fx_pixels").withColumn("scene", F.col("ix") * 100 + F.col("iy"))
    v = F.when(F.col("prob_u8") >= 60, F.col("prob_u8").cast("string")).otherwise("NaN")
    # A line has a value for each of 64 columns; pixels that are not there are gaps too.
    line = px.groupBy("scene", F.col("r").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("c", v.alias("v")))).alias("m"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("NaN"))), " ")
    nodes = tables.angle_grid(line.select("scene", "row", text.alias("text")), ["scene"])
    cell = lambda c, o: F.floor((F.col(c) - o) / 0.1).cast("int")
    metres = lambda c, o: (F.col(c) - o - F.floor((F.col(c) - o) / 0.1) * 0.1) * 6300
    points = _buildings(spark, sf_dir).select("id", (cell("lon", X0) * 100 + cell("lat", Y0)).alias("scene"), metres("lon", X0).alias("x_m"), metres("lat", Y0).alias("y_m"))
    found = tables.angle_at(points, nodes.withColumns({"n_row": F.col("row"), "n_col": F.col("col")}), 10.0)
    return found.select("id", F.col("value").cast("long").alias("angle"), ((F.col("n_row") == F.col("row")) & (F.col("n_col") == F.col("col"))).alias("own_node"))


QUERIES = _QUERIES
