"""Queries over polygons: outlines of pixels, unions, distances, shares and zonal sums, with SQL that works them out by edges.

Candidates are diamonds, buildings squares and mapped features triangles around their points; municipalities are hexagons,
the one of each county with a hole in its middle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.functions import geometry as G
from solargrid.functions import shapes
from solargrid.operators import candidates as C
from solargrid.operators import density as D
from solargrid.operators import outlines as O
from solargrid.operators import pixels as P
from solargrid.operators import spatial as S
from solargrid.plans import api
from solargrid.plans.common import GRID, scale, scaled, sql_scaled
from solargrid.plans.pixels import _CC, _PIX, PX, _pixels
from solargrid.sources import tables
from solargrid.sources.fixtures import fixture, with_views

X0, Y0 = GRID.x0, GRID.y0
#: Corners in half sides from the centre, counter-clockwise; a diamond has the area of its square.
Q = 2.0**0.5
SQUARE = ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))
DIAMOND = ((-Q, 0.0), (0.0, -Q), (Q, 0.0), (0.0, Q))
TRIANGLE = ((-1.0, -1.0), (1.0, -1.0), (0.0, 1.0))
#: Corners in a county's box, and those of its hole, which is wound the other way.
HEXAGON = ((0.2613, 0.0117), (0.7431, 0.0213), (0.9817, 0.5371), (0.7393, 0.9871), (0.2417, 0.9733), (0.0171, 0.4637))
HOLE = ((0.4123, 0.4091), (0.3911, 0.6137), (0.6071, 0.5923), (0.5937, 0.3871))
_QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *views: str):
    def add(f):
        _QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(*views, sql=sql)
        return f

    return add


# Shapes, as columns and as SQL


def _around(df: DataFrame, corners) -> DataFrame:
    hx, hy = G.half_sides(F.col("area_m2"), F.col("lat"))
    ring = F.array(*[F.struct((F.col("lon") + i * hx).alias("x"), (F.col("lat") + j * hy).alias("y")) for i, j in corners])
    return df.withColumn("rings", F.array(ring))


def _candidates(spark, sf_dir) -> DataFrame:
    return _around(fixture(spark, sf_dir, "fx_candidates"), DIAMOND)


def _buildings(spark, sf_dir) -> DataFrame:
    return _around(fixture(spark, sf_dir, "fx_buildings"), SQUARE)


def _mapped(spark, sf_dir) -> DataFrame:
    return _around(fixture(spark, sf_dir, "fx_mapped"), TRIANGLE)


def _municipalities(spark, sf_dir) -> DataFrame:
    r = fixture(spark, sf_dir, "fx_regions").where("level = 'county'")
    at = lambda a, k: F.col(f"{a}min") + k * (F.col(f"{a}max") - F.col(f"{a}min"))
    ring = lambda corners: F.array(*[F.struct(at("x", x).alias("x"), at("y", y).alias("y")) for x, y in corners])
    return r.select("region_id", "name", F.array(ring(HEXAGON), ring(HOLE)).alias("rings"))


_HX, _HY = "sqrt(area_m2)/2/(111320.0E0*cos(radians(lat)))", "sqrt(area_m2)/2/111320.0E0"


def _sql_edges(name: str, source: str, key: str, *rings, x: str, y: str, where: str = "true") -> str:
    """A table of directed edges (id, i, ax, ay, bx, by); x and y are SQL of a corner's place with {} for its number."""
    rows = []
    for ring in rings:
        for (a, b), (c, d) in zip(ring, (*ring[1:], ring[0]), strict=True):
            rows.append(f"{{'i': {len(rows)}, 'ax': {x.format(repr(a))}, 'ay': {y.format(repr(b))}, 'bx': {x.format(repr(c))}, 'by': {y.format(repr(d))}}}")
    return f"{name} AS (SELECT id, e.i AS i, e.ax AS ax, e.ay AS ay, e.bx AS bx, e.by AS by FROM (SELECT {key} AS id, unnest([{', '.join(rows)}]) AS e FROM {source} WHERE {where}))"


def _sql_around(name: str, source: str, key: str, corners, where: str = "true") -> str:
    return _sql_edges(name, source, key, corners, x=f"lon + ({{}})*{_HX}", y=f"lat + ({{}})*{_HY}", where=where)


_CAND = _sql_around("ce", "fx_candidates", "cand_id", DIAMOND)
_ROOF = _sql_around("be", "fx_buildings", "id", SQUARE)
_MAP = _sql_around("me", "fx_mapped", "osm_id", TRIANGLE)
_TOWN = _sql_edges("te", "fx_regions", "region_id", HEXAGON, HOLE, x="xmin + {}*(xmax-xmin)", y="ymin + {}*(ymax-ymin)", where="level = 'county'")


def _sql_pairs(left: str, left_id: str, right: str, right_id: str, where: str = "true") -> str:
    """Pairs (a, b) of rows whose points are close, with the metres of a degree at a."""
    return f"pr AS (SELECT a.{left_id} AS a, b.{right_id} AS b, 111320.0E0*cos(radians(a.lat)) AS kx, a.lat AS lat0, a.lon AS lon0 FROM {left} a JOIN {right} b ON abs(a.lon-b.lon) < 0.02E0 AND abs(a.lat-b.lat) < 0.02E0 AND {where})"


def _sql_gaps(ea: str, eb: str, pairs: str = "pr") -> str:
    """gp (a, b, gap): metres between polygons, 0 if they touch or hold each other."""

    def to_segment(p: str, s: str) -> str:
        px, py, ax, ay, ux, uy = f"{p}x", f"{p}y", f"{s}1x", f"{s}1y", f"({s}2x-{s}1x)", f"({s}2y-{s}1y)"
        t = f"greatest(0.0E0, least(1.0E0, (({px}-{ax})*{ux} + ({py}-{ay})*{uy})/({ux}*{ux} + {uy}*{uy})))"
        return f"pow({px}-{ax}-{t}*{ux}, 2) + pow({py}-{ay}-{t}*{uy}, 2)"

    side = lambda s, p: f"sign(({s}2x-{s}1x)*({p}y-{s}1y) - ({s}2y-{s}1y)*({p}x-{s}1x))"
    right = lambda p, s: f"CASE WHEN ({s}1y > {p}y) <> ({s}2y > {p}y) THEN CASE WHEN {p}x < {s}1x + ({p}y-{s}1y)*({s}2x-{s}1x)/nullif({s}2y-{s}1y, 0) THEN 1 ELSE 0 END ELSE 0 END"
    near = f"least({to_segment('p1', 'q')}, {to_segment('p2', 'q')}, {to_segment('q1', 'p')}, {to_segment('q2', 'p')})"
    cut = f"({side('p', 'q1')}*{side('p', 'q2')} < 0 AND {side('q', 'p1')}*{side('q', 'p2')} < 0)"
    return f"""ep AS (SELECT pr.a, pr.b, x.i AS pi, y.i AS qi, (x.ax-lon0)*kx AS p1x, (x.ay-lat0)*111320.0E0 AS p1y, (x.bx-lon0)*kx AS p2x, (x.by-lat0)*111320.0E0 AS p2y,
 (y.ax-lon0)*kx AS q1x, (y.ay-lat0)*111320.0E0 AS q1y, (y.bx-lon0)*kx AS q2x, (y.by-lat0)*111320.0E0 AS q2y FROM {pairs} pr JOIN {ea} x ON x.id = pr.a JOIN {eb} y ON y.id = pr.b),
ed AS (SELECT a, b, pi, qi, {near} AS d, {cut} AS cut, {right('p1', 'q')} AS pr_, {right('q1', 'p')} AS qr_ FROM ep),
g1 AS (SELECT a, b, pi, min(d) AS d, bool_or(cut) AS cut, sum(pr_) % 2 = 1 AS inside FROM ed GROUP BY ALL), g2 AS (SELECT a, b, qi, sum(qr_) % 2 = 1 AS inside FROM ed GROUP BY ALL),
gp AS (SELECT a, b, CASE WHEN bool_or(cut) OR bool_or(g1.inside) OR bool_or(i2) THEN 0.0E0 ELSE sqrt(min(d)) END AS gap FROM g1 JOIN (SELECT a, b, bool_or(inside) AS i2 FROM g2 GROUP BY a, b) USING (a, b) GROUP BY a, b)"""


def _sql_shares(ea: str, eb: str, pairs: str = "pr") -> str:
    """sh (a, b, shared): m2 that two polygons share, from the regions below their edges."""
    at = lambda x, e: f"({e}1y + ({x}-{e}1x)*({e}2y-{e}1y)/({e}2x-{e}1x))"
    return f"""s0 AS (SELECT pr.a, pr.b, x.ax-lon0 AS p1x, x.ay-lat0 AS p1y, x.bx-lon0 AS p2x, x.by-lat0 AS p2y, y.ax-lon0 AS q1x, y.ay-lat0 AS q1y, y.bx-lon0 AS q2x, y.by-lat0 AS q2y, kx FROM {pairs} pr JOIN {ea} x ON x.id = pr.a JOIN {eb} y ON y.id = pr.b WHERE x.ax <> x.bx AND y.ax <> y.bx),
s1 AS (SELECT *, greatest(least(p1x, p2x), least(q1x, q2x)) AS lo, least(greatest(p1x, p2x), greatest(q1x, q2x)) AS hi FROM s0),
s2 AS (SELECT a, b, kx, lo, hi, {at('lo', 'p')} AS a0, {at('hi', 'p')} AS a1, {at('lo', 'q')} AS c0, {at('hi', 'q')} AS c1, sign(p2x-p1x)*sign(q2x-q1x) AS sg FROM s1 WHERE hi > lo),
s3 AS (SELECT *, CASE WHEN (a0 < c0) <> (a1 < c1) THEN (a0-c0)/nullif(a0-c0-a1+c1, 0) ELSE 0.0E0 END AS t, least(a0, c0) AS m0, least(a1, c1) AS m1 FROM s2),
sh AS (SELECT a, b, greatest(sum(sg*(hi-lo)*(t*(m0 + a0+t*(a1-a0))/2 + (1-t)*((CASE WHEN (a0 < c0) <> (a1 < c1) THEN a0+t*(a1-a0) ELSE m0 END) + m1)/2)), 0.0E0)*any_value(kx)*111320.0E0 AS shared FROM s3 GROUP BY a, b)"""


# Outlines and unions

_PIXELS = f"WITH RECURSIVE {_PIX}, {_CC.format('0.6E0')}, v AS (SELECT k.component, x, y, prob FROM k JOIN m USING (id))"
#: Corners of the outlines: where an odd number of the four pixels around a point is set, and twice where two meet in a corner.
_CORNERS = """u AS (SELECT component, x + dx AS x, y + dy AS y, 1 AS n FROM v, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy)),
w AS (SELECT u.component, u.x, u.y, count(*) AS n, bool_or(a.x IS NOT NULL AND b.x IS NOT NULL) AS facing FROM u LEFT JOIN v a ON a.component = u.component AND a.x = u.x AND a.y = u.y LEFT JOIN v b ON b.component = u.component AND b.x = u.x - 1 AND b.y = u.y - 1 GROUP BY ALL),
f AS (SELECT u.component, u.x, u.y, bool_or(a.x IS NOT NULL AND b.x IS NOT NULL) AS facing FROM u LEFT JOIN v a ON a.component = u.component AND a.x = u.x - 1 AND a.y = u.y LEFT JOIN v b ON b.component = u.component AND b.x = u.x AND b.y = u.y - 1 GROUP BY ALL),
c AS (SELECT w.component, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND (w.facing OR f.facing) THEN 2 ELSE 0 END) AS n_corners FROM w JOIN f USING (component, x, y) GROUP BY 1)"""
_OUTLINE = f"""{_PIXELS}, {_CORNERS}, p AS (SELECT v.component, count(*) AS n, max(v.prob) AS top, count(r.x) AS nr, count(t.x) AS nt, count(CASE WHEN r.x IS NOT NULL AND t.x IS NOT NULL AND q.x IS NOT NULL THEN 1 END) AS nq
 FROM v LEFT JOIN v r ON r.x = v.x + 1 AND r.y = v.y LEFT JOIN v t ON t.x = v.x AND t.y = v.y + 1 LEFT JOIN v q ON q.x = v.x + 1 AND q.y = v.y + 1 GROUP BY 1)
SELECT p.component, n AS area_px, 4*n - 2*(nr + nt) AS perimeter_px, CAST(n_corners AS BIGINT) AS n_corners, 1 - (n - nr - nt + nq) AS n_holes"""


def _recursive(sql: str) -> str:
    return with_views("fx_pixels", sql=sql).replace("WITH fx_pixels", "WITH RECURSIVE fx_pixels", 1).replace(", RECURSIVE px", ", px")


def _ring_table(rings: DataFrame) -> DataFrame:
    """Area, perimeter, corners and holes by component, from the rings."""
    after = lambda c: F.concat(F.slice(c, 2, F.size(c) - 1), F.slice(c, 1, 1))
    length = lambda c: F.aggregate(F.zip_with(c, after(c), lambda a, b: F.abs(b - a)), F.lit(0.0), lambda s, d: s + d)
    r = rings.select("key", "area2", (length("xs") + length("ys")).alias("length"), F.size("xs").alias("n"))
    whole = lambda c: F.round(c).cast("long")
    return r.groupBy(F.col("key").alias("component")).agg(
        whole(F.sum("area2") / 2).alias("area_px"), whole(F.sum("length")).alias("perimeter_px"), F.sum("n").cast("long").alias("n_corners"), F.count_if(F.col("area2") < 0).alias("n_holes"),
    )


def pixel_rings(spark, sf_dir):
    """Outer rings and holes of every component of likely pixels."""
    mask = P.labelled(_pixels(spark, sf_dir).where("prob >= 0.6"))
    return _ring_table(O.pixel_rings(mask))


def dissolved_areas(spark, sf_dir):
    """Tiles polygonised each by itself, then the fragments that touch over tile edges dissolved, with the largest confidence of each."""
    px = _pixels(spark, sf_dir).where("prob >= 0.6")
    found, rings = api.polygonise(px)
    return _ring_table(rings).join(found.select("component", scaled("confidence", 1000).alias("confidence")), "component")


for _f, _more in ((pixel_rings, ""), (dissolved_areas, f", {sql_scaled('top', 'confidence', '1E3')}")):
    _QUERIES[_f.__name__] = _f
    ORACLES[_f.__name__] = _recursive(f"{_OUTLINE}{_more} FROM p JOIN c USING (component)")


# Distances


@query(f"WITH {_CAND}, {_ROOF}, {_sql_pairs('fx_candidates', 'cand_id', 'fx_buildings', 'id')}, {_sql_gaps('ce', 'be')}, {_sql_shares('ce', 'be')} SELECT a AS cand_id, {sql_scaled('min(gap)', 'dist_m', '1E3')}, arg_min(b, {{'d': gap, 'i': b}}) AS near_id, {sql_scaled('sum(coalesce(shared, 0))', 'overlap_m2', '1E3')} FROM gp LEFT JOIN sh USING (a, b) WHERE gap <= 200 GROUP BY a", "fx_candidates", "fx_buildings")
def nearest_building_polygons(spark, sf_dir):
    """The building nearest to each candidate's outline, and what all buildings share with it."""
    n = S.nearest(_candidates(spark, sf_dir), _buildings(spark, sf_dir), "cand_id", "id", 200.0)
    return scale(n, "dist_m", "overlap_m2", by=1000)


@query(f"WITH {_CAND}, {_MAP}, {_sql_pairs('fx_candidates', 'cand_id', 'fx_mapped', 'osm_id')}, {_sql_gaps('ce', 'me')} SELECT cand_id FROM fx_candidates WHERE cand_id NOT IN (SELECT a FROM gp WHERE gap <= 40)", "fx_candidates", "fx_mapped")
def new_lead_polygons(spark, sf_dir):
    """Candidates whose outline stays farther than 40 m from every mapped outline."""
    return S.new_leads(_candidates(spark, sf_dir), _mapped(spark, sf_dir), 40.0).select("cand_id")


@query(f"WITH {_CAND}, {_MAP}, {_sql_pairs('fx_mapped', 'osm_id', 'fx_candidates', 'cand_id')}, {_sql_gaps('me', 'ce')} SELECT osm_id, EXISTS (SELECT 1 FROM gp WHERE gp.a = osm_id AND gap <= 0) AS is_matched, (SELECT arg_min(b, {{'d': gap, 'i': b}}) FROM gp WHERE gp.a = osm_id AND gap <= 15) AS within_15m FROM fx_mapped", "fx_candidates", "fx_mapped")
def recall_match_polygons(spark, sf_dir):
    """Mapped features that some candidate's outline touches, and the nearest candidate within 15 m."""
    m, c = _mapped(spark, sf_dir), _candidates(spark, sf_dir)
    near = S.nearest(m, c, "osm_id", "cand_id", 15.0, overlap=False).select("osm_id", F.col("near_id").alias("within_15m"))
    return S.recall_matches(m, c).select("osm_id", "is_matched").join(near, "osm_id", "left")


@query(f"WITH {_ROOF}, {_MAP}, {_sql_pairs('fx_buildings', 'id', '(SELECT * FROM fx_mapped WHERE area_m2 >= 5000)', 'osm_id')}, {_sql_gaps('be', 'me')} SELECT DISTINCT a AS id FROM gp WHERE gap <= 300", "fx_buildings", "fx_mapped")
def near_mapped_outlines(spark, sf_dir):
    """Buildings within 300 m of the outline of a large mapped feature."""
    return S.within_reach(_buildings(spark, sf_dir), _mapped(spark, sf_dir).where("area_m2 >= 5000"), "id", 300.0, size=0.01).select("id")


_FAR = "sqrt(pow(greatest(abs(a.lon-b.lon)*111320.0E0*cos(radians(a.lat)) - (sqrt(a.area_m2)+sqrt(b.area_m2))/2, 0), 2) + pow(greatest(abs(a.lat-b.lat)*111320.0E0 - (sqrt(a.area_m2)+sqrt(b.area_m2))/2, 0), 2))"
_GREAT = "2*6371008.8E0*asin(sqrt(least(1.0E0, pow(sin(radians(m.lat-c.lat)/2), 2) + cos(radians(c.lat))*cos(radians(m.lat))*pow(sin(radians(m.lon-c.lon)/2), 2))))"


@query(f"WITH n AS (SELECT a.cand_id, arg_min(b.osm_id, {{'d': {_FAR}, 'i': b.osm_id}}) AS near_id FROM fx_candidates a, fx_mapped b WHERE {_FAR} <= 100000 GROUP BY 1) SELECT cand_id, near_id, {sql_scaled(_GREAT, 'distance_m', '10')}, {_GREAT} <= 200 AS is_match FROM n JOIN fx_candidates c USING (cand_id) JOIN fx_mapped m ON m.osm_id = near_id", "fx_candidates", "fx_mapped")
def nearest_mapped_feature(spark, sf_dir):
    """The mapped feature nearest to each candidate however far away, by a growing reach, with the geodesic distance of the points."""
    n = S.nearest_feature(fixture(spark, sf_dir, "fx_candidates"), fixture(spark, sf_dir, "fx_mapped"), "cand_id", "osm_id")
    return scale(n, "distance_m", by=10)


# Shares and relations


@query(f"WITH {_CAND}, {_ROOF}, {_sql_pairs('fx_candidates', 'cand_id', 'fx_buildings', 'id')}, {_sql_shares('ce', 'be')}, j AS (SELECT sh.*, c.confidence, r.area_m2 FROM sh JOIN fx_candidates c ON c.cand_id = sh.a JOIN fx_buildings r ON r.id = sh.b WHERE shared > 1E-6) SELECT b AS id, {sql_scaled('least(sum(shared), any_value(area_m2))', 'det_m2', '1E2')}, {sql_scaled('least(sum(shared*confidence), any_value(area_m2))', 'cal_m2', '1E2')}, arg_max(a, {{'s': shared, 'i': -a}}) AS main_cand FROM j GROUP BY b", "fx_candidates", "fx_buildings")
def detected_polygons(spark, sf_dir):
    """Detected and calibrated area on every roof, by outlines."""
    c = _candidates(spark, sf_dir).withColumn("p_real", F.col("confidence"))
    d = D.detected_on_buildings(c, _buildings(spark, sf_dir)).where("det_m2 > 1E-6")
    return scale(d, "det_m2", "cal_m2", by=100)


@query(f"WITH {_CAND}, {_ROOF}, {_sql_pairs('fx_candidates', 'cand_id', 'fx_buildings', 'id')}, {_sql_shares('ce', 'be')}, t AS (SELECT a, max(shared)/any_value(area_m2) AS share, arg_max(b, {{'s': shared, 'i': -b}}) AS building_id FROM sh JOIN fx_candidates ON cand_id = a WHERE shared > 1E-6 GROUP BY a) SELECT cand_id, building_id, CASE WHEN share >= 0.3E0 THEN 'rooftop' WHEN share IS NOT NULL THEN 'ground_adjacent' ELSE 'no_building' END AS placement FROM fx_candidates LEFT JOIN t ON a = cand_id", "fx_candidates", "fx_buildings")
def best_overlap_polygons(spark, sf_dir):
    """The building that covers most of each candidate's outline."""
    return C.best_overlap(_candidates(spark, sf_dir), _buildings(spark, sf_dir), least_m2=1e-6).select("cand_id", "building_id", "placement")


_TOUCH = "tp AS (SELECT a.{k} AS a, r.region_id AS b, 111320.0E0*cos(radians(a.lat)) AS kx, a.lat AS lat0, a.lon AS lon0 FROM {t} a JOIN fx_regions r ON level = 'county' AND a.lon BETWEEN xmin-0.02E0 AND xmax+0.02E0 AND a.lat BETWEEN ymin-0.02E0 AND ymax+0.02E0)"


@query(f"WITH {_MAP}, {_ROOF}, {_TOWN}, {_TOUCH.format(k='osm_id', t='fx_mapped')}, {_sql_gaps('me', 'te', 'tp')}, {_sql_pairs('fx_mapped', 'osm_id', 'fx_buildings', 'id')}, {_sql_shares('me', 'be')}, c AS (SELECT a, sum(shared)/any_value(area_m2) AS share FROM sh JOIN fx_mapped ON osm_id = a GROUP BY a) SELECT osm_id, CASE WHEN placement <> 'small' THEN placement WHEN share >= 0.4E0 THEN 'rooftop' ELSE 'ground' END AS placement, (SELECT min(b) FROM gp WHERE gp.a = osm_id AND gap = 0) AS region_id FROM fx_mapped LEFT JOIN c ON c.a = osm_id", "fx_mapped", "fx_buildings", "fx_regions")
def labels_with_region_polygons(spark, sf_dir):
    """Labels placed by the roofs under their outlines, with the first municipality that they touch."""
    m = _mapped(spark, sf_dir).withColumn("placement", F.when(F.col("placement") == "small", "unknown").otherwise(F.col("placement")))
    return api.build_labels(m, _buildings(spark, sf_dir), _municipalities(spark, sf_dir), least_share=0.4).select("osm_id", "placement", "region_id")


@query(f"WITH {_CAND}, {_TOWN}, {_TOUCH.format(k='cand_id', t='fx_candidates')}, {_sql_shares('ce', 'te', 'tp')} SELECT a AS cand_id, b AS region_id FROM sh JOIN fx_candidates ON cand_id = a WHERE shared >= area_m2*(1-1E-7)", "fx_candidates", "fx_regions")
def candidates_within(spark, sf_dir):
    """Candidates that lie in a municipality as a whole, holes excluded."""
    return S.covered(_candidates(spark, sf_dir), _municipalities(spark, sf_dir), "cand_id", "region_id")


def _sql_inside(points: str, key: str, more: str, lon: str = "p.lon", lat: str = "p.lat") -> str:
    """tp (region_id, key and more) of the points inside a municipality."""
    cross = f"CASE WHEN (te.ay > {lat}) <> (te.by > {lat}) AND {lon} < (te.bx-te.ax)*({lat}-te.ay)/nullif(te.by-te.ay, 0) + te.ax THEN 1 ELSE 0 END"
    return f"tp AS (SELECT h.region_id, {key}, {more} FROM {points} p JOIN fx_regions h ON level = 'county' AND {lon} BETWEEN xmin AND xmax AND {lat} BETWEEN ymin AND ymax JOIN te ON te.id = h.region_id GROUP BY ALL HAVING sum({cross}) % 2 = 1)"


@query(f"WITH {_TOWN}, cells AS (SELECT CAST(floor((lon-60.0E0)/0.1E0) AS INT) AS ix, CAST(floor((lat-24.0E0)/0.1E0) AS INT) AS iy, count(*) AS n, sum(area_m2) AS m2 FROM fx_buildings GROUP BY 1, 2), pt AS (SELECT *, 60.0E0+(ix+0.5E0)*0.1E0 AS lon, 24.0E0+(iy+0.5E0)*0.1E0 AS lat FROM cells), {_sql_inside('pt', 'p.ix, p.iy', 'p.n, p.m2')} SELECT region_id, name AS region_name, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_buildings, {sql_scaled('sum(m2)', 'roof_area_m2', '1E2')}, {sql_scaled('sum(m2)*0.2E0/1000', 'mwp', '1E3')} FROM tp JOIN fx_regions USING (region_id) WHERE level = 'county' GROUP BY 1, 2", "fx_buildings", "fx_regions")
def region_capacity_polygons(spark, sf_dir):
    """Estimated roof capacity of the municipalities that hold the cells' centres."""
    cells = D.cell_histogram(fixture(spark, sf_dir, "fx_buildings"), GRID)
    r = D.region_rollup(cells, _municipalities(spark, sf_dir), ["n_buildings", "roof_area_m2"], GRID)
    return r.select("region_id", "region_name", "n_cells", "n_buildings", scaled("roof_area_m2", 100).alias("roof_area_m2"), scaled(F.col("roof_area_m2") * 0.2 / 1000, 1000).alias("mwp"))


# Zones


_P = "(0.1E0/64)"
_PXS = f"px AS (SELECT *, prob_u8/255.0E0 AS prob, 60.0E0+(ix*64+c+0.5E0)*{_P} AS lon, 24.0E0+(iy*64+r+0.5E0)*{_P} AS lat FROM fx_pixels)"


@query(f"WITH {_TOWN}, {_PXS}, {_sql_inside('px', 'p.ix, p.iy, p.r, p.c', 'p.prob')}, z AS (SELECT region_id, sum(CASE WHEN prob >= 0.05E0 THEN prob ELSE 0 END)*100 AS e, count(*) AS n, max(prob) AS m FROM tp GROUP BY 1) SELECT h.region_id, {sql_scaled('coalesce(e, 0)', 'exp_m2', '1E2')}, coalesce(n, 0) AS n_px, {sql_scaled('m', 'max_prob', '1E3')} FROM fx_regions h LEFT JOIN z USING (region_id) WHERE level = 'county'", "fx_pixels", "fx_regions")
def municipality_zonal(spark, sf_dir):
    """Expected area of every municipality from the pixels whose centres it holds."""
    z = P.polygon_zonal(_pixels(spark, sf_dir).drop("id"), _municipalities(spark, sf_dir), "region_id", PX, X0, Y0)
    return z.select("region_id", scaled("exp_m2", 100).alias("exp_m2"), "n_px", scaled("max_prob", 1000).alias("max_prob"))


def _wide(df: DataFrame) -> DataFrame:
    """Outlines as large as 60 times the feature's area, so that they hold several pixels."""
    return _around(df.withColumn("area_m2", F.col("area_m2") * 60), DIAMOND)


_WIDE = "SELECT osm_id, lon, lat, area_m2*60 AS area_m2, area_m2 AS own_m2 FROM fx_mapped"
_DX, _DY = f"({Q!r}*{_HX})", f"({Q!r}*{_HY})"


def _sql_burn(step: str) -> str:
    """bp (osm_id, own_m2, gx, gy): pixels of a grid whose centres lie in a wide diamond. Its four sides are straight in x and y."""
    first, last = "CAST(ceil(({v}-{o})/{s}-0.5E0) AS BIGINT) - 1", "CAST(ceil(({v}-{o})/{s}-0.5E0) AS BIGINT) + 1"
    span = lambda v, h, o: f"unnest(range({first.format(v=f'{v}-{h}', o=o, s=step)}, {last.format(v=f'{v}+{h}', o=o, s=step)}))"
    return f"""wd AS ({_WIDE}), wx AS (SELECT *, {_DX} AS dx, {_DY} AS dy, {span('lon', _DX, '60.0E0')} AS gx FROM wd), wy AS (SELECT *, {span('lat', _DY, '24.0E0')} AS gy FROM wx),
bp AS (SELECT osm_id, own_m2, gx, gy FROM wy WHERE abs(60.0E0+(gx+0.5E0)*{step}-lon)/dx + abs(24.0E0+(gy+0.5E0)*{step}-lat)/dy < 1)"""


@query(f"WITH {_sql_burn(_P)} SELECT CAST(floor(gx/64.0E0) AS INT) AS ix, CAST(floor(gy/64.0E0) AS INT) AS iy, CAST(gy - 64*floor(gy/64.0E0) AS INT) AS r, CAST(gx - 64*floor(gx/64.0E0) AS INT) AS c, max(CASE WHEN own_m2 >= 2000 THEN 1 ELSE -1 END) AS mask FROM bp GROUP BY ALL", "fx_mapped")
def class_mask_polygons(spark, sf_dir):
    """Large outlines burned as 1, small ones as -1 (ignored); large wins."""
    m = fixture(spark, sf_dir, "fx_mapped")
    px = P.polygons_to_pixels(_wide(m.withColumn("own_m2", F.col("area_m2"))), PX, X0, Y0, ["own_m2"]).withColumnRenamed("own_m2", "area_m2")
    return P.burned(px, 2000.0)


@query(f"WITH {_sql_burn(f'({_P}/4)')} SELECT CAST(floor(gx/4.0E0) AS INT) AS px, CAST(floor(gy/4.0E0) AS INT) AS py, {sql_scaled('count(DISTINCT (gx, gy))/16.0E0', 'fraction', '1E4')} FROM bp GROUP BY ALL", "fx_mapped")
def coverage_polygons(spark, sf_dir):
    """Share of each pixel that the outlines cover."""
    f = P.coverage_fraction(_wide(fixture(spark, sf_dir, "fx_mapped")), PX, X0, Y0, ["osm_id"], parts=4)
    return f.select("px", "py", scaled("fraction", 10_000).alias("fraction"))


# Windows


SIZE, STRIDE = 16, 8


def _linear_filter():
    """A stand-in for a user's model: a fixed weighted mean of a window's values."""
    import numpy as np

    weights = (np.arange(SIZE * SIZE) % 7 + 1) / 1024.0

    def predict(values: np.ndarray) -> np.ndarray:
        return values @ weights

    return predict


_HANN = "greatest(0.5E0 - 0.5E0*cos(2*pi()*({o}+0.5E0)/16), 1E-3)"


@query(f"WITH g AS (SELECT ix, iy, r, c, ix*64+c AS gx, iy*64+r AS gy, prob_u8/255.0E0 AS v FROM fx_pixels), w AS (SELECT *, unnest([CAST(floor(gx/8.0E0) AS BIGINT)*8 - 8, CAST(floor(gx/8.0E0) AS BIGINT)*8]) AS wx FROM g), u AS (SELECT *, unnest([CAST(floor(gy/8.0E0) AS BIGINT)*8 - 8, CAST(floor(gy/8.0E0) AS BIGINT)*8]) AS wy FROM w), s AS (SELECT wx, wy, greatest(0.0E0, least(1.0E0, sum(v*((((gy-wy)*16 + gx-wx) % 7) + 1)/1024.0E0))) AS prob FROM u GROUP BY 1, 2), b AS (SELECT ix, iy, r, c, prob, {_HANN.format(o='(gy-wy)')}*{_HANN.format(o='(gx-wx)')} AS k FROM u JOIN s USING (wx, wy)) SELECT ix, iy, r, c, {sql_scaled('sum(prob*k)/sum(k)', 'p')} FROM b GROUP BY ALL", "fx_pixels")
def scored_windows(spark, sf_dir):
    """Windows over tiles' borders, scored in batches by a model and blended to one raster."""
    px = _pixels(spark, sf_dir)
    scores = P.scored(P.window_values(px, SIZE, STRIDE, "prob"), _linear_filter, "values", shape=[SIZE * SIZE])
    return P.blended(P.over_pixels(scores, px, SIZE, STRIDE), SIZE).select("ix", "iy", "r", "c", scaled("p").alias("p"))


QUERIES = dict(_QUERIES)
