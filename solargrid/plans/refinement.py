"""Queries over amplitude maps of glints and over radar backscatter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.functions import geometry as G
from solargrid.operators import density as D
from solargrid.operators import glint
from solargrid.operators import pixels as P
from solargrid.operators import refine as R
from solargrid.operators.components import cut_lineage
from solargrid.plans import series
from solargrid.plans.common import GRID, scaled, sql_scaled
from solargrid.plans.pixels import PX, _pixels
from solargrid.plans.polygons import DIAMOND, Q, _around
from solargrid.sources.fixtures import fixture, with_views

X0, Y0 = GRID.x0, GRID.y0
#: Targets and outlines are shown larger than they are, so that they hold several of the fixtures' pixels.
BOX_TIMES, OUTLINE_TIMES = 60, 200
BAND = "b08"
#: Radar scenes of a place; the last one has one polarisation only.
RADAR_SCENES = 13


def _targets(spark, sf_dir) -> DataFrame:
    """Boxes of mapped features in the pixels of their tile."""
    m = D.with_cell(fixture(spark, sf_dir, "fx_mapped").withColumn("area_m2", F.col("area_m2") * BOX_TIMES), GRID)
    hx, hy = G.half_sides(F.col("area_m2"), F.col("lat"))
    x, y = (F.col("lon") - X0) / PX - F.col("ix") * P.SIDE, (F.col("lat") - Y0) / PX - F.col("iy") * P.SIDE
    return m.select(F.col("osm_id").alias("pid"), "ix", "iy", (x - hx / PX).alias("x1"), (x + hx / PX).alias("x2"), (y - hy / PX).alias("y1"), (y + hy / PX).alias("y2"))


def _windows(spark, sf_dir) -> DataFrame:
    """The pixels around every target that has scenes, with truth."""
    seen = fixture(spark, sf_dir, "fx_scenes").select("pid").distinct()
    return P.around(_targets(spark, sf_dir).join(seen, "pid", "left_semi"), _pixels(spark, sf_dir), "pid", 8)


def _readings(spark, sf_dir, windows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Values in its target's window of every scene near a chosen one: a pattern over the scene's own value, with gaps; some scenes are mostly gaps."""
    s = series._series(spark, sf_dir).select("pid", "item", F.expr("time + make_dt_interval(0, 0, 5 * CAST(item % 5 AS INT), 0)").alias("time"), F.col(f"p98_{BAND}").alias("top"))
    s = R.near_scenes(chosen, s)
    gap = F.when(F.col("item") % 11 == 0, (F.col("r") + F.col("c")) % 3 != 0).otherwise((F.col("r") + F.col("c") + F.col("item")) % 5 == 0)
    own = ((F.col("r") * 7 + F.col("c") * 3) % 8) / 8  # how much of the scene's brightness the pixel has
    v = F.when(~gap, own * F.col("top") + (1 - own) * 0.16 * (1 + (F.col("item") % 5) / 10))
    return windows.select("pid", "r", "c").join(s, "pid").select("pid", "item", "time", "r", "c", v.alias("v"))


def _maps(spark, sf_dir, windows: DataFrame) -> DataFrame:
    chosen = R.map_scenes(glint.annotated(series._series(spark, sf_dir), series.BANDS), BAND)
    chosen = cut_lineage(chosen)  # a dozen rows for each target, used twice
    return R.amplitude_map(R.scene_pixels(chosen, _readings(spark, sf_dir, windows, chosen)))


def amplitude_maps(spark, sf_dir):
    """Amplitude of every pixel around targets with spikes."""
    return _maps(spark, sf_dir, _windows(spark, sf_dir)).select("pid", "r", "c", scaled("amp").alias("amp"))


def refined_masks(spark, sf_dir):
    """How trimming and adding pixels by amplitude changes the agreement of predictions with truth, by gate."""
    w = _windows(spark, sf_dir)
    fits = glint.fit_summary(glint.annotated(series._series(spark, sf_dir), series.BANDS))
    gates = fits.select("pid", (F.col("n_spikes") >= 1).alias("detected"), (F.col("n_consistent") >= 2).alias("validated"))
    out = R.refined(w, _maps(spark, sf_dir, w), gates, ["detected", "validated"])
    return out.select("gate", "strategy", "tp", "fp", "fn", scaled("iou").alias("iou"))


def _outlines(spark, sf_dir) -> DataFrame:
    m = fixture(spark, sf_dir, "fx_mapped").withColumn("area_m2", F.col("area_m2") * OUTLINE_TIMES)
    return R.target_windows(_around(m, DIAMOND), "osm_id", PX, X0, Y0)


def _radar(spark, sf_dir) -> DataFrame:
    """Two polarisations of RADAR_SCENES scenes over all pixels, from two orbits; some readings are missing."""
    p = fixture(spark, sf_dir, "fx_pixels").withColumn("item", F.explode(F.sequence(F.lit(0), F.lit(RADAR_SCENES - 1)).cast("array<bigint>"))).withColumn("band", F.explode(F.array(F.lit("vv"), F.lit("vh"))))
    p = p.where(~((F.col("item") == RADAR_SCENES - 1) & (F.col("band") == "vh")))
    bright = F.when((F.col("item") == 4) & (F.col("prob_u8") > 128), 3.0).otherwise(1.0)
    level = F.col("prob_u8") + F.when(F.col("band") == "vv", 40).otherwise(10) + (F.col("item") * 37 + F.col("r") * 3 + F.col("c")) % 50
    v = F.when((F.col("r") + F.col("c") * 2 + F.col("item")) % 11 != 0, level / 255.0 * bright)
    orbit = F.when(F.col("item") % 2 == 0, "ascending").otherwise("descending")
    return p.select("ix", "iy", "r", "c", "item", F.col("item").alias("time"), orbit.alias("orbit"), "band", v.alias("v"))


def radar_statistics(spark, sf_dir):
    """Backscatter inside each outline and around it, in every scene."""
    s = R.window_backscatter(_outlines(spark, sf_dir), _radar(spark, sf_dir), "osm_id", ["vv", "vh"])
    values = [scaled(f"{p}_{z}").alias(f"{p}_{z}") for p in ("vv", "vh") for z in ("inside", "ring")]
    return s.select("osm_id", "item", "orbit", *values, "vv_npx", "vh_npx")


def radar_orbit_rates(spark, sf_dir):
    """How often an outline stands out from its usual ratio, by orbit."""
    s = R.window_backscatter(_outlines(spark, sf_dir), _radar(spark, sf_dir), "osm_id", ["vv", "vh"])
    return R.orbit_rates(s, "osm_id", "vv").select("osm_id", "orbit", "n", scaled("rate").alias("rate"), scaled("median_ratio").alias("median_ratio"))


_P = f"{PX!r}"
_H = "sqrt(area_m2)/2/(111320.0E0{0})/" + _P
_COS = "*cos(radians(lat))"

_WINDOWS = f"""m0 AS (SELECT osm_id AS pid, lon, lat, area_m2*{BOX_TIMES} AS area_m2, CAST(floor((lon-60.0E0)/0.1E0 + 1E-9) AS INT) AS ix, CAST(floor((lat-24.0E0)/0.1E0 + 1E-9) AS INT) AS iy FROM fx_mapped WHERE osm_id IN (SELECT pid FROM fx_scenes)),
t0 AS (SELECT *, (lon-60.0E0)/{_P} - ix*64 AS x, (lat-24.0E0)/{_P} - iy*64 AS y, {_H.format(_COS)} AS hx, {_H.format('')} AS hy FROM m0),
w0 AS (SELECT pid, p.r, p.c, prob_u8/255.0E0 AS prob, p.c+1 > x-hx AND p.c < x+hx AND p.r+1 > y-hy AND p.r < y+hy AS truth FROM fx_pixels p JOIN t0 t ON t.ix = p.ix AND t.iy = p.iy
 AND p.c BETWEEN floor(x-hx)-8 AND floor(x+hx)+8 AND p.r BETWEEN floor(y-hy)-8 AND floor(y+hy)+8),
wd AS (SELECT * FROM w0 WHERE pid IN (SELECT pid FROM w0 WHERE truth))"""

_MAPS = f"""k1 AS (SELECT pid, item, epoch_us(time) AS tm FROM a WHERE is_spike QUALIFY row_number() OVER (PARTITION BY pid ORDER BY p98_{BAND} DESC, time, item) <= 6),
k2 AS (SELECT pid, median(tm) AS middle FROM k1 GROUP BY pid),
k3 AS (SELECT a.pid, item, epoch_us(time) AS tm FROM a JOIN k2 USING (pid) WHERE is_clear AND NOT is_spike QUALIFY row_number() OVER (PARTITION BY a.pid ORDER BY abs(epoch_us(time)-middle), time, item) <= 8),
k AS (SELECT *, 'spike' AS role FROM k1 UNION ALL SELECT *, 'base' FROM k3),
rd AS (SELECT wd.pid, item, epoch_us(time) + (item % 5)*300000000 AS tm, r, c, CASE WHEN NOT (CASE WHEN item % 11 = 0 THEN (r+c)%3 <> 0 ELSE (r+c+item)%5 = 0 END) THEN ((r*7+c*3)%8)/8.0E0*p98_{BAND} + (1-((r*7+c*3)%8)/8.0E0)*0.16E0*(1+(item%5)/10.0E0) END AS v FROM wd JOIN s USING (pid)),
sn AS (SELECT pid, item, any_value(tm) AS tm, count(v)/count(*) AS share FROM rd GROUP BY ALL),
nr AS (SELECT k.pid, k.item AS s_item, role, sn.item FROM k JOIN sn ON sn.pid = k.pid AND abs(sn.tm-k.tm) <= 1800000000 AND share > 0.5E0 QUALIFY row_number() OVER (PARTITION BY k.pid, role, k.item ORDER BY abs(sn.tm-k.tm), sn.item) = 1),
px AS (SELECT rd.pid, r, c, v, role, s_item FROM rd JOIN nr USING (pid, item)),
en AS (SELECT pid FROM px GROUP BY pid HAVING count(DISTINCT s_item) FILTER (role = 'spike') >= 1 AND count(DISTINCT s_item) FILTER (role = 'base') >= 3),
mp AS (SELECT pid, r, c, CASE WHEN count(v) FILTER (role = 'base') > 0 THEN max(v) FILTER (role = 'spike')/greatest(median(v) FILTER (role = 'base'), 0.01E0) END AS amp FROM px WHERE pid IN (SELECT pid FROM en) GROUP BY ALL)"""

_STRATEGIES = ", ".join(f"('{n}', {t or 'NULL'}, {u or 'NULL'})" for n, t, u in R.STRATEGIES)
_REFINED = f"""g AS (SELECT pid, n_spikes >= 1 AS detected, n_consistent >= 2 AS validated FROM z),
st AS (SELECT * FROM (VALUES {_STRATEGIES}) AS v(strategy, trim_at, union_at)),
hits AS (SELECT gate, strategy, truth, (prob >= 0.3E0 AND (trim_at IS NULL OR NOT is_on OR amp >= trim_at)) OR (union_at IS NOT NULL AND is_on AND amp >= union_at) AS hit
 FROM (SELECT wd.*, amp, gate, coalesce(CASE gate WHEN 'detected' THEN detected ELSE validated END, false) AND amp IS NOT NULL AS is_on FROM wd LEFT JOIN mp USING (pid, r, c) LEFT JOIN g USING (pid), (VALUES ('detected'), ('validated')) AS q(gate)) x, st),
cn AS (SELECT gate, strategy, count(*) FILTER (hit AND truth) AS tp, count(*) FILTER (hit AND NOT truth) AS fp, count(*) FILTER (NOT hit AND truth) AS fn FROM hits GROUP BY ALL)"""

_ZONES = f"""m1 AS (SELECT osm_id, lon, lat, area_m2*{OUTLINE_TIMES} AS area_m2 FROM fx_mapped),
m2 AS (SELECT osm_id, (lon-60.0E0)/{_P} AS x, (lat-24.0E0)/{_P} AS y, {Q!r}*{_H.format(_COS)} AS hx, {Q!r}*{_H.format('')} AS hy FROM m1),
m3 AS (SELECT *, CAST(floor(greatest(16, least(80, greatest(hx, hy)+10))) AS BIGINT) AS n FROM m2),
m4 AS (SELECT *, unnest(range(CAST(floor(x) AS BIGINT)-n, CAST(floor(x) AS BIGINT)+n)) AS px FROM m3),
m5 AS (SELECT *, unnest(range(CAST(floor(y) AS BIGINT)-n, CAST(floor(y) AS BIGINT)+n)) AS py FROM m4),
m6 AS (SELECT osm_id, px, py, hx, hy, abs(px+0.5E0-x) AS dx, abs(py+0.5E0-y) AS dy FROM m5),
m7 AS (SELECT *, dx/hx+dy/hy < 1 AS centred, greatest(dx-0.5E0, 0)/hx+greatest(dy-0.5E0, 0)/hy <= 1 AS touched, greatest(0, least(1, ((dx-hx)*(-hx)+dy*hy)/(hx*hx+hy*hy))) AS u FROM m6),
m8 AS (SELECT *, bool_or(centred) OVER (PARTITION BY osm_id) AS any_in, sqrt((dx-hx+u*hx)*(dx-hx+u*hx)+(dy-u*hy)*(dy-u*hy)) AS far FROM m7),
zn AS (SELECT osm_id, px // 64 AS ix, py // 64 AS iy, py % 64 AS r, px % 64 AS c, CASE WHEN CASE WHEN any_in THEN centred ELSE touched END THEN 'inside' ELSE 'ring' END AS zone FROM m8 WHERE px >= 0 AND py >= 0 AND (CASE WHEN any_in THEN centred ELSE touched END OR (NOT centred AND far > 5)))"""

_RADAR = f"""it AS (SELECT unnest(range(0, {RADAR_SCENES})) AS item),
rr AS (SELECT ix, iy, r, c, item, CASE WHEN item % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit, band, CASE WHEN (r+c*2+item)%11 <> 0 THEN (prob_u8 + CASE band WHEN 'vv' THEN 40 ELSE 10 END + (item*37+r*3+c)%50)/255.0E0 * CASE WHEN item = 4 AND prob_u8 > 128 THEN 3 ELSE 1 END END AS v
 FROM fx_pixels, it, (VALUES ('vv'), ('vh')) AS b(band) WHERE NOT (item = {RADAR_SCENES - 1} AND band = 'vh')),
rz AS (SELECT osm_id, item, orbit, band, zone, v FROM rr JOIN zn USING (ix, iy, r, c)),
rs AS (SELECT osm_id, item, orbit, {', '.join(f"quantile_cont(v, 0.9E0) FILTER (band = '{p}' AND zone = 'inside') AS i_{p}, median(v) FILTER (band = '{p}' AND zone = 'ring') AS m_{p}, count(v) FILTER (band = '{p}' AND zone = 'inside') AS n_{p}, count(v) FILTER (band = '{p}' AND zone = 'ring') AS k_{p}, count(*) FILTER (band = '{p}') AS b_{p}" for p in ('vv', 'vh'))} FROM rz GROUP BY ALL),
bs AS (SELECT osm_id, item, orbit, {', '.join(f"CASE WHEN n_{p} >= 3 AND k_{p} >= 20 THEN i_{p} END AS {p}_inside, CASE WHEN n_{p} >= 3 AND k_{p} >= 20 THEN m_{p} END AS {p}_ring, CASE WHEN n_{p} >= 3 AND k_{p} >= 20 THEN n_{p} ELSE 0 END AS {p}_npx" for p in ('vv', 'vh'))} FROM rs WHERE b_vv > 0 AND b_vh > 0)"""

_RATES = """ra AS (SELECT osm_id, orbit, vv_inside/greatest(vv_ring, 1E-6) AS ratio FROM bs WHERE vv_inside IS NOT NULL AND vv_ring IS NOT NULL),
rm AS (SELECT osm_id, orbit, count(*) AS n, median(ratio) AS mid FROM ra GROUP BY ALL),
rp AS (SELECT osm_id, orbit, greatest(1.4826E0*median(abs(ratio-mid)), 0.05E0) AS spread FROM ra JOIN rm USING (osm_id, orbit) GROUP BY ALL),
rt AS (SELECT osm_id, orbit, any_value(n) AS n, avg(CASE WHEN ratio > mid+3*spread THEN 1.0E0 ELSE 0 END) AS rate, any_value(mid) AS mid FROM ra JOIN rm USING (osm_id, orbit) JOIN rp USING (osm_id, orbit) GROUP BY ALL)"""

_BASE = f"WITH {series._annotated(True)}, {_WINDOWS}, {_MAPS}"
_VALUES = ", ".join(sql_scaled(f"{p}_{z}", f"{p}_{z}") for p in ("vv", "vh") for z in ("inside", "ring"))

QUERIES = {f.__name__: f for f in (amplitude_maps, refined_masks, radar_statistics, radar_orbit_rates)}
ORACLES = {
    "amplitude_maps": with_views("fx_scenes", "fx_mapped", "fx_pixels", sql=f"{_BASE} SELECT pid, r, c, {sql_scaled('amp', 'amp')} FROM mp"),
    "refined_masks": with_views("fx_scenes", "fx_mapped", "fx_pixels", sql=f"{_BASE}, {series._fit('a')}, {_REFINED} SELECT gate, strategy, tp, fp, fn, {sql_scaled('tp/greatest(tp+fp+fn, 1)', 'iou')} FROM cn"),
    "radar_statistics": with_views("fx_mapped", "fx_pixels", sql=f"WITH {_ZONES}, {_RADAR} SELECT osm_id, item, orbit, {_VALUES}, vv_npx, vh_npx FROM bs"),
    "radar_orbit_rates": with_views("fx_mapped", "fx_pixels", sql=f"WITH {_ZONES}, {_RADAR}, {_RATES} SELECT osm_id, orbit, n, {sql_scaled('CASE WHEN n >= 5 THEN rate END', 'rate')}, {sql_scaled('CASE WHEN n >= 5 THEN mid END', 'median_ratio')} FROM rt"),
}
