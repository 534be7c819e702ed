"""Queries over pixel tables and training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solargrid.functions import business as B
from solargrid.functions import solar
from solargrid.operators import candidates as C
from solargrid.operators import density as D
from solargrid.operators import evaluate as E
from solargrid.operators import pixels as P
from solargrid.operators import spatial as S
from solargrid.operators import training as T
from solargrid.plans.common import GRID, scale, scaled, sql_scaled
from solargrid.sources import tables
from solargrid.sources.fixtures import fixture, with_views

PX = 0.1 / 64
#: Roofs that can be hard negatives.
HARD_NEGATIVE_M2 = 400.0


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "fx_pixels")
    return p.withColumn("prob", F.col("prob_u8") / 255.0).withColumn("id", (F.col("iy") * 64 + F.col("r")).cast("long") * 100_000 + F.col("ix") * 64 + F.col("c"))


def _footprints(spark, sf_dir, least_m2: float = 0.0) -> DataFrame:
    b = S.with_box(fixture(spark, sf_dir, "fx_buildings").where(F.col("area_m2") >= least_m2))
    # A pixel of the grid is larger than a roof; boxes are grown so that some hold several centres.
    wide = b.withColumns({"xmin": F.col("xmin") - PX, "ymin": F.col("ymin") - PX, "xmax": F.col("xmax") + PX, "ymax": F.col("ymax") + PX})
    return P.footprints_to_pixels(wide, PX, 60.0, 24.0, ["id"])


def zonal_expected(spark, sf_dir):
    z = P.zonal(_footprints(spark, sf_dir), _pixels(spark, sf_dir).drop("id"), "id")
    return scale(z, "exp_m2", "max_prob", by=1000)


def zonal_single_owner(spark, sf_dir):
    """A pixel counts for one footprint only, the last one burned."""
    f = _footprints(spark, sf_dir).withColumn("seq", F.col("id"))
    return P.zonal(f, _pixels(spark, sf_dir).drop("id"), "id", by_order="seq").select("id", "n_px", scaled("exp_m2", 1000).alias("exp_m2"))


def centroid_fallback(spark, sf_dir):
    b = fixture(spark, sf_dir, "fx_buildings")
    own = b.select("id", "area_m2", F.floor((F.col("lon") - 60) / PX).alias("gx"), F.floor((F.col("lat") - 24) / PX).alias("gy"))
    own = own.select("id", "area_m2", F.floor(F.col("gx") / 64).cast("int").alias("ix"), F.floor(F.col("gy") / 64).cast("int").alias("iy"), (F.col("gy") % 64).cast("int").alias("r"), (F.col("gx") % 64).cast("int").alias("c"))
    px = _pixels(spark, sf_dir).drop("id")
    out = P.with_fallback(own, P.zonal(_footprints(spark, sf_dir), px, "id"), px, "id")
    return scale(out, "exp_m2", "max_prob", by=1000)


def pixel_components(spark, sf_dir):
    return P.polygonised(_pixels(spark, sf_dir), 0.6).select(F.col("component"), "n_px", scaled("confidence", 1000).alias("confidence"))


def hysteresis(spark, sf_dir):
    return P.hysteresis(_pixels(spark, sf_dir), 0.5, 0.9).select("component", "n_px", scaled("peak", 1000).alias("peak"))


def _masked(spark, sf_dir) -> DataFrame:
    return _pixels(spark, sf_dir).withColumn("mask", F.when((F.col("r") + F.col("c")) % 5 == 0, 1).when((F.col("r") * F.col("c")) % 7 == 0, -1).otherwise(0))


def confusion(spark, sf_dir):
    return scale(E.confusion(_masked(spark, sf_dir), 0.5, ["ix"]), "iou", "f1")


def window_iou(spark, sf_dir):
    m = _masked(spark, sf_dir).withColumn("gate", F.col("c").cast("double"))
    s = fixture(spark, sf_dir, "fx_bins").select(F.col("label").alias("strategy"), (F.lit(0.2) + F.col("bin") / 10).alias("threshold"), (F.col("bin") * 8).cast("double").alias("gate"))
    return scale(E.strategy_iou(m, s), "iou")


def recall_by_size(spark, sf_dir):
    m = S.with_box(fixture(spark, sf_dir, "fx_mapped"))
    f = P.footprints_to_pixels(m, PX, 60.0, 24.0, ["osm_id"])
    return E.recall_by_size(m, f.join(_pixels(spark, sf_dir).where("prob_u8 >= 100").drop("id"), ["ix", "iy", "r", "c"]), "osm_id")


def cohens_d(spark, sf_dir):
    d = E.cohens_d(_masked(spark, sf_dir).where("mask >= 0").withColumn("pv", F.col("mask") == 1), "prob", "pv", by=["iy"])
    return d.select("iy", "n1", "n2", scaled("d", 10_000).alias("d"))


def blend_windows(spark, sf_dir):
    """Windows of 32 pixels with a stride of 16: a pixel is seen by up to four of them."""
    p = _pixels(spark, sf_dir).withColumn("y0", F.explode(F.sequence(F.lit(0), F.lit(32), F.lit(16)))).withColumn("x0", F.explode(F.sequence(F.lit(0), F.lit(32), F.lit(16))))
    p = p.where("r >= y0 AND r < y0 + 32 AND c >= x0 AND c < x0 + 32").withColumn("wr", F.col("r") - F.col("y0")).withColumn("wc", F.col("c") - F.col("x0"))
    b = P.blended(p.withColumn("prob", F.col("prob") * (1 + F.col("wr") / 100.0) / 2), 32)
    return b.select("ix", "iy", "r", "c", scaled("p", 10_000).alias("p"))


def max_ndvi(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_scenes").withColumn("ndvi", F.when(F.col("item") % 6 > 0, solar.ndvi("p98_b08", "p98_b04")).otherwise(F.lit(float("nan"))))
    return scale(P.max_over_epochs(s.withColumn("epoch", F.col("item") % 4), "pid", "ndvi"), "ndvi")


def median_composite(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_scenes").withColumn("scl", (F.col("item") % 9).cast("int"))
    return P.median_composite(s, ["pid", "npx"], "p98_b08")


def seasonal_composite(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_scenes").withColumn("scl", (F.col("item") % 9).cast("int")).withColumn("season", F.element_at(F.array(F.lit("dry"), F.lit("wet"), F.lit("cool")), (1 + F.col("item") % 3).cast("int")))
    return P.seasonal(P.median_composite(s, ["pid", "season"], "p98_b08", 5), ["pid"], ["dry", "wet", "cool"])


def pixel_anomalies(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_scenes").withColumn("b03", solar.reflectance("p98_b03")).withColumn("b08", solar.reflectance("p98_b08"))
    return P.anomalies(s.where("cloud <= 80"), ["pid", "npx"], ["b03", "b08"])


def class_mask(spark, sf_dir):
    m = S.with_box(fixture(spark, sf_dir, "fx_mapped"))
    f = P.footprints_to_pixels(m.withColumns({"xmin": F.col("xmin") - PX, "xmax": F.col("xmax") + PX}), PX, 60.0, 24.0, ["osm_id", "area_m2"])
    return P.burned(f)


def hard_negatives(spark, sf_dir):
    z = P.zonal(_footprints(spark, sf_dir, HARD_NEGATIVE_M2), _pixels(spark, sf_dir).drop("id"), "id")
    now, old = z.withColumn("max_prob", F.col("max_prob") * (F.col("id") % 3) / 20), z.where("id % 7 > 0").withColumn("max_prob", F.col("max_prob") * (F.col("id") % 5) / 30)
    return T.hard_negatives(now, old, "id").select("id", "verdict")


def oversample_union(spark, sf_dir):
    c = fixture(spark, sf_dir, "fx_candidates").withColumn("tile", F.concat(F.lit("t"), (F.col("cand_id") % 9).cast("string")))
    a = T.split(c, "tile", ["t3", "t5"], "cand_id").select("cand_id", "split")
    return T.oversampled({"base": (a, 1), "extra": (a.where("cand_id % 4 = 0"), 3)})


def osm_labels(spark, sf_dir):
    """Solar features from tags, with placement from tags and, where these are silent, from roofs."""
    solar_rows = tables.solar_features(fixture(spark, sf_dir, "fx_osm"))
    m = fixture(spark, sf_dir, "fx_mapped").select("osm_id", "lon", "lat", "area_m2")
    labels = solar_rows.join(m, F.col("el_id") == F.col("osm_id")).select("osm_id", "lon", "lat", "area_m2", "kind", "placement")
    return C.label_placement(labels, fixture(spark, sf_dir, "fx_buildings")).select("osm_id", "kind", "placement")


def review_counts(spark, sf_dir):
    from solargrid.operators.calibration import review_counts as counts

    return counts(fixture(spark, sf_dir, "fx_reviews"))


def building_grid(spark, sf_dir):
    return scale(tables.building_grid(fixture(spark, sf_dir, "fx_buildings"), 60.0, 24.0, 0.05, 0.05, 500.0), "max_area", by=1000)


def cell_summary(spark, sf_dir):
    c = fixture(spark, sf_dir, "fx_candidates").withColumn("p_real", F.col("confidence"))
    b = fixture(spark, sf_dir, "fx_buildings")
    exp = _pixels(spark, sf_dir).groupBy("ix", "iy").agg((F.sum(B.floor_noise(F.col("prob"))) * 100).alias("exp_m2"))
    s = D.cell_summary(b, D.detected_on_buildings(c, b), c, exp, GRID)
    return scale(s, "roof_area_m2", "det_roof_m2", "cal_roof_m2", "det_total_m2", "cal_total_m2", "exp_m2", by=100)


_PIX = "px AS (SELECT *, prob_u8/255.0E0 AS prob, CAST(iy*64+r AS BIGINT)*100000 + ix*64 + c AS id FROM fx_pixels)"
_HX, _HY = "sqrt(area_m2)/2/(111320.0E0*cos(radians(lat)))", "sqrt(area_m2)/2/111320.0E0"
_P = "(0.1E0/64)"
_FEET = f"""bx AS (SELECT id, area_m2, lon, lat, lon - {_HX} - {_P} AS xmin, lon + {_HX} + {_P} AS xmax, lat - {_HY} - {_P} AS ymin, lat + {_HY} + {_P} AS ymax FROM fx_buildings WHERE area_m2 >= 0),
fs AS (SELECT id, unnest(range(CAST(ceil((xmin-60)/{_P}-0.5E0) AS BIGINT), CAST(ceil((xmax-60)/{_P}-0.5E0) AS BIGINT))) AS gx, ymin, ymax FROM bx), ft AS (SELECT id, gx, unnest(range(CAST(ceil((ymin-24)/{_P}-0.5E0) AS BIGINT), CAST(ceil((ymax-24)/{_P}-0.5E0) AS BIGINT))) AS gy FROM fs),
fp AS (SELECT f.id, p.prob, p.ix, p.iy, p.r, p.c FROM ft f JOIN px p ON p.ix = f.gx//64 AND p.iy = f.gy//64 AND p.r = f.gy%64 AND p.c = f.gx%64)"""
_FLOOR = "CASE WHEN prob >= 0.05E0 THEN prob ELSE 0 END"
_Z = f"z AS (SELECT id, sum({_FLOOR})*100 AS exp_m2, count(*) AS n_px, max(prob) AS max_prob FROM fp GROUP BY id)"
_M = "CASE WHEN (r+c)%5 = 0 THEN 1 WHEN (r*c)%7 = 0 THEN -1 ELSE 0 END"
_CC = """m AS (SELECT id, ix*64+c AS x, iy*64+r AS y, prob FROM px WHERE prob >= {0}),
e0 AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON b.x = a.x + 1 AND b.y = a.y UNION ALL SELECT a.id, b.id FROM m a JOIN m b ON b.x = a.x AND b.y = a.y + 1),
e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
l AS (SELECT id, id AS l FROM m UNION SELECT e.b, l.l FROM l JOIN e ON e.a = l.id), k AS (SELECT id, min(l) AS component FROM l GROUP BY id)"""
_BIN = "CASE WHEN area_m2 < 100 THEN 0 WHEN area_m2 < 500 THEN 1 WHEN area_m2 < 1000 THEN 2 WHEN area_m2 < 5000 THEN 3 WHEN area_m2 < 50000 THEN 4 ELSE 5 END"
_W = "greatest(0.5E0-0.5E0*cos(2*pi()*({0}+0.5E0)/32), 0.001E0)"
_SC = "*, CAST(item % 9 AS INT) AS scl"
_MC = "SELECT {0}, coalesce(CAST(floor(median(CASE WHEN scl IN (4,5,6,7) THEN p98_b08 END)) AS INT), 0) AS dn FROM (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY cloud, item) AS k FROM {1}) WHERE k <= {2} GROUP BY ALL"
_SIDE = lambda d: f"greatest(least(sqrt(a.area_m2)/2, {d} + sqrt(b.area_m2)/2) - greatest(-sqrt(a.area_m2)/2, {d} - sqrt(b.area_m2)/2), 0.0E0)"
_SHARED = f"{_SIDE('(b.lon-a.lon)*111320.0E0*cos(radians(a.lat))')} * {_SIDE('(b.lat-a.lat)*111320.0E0')}"
_CLOSE = "abs(a.lon-b.lon) < 0.01E0 AND abs(a.lat-b.lat) < 0.01E0"
_IX, _IY = "CAST(floor((lon - 60.0E0)/0.1E0) AS INT)", "CAST(floor((lat - 24.0E0)/0.1E0) AS INT)"
_RF = "b03 AS (SELECT pid, npx, greatest((p98_b03-1000)/10000, 0) AS b03, greatest((p98_b08-1000)/10000, 0) AS b08 FROM fx_scenes WHERE cloud <= 80)"

ORACLES = {
    "zonal_expected": with_views("fx_pixels", "fx_buildings", sql=f"WITH {_PIX}, {_FEET}, {_Z} SELECT id, {sql_scaled('exp_m2', 'exp_m2', '1E3')}, n_px, {sql_scaled('max_prob', 'max_prob', '1E3')} FROM z"),
    "zonal_single_owner": with_views("fx_pixels", "fx_buildings", sql=f"WITH {_PIX}, {_FEET}, o AS (SELECT max(id) AS id, any_value(prob) AS prob FROM fp GROUP BY ix, iy, r, c) SELECT id, count(*) AS n_px, {sql_scaled(f'sum({_FLOOR})*100', 'exp_m2', '1E3')} FROM o GROUP BY id"),
    "centroid_fallback": with_views("fx_pixels", "fx_buildings", sql=f"WITH {_PIX}, {_FEET}, {_Z}, n AS (SELECT b.id, area_m2, coalesce(p.prob, 0) AS prob FROM bx b LEFT JOIN px p ON p.ix = CAST(floor((lon-60)/{_P}) AS BIGINT)//64 AND p.iy = CAST(floor((lat-24)/{_P}) AS BIGINT)//64 AND p.r = CAST(floor((lat-24)/{_P}) AS BIGINT)%64 AND p.c = CAST(floor((lon-60)/{_P}) AS BIGINT)%64 WHERE b.id NOT IN (SELECT id FROM z)), u AS (SELECT id, exp_m2, n_px, max_prob FROM z UNION ALL SELECT id, {_FLOOR}*area_m2, 0, prob FROM n) SELECT id, {sql_scaled('exp_m2', 'exp_m2', '1E3')}, n_px, {sql_scaled('max_prob', 'max_prob', '1E3')} FROM u"),
    "pixel_components": with_views("fx_pixels", sql=f"WITH RECURSIVE {_PIX}, {_CC.format('0.6E0')} SELECT component, count(*) AS n_px, {sql_scaled('max(prob)', 'confidence', '1E3')} FROM k JOIN m USING (id) GROUP BY component").replace("WITH fx_pixels", "WITH RECURSIVE fx_pixels", 1).replace(", RECURSIVE px", ", px"),
    "hysteresis": with_views("fx_pixels", sql=f"WITH RECURSIVE {_PIX}, {_CC.format('0.5E0')} SELECT component, count(*) AS n_px, {sql_scaled('max(prob)', 'peak', '1E3')} FROM k JOIN m USING (id) GROUP BY component HAVING max(prob) >= 0.9E0").replace("WITH fx_pixels", "WITH RECURSIVE fx_pixels", 1).replace(", RECURSIVE px", ", px"),
    "confusion": with_views("fx_pixels", sql=f"WITH {_PIX}, q AS (SELECT ix, prob >= 0.5E0 AS p, {_M} = 1 AS t FROM px WHERE {_M} <> -1), g AS (SELECT ix, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM q GROUP BY ix) SELECT ix, tp, fp, fn, {sql_scaled('tp/nullif(tp+fp+fn, 0)', 'iou')}, {sql_scaled('2*tp/nullif(2*tp+fp+fn, 0)', 'f1')} FROM g"),
    "window_iou": with_views("fx_pixels", "fx_bins", sql=f"WITH {_PIX}, s AS (SELECT label AS strategy, prob >= 0.2E0 + bin/10 AND c >= bin*8 AS p, {_M} = 1 AS t FROM px, fx_bins WHERE {_M} <> -1) SELECT strategy, count(*) FILTER (p AND t) AS shared, count(*) FILTER (p OR t) AS either, {sql_scaled('count(*) FILTER (p AND t)/nullif(count(*) FILTER (p OR t), 0)', 'iou')} FROM s GROUP BY strategy"),
    "recall_by_size": with_views("fx_pixels", "fx_mapped", sql=f"WITH b AS (SELECT osm_id, area_m2, lon - {_HX} AS xmin, lon + {_HX} AS xmax, lat - {_HY} AS ymin, lat + {_HY} AS ymax FROM fx_mapped), s AS (SELECT osm_id, ymin, ymax, unnest(range(CAST(ceil((xmin-60)/{_P}-0.5E0) AS BIGINT), CAST(ceil((xmax-60)/{_P}-0.5E0) AS BIGINT))) AS gx FROM b), t AS (SELECT osm_id, gx, unnest(range(CAST(ceil((ymin-24)/{_P}-0.5E0) AS BIGINT), CAST(ceil((ymax-24)/{_P}-0.5E0) AS BIGINT))) AS gy FROM s), h AS (SELECT DISTINCT osm_id FROM t JOIN fx_pixels p ON prob_u8 >= 100 AND ix = gx//64 AND iy = gy//64 AND r = gy%64 AND c = gx%64) SELECT CASE WHEN area_m2 >= 1000 THEN '1000+' WHEN area_m2 >= 500 THEN '500-1000' WHEN area_m2 >= 250 THEN '250-500' ELSE '0-250' END AS bucket, count(*) AS n, count(h.osm_id) AS found FROM b LEFT JOIN h USING (osm_id) GROUP BY 1"),
    "cohens_d": with_views("fx_pixels", sql=f"WITH {_PIX}, q AS (SELECT iy, prob, {_M} AS m FROM px WHERE {_M} >= 0), g AS (SELECT iy, count(*) FILTER (m=1) AS n1, count(*) FILTER (m=0) AS n2, avg(prob) FILTER (m=1) AS m1, avg(prob) FILTER (m=0) AS m2, var_samp(prob) FILTER (m=1) AS v1, var_samp(prob) FILTER (m=0) AS v2 FROM q GROUP BY iy) SELECT iy, n1, n2, {sql_scaled('CASE WHEN n1 >= 5 AND n2 >= 20 THEN (m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)) END', 'd', '1E4')} FROM g"),
    "blend_windows": with_views("fx_pixels", sql=f"WITH {_PIX}, a AS (SELECT *, unnest([0,16,32]) AS y0 FROM px), b AS (SELECT *, unnest([0,16,32]) AS x0 FROM a), w AS (SELECT ix, iy, r, c, prob*(1+(r-y0)/100.0E0)/2 AS p, {_W.format('(r-y0)')}*{_W.format('(c-x0)')} AS w FROM b WHERE r >= y0 AND r < y0+32 AND c >= x0 AND c < x0+32) SELECT ix, iy, r, c, {sql_scaled('sum(p*w)/sum(w)', 'p', '1E4')} FROM w GROUP BY ix, iy, r, c"),
    "max_ndvi": with_views("fx_scenes", sql=f"WITH e AS (SELECT pid, item % 4 AS epoch, avg(CASE WHEN item % 6 > 0 THEN (p98_b08-p98_b04)/greatest(p98_b08+p98_b04, 1E-6) END) AS m FROM fx_scenes GROUP BY ALL) SELECT pid, {sql_scaled('max(m)', 'ndvi')} FROM e GROUP BY pid"),
    "median_composite": with_views("fx_scenes", sql=f"WITH s AS (SELECT {_SC} FROM fx_scenes) {_MC.format('pid, npx', 's', 12)}"),
    "seasonal_composite": with_views("fx_scenes", sql=f"WITH s AS (SELECT {_SC}, list_extract(['dry','wet','cool'], 1 + item % 3) AS season FROM fx_scenes), c AS ({_MC.format('pid, season', 's', 5)}), y AS (SELECT pid, floor(median(CASE WHEN dn > 0 THEN dn END)) AS annual FROM c GROUP BY pid) SELECT pid, " + ", ".join(f"CAST(coalesce(max(CASE WHEN season='{x}' AND dn > 0 THEN dn END), any_value(annual), 0) AS INT) AS {x}" for x in ("dry", "wet", "cool")) + ", CAST(coalesce(any_value(annual), 0) AS INT) AS annual FROM c JOIN y USING (pid) GROUP BY pid"),
    "pixel_anomalies": with_views("fx_scenes", sql=f"WITH {_RF}, m AS (SELECT pid, npx, count(*) AS n, median(b03) AS m3, median(b08) AS m8 FROM b03 GROUP BY ALL), d AS (SELECT pid, npx, greatest(1.4826E0*median(abs(b03-m3)), 0.015E0) AS s3, greatest(1.4826E0*median(abs(b08-m8)), 0.015E0) AS s8 FROM b03 JOIN m USING (pid, npx) GROUP BY ALL) SELECT pid, npx, any_value(n) AS n, count(*) FILTER (b03 > m3+5*s3 AND b08 > m8+5*s8) AS events FROM b03 JOIN m USING (pid, npx) JOIN d USING (pid, npx) WHERE n >= 10 GROUP BY pid, npx"),
    "class_mask": with_views("fx_mapped", sql=f"WITH b AS (SELECT osm_id, area_m2, lon - {_HX} - {_P} AS xmin, lon + {_HX} + {_P} AS xmax, lat - {_HY} AS ymin, lat + {_HY} AS ymax FROM fx_mapped), s AS (SELECT area_m2, ymin, ymax, unnest(range(CAST(ceil((xmin-60)/{_P}-0.5E0) AS BIGINT), CAST(ceil((xmax-60)/{_P}-0.5E0) AS BIGINT))) AS gx FROM b), t AS (SELECT area_m2, gx, unnest(range(CAST(ceil((ymin-24)/{_P}-0.5E0) AS BIGINT), CAST(ceil((ymax-24)/{_P}-0.5E0) AS BIGINT))) AS gy FROM s) SELECT CAST(floor(gx/64.0E0) AS INT) AS ix, CAST(floor(gy/64.0E0) AS INT) AS iy, CAST((gy%64+64)%64 AS INT) AS r, CAST((gx%64+64)%64 AS INT) AS c, max(CASE WHEN area_m2 >= 400 THEN 1 ELSE -1 END) AS mask FROM t GROUP BY 1, 2, 3, 4"),
    "hard_negatives": with_views("fx_pixels", "fx_buildings", sql=f"WITH {_PIX}, {_FEET.replace('area_m2 >= 0', 'area_m2 >= 400')}, {_Z}, n AS (SELECT id, max_prob*(id%3)/20 AS p, CASE WHEN id % 7 > 0 THEN max_prob*(id%5)/30 END AS o FROM z) SELECT id, CASE WHEN o IS NULL THEN 'no_old_data' WHEN p < 0.1E0 AND o < 0.1E0 THEN 'confirmed' WHEN p >= 0.1E0 AND o < 0.1E0 THEN 'lead' ELSE 'ambiguous' END AS verdict FROM n"),
    "oversample_union": with_views("fx_candidates", sql="WITH a AS (SELECT cand_id, CASE WHEN cand_id % 9 IN (3, 5) THEN 'val' ELSE 'train' END AS split FROM fx_candidates), u AS (SELECT *, 1 AS times, 'base' AS source FROM a UNION ALL SELECT *, 3, 'extra' FROM a WHERE cand_id % 4 = 0) SELECT cand_id, split, CAST(unnest(range(1, CASE WHEN split = 'train' THEN times ELSE 1 END + 1)) AS INT) AS copy, source FROM u"),
    "osm_labels": with_views("fx_osm", "fx_mapped", "fx_buildings", sql=f"""WITH t AS (SELECT el_id, CASE WHEN json_extract_string(tags, '$."plant:source"') = 'solar' THEN 'plant' ELSE 'generator' END AS kind, CASE WHEN json_extract_string(tags, '$.location') IN ('roof','rooftop') OR json_extract_string(tags, '$."generator:place"') IN ('roof','rooftop') THEN 'rooftop' WHEN json_extract_string(tags, '$."plant:source"') = 'solar' THEN 'ground' ELSE 'unknown' END AS p FROM fx_osm),
 c AS (SELECT a.osm_id, sum({_SHARED})/any_value(a.area_m2) AS share FROM fx_mapped a JOIN fx_buildings b ON {_CLOSE} GROUP BY a.osm_id) SELECT m.osm_id, kind, CASE WHEN p <> 'unknown' THEN p WHEN share >= 0.5E0 THEN 'rooftop' ELSE 'ground' END AS placement FROM t JOIN fx_mapped m ON m.osm_id = el_id LEFT JOIN c ON c.osm_id = m.osm_id"""),
    "review_counts": with_views("fx_reviews", sql="SELECT bin_label, count(*) AS n, count(*) FILTER (verdict = 'yes') AS n_real FROM fx_reviews WHERE verdict <> '' GROUP BY bin_label"),
    "building_grid": with_views("fx_buildings", sql=f"SELECT CAST(floor((lon-60.0E0)/0.05E0) AS INT) AS gx, CAST(floor((lat-24.0E0)/0.05E0) AS INT) AS gy, count(*) AS n, {sql_scaled('max(area_m2)', 'max_area', '1E3')} FROM fx_buildings WHERE area_m2 >= 500 GROUP BY 1, 2"),
    "cell_summary": with_views("fx_buildings", "fx_candidates", "fx_pixels", sql=f"""WITH {_PIX}, o AS (SELECT b.id, least(sum({_SHARED}), any_value(b.area_m2)) AS det, least(sum({_SHARED}*a.confidence), any_value(b.area_m2)) AS cal FROM fx_candidates a JOIN fx_buildings b ON {_CLOSE} AND {_SHARED} > 0 GROUP BY b.id),
 r AS (SELECT {_IX} AS ix, {_IY} AS iy, count(*) AS n_buildings, sum(area_m2) AS roof, count(*) FILTER (det > 0) AS n_pv, sum(coalesce(det,0)) AS det, sum(coalesce(cal,0)) AS cal FROM fx_buildings LEFT JOIN o USING (id) GROUP BY 1, 2), c AS (SELECT {_IX} AS ix, {_IY} AS iy, sum(area_m2) AS dt, sum(area_m2*confidence) AS ct FROM fx_candidates GROUP BY 1, 2), e AS (SELECT ix, iy, sum({_FLOOR})*100 AS ex FROM px GROUP BY 1, 2)
 SELECT ix, iy, coalesce(n_buildings,0) AS n_buildings, {sql_scaled('coalesce(roof,0)', 'roof_area_m2', '1E2')}, coalesce(n_pv,0) AS n_pv, {sql_scaled('coalesce(det,0)', 'det_roof_m2', '1E2')}, {sql_scaled('coalesce(cal,0)', 'cal_roof_m2', '1E2')}, {sql_scaled('coalesce(dt,0)', 'det_total_m2', '1E2')}, {sql_scaled('coalesce(ct,0)', 'cal_total_m2', '1E2')}, {sql_scaled('coalesce(ex,0)', 'exp_m2', '1E2')}, printf('%04d_%04d', ix, iy) AS cell FROM r FULL JOIN c USING (ix, iy) FULL JOIN e USING (ix, iy)"""),
}

QUERIES = {name: globals()[name] for name in ORACLES}
