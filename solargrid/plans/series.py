"""Queries over scene series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solargrid.functions import business as B
from solargrid.functions import solar
from solargrid.operators import calibration as K
from solargrid.operators import glint as G
from solargrid.operators import spatial as S
from solargrid.operators import studies as T
from solargrid.plans.common import scale, scaled, sql_scaled
from solargrid.sources.fixtures import fixture, with_views

BANDS = ["b03", "b08"]


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.to_reflectance(G.nan_to_null(fixture(spark, sf_dir, "fx_scenes")), BANDS)


def annotate_spikes_spatial(spark, sf_dir):
    a = G.annotated(_series(spark, sf_dir), BANDS)
    return a.select("pid", "item", "is_clear", "is_spike")


def annotate_spikes_selfref(spark, sf_dir):
    a = G.annotated(_series(spark, sf_dir), BANDS, spatial=False)
    return a.select("pid", "item", "is_clear", "is_spike")


def required_orientation(spark, sf_dir):
    tilt, az = solar.required_orientation(*G.ANGLES)
    return fixture(spark, sf_dir, "fx_scenes").select("item", scaled(tilt, 1000).alias("tilt"), scaled(az, 1000).alias("az"))


def spike_fit(spark, sf_dir):
    f = G.fit_summary(G.annotated(_series(spark, sf_dir), BANDS))
    return f.select("pid", "n_scenes", "n_clear", "n_spikes", "n_consistent", scaled("fit_tilt", 10).alias("fit_tilt"), scaled("fit_az", 10).alias("fit_az"))


def best_criterion(spark, sf_dir):
    return G.best_criterion(_series(spark, sf_dir), BANDS).select("pid", "criterion", "n_consistent")


def scene_dedupe(spark, sf_dir):
    return G.best_per(fixture(spark, sf_dir, "fx_scenes"), "day").select("pid", "item", "npx")


def scene_dedupe_first(spark, sf_dir):
    return G.best_per(fixture(spark, sf_dir, "fx_scenes"), "minute", by_pixels=False).select("pid", "item")


def study_by_size(spark, sf_dir):
    f = G.fit_summary(G.annotated(_series(spark, sf_dir), BANDS)).join(fixture(spark, sf_dir, "fx_candidates").select(F.col("cand_id").alias("pid"), "area_m2"), "pid")
    return scale(T.by_size(f), "med_area", "med_scenes", "pct_detected", "pct_validated", "med_spikes", by=100)


def annual_ndvi(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_scenes").withColumn("ndvi", solar.scene_ndvi("p98_b08", "p98_b04"))
    out = T.annual_ndvi(s.where("cloud <= 60"), s.select("pid").distinct(), 1 + F.col("item") % 12)
    return scale(out, "ndvi_p95", "ndvi_max", "ndvi_med", "ndvi_monsoon_p95", by=100)


def adoption_rate(spark, sf_dir):
    f = G.fit_summary(G.annotated(_series(spark, sf_dir), BANDS)).join(fixture(spark, sf_dir, "fx_candidates").select(F.col("cand_id").alias("pid"), "area_m2"), "pid")
    b = f.groupBy(B.size_bin(F.col("area_m2")).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("n_consistent") >= 2).alias("k"))
    pop = fixture(spark, sf_dir, "fx_candidates").groupBy(B.size_bin(F.col("area_m2")).alias("bin")).agg(F.count("*").alias("population"))
    j = b.join(pop, "bin").join(fixture(spark, sf_dir, "fx_bins").select("bin", (F.col("sens_k") / F.col("sens_n")).alias("d")), "bin")
    return scale(T.adoption(j), "d", "rate", "adopted", "adopted_lo", "adopted_hi", by=10_000)


def scene_match(spark, sf_dir):
    """Scenes that are bright over the target with the nearest scene of a hazy ring within ten hours."""
    s = fixture(spark, sf_dir, "fx_scenes")
    bright, hazy = s.where("p98_b03 > 4000").select("pid", "item", "time"), s.where("ring_b03 > 4000").select("pid", "item", "time")
    m = S.as_of(bright, hazy, "pid", "time", "time", 36_000)
    return m.select("pid", "item", "r_item", F.floor(F.col("gap_us") / 1000 + 0.5).alias("gap_ms"))


def run_agreement(spark, sf_dir):
    s = _series(spark, sf_dir)
    a, b = G.fit_summary(G.annotated(s, BANDS)), G.fit_summary(G.annotated(s.where("item % 5 > 0"), BANDS))
    return scale(T.agreement(a, b), "detected_agree", "validated_agree", "scene_diff")


def posterior_mixture(spark, sf_dir):
    """Posterior precision by size class; draws are as many as there are regions and counties."""
    c = fixture(spark, sf_dir, "fx_candidates").groupBy(B.size_bin(F.col("area_m2")).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("glint_consistent") >= 2).alias("k"))
    bins = fixture(spark, sf_dir, "fx_bins").select("bin", (F.col("sens_k") / F.col("sens_n")).alias("s"))
    u = fixture(spark, sf_dir, "fx_regions").select((F.col("region_id") + F.when(F.col("level") == "county", 5).otherwise(0)).cast("int").alias("draw"))
    d = c.join(bins, "bin").join(F.broadcast(u), F.lit(True)).withColumn("u", (F.col("draw") + 0.5) / 31).withColumn("f", F.lit(B.FALSE_RATE))
    return K.mixture_posterior(d).select("bin", "draw", scaled("p").alias("p"))


_S = "SELECT pid, item, time, " + ", ".join(f"greatest(({p}_{b} - 1000.0E0)/10000.0E0, 0.0E0) AS {p}_{b}" for b in BANDS for p in ("p98", "ring")) + ", sun_zen, sun_az, view_zen, view_az FROM fx_scenes"


def _annotated(spatial: bool) -> str:
    names = [f"{p}_{b}" for b in BANDS for p in (("p98",) if spatial else ("p98", "ring"))]
    clear = " AND ".join(f"ring_{b} BETWEEN 0.5E0*rm_{b} AND 1.6E0*rm_{b}+0.03E0" for b in BANDS)
    test = lambda b: f"p98_{b} > bp98_{b} + 5*sp98_{b} AND " + (f"p98_{b} > 1.5E0*(ring_{b}+0.02E0)" if spatial else f"ring_{b} <= bring_{b} + 3*sring_{b}")
    return f"""s AS ({_S}), m AS (SELECT pid, {', '.join(f'median(ring_{b}) AS rm_{b}' for b in BANDS)} FROM s GROUP BY pid),
c AS (SELECT s.*, {clear} AS is_clear FROM s JOIN m USING (pid)), b AS (SELECT pid, {', '.join(f'median({n}) AS b{n}' for n in names)} FROM c WHERE is_clear GROUP BY pid),
d AS (SELECT pid, {', '.join(f'greatest(1.4826E0*median(abs({n}-b{n})), 0.015E0) AS s{n}' for n in names)} FROM c JOIN b USING (pid) WHERE is_clear GROUP BY pid),
a AS (SELECT c.*, coalesce(is_clear AND {' AND '.join(test(b) for b in BANDS)}, false) AS is_spike FROM c LEFT JOIN b USING (pid) LEFT JOIN d USING (pid))"""


_E, _N, _U = ("sin(radians({0}_az))*sin(radians({0}_zen))", "cos(radians({0}_az))*sin(radians({0}_zen))", "cos(radians({0}_zen))")
_NEED = f"""n AS (SELECT *, {_E.format('sun')} + {_E.format('view')} AS ve, {_N.format('sun')} + {_N.format('view')} AS vn, {_U.format('sun')} + {_U.format('view')} AS vu FROM {{0}}),
o AS (SELECT *, degrees(acos(greatest(-1.0E0, least(1.0E0, vu/sqrt(ve*ve+vn*vn+vu*vu))))) AS tilt, degrees(atan2(ve, vn)) - 360.0E0*floor(degrees(atan2(ve, vn))/360.0E0) AS az FROM n)"""
_OFF = """degrees(acos(greatest(-1.0E0, least(1.0E0, (2*k*he-{se})*{ve} + (2*k*hn-{sn})*{vn} + (2*k*hu-{su})*{vu}))))""".format(se=_E.format("sun"), sn=_N.format("sun"), su=_U.format("sun"), ve=_E.format("view"), vn=_N.format("view"), vu=_U.format("view"))


def _fit(a: str, tag: str = "") -> str:
    return f"""{_NEED.format(f'(SELECT * FROM {a} WHERE is_spike)').replace('n AS (', f'n{tag} AS (', 1).replace('o AS (', f'o{tag} AS (', 1).replace('FROM n)', f'FROM n{tag})')},
h{tag} AS (SELECT pid, item AS hi, time AS ht, tilt, az, sin(radians(az))*sin(radians(tilt)) AS he, cos(radians(az))*sin(radians(tilt)) AS hn, cos(radians(tilt)) AS hu FROM o{tag}),
j{tag} AS (SELECT h.*, x.sun_zen, x.sun_az, x.view_zen, x.view_az, {_E.format('x.sun')}*he + {_N.format('x.sun')}*hn + {_U.format('x.sun')}*hu AS k FROM h{tag} h JOIN o{tag} x ON x.pid = h.pid),
w{tag} AS (SELECT pid, hi, ht, tilt, az, count(*) FILTER ({_OFF} <= 3.0E0) AS n FROM j{tag} GROUP BY ALL),
q{tag} AS (SELECT * FROM w{tag} QUALIFY row_number() OVER (PARTITION BY pid ORDER BY n DESC, ht, hi) = 1),
z{tag} AS (SELECT c.pid, n_scenes, n_clear, n_spikes, CASE WHEN n_spikes >= 2 THEN n ELSE 0 END AS n_consistent, CASE WHEN n_spikes >= 2 THEN round_even(tilt, 1) END AS fit_tilt, CASE WHEN n_spikes >= 2 THEN round_even(az, 1) END AS fit_az
 FROM (SELECT pid, count(*) AS n_scenes, count(*) FILTER (is_clear) AS n_clear, count(*) FILTER (is_spike) AS n_spikes FROM {a} GROUP BY pid) c LEFT JOIN q{tag} USING (pid))"""


_BIN = "CASE WHEN area_m2 < 100 THEN 0 WHEN area_m2 < 500 THEN 1 WHEN area_m2 < 1000 THEN 2 WHEN area_m2 < 5000 THEN 3 WHEN area_m2 < 50000 THEN 4 ELSE 5 END"
_BIN_R = _BIN.replace("<", "<=")
_INV = "CASE WHEN d > 0.087E0 + 1E-9 THEN greatest(0.0E0, least(1.0E0, ({0} - 0.087E0)/(d - 0.087E0))) END"
_MID, _HALF = "((1.0E0*k/n + 1.96E0*1.96E0/(2*n))/(1 + 1.96E0*1.96E0/n))", "(1.96E0*sqrt((1.0E0*k/n)*(1-1.0E0*k/n)/n + 1.96E0*1.96E0/(4.0E0*n*n))/(1 + 1.96E0*1.96E0/n))"

ORACLES = {
    "annotate_spikes_spatial": with_views("fx_scenes", sql=f"WITH {_annotated(True)} SELECT pid, item, is_clear, is_spike FROM a"),
    "annotate_spikes_selfref": with_views("fx_scenes", sql=f"WITH {_annotated(False)} SELECT pid, item, is_clear, is_spike FROM a"),
    "required_orientation": with_views("fx_scenes", sql=f"WITH {_NEED.format('fx_scenes')} SELECT item, {sql_scaled('tilt', 'tilt', '1E3')}, {sql_scaled('az', 'az', '1E3')} FROM o"),
    "spike_fit": with_views("fx_scenes", sql=f"WITH {_annotated(True)}, {_fit('a')} SELECT pid, n_scenes, n_clear, n_spikes, n_consistent, {sql_scaled('fit_tilt', 'fit_tilt', '10')}, {sql_scaled('fit_az', 'fit_az', '10')} FROM z"),
    "best_criterion": with_views("fx_scenes", sql=f"WITH sp AS (WITH {_annotated(True)}, {_fit('a')} SELECT * FROM z), sr AS (WITH {_annotated(False)}, {_fit('a')} SELECT * FROM z) SELECT pid, CASE WHEN greatest(sp.n_consistent, sr.n_consistent) < 2 THEN 'none' WHEN sp.n_consistent >= sr.n_consistent THEN 'spatial' ELSE 'self' END AS criterion, greatest(sp.n_consistent, sr.n_consistent) AS n_consistent FROM sp JOIN sr USING (pid)"),
    "scene_dedupe": with_views("fx_scenes", sql="SELECT pid, item, npx FROM fx_scenes QUALIFY row_number() OVER (PARTITION BY pid, date_trunc('day', time) ORDER BY npx DESC, item) = 1"),
    "scene_dedupe_first": with_views("fx_scenes", sql="SELECT pid, item FROM fx_scenes QUALIFY row_number() OVER (PARTITION BY pid, date_trunc('minute', time) ORDER BY item) = 1"),
    "study_by_size": with_views("fx_scenes", "fx_candidates", sql=f"WITH {_annotated(True)}, {_fit('a')}, y AS (SELECT z.*, area_m2, {_BIN_R} AS bucket FROM z JOIN fx_candidates f ON f.cand_id = z.pid) SELECT bucket, count(*) AS n, {sql_scaled('median(area_m2)', 'med_area', '1E2')}, {sql_scaled('median(n_scenes)', 'med_scenes', '1E2')}, {sql_scaled('avg(CASE WHEN n_spikes >= 1 THEN 100 ELSE 0 END)', 'pct_detected', '1E2')}, {sql_scaled('avg(CASE WHEN n_consistent >= 2 THEN 100 ELSE 0 END)', 'pct_validated', '1E2')}, {sql_scaled('median(CASE WHEN n_spikes >= 1 THEN n_spikes END)', 'med_spikes', '1E2')} FROM y GROUP BY bucket"),
    "annual_ndvi": with_views("fx_scenes", sql="WITH s AS (SELECT pid, cloud, 1 + item % 12 IN (6,7,8,9) AS bad, (1 + item % 12) IN (6,7,8,9) AS wet, CASE WHEN p98_b08 + p98_b04 > 0 THEN (p98_b08 - p98_b04)/greatest(p98_b08 + p98_b04, 1E-6) END AS v FROM fx_scenes), "
        f"g AS (SELECT pid, count(v) AS n_clear, count(*) FILTER (wet AND v IS NOT NULL) AS n_monsoon, quantile_cont(v, 0.95) AS p95, max(v) AS mx, median(v) AS md, quantile_cont(v, 0.95) FILTER (wet) AS mp FROM s WHERE cloud <= 60 GROUP BY pid) SELECT pid, coalesce(n_clear, 0) AS n_clear, coalesce(n_monsoon, 0) AS n_monsoon, {sql_scaled('round_even(p95, 3)', 'ndvi_p95', '1E2')}, {sql_scaled('round_even(mx, 3)', 'ndvi_max', '1E2')}, {sql_scaled('round_even(md, 3)', 'ndvi_med', '1E2')}, {sql_scaled('round_even(mp, 3)', 'ndvi_monsoon_p95', '1E2')} FROM (SELECT DISTINCT pid FROM s) LEFT JOIN g USING (pid)"),
    "adoption_rate": with_views("fx_scenes", "fx_candidates", "fx_bins", sql=f"WITH {_annotated(True)}, {_fit('a')}, y AS (SELECT {_BIN} AS bin, count(*) AS n, count(*) FILTER (n_consistent >= 2) AS k FROM z JOIN fx_candidates f ON f.cand_id = z.pid GROUP BY 1), u AS (SELECT {_BIN} AS bin, count(*) AS population FROM fx_candidates GROUP BY 1), t AS (SELECT y.*, population, sens_k/sens_n AS d FROM y JOIN u USING (bin) JOIN fx_bins USING (bin)) SELECT bin, n, k, population, {sql_scaled('d', 'd', '1E4')}, {sql_scaled('k/n', 'rate', '1E4')}, {sql_scaled(_INV.format('k/n'), 'adopted', '1E4')}, {sql_scaled(_INV.format(f'({_MID} - {_HALF})'), 'adopted_lo', '1E4')}, {sql_scaled(_INV.format(f'({_MID} + {_HALF})'), 'adopted_hi', '1E4')} FROM t"),
    "scene_match": with_views("fx_scenes", sql="WITH p AS (SELECT a.pid, a.item, b.item AS r_item, b.time AS bt, abs(epoch_us(a.time) - epoch_us(b.time)) AS gap FROM fx_scenes a JOIN fx_scenes b ON a.pid = b.pid AND a.p98_b03 > 4000 AND b.ring_b03 > 4000) SELECT pid, item, r_item, CAST(floor(gap/1E3 + 0.5E0) AS BIGINT) AS gap_ms FROM p WHERE gap <= 36000000000 QUALIFY row_number() OVER (PARTITION BY item ORDER BY gap, bt) = 1"),
    "run_agreement": with_views("fx_scenes", sql=f"WITH x AS (WITH {_annotated(True)}, {_fit('a')} SELECT * FROM z), y AS (WITH {_annotated(True).replace('FROM fx_scenes', 'FROM fx_scenes WHERE item % 5 > 0')}, {_fit('a')} SELECT * FROM z) SELECT count(*) AS n, {sql_scaled('avg(CASE WHEN (x.n_spikes >= 1) = (y.n_spikes >= 1) THEN 1 ELSE 0 END)', 'detected_agree')}, {sql_scaled('avg(CASE WHEN (x.n_consistent >= 2) = (y.n_consistent >= 2) THEN 1 ELSE 0 END)', 'validated_agree')}, {sql_scaled('avg(abs(x.n_scenes - y.n_scenes))', 'scene_diff')}, max(abs(x.n_scenes - y.n_scenes)) AS scene_diff_max FROM x JOIN y USING (pid)"),
    "posterior_mixture": with_views("fx_candidates", "fx_bins", "fx_regions", sql=f"WITH c AS (SELECT {_BIN} AS bin, count(*) AS n, count(*) FILTER (glint_consistent >= 2) AS k FROM fx_candidates GROUP BY 1), d AS (SELECT bin, n, k, sens_k/sens_n AS s, CAST(region_id + CASE WHEN level = 'county' THEN 5 ELSE 0 END AS INT) AS draw FROM c JOIN fx_bins USING (bin), fx_regions), g AS (SELECT *, unnest(range(201)) AS g FROM d), q AS (SELECT *, greatest(1E-9, least(1-1E-9, g/200*s + (1-g/200)*0.087E0)) AS q FROM g), l AS (SELECT *, k*ln(q) + (n-k)*ln(1-q) AS ll FROM q), w AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY bin, draw)) AS w FROM l), f AS (SELECT *, sum(w) OVER (PARTITION BY bin, draw ORDER BY g) / sum(w) OVER (PARTITION BY bin, draw) AS cdf FROM w) SELECT bin, draw, {sql_scaled('min(g)/200', 'p')} FROM f WHERE cdf >= (draw + 0.5E0)/31 GROUP BY bin, draw"),
}

QUERIES = {name: globals()[name] for name in ORACLES}
