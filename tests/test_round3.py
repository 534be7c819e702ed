"""Faults that only showed on larger tables, as small cases."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from solargrid.operators import glint
from solargrid.plans import series


def test_votes_at_the_tolerance_follow_the_sql(spark):
    """Whole degrees put spikes exactly three degrees off; the last digit of the sine decides."""
    at = dt.datetime(2024, 1, 1)
    rows = [(i * 7 % 3, i, at + dt.timedelta(minutes=i * 7 % 400), 25.0 + i % 30, 120.0 + i % 40, 2.0 + i % 9, 100.0 + i % 2 * 180.0) for i in range(1080)]
    names = ["pid", "item", "time", "sun_zen", "sun_az", "view_zen", "view_az"]
    con = duckdb.connect()
    con.execute("CREATE TABLE a (pid BIGINT, item BIGINT, time TIMESTAMP, sun_zen DOUBLE, sun_az DOUBLE, view_zen DOUBLE, view_az DOUBLE, is_clear BOOLEAN, is_spike BOOLEAN)")
    con.executemany("INSERT INTO a VALUES (?, ?, ?, ?, ?, ?, ?, true, true)", rows)
    want = con.execute(f"WITH {series._fit('a')} SELECT pid, n_consistent, fit_tilt, fit_az FROM z ORDER BY pid").fetchall()
    df = spark.createDataFrame(rows, names).withColumns({"is_clear": F.lit(True), "is_spike": F.lit(True)})
    got = glint.fit_summary(df).select("pid", "n_consistent", "fit_tilt", "fit_az").orderBy("pid").collect()
    assert [tuple(r) for r in got] == want


def test_gaps_in_time_are_whole_microseconds(spark):
    """8817.4055 s is half a millisecond more than 8817405 ms; as a difference of seconds it was less."""
    from solargrid.operators import spatial as S

    at = dt.datetime(2024, 1, 10, 3, 2, 1, 345)
    a = spark.createDataFrame([(1, 7, at)], "pid bigint, item bigint, time timestamp")
    b = spark.createDataFrame([(1, 9, at + dt.timedelta(microseconds=8_817_405_500)), (1, 8, at + dt.timedelta(microseconds=8_817_405_500)), (1, 5, at - dt.timedelta(hours=9)), (2, 6, at)], "pid bigint, item bigint, time timestamp")
    assert [(r.r_item, r.gap_us) for r in S.as_of(a, b, "pid", "time", "time", 36_000).collect()] == [(8, 8_817_405_500)]


def test_nearest_pass_makes_no_pairs(spark):
    """Sixty thousand passes and twenty thousand spikes of one target in two days: 1.2e9 pairs, if they were all compared."""
    n = spark.range(60_000).select(F.lit(1).cast("long").alias("pid"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 1_000_000).alias("time"), (F.col("id") % 9).cast("double").alias("misalignment"))
    s = spark.range(20_000).select(F.lit(1).cast("long").alias("pid"), F.col("id").alias("item"), F.timestamp_micros(F.lit(1_704_067_200_300_000) + F.col("id") * 3_000_000).alias("time"))
    out = glint.nearest_pass(s, n)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    r = out.agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.max("gap").alias("gap")).first()
    assert r.n == 20_000 and r.hits == sum(i * 3 % 9 <= 3 for i in range(20_000)) and abs(r.gap * 86_400 - 0.3) < 1e-5


def test_copies_of_shapes_do_not_meet_each_other(spark):
    """Fifty candidates and forty buildings of one shape each: one pair of shapes, not two thousand pairs of rows."""
    from solargrid.operators import candidates as C
    from solargrid.operators import density as D
    from solargrid.operators import spatial as S

    square = [F.lit(60.5).alias("lon"), F.lit(24.5).alias("lat"), F.lit(400.0).alias("area_m2")]
    c = spark.range(100, 150).select(F.col("id").alias("cand_id"), *square, F.lit(0.5).alias("p_real"))
    b = spark.range(7, 47).select("id", *square)
    assert S.shape_overlaps(c, b, "cand_id", "id")[2].count() == 1
    n = S.nearest(c, b, "cand_id", "id", 200.0).collect()
    assert len(n) == 50 and all(r.near_id == 7 and r.dist_m == 0 and abs(r.overlap_m2 - 16_000) < 1e-6 for r in n)
    d = D.detected_on_buildings(c, b.withColumn("area_m2", F.lit(400.0))).collect()
    assert len(d) == 40 and all(r.main_cand == 100 and r.det_m2 == 400 and r.cal_m2 == 400 for r in d)
    assert {r.building_id for r in C.best_overlap(c, b).collect()} == {7}
    assert S.matched(c, b, "cand_id", 0.0).count() == 50
    ring = lambda df: df.withColumn("rings", F.expr("array(array(struct(0D AS x, 0D AS y), struct(1D AS x, 0D AS y), struct(1D AS x, 1D AS y)))"))
    assert S.polygon_overlaps(ring(c), ring(b), "cand_id", "id").where("abs(shared - 0.5) < 1e-9").count() == 2000
    tiles = spark.range(30).select(F.format_string("t%02d", "id").alias("file"), F.lit(60.0).alias("xmin"), F.lit(24.0).alias("ymin"), F.lit(61.0).alias("xmax"), F.lit(25.0).alias("ymax"))
    assert {(r.file, r.n_covering) for r in S.covered_by_one(S.with_box(c), tiles, "cand_id").collect()} == {("t00", 30)}
    assert {r.file for r in S.one_tile(b, tiles, "id", first=False).collect()} == {"t29"}


def test_ids_beyond_a_million_follow_the_sql(spark):
    from solargrid.plans.common import six_digits

    df = spark.createDataFrame([(7,), (999_999,), (1_234_567,)], "n bigint").select(six_digits("fx-pv-", F.col("n")).alias("c"))
    want = [r[0] for r in duckdb.sql("SELECT 'fx-pv-' || lpad(CAST(n AS VARCHAR), 6, '0') FROM (VALUES (7), (999999), (1234567)) t(n)").fetchall()]
    assert [r.c for r in df.collect()] == want


def test_only_scenes_near_a_chosen_one_are_read(spark):
    from solargrid.operators import refine as R

    at = dt.datetime(2024, 1, 1, 12)
    us = int(at.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    chosen = spark.createDataFrame([(1, 10, us, "spike")], "pid bigint, item bigint, at bigint, role string")
    gaps = {10: 0, 11: 1800, 12: -1800, 13: 1801, 14: -1801, 15: 86_400}
    scenes = spark.createDataFrame([(p, i, at + dt.timedelta(seconds=g)) for p in (1, 2) for i, g in gaps.items()], "pid bigint, item bigint, time timestamp")
    assert {(r.pid, r.item) for r in R.near_scenes(chosen, scenes).collect()} == {(1, 10), (1, 11), (1, 12)}


def test_backscatter_packs_readings_by_tile_and_scene(spark, sf_dir):
    """Readings move by tile and scene: windows across tiles, a pixel read twice, absent values and many windows of a home."""
    import numpy as np

    from solargrid.operators import refine as R

    rng = np.random.default_rng(5)
    zones, readings = [], []
    for k, (x0, y0) in enumerate([(60, 60), (60, 60), (10, 3), (120, 62)]):  # two alike; three reach over an edge of their tile
        zones += [(k, x // 64, y // 64, y % 64, x % 64, "inside" if max(abs(x - x0 - 5), abs(y - y0 - 5)) < 2 else "ring") for x in range(x0, x0 + 11) for y in range(y0, y0 + 11) if (x + y) % 7]
    for x, y, item, band in {tuple(t) for t in zip(*(rng.integers(0, n, 60_000).tolist() for n in (130, 130, 4, 2)), strict=True)}:
        for _ in range(1 + (x * y % 13 == 0)):
            readings.append((x // 64, y // 64, y % 64, x % 64, item, item, "up" if item % 2 else None, ("vv", "vh")[band], None if (x + item) % 11 == 0 else float(rng.integers(0, 99)) / 7))
    readings = [r for r in readings if not (r[4] == 3 and r[7] == "vh" and r[0] == 0)]
    z = spark.createDataFrame(zones, "id long, ix int, iy int, r int, c int, zone string")
    m = spark.createDataFrame(readings, "ix int, iy int, r int, c int, item int, time int, orbit string, band string, v double")
    out = R.backscatter(z, m, "id", ["vv", "vh"])
    got = {(r["id"], r["item"], r.orbit): tuple(r)[4:] for r in out.collect()}
    at = {}
    for k, ix, iy, r, c, zone in zones:
        at.setdefault((ix, iy, r, c), []).append((k, zone))
    seen = {}
    for ix, iy, r, c, item, _, orbit, band, v in readings:
        for k, zone in at.get((ix, iy, r, c), []):
            own = seen.setdefault((k, item, orbit), {}).setdefault(band, {"inside": [], "ring": []})[zone]
            own += [] if v is None else [v]
    want = {}
    for k, bands in seen.items():
        if len(bands) == 2:
            row = []
            for band in ("vv", "vh"):
                i, o = bands[band]["inside"], bands[band]["ring"]
                row += [np.quantile(i, 0.9), np.median(o), len(i)] if len(i) >= 3 and len(o) >= 20 else [None, None, 0]
            want[k] = tuple(row)
    assert set(got) == set(want) and len(want) > 12 and {k[0] for k in want} == {0, 1, 2, 3}
    for k in want:
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got[k], want[k], strict=True)), k
    # The faulty form joined every reading with every target that shows it, a row for each pair; the series was worked out three times.
    from solargrid.plans import refinement

    plan = refinement.radar_orbit_rates(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(array(vv, vh))") <= 1 and plan.count("zone#") == 0


def test_areas_of_boxes_follow_the_sql(spark, tmp_path):
    """Footprints whose area ends within a millionth of a rounding step, found on sixty times sf0.1."""
    from solargrid.plans import surveys

    rows = [(k, 1, "O", price, dt.datetime(1998, 2, 6), "5-LOW") for k, price in [(7073157, 314430.72), (3848141, 491646.28), (7328141, 332646.76)]]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"SELECT id, area FROM ({surveys.ORACLES['footprint_measures']}) ORDER BY id").fetchall()
    assert [tuple(r) for r in surveys.footprint_measures(spark, str(tmp_path)).select("id", "area").orderBy("id").collect()] == want


def test_squares_around_one_point_stand_for_each_other(spark):
    """Sixty squares of different areas around one point: few can be nearest, one decides whether something is near."""
    from solargrid.operators import spatial as S

    at = [F.lit(60.5).alias("lon"), F.lit(24.5).alias("lat")]
    b = spark.range(60).select("id", *at, (100.0 + F.pmod(F.col("id") * 37, F.lit(60)) * 10).alias("area_m2"))
    own = {r.id: r.area_m2 for r in b.collect()}
    few = {r.s_id for r in S.foremost(S.shapes_of(b, "id")).collect()}
    assert few == {i for i in own if not any(own[j] > own[i] and j < i for j in own)} and len(few) < 12
    odd = spark.createDataFrame([(900, 60.5, 24.5, float("nan")), (901, 60.5, 24.5, None), (902, None, 24.5, 9e9), (903, 60.5, 24.5, -1.0)], "id long, lon double, lat double, area_m2 double")
    b = b.unionByName(odd)
    c = spark.range(20).select(F.col("id").alias("cand_id"), (60.5 + F.col("id") * 0.00002).alias("lon"), F.lit(24.5).alias("lat"), F.lit(50.0).alias("area_m2"))
    pairs = S.nearest(c, b, "cand_id", "id", 15.0).select("cand_id", "dist_m", "near_id").orderBy("cand_id").collect()
    assert S.nearest(c, b, "cand_id", "id", 15.0, overlap=False).orderBy("cand_id").collect() == pairs and 5 < len(pairs) < 20 and len({r.near_id for r in pairs}) > 2
    assert {r.cand_id for r in S.matched(c, b, "cand_id", 15.0).collect()} == {r.cand_id for r in pairs}
    seen = []

    def hits(x, y):
        pairs = S.polygon_pairs(x, y, 15.0)
        seen.append((x.count(), y.count(), pairs.count()))
        return pairs

    a, rings = S.shapes_of(c, "cand_id"), S.shaped(b.where("id < 900"), "").select("rings")
    found = S.hit_shapes(a.withColumn("rings", S.G.box_rings(F.col("lon"), F.col("lat"), F.col("area_m2"))), rings, hits)
    assert {r.s_id for r in found.collect()} == {r.cand_id for r in pairs}
    assert seen[0][1] == 1 and seen[1][0] == 20 - len(pairs) and seen[1][2] == 0  # those that hit the widest meet no other


def _nested(spark, n=200):
    """Squares of different areas around one point."""
    return spark.range(n).select("id", F.lit(60.5).alias("lon"), F.lit(24.5).alias("lat"), (100.0 + F.pmod(F.col("id") * 37, F.lit(n)) * 10).alias("area_m2"))


def test_sums_of_overlaps_neither_sort_nor_send_pairs(spark):
    """The nearest of two hundred squares around one point is sought among few; the sum over all goes by hashes."""
    from solargrid.operators import spatial as S

    b = _nested(spark)
    c = spark.range(20).select(F.col("id").alias("cand_id"), (60.5 + F.col("id") * 0.00002).alias("lon"), F.lit(24.5).alias("lat"), F.lit(50.0).alias("area_m2"))
    pairs = S._near(S.shapes_of(c, "cand_id"), S.shapes_of(b, "id"), 15.0).withColumn("shared", S._shared_m2(False)).collect()
    want = {}
    for r in pairs:
        d, i, m2 = want.get(r.l_s_id, (float("inf"), 0, 0.0))
        want[r.l_s_id] = (*min((d, i), (r.gap_m, r.r_s_id)), m2 + r.shared)
    got = {r.cand_id: (r.dist_m, r.near_id, r.overlap_m2) for r in S.nearest(c, b, "cand_id", "id", 15.0).collect()}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-6 for k in want)
    plan = S._shared_sums(S.shapes_of(c, "cand_id"), S.shapes_of(b, "id"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_best_roof_is_sought_among_those_no_other_holds(spark):
    from solargrid.operators import candidates as C
    from solargrid.operators import spatial as S

    ring = lambda *p: F.array(F.array(*[F.struct(F.lit(60.5 + x * 1e-5).alias("x"), F.lit(24.5 + y * 1e-5).alias("y")) for x, y in p]))
    wide = spark.range(1).select(F.lit(-9).cast("long").alias("id"), F.lit(60.5).alias("lon"), F.lit(24.5).alias("lat"), F.lit(1.0).alias("area_m2"))
    b = _nested(spark).withColumn("rings", S.G.box_rings(F.col("lon"), F.col("lat"), F.col("area_m2")))
    own = {r.id: r.area_m2 for r in b.collect()}
    # A narrow star and a bent shape have the widest bounds and the smallest ids, but hold no square.
    star = wide.withColumn("rings", ring((90, 90), (1, 0), (90, -90), (0, -1), (-90, -90), (-1, 0), (-90, 90), (0, 1)))
    bent = wide.withColumns({"id": F.lit(-8).cast("long"), "rings": ring((-80, -80), (80, -80), (80, 80), (79, -79))})
    few = {r.s_id for r in S.foremost(S.shapes_of(b, "id")).collect()}
    assert few == {i for i in own if not any(own[j] > own[i] and j < i for j in own)} and len(few) < 15
    b = b.unionByName(star).unionByName(bent)
    assert len(S.foremost(S.shapes_of(b, "id")).collect()) == 202
    c = spark.range(12).select(F.col("id").alias("cand_id"), (60.5 + F.col("id") * 0.00005).alias("lon"), F.lit(24.5).alias("lat"), F.lit(300.0).alias("area_m2"))
    c = c.withColumn("rings", S.G.box_rings(F.col("lon"), F.col("lat"), F.col("area_m2")))
    top = {}
    for r in S.overlaps(S.shapes_of(c, "cand_id"), S.shapes_of(b, "id")).where("shared > 1e-6").collect():
        top[r.l_s_id] = max(top.get(r.l_s_id, (0.0, 0)), (round(r.shared, 6), -r.r_s_id))
    got = {r.cand_id: r.building_id for r in C.best_overlap(c, b, least_m2=1e-6).collect()}
    assert all(got[k] == (-top[k][1] if k in top else None) for k in got) and len(top) > 5


def test_boxes_share_their_sides_and_pairs_are_named_last(spark):
    """Boxes, a diamond, a box with a hole and copies on both sides, against the kernel on every pair of rows; boxes alone need no kernel."""
    from solargrid.functions import shapes
    from solargrid.operators import spatial as S

    box = lambda x, y, h: [{"x": x + i * h, "y": y + j * h} for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    diamond = [[{"x": 0.5, "y": 0.0}, {"x": 1.0, "y": 0.5}, {"x": 0.5, "y": 1.0}, {"x": 0.0, "y": 0.5}]]
    level = [[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]]
    holed = [box(0.5, 0.5, 0.5), box(0.5, 0.5, 0.2)[::-1]]
    schema = "{} long, rings array<array<struct<x:double,y:double>>>"
    left = [(1, [box(0.1, 0.1, 0.31)]), (2, diamond), (3, holed), (4, [box(0.1, 0.1, 0.31)]), (5, None), (6, level)]
    right = [(7, [box(0.3, 0.2, 0.17)]), (8, [box(0.3, 0.2, 0.17)]), (9, diamond), (10, [box(5.0, 5.0, 0.1)]), (11, []), (12, holed)]
    a, b = spark.createDataFrame(left, schema.format("a")), spark.createDataFrame(right, schema.format("b"))
    rows = a.crossJoin(b.withColumnRenamed("rings", "r_rings")).select("a", "b", shapes.intersection_area("rings", "r_rings").alias("shared")).where("shared > 1e-12").collect()
    got = S.polygon_overlaps(a, b, "a", "b", 0.5).collect()
    assert len(got) == len(rows) > 12 and {(r.a, r.b): round(r.shared, 9) for r in got} == {(r.a, r.b): round(r.shared, 9) for r in rows}
    assert {r.a for r in a.where(shapes.is_box("rings")).collect()} == {1, 4}
    plain = S.polygon_overlaps(a.where("a IN (1, 4)"), b.where("b IN (7, 8, 10)"), "a", "b", 0.5)
    assert plain.count() == 4 and "intersection_area" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_chips_of_one_box_are_dealt_over_tasks(spark):
    """Forty chips of one box and four hundred labels: no task makes all the pairs."""
    from solargrid.operators import training as N

    edge = lambda lo, hi: [F.lit(v).alias(c) for c, v in (("xmin", lo), ("ymin", lo), ("xmax", hi), ("ymax", hi))]
    labels = spark.range(400).select(F.col("id").alias("osm_id"), *edge(60.02, 60.021))
    chips = spark.range(40).select(F.col("id").cast("string").alias("chip_id"), *edge(60.0, 60.1))
    out = N.labels_in_chips(labels, chips.unionByName(spark.range(1).select(F.lit("far").alias("chip_id"), *edge(61.0, 61.1))))
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == out.distinct().count() == 16_000 and max(per_task) < 12_000
