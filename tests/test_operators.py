"""Operators on small tables: edges, empty input, sources, sinks and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from solargrid.functions import business
from solargrid.operators import components, density, evaluate, glint, pixels, spatial, studies, training
from solargrid.plans import api
from solargrid.sources import sinks, tables
from solargrid.streaming import ingest


def squares(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, lon double, lat double, area_m2 double")


def test_distance_test_is_strict(spark):
    a = squares(spark, [(1, 60.0, 24.0, 100.0), (2, 60.5, 24.0, 100.0)], "cand_id")
    b = squares(spark, [(9, 60.0, 24.0 + 110.0 / 111_320, 100.0)], "osm_id")  # a gap of 100 m
    left = lambda d: {r.cand_id for r in spatial.new_leads(a, b, d).collect()}
    assert left(99.0) == {1, 2} and left(100.001) == {2} and left(0.0) == {1, 2}
    assert spatial.new_leads(a, b.limit(0), 100.0).count() == 2


def test_nearest_prefers_the_smaller_id_on_ties(spark):
    a = squares(spark, [(1, 60.0, 24.0, 400.0)], "cand_id")
    b = squares(spark, [(8, 60.0, 24.0, 100.0), (7, 60.0, 24.0, 100.0)], "id")
    r = spatial.nearest(a, b, "cand_id", "id", 50.0).first()
    assert (r.dist_m, r.near_id) == (0.0, 7) and r.overlap_m2 == pytest.approx(200.0)


def test_region_attach_keeps_one_row_and_both_ways_agree(spark):
    p = spark.range(40).select("id", (60 + F.col("id") / 50).alias("lon"), F.lit(24.5).alias("lat"))
    g = spark.createDataFrame([(2, "b", 60.0, 24.0, 60.5, 25.0), (1, "a", 60.2, 24.0, 61.0, 25.0)], "region_id int, name string, xmin double, ymin double, xmax double, ymax double")
    a = spatial.attach_region(p, g, "left")
    b = spatial.attach_region(p, g, "left", most_rows=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 40
    assert {r.region_name for r in a.where("lon > 60.3 AND lon < 60.5").collect()} == {"a"}


def test_as_of_takes_the_nearest(spark):
    a = spark.createDataFrame([(1, "2024-01-01 10:00:00")], "pid long, t string").withColumn("t", F.to_timestamp("t"))
    b = spark.createDataFrame([(1, "2024-01-01 09:45:00"), (1, "2024-01-01 10:10:00"), (1, "2024-01-01 12:00:00")], "pid long, t string").withColumn("t", F.to_timestamp("t"))
    r = spatial.as_of(a, b, "pid", "t", "t", 1800).collect()
    assert len(r) == 1 and r[0].gap_s == 600


def test_components_of_a_long_chain(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(900, 901)], "a long, b long"))
    got = components.components(e)
    assert {r.component for r in got.where("node < 300").collect()} == {0} and got.where("node >= 900").first().component == 900


def test_components_cross_tile_borders(spark):
    rows = [(1, 0, 0, 5, 63), (2, 1, 0, 5, 0), (3, 1, 0, 7, 9)]
    m = spark.createDataFrame(rows, "id long, ix int, iy int, r int, c int").withColumn("prob", F.lit(0.9))
    got = {r.component: r.n_px for r in pixels.polygonised(m, 0.5).collect()}
    assert got == {1: 2, 3: 1}
    diagonal = spark.createDataFrame([(1, 0, 0, 1, 1), (2, 0, 0, 2, 2)], "id long, ix int, iy int, r int, c int").withColumn("prob", F.lit(0.9))
    assert pixels.polygonised(diagonal, 0.5).count() == 2 and pixels.polygonised(diagonal, 0.5, eight=True).count() == 1


def series(spark, rows):
    s = spark.createDataFrame(rows, "pid long, item long, p98_b03 double, ring_b03 double")
    return s.withColumn("time", F.to_timestamp(F.lit("2024-01-01"))).withColumns({c: F.lit(30.0 if "zen" in c else 180.0) for c in glint.ANGLES})


def test_one_spike_gives_no_fit(spark):
    rows = [(1, k, 0.1, 0.1) for k in range(9)] + [(1, 9, 0.9, 0.1)]
    f = glint.fit_summary(glint.annotated(series(spark, rows), ["b03"])).first()
    assert (f.n_scenes, f.n_spikes, f.n_consistent, f.fit_tilt) == (10, 1, 0, None)
    two = [*rows, (1, 10, 0.9, 0.1)]
    f = glint.fit_summary(glint.annotated(series(spark, two), ["b03"])).first()
    assert (f.n_spikes, f.n_consistent, f.fit_tilt) == (2, 2, 30.0)


def test_missing_statistics_drop_a_scene(spark):
    rows = [(1, k, 0.1, 0.1) for k in range(5)] + [(1, 6, float("nan"), 0.1), (1, 7, None, 0.1)]
    assert glint.annotated(glint.nan_to_null(series(spark, rows)), ["b03"]).count() == 5
    assert glint.annotated(series(spark, rows).limit(0), ["b03"]).count() == 0


def test_zonal_and_masks(spark):
    assert spark.range(1).select(F.explode(pixels.windows(300, 224)).alias("w")).count() == 2
    p = spark.createDataFrame([("a", 0, 0, 0), ("b", 0, 0, 7)], "tile string, r int, c int, v int")
    assert pixels.mosaic(p).first().v == 7
    box = spark.createDataFrame([(1, 0.0, 0.0, 0.5, 1.0)], "id long, xmin double, ymin double, xmax double, ymax double")
    assert pixels.coverage_fraction(box, 1.0, 0.0, 0.0, ["id"]).first().fraction == pytest.approx(0.5)
    e = spark.createDataFrame([(1, 0, 0.2), (1, 1, float("nan"))], "pid long, epoch int, ndvi double")
    assert pixels.max_over_epochs(e, "pid", "ndvi").first().ndvi == 0.2


def test_scores(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0)], "p double, t double")
    r = evaluate.regression(d, "p", "t").first()
    assert r.mae == 1.0 and r.bias == -1.0 and evaluate.rmse(d, "p", "t").first().rmse == pytest.approx(2**0.5)
    few = spark.createDataFrame([(1.0, True), (2.0, False)], "v double, pv boolean")
    assert evaluate.cohens_d(few, "v", "pv").first().d is None


def test_training_tables(spark):
    labels = spark.range(50).select("id", (60 + F.col("id") / 100).alias("lon"), F.lit(24.5).alias("lat"))
    c = training.chip_centers(labels, "id").cache()
    assert c.where("kind = 'positive'").count() == 50 and 5 < c.where("kind <> 'positive'").count() < 45
    old = spark.createDataFrame([("a", 1), ("b", 2)], "chip_id string, v int")
    new = spark.createDataFrame([("b", 9)], "chip_id string, v int")
    assert sorted(map(tuple, training.merged_index(old, new).collect())) == [("a", 1), ("b", 9)]


def test_growth_is_one_sided(spark):
    now, old = spark.createDataFrame([(1, 5.0)], "k int, v double"), spark.createDataFrame([(2, 3.0)], "k int, v double")
    assert list(map(tuple, density.growth(now, old, ["k"], ["v"]).collect())) == [(1, 5.0, 5.0)]


def test_more_studies(spark):
    t = spark.createDataFrame([(1, 150.0, 2, True), (2, 150.0, 0, False), (3, 90.0, 2, False)], "pid long, area_m2 double, n_consistent int, is_mapped boolean")
    r = {x.bucket: x for x in studies.detection_report(t).collect()}
    assert r[None].n == 3 and r[1].recall == 1.0 and r[1].flagged == 0.0
    s = spark.createDataFrame([("a", 1.0, 1.0)] * 4, "k string, inside double, ring double")
    assert studies.enhancement(s, ["k"]).first().rate is None


def test_sources(spark, tmp_path):
    el = {"elements": [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"generator:source": "solar"}},
        {"type": "way", "id": 2, "geometry": [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 0}], "tags": {"plant:source": "solar"}},
        {"type": "way", "id": 3, "geometry": [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 5}, {"lat": 1, "lon": 1}], "tags": {}},
        {"type": "way", "id": 4, "geometry": [{"lat": 0, "lon": 0}], "tags": {}},
    ]}
    (tmp_path / "osm.json").write_text(json.dumps(el))
    got = {r.osm_id: r for r in tables.osm_elements(spark, str(tmp_path / "osm.json")).collect()}
    assert set(got) == {"osm/node/1", "osm/way/2", "osm/way/3"} and got["osm/way/2"].geometry_kind == "polygon" and got["osm/way/3"].rings[0][0].x == 5.0
    cur = spark.createDataFrame([(1, 500.0)], "osm_id long, area_m2 double")
    oth = spark.createDataFrame([(1, 500.0), (2, 500.0), (1, 10.0)], "osm_id long, area_m2 double")
    assert sorted((r.osm_id, r.placement) for r in tables.labels_of(cur, oth).collect()) == [(1, "rooftop"), (1, "small"), (2, "ground")]
    assert tables.first_available(lambda: None, lambda: cur.limit(0), lambda: oth).count() == 3
    done = spark.createDataFrame([(1,), (2,)], "pid long")
    assert tables.scene_series(spark.createDataFrame([(1, 7)], "pid long, item long"), done).where("item IS NULL").count() == 1


def test_bbox_filter_reaches_the_scan(spark, tmp_path):
    b = spark.range(10).select(F.lit(b"x").alias("geometry"), F.lit(5.0).alias("area_in_meters"), F.lit(0.9).alias("confidence"), F.struct(*[(F.col("id") * 1.0).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")]).alias("bbox"))
    b.write.parquet(str(tmp_path / "b"))
    df = tables.building_points(spark, str(tmp_path / "b"), {"xmin": 2, "ymin": 2, "xmax": 4, "ymax": 4})
    assert df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "bbox.xmin" in plan.split("PushedFilters")[1] and "geometry" not in plan.split("ReadSchema")[1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("fx-pv-000001", 2, 60.0, 24.0, 120.0, 0.5), ("fx-pv-000000", 1, 61.0, 24.0, 80.0, 0.9)], "candidate_id string, rank int, lon double, lat double, area_m2 double, confidence double")
    tasks = [json.loads(r.value) for r in sinks.review_tasks(df).collect()]
    assert [t["features"][0]["properties"]["rank"] for t in tasks] == [1, 2]
    sinks.write_geojson(df, str(tmp_path / "g"), sinks.point(F.col("lon"), F.col("lat")), ["rank"])
    assert spark.read.text(str(tmp_path / "g")).count() == 2
    cells = spark.createDataFrame([("a", 1), ("b", 2)], "cell string, v int")
    sinks.write_partials(cells, str(tmp_path / "p"))
    sinks.write_partials(spark.createDataFrame([("b", 9)], "cell string, v int"), str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).select("cell", "v").collect())) == [("a", 1), ("b", 9)]
    assert sinks.unfinished(cells, cells.where("cell = 'a'")).count() == 1
    sinks.write_metadata(spark, str(tmp_path / "m"), {"x": 1}, cells.agg(F.sum("v").alias("v")))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value) == {"params": {"x": 1}, "totals": {"v": 3}}
    grid = spark.createDataFrame([(0, 0, 60.0, 24.0, 1.5), (1, 0, 60.1, 24.0, 0.0)], "ix int, iy int, lon0 double, lat0 double, det_mwp double")
    doc = json.loads(sinks.atlas_payload(grid, spark.createDataFrame([("a", 1.0), ("b", 2.0)], "region_name string, det_mwp double"), False).first().value)
    assert doc["total"] == 1.5 and [p["region_name"] for p in doc["provinces"]] == ["b", "a"]


def test_available_now_ingest_takes_each_file_once(spark, tmp_path):
    from solargrid.schemas import SCENES

    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    row = lambda k: spark.createDataFrame([(k, k, None, 1.0, 1, *[0.1] * 8)], SCENES)
    for k in (1, 2):
        row(k).write.mode("append").parquet(src)
        ingest.take_up(ingest.scene_files(spark, src), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    targets = spark.createDataFrame([(1,), (3,)], "pid long")
    ledger = ingest.ledger_rows(targets, spark.read.parquet(out))
    assert {r.pid: r.n_scenes for r in ledger.collect()} == {1: 1, 3: 0}
    assert ingest.pending(spark.createDataFrame([(3,), (4,)], "pid long"), ledger).first().pid == 4


def test_chips_stay_in_coverage(spark):
    labels = spark.range(30).select("id", (60 + F.col("id") / 100).alias("lon"), F.lit(24.5).alias("lat"))
    tiles = spark.createDataFrame([("t1", 60.0, 24.4, 60.15, 24.6), ("t2", 60.1, 24.4, 60.3, 24.6)], "file string, xmin double, ymin double, xmax double, ymax double")
    c = api.chips(labels, tiles, "id", ["t2"])
    assert c.where("lon < 60 OR lon > 60.3").count() == 0 and {r.split for r in c.collect()} == {"train", "val"}


def test_samples_and_strata(spark):
    from solargrid.operators import candidates as C

    d = spark.createDataFrame([(1, "rooftop", 50.0), (2, "rooftop", 500.0), (3, "rooftop", 500.0), (4, "ground", 900.0)], "id long, kind string, area_m2 double")
    assert sorted((r.id, r.target) for r in C.largest(d, "kind", 1, 100.0, "id").collect()) == [(2, "rooftop-01"), (4, "ground-01")]
    assert C.random_targets(d, 2, "id").count() == 2
    f = spark.createDataFrame([(1, 150.0, 2, 3), (2, 150.0, 2, 4)], "pid long, area_m2 double, n_consistent int, n_spikes int")
    assert C.best_examples(f).first().pid == 2
    cells = spark.range(100).select((F.col("id") % 10).cast("int").alias("ix"), F.floor(F.col("id") / 10).cast("int").alias("iy"), F.when(F.col("id") < 30, F.col("id") * 100.0).otherwise(0.0).alias("area_m2"))
    s = C.cell_strata(cells, 3, 4, 5)
    assert {r.stratum: r.n for r in s.groupBy("stratum").agg(F.count("*").alias("n")).collect()} == {"dense": 3, "mid": 4, "zero": 5}
    assert s.where("stratum = 'zero' AND iy < 4").count() == 0


def test_pixel_cubes_and_peaks(spark):
    r = spark.createDataFrame([(1, 0, "a", 1.0), (1, 0, "b", 2.0), (1, 1, "a", 3.0)], "item int, r int, band string, v double")
    assert list(map(tuple, pixels.cube(r, ["item", "r"], ["a", "b"]).collect())) == [(1, 0, 1.0, 2.0)]
    px = spark.range(100).select(F.lit(0).alias("ix"), F.lit(0).alias("iy"), F.floor(F.col("id") / 10).cast("int").alias("r"), (F.col("id") % 10).cast("int").alias("c"))
    t = spark.createDataFrame([(1, 0, 0, 3.5, 3.5, 4.5, 4.5), (2, 0, 0, 50.0, 50.0, 51.0, 51.0)], "pid long, ix int, iy int, x1 double, y1 double, x2 double, y2 double")
    got = pixels.around(t, px, "pid", 2)
    assert {x.pid for x in got.collect()} == {1} and got.where("truth").count() == 4
    peak = pixels.peak_offset(px.withColumn("pid", F.lit(1)).withColumn("v", F.col("r") * 1.0), spark.createDataFrame([(1, 9.0, 0.0)], "pid int, r0 double, c0 double"), "pid", "v").first()
    assert (peak.r, peak.c, peak.offset_m) == (9, 0, 0.0)


def test_missed_targets_and_controls(spark):
    m = squares(spark, [(1, 60.0, 24.0, 6000.0), (2, 60.0, 24.0, 300.0), (3, 60.0, 24.0, 300.0)], "osm_id")
    b = squares(spark, [(7, 60.0, 24.0, 300.0), (8, 60.0, 24.0, 10.0)], "id")
    got = training.missed_and_controls(m, b, m.where("osm_id = 3").select("osm_id"), b.limit(0).select("id"), 5)
    assert sorted((r.key, r.role) for r in got.collect()) == [(1, "missed"), (2, "missed"), (7, "control")]


def test_boundary_by_folded_name(spark):
    a = spark.createDataFrame([("Málaga",), ("Other",)], "name string")
    assert tables.boundary(None, None, a, "malaga").first().name == "Málaga" and tables.boundary(None, None, a, "none") is None


def test_relation_pieces_are_stitched_into_rings(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    line = lambda *p: [{"x": x, "y": y} for x, y in p]
    pieces = [line(square[0], square[1]), line(square[3], square[2], square[1]), line(square[3], square[0]), line((5.0, 5.0), (6.0, 6.0))]
    d = spark.createDataFrame([(pieces,), (None,)], "p array<array<struct<x:double,y:double>>>")
    got = [r[0] for r in d.select(tables.stitched(F.col("p"))).collect()]
    assert len(got[0]) == 1 and {(q.x, q.y) for q in got[0][0]} == set(square) and got[0][0][0] == got[0][0][-1] and got[1] == []


def test_geojson_kinds_and_review_files(spark, tmp_path):
    texts = [('{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}',), ('{"type":"Point","coordinates":[1,2]}',), (None,)]
    d = spark.createDataFrame(texts, "g string").select(tables.geojson_rings(F.col("g")).alias("r")).collect()
    assert [len(d[0].r), d[1].r, d[2].r] == [2, None, None] and d[0].r[1][1].x == 6
    (tmp_path / "r.csv").write_text("sample_uid,bin_label,verdict\n1,<100,yes\n2,>50k,\n")
    (tmp_path / "r.geojson").write_text('{"features":[{"properties":{"bin_label":"<100","verdict":"no"}}]}')
    assert [tuple(r) for r in tables.reviews(spark, str(tmp_path / "r.csv")).collect()] == [("<100", "yes"), (">50k", None)]
    assert [tuple(r) for r in tables.reviews(spark, str(tmp_path / "r.geojson")).collect()] == [("<100", "no")]


def test_tile_labels_by_brute_force(spark):
    """Winding components, corners apart or joined, against a flood fill."""
    import random

    dice = random.Random(2)
    for eight in (False, True):
        cells = {(r, c) for r in range(24) for c in range(24) if dice.random() < 0.55} | {(30, c) for c in range(40)}
        left, want = set(cells), {}
        while left:
            todo, part = [left.pop()], set()
            while todo:
                r, c = todo.pop()
                part.add((r, c))
                near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if eight or not (i and j)} & left
                left -= near
                todo += near
            want |= {p: min(100 * r + c for r, c in part) for p in part}
        mask = spark.createDataFrame([(100 * r + c, 0, 0, r, c) for r, c in cells], "id long, ix int, iy int, r int, c int")
        assert {r.id: r.label for r in pixels.local_labels(mask, eight).collect()} == {100 * r + c: k for (r, c), k in want.items()}


def test_sun_angles_agree_with_a_scene(spark):
    s = spark.sql("SELECT 52.0D AS lat, 13.0D AS lon, TIMESTAMP'2024-06-21 11:09:00' AS time, 28.6D AS sun_zen, 180.0D AS sun_az")
    r = studies.sun_check(s).first()
    assert r.max_zen < 0.5 and r.max_az < 2 and r.med_zen == r.p95_zen


def test_windows_end_where_they_are_asked_to():
    assert business.annual_window("2024-03-01") == "2023-03-02:2024-03-01"


def test_overlap_of_tilted_polygons(spark):
    """A diamond over a square: a quarter of it in each corner is outside."""
    ring = lambda *p: [[{"x": x, "y": y} for x, y in p]]
    diamond, square = ring((10.0, 49.0), (11.0, 50.0), (10.0, 51.0), (9.0, 50.0), (10.0, 49.0)), ring((9.5, 49.5), (10.5, 49.5), (10.5, 50.5), (9.5, 50.5), (9.5, 49.5))
    a, b = spark.createDataFrame([(1, diamond)], "a long, rings array<array<struct<x:double,y:double>>>"), spark.createDataFrame([(7, square)], "b long, rings array<array<struct<x:double,y:double>>>")
    assert spatial.polygon_overlaps(a, b, "a", "b").first().shared == pytest.approx(1.0)
    p = spark.createDataFrame([(1, 10.0, 50.0), (2, 9.2, 49.2), (3, 9.5, 50.4)], "k long, lon double, lat double")
    assert {r.k for r in spatial.in_polygons(p, a, "k", "a").collect()} == {1, 3}
    assert spatial.first_polygon(p, a, "k", "a").where("a IS NULL").count() == 1


def test_beta_quantiles_are_those_of_the_density(spark):
    import numpy as np

    from solargrid.operators import calibration as K

    rows = [(0, 0, 1), (1, 5, 5), (2, 3, 80), (3, 0, 400), (4, 400_000, 1_000_000), (5, 999_999, 1_000_000)]
    got = {}
    for r in K.beta_quantiles(spark.createDataFrame(rows, "bin int, k long, n long"), ["bin"], 100).collect():
        got.setdefault(r.bin, {})[r.level] = r.value
    for bin_no, k, n in rows:
        a, b = k + 0.5, n - k + 0.5
        middle, reach = np.arcsin(np.sqrt(a / (n + 1))), 8 / np.sqrt(n + 1)
        edge = np.linspace(max(middle - reach, 0), min(middle + reach, np.pi / 2), 2_000_001)
        t = (edge[1:] + edge[:-1]) / 2
        d = 2 * k * np.log(np.sin(t)) + 2 * (n - k) * np.log(np.cos(t))
        cdf = np.concatenate(([0], np.cumsum(np.exp(d - d.max()))))
        want = np.sin(np.interp((np.arange(100) + 0.5) / 100, cdf / cdf[-1], edge)) ** 2
        assert sorted(got[bin_no]) == list(range(100))
        assert np.abs(np.array([got[bin_no][j] for j in range(100)]) - want).max() < 2e-4 * np.sqrt(a * b / (n + 1) ** 2 / (n + 2)) + 1e-12


def test_draws_are_the_quantiles_in_orders_of_their_own(spark):
    import numpy as np

    from solargrid.operators import calibration as K

    counts = spark.createDataFrame([(0, "p", 8, 20, 1.0), (1, "p", 8, 20, 1.0), (0, "recall", 8, 20, 1.0), (2, "p", 0, 0, 0.25)], "bin int, rate string, k long, n long, fixed double")
    d = {}
    for r in K.jeffreys_draws(counts, 400).orderBy("bin", "rate", "draw").collect():
        d.setdefault((r.bin, r.rate), []).append(r.value)
    assert {len(v) for v in d.values()} == {400} and set(d[2, "p"]) == {0.25}
    a, b, c = d[0, "p"], d[1, "p"], d[0, "recall"]
    assert sorted(a) == pytest.approx(sorted(b)) and sorted(a) == pytest.approx(sorted(c)) and np.mean(a) == pytest.approx(8.5 / 21, abs=1e-3)
    assert all(abs(np.corrcoef(x, y)[0, 1]) < 0.2 for x, y in ((a, b), (a, c), (b, c)))
