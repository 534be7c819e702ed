"""Polygons: kernels against grids of points, outlines against counts of pixels, unions, and joins on odd shapes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from solargrid.functions import shapes
from solargrid.operators import outlines as O
from solargrid.operators import pixels as P
from solargrid.operators import spatial as S
from solargrid.sources import tables

RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
DDL = "array<array<struct<x:double,y:double>>>"


def rings(*parts):
    return [[{"x": float(x), "y": float(y)} for x, y in p] for p in parts]


def box(a, b, c, d):
    return rings([(a, b), (c, b), (c, d), (a, d), (a, b)])


L = rings([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)])
FRAME = rings([(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 8), (8, 8), (8, 2)])


def edges(*polygons):
    return shapes.Edges(pa.array(polygons, RINGS))


def star(r, cx, cy):
    k = int(r.integers(5, 12))
    t, q = (np.arange(k) + r.random(k) * 0.9) / k * 2 * np.pi, r.random(k) * 2 + 0.3
    return list(zip(cx + q * np.cos(t), cy + q * np.sin(t), strict=True))


def inside(p, g):
    c = np.zeros(len(g), int)
    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
        hit = (ay > g[:, 1]) != (by > g[:, 1])
        c += hit & (g[:, 0] < (bx - ax) * (g[:, 1] - ay) / (by - ay) + ax)
    return c % 2 == 1


def test_shares_and_gaps_of_known_shapes():
    backwards = [r[::-1] for r in FRAME]
    a = edges(L, FRAME, FRAME, backwards, box(0, 0, 1, 1), None, FRAME, [])
    b = edges(box(0.5, 0.5, 3, 3), box(3, 3, 7, 7), box(1, 1, 3, 3), box(1, 1, 3, 3), box(5, 4, 6, 7), L, box(0, 0, 1, 1), L)
    assert shapes.shared_areas(a, b).tolist() == pytest.approx([2.25, 0, 3, 3, 0, 0, 1, 0])
    gaps = shapes.gaps(a, b)
    assert gaps[[0, 1, 2, 3, 4, 6]].tolist() == pytest.approx([0, 1, 0, 0, 5, 0]) and np.isinf(gaps[[5, 7]]).all()
    # One inside the other without touching, either way, and touching at a corner only.
    assert shapes.gaps(edges(box(0, 0, 9, 9), box(4, 4, 5, 5), box(0, 0, 1, 1)), edges(box(4, 4, 5, 5), box(0, 0, 9, 9), box(1, 1, 2, 2))).tolist() == [0, 0, 0]


def test_shares_and_gaps_of_random_shapes(monkeypatch):
    r = np.random.default_rng(1)
    ps, qs = [star(r, 0, 0) for _ in range(40)], [star(r, *r.random(2) * 3) for _ in range(40)]
    a, b = edges(*[rings(p) for p in ps]), edges(*[rings(q) for q in qs])
    g = np.stack(np.meshgrid(np.linspace(-2.4, 2.4, 601), np.linspace(-2.4, 2.4, 601)), -1).reshape(-1, 2)
    near = np.array([(inside(p, g) & inside(q, g)).sum() * 0.008**2 for p, q in zip(ps, qs, strict=True)])
    share, gap = shapes.shared_areas(a, b), shapes.gaps(a, b)
    assert share == pytest.approx(near, abs=0.02)
    for p, q, d in zip(ps, qs, gap, strict=True):
        if d > 0:
            dense = lambda c: np.concatenate([np.linspace(c[i - 1], c[i], 200) for i in range(len(c))])
            assert d == pytest.approx(np.sqrt(((dense(p)[:, None] - dense(q)[None]) ** 2).sum(-1)).min(), abs=1e-3)
    monkeypatch.setattr(shapes, "PAIRS", 7)  # many stretches
    assert shapes.shared_areas(a, b) == pytest.approx(share) and shapes.gaps(a, b) == pytest.approx(gap)


def test_scan_lines_are_the_centres_inside(monkeypatch):
    r = np.random.default_rng(2)
    ps = [star(r, *r.random(2) * 5) for _ in range(20)]
    c = np.arange(-40, 120)
    g = np.stack(np.meshgrid(0.37 + (c + 0.5) * 0.1, -0.21 + (c + 0.5) * 0.1), -1).reshape(-1, 2)
    for step in (1 << 22, 5):
        monkeypatch.setattr(shapes, "CROSSINGS", step)
        got = [set() for _ in ps]
        for row, line, first, last in shapes.spans(edges(*[rings(p) for p in ps]), 0.1, 0.37, -0.21):
            for i, y, a, b in zip(row, line, first, last, strict=True):
                got[i] |= {(int(x), int(y)) for x in range(a, b + 1)}
        for p, cells in zip(ps, got, strict=True):
            assert cells == {(int(c[k % len(c)]), int(c[k // len(c)])) for k in np.flatnonzero(inside(p, g))}


def test_measures_agree_with_the_expressions(spark):
    from solargrid.functions import geometry as G

    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rings([(60 + x * 1e-3, 24 + y * 1e-3) for x, y in star(r, 0, 0)])) for i in range(30)] + [(98, None), (99, [])], f"id int, rings {DDL}")
    cx, cy = G.centroid(F.col("rings"))
    m = df.select("id", shapes.measures("rings").alias("m"), G.geodesic_area_m2(F.col("rings")).alias("area"), cx.alias("x"), cy.alias("y"), shapes.contains_point("rings", shapes.measures("rings")["px"], shapes.measures("rings")["py"]).alias("held")).collect()
    for row in m:
        if row.id < 98:
            assert row.m.area_m2 == pytest.approx(row.area, rel=1e-9) and (row.m.cx, row.m.cy) == pytest.approx((row.x, row.y)) and row.held
        else:
            assert row.m.area_m2 is None and row.m.xmin is None and row.held is None


def mask_of(spark, there):
    rows = [(int(y * 1000 + x), int(x // 64), int(y // 64), int(y % 64), int(x % 64), float(0.5 + (x % 7) / 20)) for y, x in zip(*np.nonzero(there), strict=True)]
    return spark.createDataFrame(rows, "id long, ix int, iy int, r int, c int, prob double")


def as_set(df):
    return sorted((r.key, tuple(r.xs), tuple(r.ys), r.area2) for r in df.collect())


def test_outlines_over_tiles_and_their_union(spark):
    from solargrid.plans import api

    there = np.random.default_rng(4).random((80, 140)) < 0.62
    there[60:70, 30:100] = True
    there[62:68, 60:68] = False  # a hole over the corner of four tiles
    mask = mask_of(spark, there)
    parts = P.labelled(mask).cache()
    whole = as_set(O.pixel_rings(parts))
    size, holes, right, up, quad = {}, {}, {}, {}, {}
    name = {(r.ix * 64 + r.c, r.iy * 64 + r.r): r.component for r in parts.collect()}
    for (x, y), k in name.items():
        size[k] = size.get(k, 0) + 1
        right[k] = right.get(k, 0) + ((x + 1, y) in name)
        up[k] = up.get(k, 0) + ((x, y + 1) in name)
        quad[k] = quad.get(k, 0) + ((x + 1, y) in name and (x, y + 1) in name and (x + 1, y + 1) in name)
    area, outer = {}, {}
    for k, _, _, a in whole:
        area[k] = area.get(k, 0) + a / 2
        outer[k] = outer.get(k, 0) + (a > 0)
        holes[k] = holes.get(k, 0) + (a < 0)
    assert area == size and set(outer.values()) == {1}
    assert holes == {k: 1 - (size[k] - right[k] - up[k] + quad[k]) for k in size}
    found, union = api.polygonise(mask)
    assert as_set(union) == whole
    assert {r.component: (r.n_px, r.confidence) for r in found.collect()} == {r.component: (r.n, r.p) for r in parts.groupBy("component").agg(F.count("*").alias("n"), F.max("prob").alias("p")).collect()}
    assert O.pixel_rings(parts.limit(0)).count() == 0


def test_union_of_parts_that_share_pieces_of_edges(spark):
    # Two small boxes beside a large one, a part that is far away, and a frame filled by its core; districts by five digits.
    rows = [("7", 4, box(0, 0, 2, 4)), ("7", 4, box(2, 0, 4, 1)), ("7", 4, box(2, 1, 4, 4)), ("7", 4, box(9, 9, 10, 10)), ("7", 2, box(4, 0, 5, 4)), ("12", 4, FRAME), ("12", 4, [r[::-1] for r in rings([(2, 2), (8, 2), (8, 8), (2, 8)])])]
    df = spark.createDataFrame(rows, f"ags string, GF int, rings {DDL}")
    out = {r.ags: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in tables.municipalities(df, size=1.0).collect()}
    assert out == {"00000007": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(9, 9), (10, 9), (10, 10), (9, 10)]], "00000012": [[(0, 0), (10, 0), (10, 10), (0, 10)]]}
    half = tables.municipalities(None, df.where("GF = 2 OR ags = '12'").drop("GF").limit(2), size=1.0)
    assert {r.ags: len(r.rings) for r in half.collect()} == {"00007": 1, "00012": 2}


def test_joins_of_odd_shapes(spark):
    far = 1 / 111_320  # a metre of latitude
    left = spark.createDataFrame([(1, box(0, 0, 10 * far, 10 * far)), (2, FRAME), (3, None), (4, box(50, 50, 51, 51))], f"cand_id int, rings {DDL}")
    right = spark.createDataFrame([(1, box(0, 25 * far, far, 30 * far)), (2, box(0, 13 * far, far, 14 * far)), (3, box(4, 4, 5, 5)), (4, [])], f"id int, rings {DDL}")
    near = {r.cand_id: (round(r.dist_m, 6), r.near_id) for r in S.nearest(left.where("cand_id <> 2"), right, "cand_id", "id", 20.0).collect()}
    assert near == {1: (3.0, 2)}
    assert {r.cand_id for r in S.within_reach(left, right.where("id = 1"), "cand_id", 15.001).collect()} == {1, 2}
    assert {r.cand_id for r in S.within_reach(left.where("cand_id <> 2"), right.where("id = 1"), "cand_id", 14.999).collect()} == set()
    # Boxes 1 and 2 touch the frame's corner; 3 lies in its hole.
    assert {(r.cand_id, r.id) for r in S.touching(left, right, "cand_id", "id").collect()} == {(2, 1), (2, 2)}
    assert {(r.id, r.cand_id) for r in S.covered(right, left, "id", "cand_id").collect()} == {(1, 2), (2, 2)}
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 50.5, 50.5), (4, None, 1.0)], "id int, lon double, lat double")
    regions = left.select(F.col("cand_id").alias("region_id"), F.concat(F.lit("r"), "cand_id").alias("name"), "rings")
    assert {r.id: r.region_id for r in S.attach_region(points, regions, how="left").collect()} == {1: 2, 2: None, 3: 4, 4: None}
    assert {r.id: r.region_id for r in S.attach_region(points, regions).collect()} == {1: 2, 3: 4}


def test_regions_by_cells_are_the_same_broadcast_or_not(spark):
    r = np.random.default_rng(5)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(r.random((500, 2)) * 3)], "id int, lon double, lat double")
    b = [(k, f"n{k}", float(x), float(y), float(x + w), float(y + h)) for k, (x, y, w, h) in enumerate(r.random((40, 4)) * [2, 2, 0.5, 0.5])]
    regions = spark.createDataFrame(b, "region_id int, name string, xmin double, ymin double, xmax double, ymax double")
    want = {p.id: min((k for k, _, x1, y1, x2, y2 in b if x1 <= p.lon < x2 and y1 <= p.lat < y2), default=None) for p in points.collect()}
    for most in (50_000, 0):
        assert {x.id: x.region_id for x in S.attach_region(points, regions, "left", most_rows=most).collect()} == want


def test_nearest_anywhere_grows_its_reach(spark):
    a = spark.createDataFrame([(1, 60.0, 24.0, 100.0), (2, 60.5, 24.0, 100.0), (3, 70.0, 24.0, 100.0)], "cand_id int, lon double, lat double, area_m2 double")
    b = spark.createDataFrame([(7, 60.001, 24.0, 100.0), (8, 60.45, 24.0, 100.0), (9, 60.55, 24.0, 100.0)], "osm_id int, lon double, lat double, area_m2 double")
    got = {r.cand_id: (r.near_id, r.is_match) for r in S.nearest_feature(a, b, "cand_id", "osm_id").collect()}
    assert got == {1: (7, True), 2: (8, False), 3: (None, False)}


def test_angles_of_the_nearest_node_that_has_some(spark):
    r = np.random.default_rng(6)
    text = lambda row: " ".join("NaN" if r.random() < 0.93 else str(row * 100 + c) for c in range(40))
    lines = spark.createDataFrame([(s, y, f" {text(y)} ") for s in (1, 2) for y in range(30)] + [(3, 0, "NaN x 5")], "scene int, row int, text string").cache()
    nodes = tables.angle_grid(lines, ["scene"])
    known = {(n.scene, n.row, n.col): n.value for n in nodes.collect()}
    assert known[3, 0, 2] == 5 and all(v == y * 100 + c for (s, y, c), v in known.items() if s < 3)
    points = [(i, int(1 + i % 3), float(x), float(y)) for i, (x, y) in enumerate(r.random((90, 2)) * [500, 320] - 20)] + [(99, 4, 1.0, 1.0)]
    got = {p.id: p.value for p in tables.angle_at(spark.createDataFrame(points, "id int, scene int, x_m double, y_m double"), nodes, 10.0).collect()}
    want = {}
    for i, s, x, y in points:
        col, row = max(round(x / 10), 0), max(round(y / 10), 0)
        if own := [((row - a) ** 2 + (col - b) ** 2, a, b) for t, a, b in known if t == s]:
            want[i] = known[(s, *min(own)[1:])]
    assert got == want and len(got) == 90


def test_windows_hold_their_pixels_over_tiles(spark):
    px = spark.createDataFrame([(0, 0, 5, 62, 1.0), (1, 0, 5, 1, 2.0)], "ix int, iy int, r int, c int, prob double")
    w = {(x.wx, x.wy): x["values"] for x in P.window_values(px, 8, 4, "prob").collect()}
    assert set(w) == {(56, 0), (60, 0), (64, 0), (56, 4), (60, 4), (64, 4)}
    assert w[60, 4][1 * 8 + 2] == 1 and w[60, 4][1 * 8 + 5] == 2 and sum(w[60, 4]) == 3 and sum(w[56, 0]) == 1
    scores = spark.createDataFrame([(60, 4, 0.5)], "wx long, wy long, prob double")
    assert {(x.ix, x.c, x.wr, x.wc, x.prob) for x in P.over_pixels(scores, px, 8, 4).collect()} == {(0, 62, 1, 2, 0.5), (1, 1, 1, 5, 0.5)}


def test_main_candidate_among_those_that_hold_the_whole_roof_is_that_of_the_sql(spark, tmp_path):
    import duckdb

    from solargrid.plans import polygons

    # Six candidates around one point each, of three sizes twice, and a roof that most of them hold.
    spark.createDataFrame([(5 * i + 20_000 * k, 1 + (i + k) % 50) for i in range(60) for k in range(6)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(35 * i, 100.7 + 37 * i) for i in range(60)], "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect(config={"threads": 1})
    for t in ("part", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(polygons.ORACLES["detected_polygons"]).fetchall()
    got = polygons.detected_polygons(spark, str(tmp_path)).select("id", "det_m2", "cal_m2", "main_cand").collect()
    assert len(want) == 60 and sorted(map(tuple, got)) == sorted(want)


def test_shares_count_from_a_point_only_where_it_lies_inside(spark):
    point = "lon double, lat double"
    c = spark.createDataFrame([(1, 0.5, 0.5, box(0, 0, 1, 1)), (2, None, 0.5, box(0, 0, 1, 1)), (3, float("nan"), 0.5, box(0, 0, 1, 1)), (4, 0.5, 80.0, box(0, 0, 1, 1))], f"cand_id long, {point}, rings {DDL}")
    b = spark.createDataFrame([(7, box(0.25, 0.25, 0.75, 0.75))], f"id long, rings {DDL}")
    got = {r.l_cand_id: r.shared for r in S.overlaps(c, b).collect()}
    assert got == pytest.approx(dict.fromkeys((1, 2, 3, 4), 0.25 * S.LAT_M**2), rel=1e-3)
