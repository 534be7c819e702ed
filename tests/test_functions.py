"""Column functions on hand-worked values, edges, nulls and NaN."""

import math

import pytest
from pyspark.sql import functions as F

from solargrid.functions import business as B
from solargrid.functions import geometry as G, shapes
from solargrid.functions import solar


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def ring(*points):
    return F.array(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points]))


SQUARE = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))


@pytest.mark.parametrize(("area", "left", "right"), [(99.9, 0, 0), (100.0, 1, 0), (500.0, 2, 1), (1000.0, 3, 2), (5000.0, 4, 3), (50_000.0, 5, 4), (50_000.1, 5, 5)])
def test_size_bins_at_their_edges(spark, area, left, right):
    assert tuple(one(spark, B.size_bin(F.lit(area)), B.size_bin(F.lit(area), True))) == (left, right)


def test_unknown_is_never_evidence(spark):
    assert one(spark, B.within_distance(F.lit(-1.0), 50))[0] is True
    assert one(spark, B.within_distance(F.lit(51.0), 50))[0] is False
    assert one(spark, B.within_distance(F.lit(51.0), 0))[0] is True
    assert one(spark, B.veto({"a": F.lit(None).cast("boolean"), "b": F.lit(True)}))[0] == "b"
    assert one(spark, B.recall_floor(F.lit(None).cast("double")), B.recall_floor(F.lit(0.01)))[:2] == (1.0, 0.05)


def test_prior_and_score(spark):
    far, near, roof = (B.building_prior(F.lit(f), F.lit(d)) for f, d in ((0.0, -1.0), (0.0, 0.0), (0.6, 0.0)))
    assert tuple(one(spark, far, near, roof)) == (0.15, 0.5, 1.0)
    assert one(spark, B.rank_score(F.lit(0.8), F.lit(1.0)))[0] == 0.8
    assert tuple(one(spark, B.glint_boost(F.lit(1), F.lit(3.0)), B.glint_boost(F.lit(4), F.lit(3.0)), B.glint_boost(F.lit(4), F.lit(0.2)))) == (1.0, 3.0, 1.0)


def test_p_real_rises_only_with_two_consistent_spikes(spark):
    a, b = one(spark, B.p_real(F.lit(0.5), F.lit(1), F.lit(3.0)), B.p_real(F.lit(0.5), F.lit(2), F.lit(3.0)))
    assert a == 0.5 and b == pytest.approx(0.75)


def test_verdicts(spark):
    assert tuple(one(spark, *[B.verdict(F.lit(x)) for x in (" Yes ", "nopv", "", "NaN")], B.verdict(F.lit(None).cast("string")))) == (True, False, None, None, None)
    with pytest.raises(Exception, match="unknown verdict"):
        one(spark, B.verdict(F.lit("perhaps")))


def test_rates(spark):
    lo, hi, none = one(spark, *B.wilson(F.lit(5), F.lit(10)), B.wilson(F.lit(0), F.lit(0))[0])
    assert lo == pytest.approx(0.2366, abs=1e-4) and hi == pytest.approx(0.7634, abs=1e-4) and none is None
    assert tuple(one(spark, B.rate_inversion(F.lit(0.5), F.lit(0.1), F.lit(0.9)), B.rate_inversion(F.lit(0.5), F.lit(0.1), F.lit(0.1)))) == (0.5, None)


def test_angles(spark):
    tilt, az = one(spark, *solar.required_orientation(30.0, 180.0, 30.0, 180.0))
    assert tilt == pytest.approx(30) and az == pytest.approx(180)
    off = solar.misalignment(30.0, 180.0, solar.unit_enu(30.0, 180.0), solar.unit_enu(30.0, 180.0))
    assert one(spark, off)[0] == pytest.approx(0, abs=1e-5)
    assert tuple(one(spark, solar.circular_difference(350.0, 10.0), solar.circular_difference(10.0, 350.0))) == (-20.0, 20.0)
    assert tuple(one(spark, solar.reflectance(500.0), solar.reflectance(6000.0))) == (0.0, 0.5)
    assert one(spark, solar.scene_ndvi(0.0, 0.0))[0] is None


def test_sun_at_equinox_noon(spark):
    zen, az = one(spark, *solar.sun_position(F.lit(45.0), F.lit(0.0), F.to_timestamp(F.lit("2024-03-20 12:07:00"))))
    assert zen == pytest.approx(45, abs=0.5) and az == pytest.approx(180, abs=1)


def test_areas_and_centroids(spark):
    area, (cx, cy) = G.geodesic_area_m2(ring(*SQUARE)), G.centroid(ring(*SQUARE))
    a, x, y, none = one(spark, area, cx, cy, G.geodesic_area_m2(F.lit(None).cast("array<array<struct<x:double,y:double>>>")))
    assert a == pytest.approx(12_308_778_361, rel=1e-4) and x == pytest.approx(0.5) and y == pytest.approx(0.5) and none == 0


def test_points_in_polygons(spark):
    concave = ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0))
    inside = [G.contains_xy(concave, F.lit(x), F.lit(y)) for x, y in ((1.0, 1.0), (2.0, 3.0), (5.0, 1.0))]
    assert tuple(one(spark, *inside)) == (True, False, False)
    x, y = one(spark, *G.representative_point(concave))
    assert one(spark, G.contains_xy(concave, F.lit(x), F.lit(y)))[0]


def test_projection_round_trip(spark):
    lon, lat = F.lit(67.0), F.lit(24.86)
    code = G.utm_code(lon, lat)
    e, n = G.to_utm(lon, lat, code)
    back = G.from_utm(e, n, code)
    c, east, north, x, y = one(spark, code, e, n, *back)
    assert c == 32642 and 290_000 < east < 310_000 and 2_740_000 < north < 2_760_000
    assert x == pytest.approx(67.0, abs=1e-8) and y == pytest.approx(24.86, abs=1e-8)  # a millimetre


def test_kernels(spark):
    tall = ring((0, 0), (1, 0), (1, 3), (0, 3), (0, 0))
    shifted = ring((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5))
    a, b = one(spark, shapes.intersection_area(tall, shifted), G.long_axis_bearing(tall))
    assert a == pytest.approx(0.5) and b % 180 == pytest.approx(0, abs=1e-6)
    s = one(spark, G.simplified(ring((0, 0), (0.5, 0.001), (1, 0), (1, 1), (0, 0))))[0]
    assert len(s) == 4


def test_grid(spark):
    assert tuple(one(spark, G.cell(F.lit(60.35), 60.0), G.cell_key(F.lit(3), F.lit(12)), G.snapped_origin(F.lit(60.07), F.lit(0.02)))) == (3, "0003_0012", pytest.approx(60.02))
    assert len(one(spark, G.chip_id(F.lit(1.0), F.lit(2.0)))[0]) == 12
    assert one(spark, G.south_gap(F.lit(90.0)), G.south_gap(F.lit(0.0)))[:2] == (0.0, 90.0)
    assert one(spark, G.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))[0] == pytest.approx(math.pi * 6_371_008.8 / 180)


def test_folded_names(spark):
    assert one(spark, B.folded(F.lit("Málaga")) == B.folded(F.lit("MALAGA")))[0]
