"""Schemas of the tables that stages hand to each other. Optional columns are always there and may be null."""

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _schema(fields: str) -> T.StructType:
    """A schema from 'name type, ...'; needs no session, unlike the DDL parser."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
#: A polygon's rings, the outer one first.
RINGS = T.ArrayType(T.ArrayType(POINT))
BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])
BUILDINGS = _schema("id string, lon double, lat double, area_m2 double, bf_confidence double")
CANDIDATES = _schema(
    "cand_id long, lon double, lat double, area_m2 double, confidence double, placement string, building_id string, building_overlap_frac double, "
    "building_dist_m double, building_prior double, rank_score double, preboom_prob double, epoch_checked boolean, epoch_prior double, "
    "glint_spikes int, glint_consistent int, glint_fit_tilt double, glint_fit_az double, glint_lr double, glint_prior double"
)
SCENES = _schema("pid long, item long, time timestamp, cloud double, npx int, p98_b03 double, p98_b08 double, ring_b03 double, ring_b08 double, sun_zen double, sun_az double, view_zen double, view_az double")
PIXELS = _schema("tile string, row int, col int, v int")
REGISTER = _schema("ags string, art string, kw double, status string, commissioned date, decommissioned date")
LABELS = _schema("osm_id long, lon double, lat double, area_m2 double, placement string")
REGIONS = _schema("region_id int, name string, level string, xmin double, ymin double, xmax double, ymax double")
