"""Rasters as pixel tables (tile key, r, c, value): zonal statistics, components, composites and blends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solargrid.functions import business as B
from solargrid.functions import shapes
from solargrid.operators.components import components

TILE = ["ix", "iy"]
PIXEL_M2 = 100.0
SIDE = 64


def footprints_to_pixels(df: DataFrame, pixel_deg: float, x0: float, y0: float, keep: list[str]) -> DataFrame:
    """A row for each pixel whose centre lies in a row's box (xmin.. columns): tile, r, c.

    Pixels are numbered over the whole grid, so a box may cross tiles; rows are spans first and pixels last.
    """
    first = lambda a, o: F.ceil((F.col(f"{a}min") - o) / pixel_deg - 0.5)
    last = lambda a, o: F.ceil((F.col(f"{a}max") - o) / pixel_deg - 0.5) - 1
    d = df.select(*keep, first("x", x0).alias("x1"), last("x", x0).alias("x2"), first("y", y0).alias("y1"), last("y", y0).alias("y2")).where("x1 <= x2 AND y1 <= y2")
    d = d.withColumn("py", F.explode(F.sequence("y1", "y2"))).withColumn("px", F.explode(F.sequence("x1", "x2")))
    return d.select(*keep, F.floor(F.col("px") / SIDE).cast("int").alias("ix"), F.floor(F.col("py") / SIDE).cast("int").alias("iy"), F.pmod("py", F.lit(SIDE)).cast("int").alias("r"), F.pmod("px", F.lit(SIDE)).cast("int").alias("c"))


def polygon_spans(df: DataFrame, pixel_deg: float, x0: float, y0: float, keep: list[str]) -> DataFrame:
    """keep, py, x1 and x2: for each row of pixels of the whole grid the stretches whose centres lie in a polygon (rings).

    Scan lines, without a shuffle; a polygon of any size gives as many rows as it has stretches, not pixels.
    """
    schema = df.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    names = [*keep, "py", "x1", "x2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, line, first, last in shapes.spans(shapes.Edges(b.column(len(keep))), pixel_deg, x0, y0):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(len(keep))], pa.array(line), pa.array(first), pa.array(last)], names)

    return df.select(*keep, "rings").mapInArrow(run, f"{fields}, py long, x1 long, x2 long")


def polygons_to_pixels(df: DataFrame, pixel_deg: float, x0: float, y0: float, keep: list[str]) -> DataFrame:
    """A row for each pixel whose centre lies in a row's polygon: tile, r, c, like footprints_to_pixels for boxes."""
    d = polygon_spans(df, pixel_deg, x0, y0, keep).withColumn("px", F.explode(F.sequence("x1", "x2")))
    return d.select(*keep, F.floor(F.col("px") / SIDE).cast("int").alias("ix"), F.floor(F.col("py") / SIDE).cast("int").alias("iy"), F.pmod("py", F.lit(SIDE)).cast("int").alias("r"), F.pmod("px", F.lit(SIDE)).cast("int").alias("c"))


def pixels_in_polygons(pixels: DataFrame, polygons: DataFrame, key: str, pixel_deg: float, x0: float, y0: float) -> DataFrame:
    """Pixels (tile, r, c and more) with the key of each polygon that holds their centre: stretches meet the pixels of their row of a tile."""
    s = polygon_spans(polygons, pixel_deg, x0, y0, [key])
    tile = lambda c: F.floor(F.col(c) / SIDE)
    s = s.withColumn("ix", F.explode(F.sequence(tile("x1").cast("int"), tile("x2").cast("int"))))
    s = s.select(F.col(key), "ix", tile("py").cast("int").alias("iy"), F.pmod("py", F.lit(SIDE)).cast("int").alias("r"), (F.col("x1") - F.col("ix") * SIDE).alias("c1"), (F.col("x2") - F.col("ix") * SIDE).alias("c2"))
    return pixels.join(s, [*TILE, "r"]).where((F.col("c") >= F.col("c1")) & (F.col("c") <= F.col("c2"))).drop("c1", "c2")


def polygon_zonal(pixels: DataFrame, polygons: DataFrame, key: str, pixel_deg: float, x0: float, y0: float, by_order: str | None = None, least: float = 0.05) -> DataFrame:
    """exp_m2, n_px and max_prob of every polygon, 0 and null where it holds no pixel. With by_order as in zonal: later ones overwrite."""
    hits = pixels_in_polygons(pixels, polygons.select(F.struct(*([by_order] if by_order else []), key).alias("s_key"), "rings"), "s_key", pixel_deg, x0, y0)
    if by_order:
        hits = hits.groupBy(*TILE, "r", "c").agg(F.max("s_key").alias("s_key"), F.first("prob").alias("prob"))
    own = hits.groupBy(F.col(f"s_key.{key}").alias(key)).agg((F.sum(B.floor_noise(F.col("prob"), least)) * PIXEL_M2).alias("exp_m2"), F.count("*").alias("n_px"), F.max("prob").alias("max_prob"))
    return polygons.select(key).join(own, key, "left").fillna(0, ["exp_m2", "n_px"])


def zonal(footprints: DataFrame, pixels: DataFrame, key: str, by_order: str | None = None, least: float = 0.05) -> DataFrame:
    """exp_m2 (noise floored), n_px and max_prob of each footprint's pixels.

    With by_order, a pixel belongs to one footprint only: the one with the largest value, as later burns overwrite.
    """
    hits = footprints.join(pixels, [*TILE, "r", "c"])
    if by_order:
        hits = hits.groupBy(*TILE, "r", "c").agg(F.max_by(key, by_order).alias(key), F.first("prob").alias("prob"))
    return hits.groupBy(key).agg((F.sum(B.floor_noise(F.col("prob"), least)) * PIXEL_M2).alias("exp_m2"), F.count("*").alias("n_px"), F.max("prob").alias("max_prob"))


def with_fallback(areas: DataFrame, zones: DataFrame, pixels: DataFrame, key: str, least: float = 0.05) -> DataFrame:
    """Zonal results; rows without a pixel take the probability at their own pixel times their area."""
    none = areas.join(zones, key, "left_anti").join(pixels, [*TILE, "r", "c"], "left")
    p = F.coalesce("prob", F.lit(0.0))
    own = none.select(key, (B.floor_noise(p, least) * F.col("area_m2")).alias("exp_m2"), F.lit(0).cast("long").alias("n_px"), p.alias("max_prob"))
    return zones.select(key, "exp_m2", "n_px", "max_prob").unionByName(own)


def pixel_edges(mask: DataFrame, eight: bool = False) -> DataFrame:
    """Edges (a, b) between neighbouring pixels of a mask (id, tile, r, c), and from each pixel to itself."""
    steps = [(0, 0), (0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    moved = mask.select(F.col("id").alias("a"), *TILE, F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in steps])).alias("to"))
    return moved.select("a", *TILE, "to.r", "to.c").join(mask.select(F.col("id").alias("b"), *TILE, "r", "c"), [*TILE, "r", "c"]).select("a", "b")


def local_labels(mask: DataFrame, eight: bool = False) -> DataFrame:
    """Components within each tile (id, label): the smallest id of a component. A tile is one raster, so a bounded group."""

    def label(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")  # so that a component's smallest place is its smallest id
        ids, r, c = f["id"].to_numpy(), f["r"].to_numpy() - f["r"].min(), f["c"].to_numpy() - f["c"].min()
        place = np.full((r.max() + 2, c.max() + 3), -1)
        place[r, c + 1] = np.arange(len(ids))
        edges = []
        for dr, dc in ((0, 1), (1, 0), *(((1, 1), (1, -1)) if eight else ())):
            to = place[r + dr, c + 1 + dc]
            edges.append(np.stack([np.flatnonzero(to >= 0), to[to >= 0]]))
        a, b = np.concatenate(edges, axis=1)
        up = np.arange(len(ids))
        while True:  # hook the larger root below the smaller one, then shorten all paths
            low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
            if (low == high).all():
                return pd.DataFrame({"id": ids, "label": ids[up]})
            np.minimum.at(up, high, low)
            while (up[up] != up).any():
                up = up[up]

    return mask.groupBy(*TILE).applyInPandas(label, "id long, label long")


def labelled(mask: DataFrame, eight: bool = False) -> DataFrame:
    """id and component of a mask: tiles are labelled by themselves, and labels that touch over a border are joined.

    mask has id, ix, iy, r and c. Only border pixels take part in the iteration.
    """
    own = mask.join(local_labels(mask, eight), "id")
    g = own.select("label", (F.col("ix") * SIDE + F.col("c")).alias("x"), (F.col("iy") * SIDE + F.col("r")).alias("y"), "r", "c")
    edge = g.where((F.col("r") % SIDE).isin(0, SIDE - 1) | (F.col("c") % SIDE).isin(0, SIDE - 1))
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if eight else [])
    to = edge.select(F.col("label").alias("a"), F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])).alias("t")).select("a", "t.x", "t.y")
    touching = to.join(edge.select(F.col("label").alias("b"), "x", "y"), ["x", "y"]).where("a <> b").select("a", "b").distinct()
    joined = components(touching)
    return own.join(joined, F.col("label") == F.col("node"), "left").select(*mask.columns, F.coalesce("component", "label").alias("component"))


def polygonised(pixels: DataFrame, least: float, eight: bool = False) -> DataFrame:
    """Components of prob >= least: pixels, area, confidence (max prob) and box."""
    parts = labelled(pixels.where(F.col("prob") >= least), eight)
    x, y = F.col("ix") * SIDE + F.col("c"), F.col("iy") * SIDE + F.col("r")
    return parts.groupBy("component").agg(F.count("*").alias("n_px"), (F.count("*") * PIXEL_M2).alias("area_m2"), F.max("prob").alias("confidence"), F.min(x).alias("x1"), F.min(y).alias("y1"), F.max(x).alias("x2"), F.max(y).alias("y2"))


def hysteresis(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """Components of the low threshold that hold a pixel of the high one."""
    parts = labelled(pixels.where(F.col("prob") >= low))
    return parts.groupBy("component").agg(F.count("*").alias("n_px"), F.max("prob").alias("peak")).where(F.col("peak") >= high)


def burned(footprints: DataFrame, least_m2: float = 400.0) -> DataFrame:
    """Class mask: 1 for large footprints, -1 (ignored) for small ones; large wins."""
    v = F.when(F.col("area_m2") >= least_m2, 1).otherwise(-1)
    return footprints.groupBy(*TILE, "r", "c").agg(F.max(v).alias("mask"))


def coverage_fraction(boxes: DataFrame, pixel_deg: float, x0: float, y0: float, keep: list[str], parts: int = 10) -> DataFrame:
    """Share of each pixel that boxes or polygons (rings) cover, by the centres of a finer grid."""
    fine = (polygons_to_pixels if "rings" in boxes.columns else footprints_to_pixels)(boxes, pixel_deg / parts, x0, y0, keep)
    gx, gy = F.col("ix") * SIDE + F.col("c"), F.col("iy") * SIDE + F.col("r")
    px, py = F.floor(gx / parts).cast("int"), F.floor(gy / parts).cast("int")
    cells = fine.select(*keep, px.alias("px"), py.alias("py"), F.pmod(gx, F.lit(parts)).alias("sx"), F.pmod(gy, F.lit(parts)).alias("sy"))
    return cells.groupBy("px", "py").agg((F.count_distinct("sx", "sy") / (parts * parts)).alias("fraction"))


def windows(width: int, height: int, size: int = 224, stride: int = 104) -> Column:
    """Origins (x, y) of windows over a raster, the last one moved back to fit."""
    line = lambda n: F.array_union(F.sequence(F.lit(0), F.lit(max(n - size, 0)), F.lit(stride)), F.array(F.lit(max(n - size, 0))))
    return F.flatten(F.transform(line(height), lambda y: F.transform(line(width), lambda x: F.struct(x.alias("x"), y.alias("y")))))


def _lattice(at: str, size: int, stride: int) -> Column:
    """The origins, by multiples of stride, of the windows that hold a place; a row for each."""
    return F.explode(F.sequence((F.floor((F.col(at) - size) / stride) + 1) * stride, F.floor(F.col(at) / stride) * stride, F.lit(stride).cast("long")))


def window_values(pixels: DataFrame, size: int, stride: int, value: str) -> DataFrame:
    """wx, wy and values (by row, then column; 0 where there is no pixel) of the windows of a lattice that hold a pixel.

    Windows lie over tiles' borders, so each pixel goes to the (size / stride) ^ 2 windows that it lies in.
    """
    g = pixels.select((F.col("ix") * SIDE + F.col("c")).cast("long").alias("gx"), (F.col("iy") * SIDE + F.col("r")).cast("long").alias("gy"), F.col(value).cast("double").alias("v"))
    g = g.withColumn("wx", _lattice("gx", size, stride)).withColumn("wy", _lattice("gy", size, stride))
    place = ((F.col("gy") - F.col("wy")) * size + F.col("gx") - F.col("wx")).cast("int")
    held = g.groupBy("wx", "wy").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("k"), "v"))).alias("m"))
    return held.select("wx", "wy", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("values"))


def over_pixels(windows_df: DataFrame, pixels: DataFrame, size: int, stride: int) -> DataFrame:
    """Each pixel with the windows (wx, wy, prob) that it lies in, ready to be blended."""
    g = pixels.select(*TILE, "r", "c", (F.col("ix") * SIDE + F.col("c")).cast("long").alias("gx"), (F.col("iy") * SIDE + F.col("r")).cast("long").alias("gy"))
    g = g.withColumn("wx", _lattice("gx", size, stride)).withColumn("wy", _lattice("gy", size, stride)).join(windows_df.select("wx", "wy", "prob"), ["wx", "wy"])
    return g.select(*TILE, "r", "c", (F.col("gy") - F.col("wy")).alias("wr"), (F.col("gx") - F.col("wx")).alias("wc"), "prob")


def hann(offset: Column, size: int) -> Column:
    return F.greatest(0.5 - 0.5 * F.cos(2 * np.pi * (offset + 0.5) / size), F.lit(1e-3))


def blended(predictions: DataFrame, size: int) -> DataFrame:
    """Overlapping window predictions (r, c, wr, wc, prob) as one raster of 8-bit values."""
    w = hann(F.col("wr"), size) * hann(F.col("wc"), size)
    p = predictions.withColumn("w", w).groupBy(*TILE, "r", "c").agg((F.sum(F.col("prob") * F.col("w")) / F.sum("w")).alias("p"))
    return p.withColumn("v", F.floor(F.col("p") * 255).cast("int"))


def median_composite(scenes: DataFrame, keys: list[str], band: str, most_scenes: int = 12) -> DataFrame:
    """Median of the clear classes over the least cloudy scenes of a key; 0 where nothing is clear, truncated."""
    w = Window.partitionBy(*keys).orderBy("cloud", "item")
    best = scenes.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most_scenes)
    clear = F.when(F.col("scl").isin(4, 5, 6, 7), F.col(band))
    return best.groupBy(*keys).agg(F.coalesce(F.floor(F.median(clear)).cast("int"), F.lit(0)).alias("dn"))


def seasonal(composites: DataFrame, keys: list[str], seasons: list[str]) -> DataFrame:
    """A column for each season, filled from the median of the seasons there are, and 'annual' with that median."""
    p = composites.groupBy(*keys).pivot("season", seasons).agg(F.first(F.when(F.col("dn") > 0, F.col("dn"))))
    year = composites.groupBy(*keys).agg(F.floor(F.median(F.when(F.col("dn") > 0, F.col("dn")))).alias("annual"))
    j = p.join(year, keys)
    return j.select(*keys, *[F.coalesce(s, "annual", F.lit(0)).cast("int").alias(s) for s in seasons], F.coalesce("annual", F.lit(0)).cast("int").alias("annual"))


def mosaic(pixels: DataFrame) -> DataFrame:
    """Per pixel the value of the first tile (by name) that is not 0."""
    return pixels.groupBy("r", "c").agg(F.coalesce(F.min_by(F.when(F.col("v") != 0, F.col("v")), F.when(F.col("v") != 0, F.col("tile"))), F.lit(0)).alias("v"))


def regrid(target: DataFrame, source: DataFrame, scale: float, offset_r: float, offset_c: float) -> DataFrame:
    """Nearest source pixel of each target pixel; 0 is missing."""
    t = target.withColumn("s_r", F.floor(F.col("r") * scale + offset_r).cast("int")).withColumn("s_c", F.floor(F.col("c") * scale + offset_c).cast("int"))
    s = source.select(F.col("r").alias("s_r"), F.col("c").alias("s_c"), F.when(F.col("v") != 0, F.col("v")).alias("v"))
    return t.join(s, ["s_r", "s_c"], "left").drop("s_r", "s_c")


def anomalies(cube: DataFrame, keys: list[str], bands: list[str], sigmas: float = 5.0, least_clear: int = 10) -> DataFrame:
    """Per pixel, how many scenes stand out from its own baseline in every band."""
    base = cube.groupBy(*keys).agg(F.count("*").alias("n"), *[F.median(b).alias(f"m_{b}") for b in bands])
    j = cube.join(base, keys)
    mad = j.groupBy(*keys).agg(*[F.greatest(1.4826 * F.median(F.abs(F.col(b) - F.col(f"m_{b}"))), F.lit(0.015)).alias(f"s_{b}") for b in bands])
    j = j.join(mad, keys)
    out = F.lit(True)
    for b in bands:
        out &= F.col(b) > F.col(f"m_{b}") + sigmas * F.col(f"s_{b}")
    return j.where(F.col("n") >= least_clear).groupBy(*keys, "n").agg(F.count_if(out).alias("events"))


def amplitude(cube: DataFrame, keys: list[str], band: str) -> DataFrame:
    """Largest value over spikes divided by the clipped median over baselines, and the peak scene."""
    return cube.groupBy(*keys).agg((F.max(F.when(F.col("role") == "spike", F.col(band))) / F.greatest(F.median(F.when(F.col("role") == "base", F.col(band))), F.lit(0.02))).alias("amplitude"), F.max_by("item", F.when(F.col("role") == "spike", F.col(band))).alias("peak_item"))


def max_over_epochs(means: DataFrame, key: str, value: str) -> DataFrame:
    """Largest epoch mean; NaN and null are unchecked and never the largest."""
    return means.withColumn(value, F.nanvl(F.col(value), F.lit(None).cast("double"))).groupBy(key, "epoch").agg(F.avg(value).alias("m")).groupBy(key).agg(F.max("m").alias(value))


def inside_and_ring(pixels: DataFrame, keys: list[str], band: str, share: float = 0.98, least_inside: int = 1, least_ring: int = 20) -> DataFrame:
    """Percentile inside a target and median of its ring; null with too few pixels. pixels has zone: inside, ring or null."""
    zone = lambda z: F.when(F.col("zone") == z, F.col(band))
    s = pixels.groupBy(*keys).agg(F.percentile(zone("inside"), F.lit(share)).alias("p"), F.median(zone("ring")).alias("m"), F.count(zone("inside")).alias("npx"), F.count(zone("ring")).alias("nring"))
    ok = (F.col("npx") >= least_inside) & (F.col("nring") >= least_ring)
    return s.select(*keys, F.when(ok, F.col("p")).alias("inside"), F.when(ok, F.col("m")).alias("ring"), "npx")


def scored(windows_df: DataFrame, model_fn, input_col: str, batch: int = 64, shape: list[int] | None = None) -> DataFrame:
    """Probabilities from a user's model: model_fn builds a predictor of arrays (n, *shape) once in each task; shape is that of an array column."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType

    udf = predict_batch_udf(model_fn, return_type=DoubleType(), batch_size=batch, input_tensor_shapes=None if shape is None else [shape])
    return windows_df.withColumn("prob", F.greatest(F.lit(0.0), F.least(F.lit(1.0), udf(input_col))))


def cube(readings: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Scene pixels with a column for each band; a scene and pixel that lacks one is dropped. readings: keys, band, v."""
    wide = readings.groupBy(*keys).pivot("band", bands).agg(F.first("v"))
    return wide.dropna(subset=bands)


def around(targets: DataFrame, pixels: DataFrame, key: str, pad_px: int) -> DataFrame:
    """Pixels of each target's tile within a margin of its box (x1, y1, x2, y2 in pixels), with truth: the box touches it."""
    t = targets.select(key, *TILE, "x1", "y1", "x2", "y2")
    j = pixels.join(t, TILE).where((F.col("c") >= F.floor("x1") - pad_px) & (F.col("c") <= F.floor("x2") + pad_px) & (F.col("r") >= F.floor("y1") - pad_px) & (F.col("r") <= F.floor("y2") + pad_px))
    touch = (F.col("c") + 1 > F.col("x1")) & (F.col("c") < F.col("x2")) & (F.col("r") + 1 > F.col("y1")) & (F.col("r") < F.col("y2"))
    seen = j.withColumn("truth", touch)
    some = seen.where("truth").select(key).distinct()
    return seen.join(some, key, "left_semi").drop("x1", "y1", "x2", "y2")


def peak_offset(spike_pixels: DataFrame, centres: DataFrame, key: str, band: str, pixel_m: float = 10.0) -> DataFrame:
    """Distance of each target's brightest pixel over its spikes from its centre (r0, c0). Ties: the first row, then column."""
    top = spike_pixels.groupBy(key, "r", "c").agg(F.max(band).alias("v")).groupBy(key).agg(F.max_by(F.struct("r", "c"), F.struct("v", -F.col("r"), -F.col("c"))).alias("p"))
    d = F.sqrt(F.pow(F.col("p.r") - F.col("r0"), 2) + F.pow(F.col("p.c") - F.col("c0"), 2)) * pixel_m
    return top.join(centres, key).select(key, F.col("p.r").alias("r"), F.col("p.c").alias("c"), d.alias("offset_m"))


def zonal_mean(footprints: DataFrame, pixels: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """Every area with the mean probability of an earlier epoch in it, whether a pixel was read at all, and the epoch prior."""
    z = footprints.join(pixels, [*TILE, "r", "c"]).groupBy(key).agg(F.avg("prob").alias("old_prob"))
    out = areas.join(z, key, "left").withColumn("epoch_checked", F.col("old_prob").isNotNull())
    return out.withColumn("epoch_prior", F.when(F.col("epoch_checked"), B.epoch_prior(F.col("old_prob"))))


def oriented(anomalous: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Pixels whose bright scenes (time, item, required orientation, angles) agree on one orientation: `least` of them or more."""
    from solargrid.operators.glint import best_orientation

    many = anomalous.groupBy(key).agg(F.count("*").alias("n_events")).where(F.col("n_events") >= least)
    fit = best_orientation(anomalous.join(many.select(key), key, "left_semi"), key).where(F.col("n_consistent") >= least)
    return many.join(fit, key)


def class_masked(pixels: DataFrame, classes: DataFrame, clear: tuple[int, ...] = (4, 5, 6, 7), least: int = 10) -> DataFrame:
    """Readings (tile, r, c, item) under a clear class of the grid of twice the pixel size, of pixels with enough of them."""
    half = classes.select(*TILE, "item", F.col("r").alias("h_r"), F.col("c").alias("h_c"), "scl")
    j = pixels.withColumn("h_r", F.floor(F.col("r") / 2).cast("int")).withColumn("h_c", F.floor(F.col("c") / 2).cast("int")).join(half, [*TILE, "item", "h_r", "h_c"]).where(F.col("scl").isin(*clear)).drop("h_r", "h_c", "scl")
    enough = j.groupBy(*TILE, "r", "c").agg(F.count_distinct("item").alias("n_valid")).where(F.col("n_valid") >= least)
    return j.join(enough, [*TILE, "r", "c"])


def clusters(mask: DataFrame, least: int = 2) -> DataFrame:
    """Components over edges and corners of at least so many pixels: component, n_px."""
    return labelled(mask, eight=True).groupBy("component").agg(F.count("*").alias("n_px")).where(F.col("n_px") >= least)


def pixel_points(pixels: DataFrame, pixel_deg: float, x0: float, y0: float) -> DataFrame:
    """Pixels with the longitude and latitude of their centres."""
    at = lambda o, tile, k: o + (F.col(tile) * SIDE + F.col(k) + 0.5) * pixel_deg
    return pixels.withColumn("lon", at(x0, "ix", "c")).withColumn("lat", at(y0, "iy", "r"))


def max_composite(scenes: DataFrame, keys: list[str], band: str) -> DataFrame:
    """Largest value of a band over scenes and the scene that has it (ties: the smallest item)."""
    return scenes.groupBy(*keys).agg(F.max(band).alias("peak"), F.max_by("item", F.struct(F.col(band), -F.col("item"))).alias("peak_item"))
