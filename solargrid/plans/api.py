"""The engine's entry points: each is a chain of operators from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.functions import business as B
from solargrid.functions import geometry as G
from solargrid.operators import calibration, candidates, density, evaluate, glint, outlines, pixels, spatial, studies, training
from solargrid.operators.components import cut_lineage
from solargrid.sources import tables


def build_labels(features: DataFrame, buildings: DataFrame, regions: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Solar features with placement (from tags, else from roofs) and the first region they fall in or, as polygons, touch."""
    placed = candidates.label_placement(features, buildings, least_share)
    return spatial.attach_region(placed.withColumnRenamed("osm_id", "id"), regions, how="left").withColumnRenamed("id", "osm_id")


def labels_from_osm_json(elements: DataFrame, buildings: DataFrame) -> DataFrame:
    """Labels from saved OSM elements (see tables.osm_elements): areas, centroids, placement."""
    e = tables.solar_from_tag_map(elements.withColumnRenamed("tags", "source_tags").withColumn("subtype", F.lit("power")).withColumn("class", F.lit("generator")))
    lon, lat = G.centroid(F.col("rings"))
    rows = e.where("geometry_kind = 'polygon'").select("osm_id", lon.alias("lon"), lat.alias("lat"), G.geodesic_area_m2(F.col("rings")).alias("area_m2"), "kind", F.lit("unknown").alias("placement"))
    return candidates.label_placement(rows, buildings)


def chips(labels: DataFrame, tiles: DataFrame, key: str, val_tiles: list[str], seed: int = 0) -> DataFrame:
    """Chip centres inside the coverage with their tile and split."""
    c = training.chip_centers(labels, key, seed)
    return training.split(spatial.one_tile(c, tiles, "chip_id").withColumn("n", F.crc32(F.col("chip_id").cast("binary"))), "file", val_tiles, "n")


def compose(buildings: DataFrame, labels: DataFrame, least: int, grid: density.Grid) -> DataFrame:
    """Cells to composite, in order of priority."""
    return density.priority(density.select_cells(density.cell_histogram(buildings, grid), labels, least, grid))


def score(predicted: DataFrame, threshold: float) -> DataFrame:
    return evaluate.confusion(predicted, threshold)


def polygonise(likely: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments of likely pixels (id, tile, r, c, prob): each tile is outlined by itself, then those that touch are dissolved.

    The first table has component, n_px and confidence (the largest of its fragments), the second the rings of each component.
    """
    whole = cut_lineage(pixels.labelled(likely))
    own = pixels.local_labels(likely).withColumnRenamed("label", "fragment")
    parts = cut_lineage(whole.join(own, "id"))
    fragments = parts.groupBy("component", "fragment").agg(F.count("*").alias("n_px"), F.max("prob").alias("confidence"))
    rings = outlines.strung(outlines.pixel_pieces(parts.withColumn("component", F.col("fragment")), alone=True))
    shaped = outlines.polygons(rings, "fragment").join(fragments.select("fragment", F.col("component").alias("key")), "fragment")
    found = fragments.groupBy("component").agg(F.sum("n_px").alias("n_px"), F.max("confidence").alias("confidence"))
    return found, outlines.dissolved(shaped, size=8.0)


def postprocess(found: DataFrame, buildings: DataFrame, least_m2: float = 50.0, most_distance: float = 0.0) -> DataFrame:
    """Candidates (cand_id, lon, lat, area_m2, confidence) placed, ranked and filtered."""
    c = candidates.place_on_buildings(found.where(F.col("area_m2") >= least_m2), buildings)
    return candidates.ranked(c).where(B.within_distance(F.col("building_dist_m"), most_distance))


def export_leads(ranked: DataFrame, mapped: DataFrame, prefix: str, distance_m: float = 0.0) -> DataFrame:
    """New leads with rank, candidate id and note."""
    leads = candidates.with_rank(ranked, F.coalesce("rank_score", "confidence"), prefix).join(spatial.matched(ranked, mapped, "cand_id", distance_m), "cand_id", "left_anti")
    known = "epoch_checked" in leads.columns
    return leads.withColumn("note", B.epoch_note(F.col("epoch_checked"), F.col("epoch_prior")) if known else F.lit("")).withColumn("link", B.map_link(F.col("lat"), F.col("lon")))


def hard_negatives(buildings: DataFrame, mapped: DataFrame, now: DataFrame, before: DataFrame, reach_m: float = 75.0) -> DataFrame:
    """Large buildings away from mapped features, judged by two epochs."""
    b = buildings.withColumnRenamed("id", "cand_id")
    free = b.join(spatial.matched(b, mapped, "cand_id", reach_m), "cand_id", "left_anti").withColumnRenamed("cand_id", "id")
    return free.join(training.hard_negatives(now, before, "id"), "id")


def hard_negative_index(old: DataFrame, new: DataFrame) -> DataFrame:
    return training.merged_index(old, new)


def calibrate_candidates(cands: DataFrame, mapped: DataFrame, reviews: DataFrame, bins: DataFrame, recall_m: float = 50.0) -> DataFrame:
    recall = spatial.recall_matches(mapped, cands, recall_m).groupBy(B.size_bin(F.col("area_m2")).alias("bin")).agg(F.count("*").alias("recall_n"), F.count_if("is_matched").alias("recall_k"))
    return calibration.bin_table(cands, spatial.matched(cands, mapped, "cand_id", 0.0), reviews, recall, bins)


def calibrate_sample(cands: DataFrame, mapped: DataFrame, per_bin: int, seed: int = 0) -> DataFrame:
    """A review sample of unmapped candidates by size class, with blank verdicts."""
    new = spatial.new_leads(cands, mapped)
    s = candidates.stratified(new, B.size_bin(F.col("area_m2")), per_bin, "cand_id", seed)
    return s.select(F.concat_ws("-", B.bin_label(F.col("stratum")), "pick").alias("sample_uid"), B.bin_label(F.col("stratum")).alias("bin_label"), F.round("area_m2", 1).alias("area_m2"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.lit("").alias("verdict"), "pool")


def run_density(cands: DataFrame, buildings: DataFrame, pixel_cells: DataFrame, table: DataFrame, regions: DataFrame, grid: density.Grid) -> tuple[DataFrame, DataFrame]:
    """Cells and regions with detected, calibrated, expected and recall-corrected area and capacity."""
    c = calibration.candidate_p_real(cands, table)
    cells = density.cell_summary(buildings, density.detected_on_buildings(c, buildings), c, pixel_cells, grid)
    rc = calibration.recall_corrected(density.with_cell(c, grid), ["ix", "iy"])
    cells = cells.join(rc, ["ix", "iy"], "left").fillna(0.0, ["rc_m2", "rc_roof_m2"])
    measures = ["n_buildings", "roof_area_m2", "n_pv", "det_roof_m2", "cal_roof_m2", "det_total_m2", "cal_total_m2", "exp_m2", "rc_m2", "rc_roof_m2"]
    rolled = density.region_rollup(cells, regions, measures, grid)
    more = {"det_mwp": density.mwp(F.col("det_total_m2")), "cal_mwp": density.mwp(F.col("cal_total_m2")), "exp_mwp": density.mwp(F.col("exp_m2")), "pv_ratio": density.ratio(F.col("det_roof_m2"), F.col("roof_area_m2"))}
    return cells.withColumns(more), rolled.withColumns(more)


def density_intervals(cands: DataFrame, draws: DataFrame, grid: density.Grid) -> DataFrame:
    """90 % intervals of calibrated area by cell, from draws that all cells share."""
    return density.intervals(density.draw_sums(density.with_cell(cands, grid), draws, ["ix", "iy"]), ["ix", "iy"])


def register(units: DataFrame, cutoff: str) -> DataFrame:
    return calibration.register_by_area(units, cutoff)


def glint_test(series: DataFrame, bands: list[str]) -> DataFrame:
    """Best scene of each minute, spikes, and the orientation that explains them."""
    return glint.fit_summary(glint.annotated(glint.to_reflectance(glint.best_per(glint.nan_to_null(series), "minute"), bands), bands))


def glint_study(series: DataFrame, targets: DataFrame, bands: list[str]) -> DataFrame:
    return studies.by_size(glint_test(series, bands).join(targets, "pid"))


def infer(predictions: DataFrame, size: int) -> DataFrame:
    return pixels.blended(predictions, size)


def evaluate_run(predicted: DataFrame, threshold: float, installations: DataFrame, hits: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Pixel confusion, and the recall of installations by size. hits: installations that some predicted pixel touches."""
    return evaluate.confusion(predicted, threshold), evaluate.recall_by_size(installations, hits, key)


def calibrate(zones: DataFrame, labels_by_area: DataFrame, units: DataFrame, areas: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Completeness of every municipality, and how the expected areas (zones: ags, exp_m2) fit the register where it is well mapped."""
    r = calibration.register_by_area(units, cutoff)
    full = calibration.completeness(labels_by_area, r, areas=areas)
    fit = zones.join(r, "ags").join(full.select("ags", "well_mapped"), "ags")
    return full, calibration.fit_stats(fit, "exp_m2", "kw_roof", "well_mapped")


def pv_yield(regions: DataFrame, yields: DataFrame) -> DataFrame:
    return density.yearly_yield(regions, yields)


def atlas(cells: DataFrame, regions: DataFrame, calibrated: bool = True) -> DataFrame:
    """The one-row payload of a map."""
    from solargrid.sources import sinks

    return sinks.atlas_payload(cells, regions, calibrated)
