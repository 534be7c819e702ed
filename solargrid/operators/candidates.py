"""Candidates: placement by buildings, ranking, and selection for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solargrid.functions import business as B
from solargrid.operators import spatial as S
from solargrid.operators.components import cut_lineage

ROOF_SHARE, BESIDE_M, REACH_M = 0.3, 30.0, 200.0
#: Distinct values whose counts are summed in one window.
RANK_BLOCK = 100_000


def place_on_buildings(candidates: DataFrame, buildings: DataFrame, reach_m: float = REACH_M) -> DataFrame:
    """building_overlap_frac, building_dist_m (-1: none in reach), building_id and placement of every candidate."""
    near = S.nearest(candidates, buildings, "cand_id", "id", reach_m)
    j = candidates.join(near, "cand_id", "left")
    share = F.coalesce(F.when(F.col("dist_m") == 0, F.least(F.col("overlap_m2") / F.col("area_m2"), F.lit(1.0))), F.lit(0.0))
    d = F.coalesce("dist_m", F.lit(-1.0))
    placement = F.when(share >= ROOF_SHARE, "rooftop").when((d >= 0) & (d <= BESIDE_M), "ground_adjacent").otherwise("no_building")
    out = j.withColumn("building_overlap_frac", B.half_even(share, 3)).withColumn("building_dist_m", B.half_even(d, 1)).withColumn("placement", placement)
    return out.withColumn("building_id", F.when(F.col("placement") != "no_building", F.col("near_id"))).drop("dist_m", "near_id", "overlap_m2")


def best_overlap(candidates: DataFrame, buildings: DataFrame, least_m2: float | None = None) -> DataFrame:
    """Fallback placement: the building with the largest intersection (of more than least_m2, if given) decides; ties: the smallest id."""
    own = S.shapes_of(candidates, "cand_id")
    hits = S.overlaps(own, S.foremost(S.shapes_of(buildings, "id")))
    hits = hits if least_m2 is None else hits.where(F.col("shared") > least_m2)
    top = hits.groupBy(F.col("l_s_id").alias("s_id")).agg(F.max(F.struct("shared", (-F.col("r_s_id")).alias("neg"))).alias("t"))
    top = S.by_shape(candidates, own, top, "cand_id")
    j = candidates.join(top, "cand_id", "left")
    share = F.col("t.shared") / F.col("area_m2")
    return j.withColumn("building_id", -F.col("t.neg")).withColumn("placement", F.when(share >= ROOF_SHARE, "rooftop").when(share.isNotNull(), "ground_adjacent").otherwise("no_building")).drop("t")


def label_placement(labels: DataFrame, buildings: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Labels of unknown placement become rooftop if buildings cover half of them, else ground."""
    unknown = labels.where("placement = 'unknown'")
    own, _, hits = S.shape_overlaps(unknown, buildings, "osm_id", "id")
    cover = hits.groupBy(F.col("l_s_id").alias("s_id")).agg(F.sum(F.col("shared") * F.col("r_s_n")).alias("s_m2"))
    cover = S.by_shape(unknown, own, cover, "osm_id", "area_m2").select("osm_id", (F.col("s_m2") / F.col("area_m2")).alias("share"))
    solved = F.when(F.col("placement") != "unknown", F.col("placement")).when(F.col("share") >= least_share, "rooftop").otherwise("ground")
    return labels.join(cover, "osm_id", "left").withColumn("placement", solved).drop("share")


def ranked(candidates: DataFrame) -> DataFrame:
    """building_prior and rank_score, then the epoch and glint factors where their columns are there; rounded at each step."""
    out = candidates.withColumn("building_prior", B.building_prior(F.col("building_overlap_frac"), F.col("building_dist_m")))
    out = out.withColumn("rank_score", B.rank_score(F.col("confidence"), F.col("building_prior")))
    if "epoch_prior" in out.columns:
        out = out.withColumn("rank_score", B.epoch_factor(F.col("rank_score"), F.col("epoch_prior")))
    if "glint_consistent" in out.columns:
        boost = B.glint_boost(F.coalesce("glint_consistent", F.lit(0)), B.likelihood_ratio(B.size_bin(F.col("area_m2"))))
        out = out.withColumn("rank_score", B.half_even(F.col("rank_score") * boost, 4))
    return out


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank: 1, 2, ... in an order of all rows, without a task that sees them all.

    Rows are split into ranges of the order, numbered within each, and moved on by the number of rows in the ranges before.
    """
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("q_part", F.spark_partition_id()))
    w = Window.partitionBy("q_part").orderBy(*order)
    # A row for each partition: so many as the session's setting allows.
    before = parts.groupBy("q_part").count().withColumn("q_before", F.sum("count").over(Window.orderBy("q_part").rowsBetween(Window.unboundedPreceding, -1))).select("q_part", "q_before")
    out = parts.withColumn("q_no", F.row_number().over(w)).join(F.broadcast(before), "q_part")
    return out.withColumn("rank", (F.col("q_no") + F.coalesce("q_before", F.lit(0))).cast("int")).drop("q_part", "q_no", "q_before")


def with_rank(df: DataFrame, score: Column, prefix: str, key: str = "cand_id") -> DataFrame:
    """rank (1 is best; ties by key) and candidate_id."""
    ids = numbered(df.select(key, score.alias("s")), F.desc("s"), F.asc(key))
    return df.join(ids.select(key, "rank"), key).withColumn("candidate_id", F.format_string(f"{prefix}-pv-%06d", F.col("rank") - 1))


def budget(df: DataFrame, skip_top: int, top_n: int, least_ratio: float = 1.2) -> DataFrame:
    """The best top_n of those with a ratio above the limit that are not among the overall best skip_top."""
    able = df.where((F.col("rank") > skip_top) & (B.likelihood_ratio(B.size_bin(F.col("area_m2"))) >= least_ratio))
    return able.orderBy("rank").limit(top_n)


def average_ranks(df: DataFrame, col: str, up: bool = True) -> DataFrame:
    """r_<col> for each distinct value: the mean of the ranks of the rows that share it. Rows are counted by value first."""
    n = numbered(df.groupBy(col).agg(F.count("*").alias("n")), F.asc(col) if up else F.desc(col))
    # Ranges again: rows before a value are those of the ranges before it and of the values before it in its own.
    parts = n.withColumn("q_part", F.floor((F.col("rank") - 1) / RANK_BLOCK))
    before = parts.groupBy("q_part").agg(F.sum("n").alias("q_n")).withColumn("q_before", F.sum("q_n").over(Window.orderBy("q_part").rowsBetween(Window.unboundedPreceding, -1))).select("q_part", "q_before")
    own = F.sum("n").over(Window.partitionBy("q_part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("q_own", own).join(F.broadcast(before), "q_part")
    return out.select(F.col(col).alias(f"k_{col}"), (F.coalesce("q_before", F.lit(0)) + F.col("q_own") - F.col("n") + 1 + (F.col("n") - 1) / 2).alias(f"r_{col}"))


def suspicion(df: DataFrame, key: str = "cand_id") -> DataFrame:
    """Average rank of confidence upwards plus average rank of distance downwards."""
    s = cut_lineage(df.select(key, "confidence", "dist_m"))
    c, d = average_ranks(s, "confidence"), average_ranks(s, "dist_m", False)
    j = s.join(c, s["confidence"].eqNullSafe(c["k_confidence"])).join(d, s["dist_m"].eqNullSafe(d["k_dist_m"]))
    return j.select(key, "confidence", "dist_m", (F.col("r_confidence") + F.col("r_dist_m")).alias("suspicion"))


def hash_order(key: Column, seed: int = 0) -> Column:
    """A fixed shuffle in integer arithmetic that any engine can repeat."""
    return (key * 7919 + seed) % 10007


def stratified(df: DataFrame, stratum: Column, n: int, key: str, seed: int = 0) -> DataFrame:
    """Up to n rows of each stratum in hash order (ties by key), with the size of its pool."""
    out = df.withColumn("stratum", stratum)
    w = Window.partitionBy("stratum").orderBy(hash_order(F.col(key), seed), key)
    pool = out.groupBy("stratum").agg(F.count("*").alias("pool"))
    return out.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n).join(pool, "stratum")


def declutter(df: DataFrame, step_deg: float, key: str) -> DataFrame:
    """The largest row of each rounded cell (half to even; ties: the smallest key)."""
    kx, ky = F.bround(F.col("lon") / step_deg), F.bround(F.col("lat") / step_deg)
    best = df.groupBy(kx.alias("kx"), ky.alias("ky")).agg(F.max_by(F.struct(*df.columns), F.struct("area_m2", -F.col(key))).alias("b"))
    return best.select("b.*")


def veto(df: DataFrame, most_ndvi: float = 0.35, least_epoch: float = 0.5, most_distance: float = 0.0) -> DataFrame:
    """veto: the first reason against a lead, or null; unknown values never veto."""
    reasons = {"vegetation": F.col("max_ndvi") > most_ndvi, "vegetation_annual": F.col("ndvi_p95") > most_ndvi, "old_epoch": F.col("epoch_prior") < least_epoch}
    if most_distance:
        reasons["far_from_building"] = ~B.within_distance(F.col("building_dist_m"), most_distance)
    return df.withColumn("veto", B.veto(reasons))


def largest(df: DataFrame, by: str, n: int, least_m2: float, key: str, most_m2: float | None = None) -> DataFrame:
    """The n largest rows of each kind above a floor (and up to a limit), with ids from kind and position."""
    d = df.where(F.col("area_m2") >= least_m2)
    d = d if most_m2 is None else d.where(F.col("area_m2") <= most_m2)
    w = Window.partitionBy(by).orderBy(F.desc("area_m2"), key)
    return d.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).withColumn("target", F.format_string("%s-%02d", F.col(by), F.col("k"))).drop("k")


def random_targets(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in hash order, without replacement."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def best_examples(fits: DataFrame) -> DataFrame:
    """The most convincing target of each size class."""
    f = fits.withColumn("bucket", B.size_bin(F.col("area_m2"), True))
    return f.groupBy("bucket").agg(F.max_by("pid", F.struct("n_consistent", "n_spikes", -F.col("pid"))).alias("pid"))


def not_yet_scored(ranked_df: DataFrame, done: DataFrame, key: str = "cand_id") -> DataFrame:
    """What a resumed study still has to look at, best rank first."""
    return ranked_df.join(done.select(key).distinct(), key, "left_anti").orderBy("rank")


def cell_strata(cells: DataFrame, dense: int = 15, middle: int = 10, empty: int = 15) -> DataFrame:
    """Cells for a study: the fullest, some of 500 to 3000 m2 in hash order, and empty ones whose 3 x 3 block is empty.

    cells has ix, iy and area_m2, with a row for every cell of the grid.
    """
    key = F.col("ix") * 10_000 + F.col("iy")
    c = cells.withColumn("k", key)
    full = c.where("area_m2 > 0").orderBy(F.desc("area_m2"), "k").limit(dense).withColumn("stratum", F.lit("dense"))
    mid = c.join(full.select("k"), "k", "left_anti").where("area_m2 BETWEEN 500 AND 3000").orderBy(hash_order(F.col("k")), "k").limit(middle).withColumn("stratum", F.lit("mid"))
    near = c.where("area_m2 > 0").select(F.explode(F.array(*[F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("b")).select("b.*").distinct()
    none = c.join(near, ["ix", "iy"], "left_anti").orderBy(hash_order(F.col("k")), "k").limit(empty).withColumn("stratum", F.lit("zero"))
    cols = ["ix", "iy", "area_m2", "stratum"]
    return full.select(cols).unionByName(mid.select(cols)).unionByName(none.select(cols))


def in_band(df: DataFrame, least_m2: float, most_m2: float, confidence: tuple[str, float] | None = None) -> DataFrame:
    """Rows of a size band (edges included) and, if asked for, of a least confidence in a column."""
    d = df.where(F.col("area_m2").between(least_m2, most_m2))
    return d if confidence is None else d.where(F.col(confidence[0]) >= confidence[1])
