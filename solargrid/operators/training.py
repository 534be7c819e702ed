"""Tables for training: chip centres, splits, hard negatives and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solargrid.functions import geometry as G
from solargrid.operators.candidates import hash_order

#: Tasks that the labels of one chip box are dealt over.
SHARES = 16


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)


def chip_centers(labels: DataFrame, key: str, seed: int = 0, jitter_m: float = 900.0) -> DataFrame:
    """Positives near labels, half as many negatives not far off, with chip_id and kind."""
    k = F.col(key)
    shift = lambda n, m: (uniform(k, seed + n) * 2 - 1) * jitter_m / m
    pos = labels.select((F.col("lon") + shift(1, G.lon_metres(F.col("lat")))).alias("lon"), (F.col("lat") + shift(2, 111_320.0)).alias("lat"), F.lit("positive").alias("kind"))
    side = lambda n: F.when(uniform(k, seed + n) < 0.5, -1).otherwise(1)
    neg = labels.where(uniform(k, seed + 3) < 0.5).select((F.col("lon") + side(4) * (0.03 + 0.03 * uniform(k, seed + 5))).alias("lon"), (F.col("lat") + side(6) * (0.02 + 0.02 * uniform(k, seed + 7))).alias("lat"), F.lit("near_negative").alias("kind"))
    return _named_chips(pos.unionByName(neg))


def background_centers(n: int, box: dict[str, float], labels: DataFrame, seed: int = 0) -> DataFrame:
    """n points over a box, by a fixed sequence, as chips of kind background."""
    k = F.col("id")
    p = labels.sparkSession.range(n).select((box["xmin"] + uniform(k, seed + 8) * (box["xmax"] - box["xmin"])).alias("lon"), (box["ymin"] + uniform(k, seed + 9) * (box["ymax"] - box["ymin"])).alias("lat"), F.lit("background").alias("kind"))
    return _named_chips(p)


def _named_chips(both: DataFrame) -> DataFrame:
    return both.withColumn("chip_id", G.chip_id(F.col("lon"), F.col("lat")))


def split(df: DataFrame, tile: str, val_tiles: list[str], key: str, least: int = 8) -> DataFrame:
    """val by tile; if that gives too few rows, a fixed fifth of train."""
    s = df.withColumn("split", F.when(F.col(tile).isin(val_tiles), "val").otherwise("train"))
    if s.where("split = 'val'").limit(least).count() >= least:
        return s
    return s.withColumn("split", F.when((F.col("split") == "val") | (hash_order(F.col(key)) % 5 == 0), "val").otherwise("train"))


def oversampled(parts: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Union of indexes with train rows repeated as often as each asks, val rows once, and their source."""
    out = None
    for name, (df, times) in parts.items():
        n = F.when(F.col("split") == "train", times).otherwise(1)
        d = df.withColumn("copy", F.explode(F.sequence(F.lit(1), n))).withColumn("source", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def merged_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones with the same chip_id."""
    return old.join(new.select("chip_id"), "chip_id", "left_anti").unionByName(new, allowMissingColumns=True)


def hard_negatives(now: DataFrame, before: DataFrame, key: str, limit: float = 0.1) -> DataFrame:
    """What two epochs of maximum probability say about each building."""
    j = now.join(before.select(key, F.col("max_prob").alias("old_prob")), key, "left")
    low_now, low_old = F.col("max_prob") < limit, F.col("old_prob") < limit
    return j.withColumn("verdict", F.when(F.col("old_prob").isNull(), "no_old_data").when(low_now & low_old, "confirmed").when(~low_now & low_old, "lead").otherwise("ambiguous"))


def contaminated(index: DataFrame) -> DataFrame:
    return index.where("kind <> 'positive'").agg(F.count("*").alias("negatives"), F.count_if(F.col("pv_pixels") > 0).alias("contaminated"))


def shifted_cells(cells: DataFrame, dx: int = 85, dy: int = 40) -> DataFrame:
    """Names of the same places on another grid."""
    return cells.withColumn("other", G.cell_key(F.col("ix") + dx, F.col("iy") + dy))


def missed_and_controls(mapped: DataFrame, buildings: DataFrame, hits: DataFrame, signal: DataFrame, per_bin: int, least_kept_m2: float = 5000.0) -> DataFrame:
    """Mapped features that no predicted pixel touches, sampled by size (large ones all kept), and buildings without signal.

    hits has osm_id, signal has id; controls are of 50 to 5000 m2.
    """
    from solargrid.functions import business as B
    from solargrid.operators.candidates import stratified

    cols = ["key", "lon", "lat", "area_m2", "role"]
    missed = mapped.join(hits.select("osm_id").distinct(), "osm_id", "left_anti").withColumn("key", F.col("osm_id")).withColumn("role", F.lit("missed")).select(cols)
    large = missed.where(F.col("area_m2") >= least_kept_m2)
    quiet = buildings.join(signal.select("id").distinct(), "id", "left_anti").where(F.col("area_m2").between(50, 5000)).withColumn("key", F.col("id")).withColumn("role", F.lit("control")).select(cols)
    sampled = [stratified(d, B.size_bin(F.col("area_m2"), True), per_bin, "key").select(cols) for d in (missed.where(F.col("area_m2") < least_kept_m2), quiet)]
    return large.unionByName(sampled[0]).unionByName(sampled[1])


def one_per_place(chips: DataFrame, key: str, step_deg: float = 0.02, seed: int = 0) -> DataFrame:
    """One chip of each rounded cell (half to even), the first in hash order."""
    k = F.col(key)
    best = chips.groupBy(F.bround(F.col("lon") / step_deg).alias("kx"), F.bround(F.col("lat") / step_deg).alias("ky")).agg(F.min_by(F.struct(*chips.columns), F.struct(hash_order(k, seed), k)).alias("b"))
    return best.select("b.*")


def chip_counts(chip_pixels: DataFrame) -> DataFrame:
    """pv_pixels, their sum of coverage fractions and the split of every chip. chip_pixels: chip_id, split, mask, fraction."""
    pv = F.col("mask") == 1
    return chip_pixels.groupBy("chip_id", "split").agg(F.count_if(pv).alias("pv_pixels"), F.sum(F.when(pv, F.col("fraction")).otherwise(0.0)).alias("pv_frac_sum"))


def labels_in_chips(labels: DataFrame, chips: DataFrame) -> DataFrame:
    """chip_id and osm_id of labels (with boxes) that cross a chip's box, edges included.

    Labels meet the different boxes; the chips of a box, however many, are dealt with its labels over SHARES tasks.
    """
    from solargrid.operators import spatial as S

    boxes = S.cut_lineage(chips.select(*S.BOX).distinct().withColumn("no", F.monotonically_increasing_id()))
    hit = S.box_pairs(S.renamed(labels.select("osm_id", *S.BOX), "l_"), S.renamed(boxes, "r_"), 0.1)
    hit = hit.select(F.col("l_osm_id").alias("osm_id"), F.col("r_no").alias("no"), F.pmod(F.hash("l_osm_id"), F.lit(SHARES)).alias("share"))
    dealt = chips.join(boxes, list(S.BOX)).select("chip_id", "no", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    # By number, so that small inputs of a large result are not put into few tasks.
    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hit.repartition(parts, "no", "share").join(dealt.hint("merge"), ["no", "share"]).select("chip_id", "osm_id")


def vegetation_negatives(vetoed: DataFrame) -> DataFrame:
    """Candidates that only their greenness speaks against; those of other vetoes teach nothing here."""
    return vetoed.where(F.col("veto").isin("vegetation", "vegetation_annual"))


def linked_cells(cells: DataFrame, other: DataFrame, dx: int = 85, dy: int = 40) -> DataFrame:
    """Cells joined to the same places of another grid, whose cells are numbered further by dx and dy (columns o_...)."""
    o = other.select(*[F.col(c).alias(f"o_{c}") for c in other.columns])
    return cells.join(o, (F.col("ix") + dx == F.col("o_ix")) & (F.col("iy") + dy == F.col("o_iy")))
