"""Precision and recall by size class, their posteriors, and the register of installed units."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solargrid.functions import business as B

LEAST_MANUAL, LEAST_SAMPLE, LEAST_RECALL = 20, 30, 20
#: Cells of the sums of a Beta density, and points of the mixture's grid.
BETA_CELLS, GRID = 2000, 201


def review_counts(reviews: DataFrame) -> DataFrame:
    """n and n_real of the answered reviews of each bin."""
    r = reviews.withColumn("real", B.verdict(F.col("verdict"))).where("real IS NOT NULL")
    return r.groupBy("bin_label").agg(F.count("*").alias("n"), F.count_if("real").alias("n_real"))


def bin_table(candidates: DataFrame, mapped_ids: DataFrame, reviews: DataFrame, recall: DataFrame, bins: DataFrame, false_rate: float = B.FALSE_RATE) -> DataFrame:
    """A row for each size class: counts, p_unmapped by its source, p_real and recall.

    The precision of unmapped candidates comes from reviews if there are enough, else from the glint sample if its rates
    are apart, else from the nearest class that has one (ties: the larger class).
    """
    c = candidates.withColumn("bin", B.size_bin(F.col("area_m2"))).join(mapped_ids.withColumn("is_mapped", F.lit(True)), "cand_id", "left")
    counts = c.groupBy("bin").agg(F.count("*").alias("n_all"), F.count_if(F.coalesce("is_mapped", F.lit(False))).alias("n_mapped"), F.count_if(F.col("is_mapped").isNull() & (F.col("glint_consistent") >= 2)).alias("sample_k"), F.count_if(F.col("is_mapped").isNull()).alias("sample_n"))
    t = bins.join(counts, "bin", "left").join(review_counts(reviews).withColumnsRenamed({"bin_label": "label", "n": "manual_n", "n_real": "manual_k"}), "label", "left").join(recall, "bin", "left")
    t = t.fillna(0, ["n_all", "n_mapped", "sample_k", "sample_n", "manual_n", "manual_k", "recall_n", "recall_k"])
    s, rate = F.col("sens_k") / F.col("sens_n"), F.col("sample_k") / F.col("sample_n")
    manual = F.when(F.col("manual_n") >= LEAST_MANUAL, F.col("manual_k") / F.col("manual_n"))
    measured = F.when((F.col("sample_n") >= LEAST_SAMPLE) & (s - false_rate >= 0.05), B.clip((rate - false_rate) / (s - false_rate), 0, 1))
    t = t.withColumn("own", F.coalesce(manual, measured)).withColumn("origin", F.when(manual.isNotNull(), "manual").when(measured.isNotNull(), "measured").otherwise("extrapolated"))
    known = t.where("own IS NOT NULL").select(F.col("bin").alias("k_bin"), F.col("own").alias("k_own"))
    # Six rows against six at most.
    pick = t.select("bin").join(F.broadcast(known), F.lit(True)).groupBy("bin").agg(F.min_by("k_own", F.struct(F.abs(F.col("bin") - F.col("k_bin")), -F.col("k_bin"))).alias("near"))
    t = t.join(pick, "bin", "left").withColumn("p_unmapped", F.coalesce("own", "near"))
    share = F.col("n_mapped") / F.greatest(F.col("n_all"), F.lit(1))
    t = t.withColumn("p_real", share + (1 - share) * F.col("p_unmapped")).withColumn("recall", F.when(F.col("recall_n") >= LEAST_RECALL, F.col("recall_k") / F.col("recall_n")))
    return t.drop("own", "near")


def candidate_p_real(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """p_real and recall of every candidate."""
    t = table.select(F.col("bin").alias("t_bin"), F.col("p_real").alias("bin_p_real"), F.col("recall").alias("bin_recall"))
    b = B.size_bin(F.col("area_m2"))
    j = candidates.withColumn("bin", b).join(F.broadcast(t), F.col("bin") == F.col("t_bin"), "left").drop("t_bin")  # six rows
    j = j.withColumn("p_real", B.p_real(F.col("bin_p_real"), F.col("glint_consistent"), B.likelihood_ratio(F.col("bin"))))
    return j.withColumn("recall_used", B.recall_floor(F.col("bin_recall"))).drop("bin_p_real", "bin_recall")


def recall_corrected(candidates: DataFrame, keys: list[str]) -> DataFrame:
    m2 = F.col("area_m2") * F.col("p_real") / F.col("recall_used")
    return candidates.groupBy(*keys).agg(F.sum(m2).alias("rc_m2"), F.sum(F.when(F.col("placement") == "rooftop", m2).otherwise(0.0)).alias("rc_roof_m2"))


def beta_quantiles(counts: DataFrame, keys: list[str], n_levels: int, cells: int = BETA_CELLS) -> DataFrame:
    """keys, level (0 to n_levels - 1) and value: quantiles (level + 1/2) / n_levels of Beta(k + 1/2, n - k + 1/2) for each row of counts.

    With x = sin(t)^2 the density is sin(t)^2k cos(t)^2(n - k), which has no poles. It is summed over equal cells of t within ten
    standard deviations of its middle, and a quantile lies in its cell by linear interpolation, so the error is a ten thousandth
    of a standard deviation whatever the counts are. counts has keys, k and n; each row meets its own cells only.
    """
    reach, middle = 5 / F.sqrt(F.col("n") + 1), F.asin(F.sqrt((F.col("k") + 0.5) / (F.col("n") + 1)))
    c = counts.select(*keys, "k", "n", F.greatest(middle - reach, F.lit(0.0)).alias("lo"), F.least(middle + reach, F.lit(math.pi / 2)).alias("hi"))
    c = c.withColumn("width", (F.col("hi") - F.col("lo")) / cells).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    t = F.col("lo") + (F.col("i") + 0.5) * F.col("width")
    c = c.withColumn("loglik", 2 * F.col("k") * F.log(F.sin(t)) + 2 * (F.col("n") - F.col("k")) * F.log(F.cos(t)))
    w = Window.partitionBy(*keys)
    c = c.withColumn("weight", F.exp(F.col("loglik") - F.max("loglik").over(w))).withColumn("upto", F.sum("weight").over(w.orderBy("i")))
    c = c.withColumn("before", F.coalesce(F.lag("upto").over(w.orderBy("i")), F.lit(0.0))).withColumn("total", F.max("upto").over(w))
    c = c.withColumn("before", F.col("before") / F.col("total")).withColumn("after", F.col("upto") / F.col("total"))
    first = lambda p: F.ceil(F.col(p) * n_levels - 0.5).cast("int")
    c = c.where(first("after") > first("before")).withColumn("level", F.explode(F.sequence(first("before"), first("after") - 1)))
    share = ((F.col("level") + 0.5) / n_levels - F.col("before")) / (F.col("after") - F.col("before"))
    return c.select(*keys, "level", F.pow(F.sin(F.col("lo") + (F.col("i") + share) * F.col("width")), 2).alias("value"))


def shuffled(level: Column, bin_no: Column, salt: Column, seed: int) -> Column:
    """What levels are sorted by to become draws: an order of its own for each bin and salt, in integers that any engine repeats."""
    one = level.cast("long") + 1
    return (one * one * 7919 + one * ((bin_no + 1) * 104_729 + salt * 15_013) + seed) % 1_000_003


def jeffreys_draws(counts: DataFrame, n_draws: int = 1000, seed: int = 7) -> DataFrame:
    """bin, rate, draw, value: stratified draws of Beta(k + 1/2, n - k + 1/2) of each counted rate; a rate without counts is a point mass.

    counts has bin, rate (a name), k, n and fixed. The draws of a rate are its n_draws middle quantiles in an order that depends
    on its bin and name, so that rates vary independently and every engine gets the same ones.
    """
    known = beta_quantiles(counts.where("n > 0"), ["bin", "rate"], n_draws)
    order = shuffled(F.col("level"), F.col("bin"), F.crc32(F.col("rate").cast("binary")) % 997, seed)
    w = Window.partitionBy("bin", "rate").orderBy(order, "level")
    own = known.select("bin", "rate", (F.row_number().over(w) - 1).alias("draw"), "value")
    flat = counts.where("n = 0").select("bin", "rate", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"), F.col("fixed").cast("double").alias("value"))
    return own.unionByName(flat)


def mixture_posterior(draws: DataFrame) -> DataFrame:
    """bin, draw, p: a precision drawn from the binomial mixture, by inverse CDF over a grid.

    draws has bin, draw, s and f (detection and false rates), k of n seen, and u, a uniform number.
    """
    g = draws.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    p = F.col("g") / (GRID - 1)
    q = B.clip(p * F.col("s") + (1 - p) * F.col("f"), 1e-9, 1 - 1e-9)
    g = g.withColumn("loglik", F.col("k") * F.log(q) + (F.col("n") - F.col("k")) * F.log(1 - q))
    w = Window.partitionBy("bin", "draw")
    g = g.withColumn("weight", F.exp(F.col("loglik") - F.max("loglik").over(w)))
    g = g.withColumn("cdf", F.sum("weight").over(w.orderBy("g")) / F.sum("weight").over(w))
    return g.where(F.col("cdf") >= F.col("u")).groupBy("bin", "draw").agg((F.min("g") / (GRID - 1)).alias("p"))


def register_by_area(units: DataFrame, cutoff: str) -> DataFrame:
    """Installed kW by municipality: rooftop, rooftop up to 100 kW, ground, and the number of all active units."""
    d = F.lit(cutoff).cast("date")
    live = units.where((F.col("commissioned") <= d) & F.col("ags").isNotNull() & F.col("kw").isNotNull()).where(B.active_unit(F.col("status"), F.col("decommissioned"), d))
    roof, total = F.col("art") == "building", lambda c: F.sum(F.when(c, F.col("kw")).otherwise(0.0))
    return live.groupBy("ags").agg(total(roof).alias("kw_roof"), total(roof & (F.col("kw") <= 100)).alias("kw_roof_small"), total(F.col("art") == "ground").alias("kw_ground"), F.count("*").alias("n_units"))


def completeness(labels_by_area: DataFrame, register: DataFrame, kwp_per_m2: float = B.KWP_PER_M2, areas: DataFrame | None = None) -> DataFrame:
    """How much of the register the labels hold; well mapped at 0.6 and 50 kW. With areas (ags), each of these has a row."""
    if areas is not None:
        register = areas.select("ags").distinct().join(register, "ags", "left").fillna(0.0, ["kw_roof"])
    j = register.join(labels_by_area, "ags", "left").fillna(0.0, ["label_m2"])
    j = j.withColumn("completeness", B.half_even(F.col("label_m2") * kwp_per_m2 / F.greatest(F.col("kw_roof"), F.lit(1e-6)), 4))
    return j.withColumn("well_mapped", (F.col("completeness") >= 0.6) & (F.col("kw_roof") >= 50))


def average_rank(col: str, *by: str) -> Column:
    w = Window.partitionBy(*by).orderBy(col)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, col)) - 1) / 2


def fit_stats(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """n, slope through the origin, median ratio, r2 and Spearman's rank correlation by group; null below two rows."""
    r = df.withColumn("rx", average_rank(x, group)).withColumn("ry", average_rank(y, group))
    enough = lambda c: F.when(F.count("*") >= 2, c)
    return r.groupBy(group).agg(
        F.count("*").alias("n"), enough(F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("slope"), enough(F.median(F.when(F.col(x) > 0, F.col(y) / F.col(x)))).alias("median_ratio"),
        enough(F.pow(F.corr(x, y), 2)).alias("r2"), enough(F.corr("rx", "ry")).alias("spearman"),
    )
