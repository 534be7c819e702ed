"""Studies over series, candidates and runs: rates by size, seasons, agreement and spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solargrid.functions import business as B


def by_size(fits: DataFrame, right_closed: bool = True) -> DataFrame:
    """Detected and validated share and medians by size class (right-closed, as the studies have it)."""
    return by_group(fits.withColumn("bucket", B.size_bin(F.col("area_m2"), right_closed)), "bucket")


def by_group(fits: DataFrame, group: str) -> DataFrame:
    """The same by any column, such as the kind of a target."""
    found = F.col("n_spikes") >= 1
    return fits.groupBy(group).agg(
        F.count("*").alias("n"), F.median("area_m2").alias("med_area"), F.median("n_scenes").alias("med_scenes"), F.avg(found.cast("int") * 100).alias("pct_detected"),
        F.avg((F.col("n_consistent") >= 2).cast("int") * 100).alias("pct_validated"), F.median(F.when(found, F.col("n_spikes"))).alias("med_spikes"),
    )


def annual_ndvi(scenes: DataFrame, pulled: DataFrame, month: Column) -> DataFrame:
    """Clear counts and NDVI statistics of every pulled target; one without scenes has 0 clear ones."""
    wet = month.isin(6, 7, 8, 9)
    s = scenes.groupBy("pid").agg(
        F.count("ndvi").alias("n_clear"), F.count_if(wet & F.col("ndvi").isNotNull()).alias("n_monsoon"), F.percentile("ndvi", F.lit(0.95)).alias("ndvi_p95"), F.max("ndvi").alias("ndvi_max"), F.median("ndvi").alias("ndvi_med"),
        F.percentile(F.when(wet, F.col("ndvi")), F.lit(0.95)).alias("ndvi_monsoon_p95"),
    )
    out = pulled.join(s, "pid", "left").fillna(0, ["n_clear", "n_monsoon"])
    return out.withColumns({c: B.half_even(F.col(c), 3) for c in ("ndvi_p95", "ndvi_max", "ndvi_med", "ndvi_monsoon_p95")})


def adoption(buckets: DataFrame, false_rate: float = B.FALSE_RATE) -> DataFrame:
    """Share of roofs with panels from spike rates (bucket, k, n, d, population), with a Wilson interval."""
    r = F.col("k") / F.when(F.col("n") > 0, F.col("n"))
    lo, hi = B.wilson(F.col("k"), F.col("n"))
    inv = lambda x: B.rate_inversion(x, F.lit(false_rate), F.col("d"))
    return buckets.withColumns({"rate": r, "adopted": inv(r), "adopted_lo": inv(lo), "adopted_hi": inv(hi)})


def adoption_total(buckets: DataFrame) -> DataFrame:
    """Population-weighted share over the buckets that have one."""
    known = buckets.where("adopted IS NOT NULL")
    return known.agg((F.sum(F.col("adopted") * F.col("population")) / F.sum("population")).alias("adopted"))


def missed_recovery(targets: DataFrame) -> DataFrame:
    """Rates of validated targets among missed ones and controls, and the missed area that this recovers, by size."""
    t = targets.withColumn("bucket", B.size_bin(F.col("area_m2"), True))
    ok = F.col("n_consistent") >= 2
    rate = lambda role: F.avg(F.when(F.col("role") == role, ok.cast("int")))
    return t.groupBy("bucket").agg(rate("missed").alias("missed_rate"), rate("control").alias("control_rate"), F.sum(F.when((F.col("role") == "missed") & ok, F.col("area_m2")).otherwise(0.0)).alias("recovered_m2"))


def cell_correlations(cells: DataFrame) -> DataFrame:
    return cells.agg(F.corr("spikes", "area_m2").alias("r_area"), F.corr("spikes", "n").alias("r_n"), F.corr("spikes", F.log1p("area_m2")).alias("r_log"))


def strata(cells: DataFrame, stratum: str, value: str) -> DataFrame:
    return cells.groupBy(stratum).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def enhancement(series: DataFrame, keys: list[str]) -> DataFrame:
    """Share of scenes whose inside to ring ratio is an outlier by median and MAD; null below five scenes."""
    s = series.withColumn("ratio", F.col("inside") / F.col("ring"))
    s = s.join(s.groupBy(*keys).agg(F.median("ratio").alias("med"), F.count("*").alias("n")), keys)
    s = s.join(s.groupBy(*keys).agg(F.median(F.abs(F.col("ratio") - F.col("med"))).alias("mad")), keys)
    out = F.col("ratio") > F.col("med") + 3 * F.greatest(1.4826 * F.col("mad"), F.lit(0.05))
    return s.groupBy(*keys, "n").agg(F.when(F.col("n") >= 5, F.avg(out.cast("int"))).alias("rate"))


def module_density(modules: DataFrame) -> DataFrame:
    """Median and quartiles of watts for each m2 of modules of 350 to 600 W."""
    d = F.col("stc_w") / F.col("area_m2")
    return modules.where(F.col("stc_w").between(350, 600)).agg(F.percentile(d, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))


def growth_totals(now: DataFrame, before: DataFrame, measure: str, top: int = 10) -> tuple[DataFrame, DataFrame]:
    total = now.agg(F.sum(measure).alias("now")).join(before.agg(F.sum(measure).alias("before")), F.lit(True))  # one row each
    return total, now.orderBy(F.desc(f"{measure}_delta"), "region_id").limit(top)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of equal flags where both runs have the target, and the differences in scenes."""
    o = b.select("pid", *[F.col(c).alias(f"o_{c}") for c in ("n_scenes", "n_spikes", "n_consistent")])
    j = a.join(o, "pid", "full_outer").where("n_scenes IS NOT NULL AND o_n_scenes IS NOT NULL")
    same = lambda c, k: F.avg(((F.col(c) >= k) == (F.col(f"o_{c}") >= k)).cast("int"))
    d = F.abs(F.col("n_scenes") - F.col("o_n_scenes"))
    return j.agg(F.count("*").alias("n"), same("n_spikes", 1).alias("detected_agree"), same("n_consistent", 2).alias("validated_agree"), F.avg(d).alias("scene_diff"), F.max(d).alias("scene_diff_max"))


def distances(df: DataFrame, col: str) -> DataFrame:
    shares = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)])
    return df.agg(F.percentile(col, shares).alias("q"))


def orientations(fits: DataFrame, *by: str) -> DataFrame:
    fitted = F.col("fit_tilt").isNotNull()
    return fits.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(fitted).alias("n_fitted"), F.median("fit_tilt").alias("med_tilt"), F.median("fit_az").alias("med_az"))


def detection_report(targets: DataFrame) -> DataFrame:
    """Recall on mapped targets and flag rate on unmapped ones, by size and in all."""
    t = targets.withColumn("bucket", B.size_bin(F.col("area_m2"), True))
    ok = (F.col("n_consistent") >= 2).cast("int")
    return t.groupingSets([["bucket"], []], "bucket").agg(F.count("*").alias("n"), F.avg(F.when(F.col("is_mapped"), ok)).alias("recall"), F.avg(F.when(~F.col("is_mapped"), ok)).alias("flagged"))


def share_difference(cells: DataFrame, hexes: DataFrame, membership: DataFrame) -> DataFrame:
    """Own share of capacity minus the reference share, in percent, for each hexagon."""
    own = cells.join(membership, "cell").groupBy("hex").agg(F.sum("mwp").alias("mwp"))
    j = hexes.join(own, "hex", "left").fillna(0.0, ["mwp"])
    total = j.agg(F.sum("mwp").alias("own_total"), F.sum("value").alias("ref_total"))
    return j.join(F.broadcast(total), F.lit(True)).withColumn("difference", 100 * F.col("mwp") / F.col("own_total") - 100 * F.col("value") / F.col("ref_total"))  # total is one row


def azimuth_picks(fits: DataFrame, width: float = 15.0, n: int = 3) -> DataFrame:
    """Up to n targets of each azimuth bin, most consistent first, with the axis of their rows."""
    from pyspark.sql import Window

    f = fits.where("fit_az IS NOT NULL").withColumn("az_bin", F.floor(F.col("fit_az") / width)).withColumn("row_axis", F.pmod(F.col("fit_az") + 90, F.lit(180.0)))
    w = Window.partitionBy("az_bin").orderBy(F.desc("n_consistent"), F.desc("n_spikes"), "pid")
    return f.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def terciles(df: DataFrame, cap: int, key: str) -> DataFrame:
    """A third of cap from each tercile of area, in hash order."""
    from solargrid.operators.candidates import stratified

    q = df.agg(F.percentile("area_m2", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    t = df.join(F.broadcast(q), F.lit(True))  # one row
    return stratified(t, (F.col("area_m2") > F.col("q")[0]).cast("int") + (F.col("area_m2") > F.col("q")[1]).cast("int"), cap // 3, key).drop("q")


def box_against_country(box_fits: DataFrame, country: DataFrame) -> DataFrame:
    """Validated percent by size class in a box beside the country's. country: bucket, pct (six rows)."""
    b = box_fits.groupBy(B.size_bin(F.col("area_m2"), True).alias("bucket")).agg(F.count("*").alias("n"), F.avg((F.col("n_consistent") >= 2).cast("int") * 100).alias("box_pct"))
    return b.join(F.broadcast(country.select("bucket", F.col("pct").alias("country_pct"))), "bucket", "left").withColumn("difference", F.col("box_pct") - F.col("country_pct"))


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both tables have."""
    return a.select(key).intersect(b.select(key))


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def sun_check(scenes: DataFrame) -> DataFrame:
    """Median, 95th percentile and largest difference between a scene's sun angles and those computed for lat, lon and time."""
    from solargrid.functions import solar

    zen, az = solar.sun_position("lat", "lon", "time")
    d = scenes.select(F.abs(zen - F.col("sun_zen")).alias("zen"), F.abs(solar.circular_difference(az, "sun_az")).alias("az"))
    return d.agg(*[f(c).alias(f"{n}_{c}") for c in ("zen", "az") for n, f in (("med", F.median), ("p95", lambda x: F.percentile(x, F.lit(0.95))), ("max", F.max))])
