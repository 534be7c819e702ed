"""Rules of the solar domain as columns: bins, priors, factors, notes and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size bins in m2, their names, and study rates of validated glints by bin.
EDGES = (100.0, 500.0, 1000.0, 5000.0, 50_000.0)
LABELS = ("<100", "100-500", "500-1k", "1k-5k", "5k-50k", ">50k")
GLINT_RATES = (0.025, 0.088, 0.162, 0.306, 0.293, 0.261)
FALSE_RATE = 0.087
CELL_DEG = 0.1
KWP_PER_M2 = 0.2


def size_bin(area: Column, right_closed: bool = False) -> Column:
    """Bin number 0 to 5; a value at an edge goes up, or down in the right-closed form that the studies use."""
    out = F.lit(0)
    for e in EDGES:
        out = out + (area > e if right_closed else area >= e).cast("int")
    return out


def bin_label(bin_no: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), bin_no + 1)


def likelihood_ratio(bin_no: Column, rates: tuple = GLINT_RATES, false_rate: float = FALSE_RATE) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in rates]), bin_no + 1) / false_rate


def half_even(x: Column, digits: int) -> Column:
    """Round half to even."""
    return F.bround(x, digits)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def building_prior(overlap: Column, distance: Column) -> Column:
    """How well a building explains a candidate; an unknown distance (below 0) is far."""
    far = F.when(distance < 0, F.lit(1e6)).otherwise(distance)
    return clip(F.greatest(clip(overlap / 0.5, 0, 1), 0.5 * F.exp(-far / 30), F.lit(0.15)), 0, 1)


def rank_score(confidence: Column, prior: Column) -> Column:
    return half_even(confidence * (0.5 + 0.5 * prior), 4)


def epoch_prior(old_probability: Column) -> Column:
    """1 where nothing was there before; null where the old epoch was not read."""
    return half_even(clip(1 - old_probability, 0, 1), 3)


def epoch_factor(score: Column, prior: Column) -> Column:
    return half_even(score * (0.5 + 0.5 * F.coalesce(prior, F.lit(1.0))), 4)


def glint_boost(n_consistent: Column, ratio: Column) -> Column:
    """A reward only: 1 below two consistent spikes."""
    sure = F.when(n_consistent < 2, F.lit(0.0)).otherwise(clip(n_consistent / 4, 0, 1))
    return 1 + (clip(ratio, 1, 4) - 1) * sure


def p_real(prior: Column, n_consistent: Column, ratio: Column) -> Column:
    """A bin's precision, with its odds raised by the ratio for a validated candidate."""
    p = clip(prior, 1e-6, 1 - 1e-6)
    odds = p / (1 - p) * ratio
    return F.when(n_consistent >= 2, odds / (1 + odds)).otherwise(prior)


def recall_floor(recall: Column, floor: float = 0.05) -> Column:
    return F.greatest(F.coalesce(recall, F.lit(1.0)), F.lit(floor))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a binomial rate; null for n = 0."""
    n = F.when(n > 0, n)
    p, zz = k / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return mid - half, mid + half


def rate_inversion(r: Column, f: Column, d: Column) -> Column:
    """The true share behind a measured rate, given false and detection rates; null if they do not differ."""
    return F.when(d > f + 1e-9, clip((r - f) / (d - f), 0, 1))


def epoch_note(checked: Column, prior: Column) -> Column:
    return F.when(~F.coalesce(checked, F.lit(False)), "").when(prior < 0.5, "already visible in the earlier epoch").when(prior >= 0.9, "new since the earlier epoch").otherwise("unclear in the earlier epoch")


def map_link(lat: Column, lon: Column) -> Column:
    return F.format_string("https://www.openstreetmap.org/#map=19/%.5f/%.5f", lat, lon)


def instruction(area: Column, confidence: Column) -> Column:
    return F.format_string("Check for solar panels: about %.0f m2, confidence %.2f", area, confidence)


def tag_placement(location: Column, place: Column, kind: Column) -> Column:
    roof = ("roof", "rooftop")
    return F.when(location.isin(*roof) | place.isin(*roof), "rooftop").when(kind == "plant", "ground").otherwise("unknown")


def label_placement(placement: Column, area: Column, least: float = 400.0) -> Column:
    """Live labels: small below the limit whatever they were; unknown ones above it are ground."""
    return F.when(area < least, "small").when(placement == "unknown", "ground").otherwise(placement)


def verdict(text: Column) -> Column:
    """True, false, or null for a blank; any other word is an error."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (
        F.when(t.isin("yes", "y", "true", "1", "real", "pv"), F.lit(True))
        .when(t.isin("no", "n", "false", "0", "fp", "not_pv", "nopv"), F.lit(False))
        .when(t.isin("", "nan", "none"), F.lit(None).cast("boolean"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown verdict: "), t)).cast("boolean"))
    )


def active_unit(status: Column, decommissioned: Column, cutoff: Column) -> Column:
    return F.coalesce(status == "operating", F.lit(False)) | F.coalesce(decommissioned > cutoff, F.lit(False))


def within_distance(distance: Column, most: float) -> Column:
    """Unknown distances (below 0) stay; 0 switches the rule off."""
    return F.lit(True) if not most else (distance < 0) | (distance <= most)


def veto(reasons: dict[str, Column]) -> Column:
    """The first reason whose condition holds; an unknown condition never vetoes."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons.items()])


def floor_noise(p: Column, least: float = 0.05) -> Column:
    return F.when(p >= least, p).otherwise(0.0)


def in_window(time: Column, window: str) -> Column:
    """window: 'start:end' as ISO dates, both included."""
    start, end = window.split(":")
    return (F.to_date(time) >= F.lit(start).cast("date")) & (F.to_date(time) <= F.lit(end).cast("date"))


def folded(name: Column) -> Column:
    """A name under a collation that ignores case and accents."""
    return F.collate(name, "UNICODE_CI_AI")


def annual_window(end: str, days: int = 365) -> str:
    """The window of so many days up to an ISO date, for in_window; "now" is the caller's."""
    from datetime import date, timedelta

    last = date.fromisoformat(end)
    return f"{last - timedelta(days=days)}:{last}"
