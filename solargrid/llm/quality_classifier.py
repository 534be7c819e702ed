"""Quality classifier: a sparse ensemble of rules.

Boosted trees are grown over statistics of labelled documents; every path from a root to a node is a rule, a conjunction of
comparisons. A logistic model with a lasso penalty weights the rules, most weights become zero, and the rest compile
into one Spark column expression, so scoring is a projection.

Statistics are computed once for every whole text, by Spark, and laid down. Trees and weights are fitted in the driver on
at most SAMPLE labelled rows, those with the smallest hashes of their doc_id; SAMPLE is a parameter.

Nulls and odd input: a null text counts as empty; ratios over nothing are 0, so every row has a score. Rows without a
quality label teach nothing; without labels of both kinds every score is the base rate (0.5 without any label). Rows are
scored one by one, so repeated rows repeat their score; a null doc_id hashes as the empty string and is kept. Empty tables
give an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solargrid.llm.quality_rules import base_statistics
from solargrid.llm.storage import stored

FOLDS = 5
SAMPLE = 20_000
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS, LEAST = 24, 3, 0.3, 24, 20
PENALTY, STEPS = 0.002, 400


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _share(a: str, b: str, k: int = 1000) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) * {k} / {b} ELSE 0D END"


#: The statistics that rules may use, as SQL over the base counts.
STATISTICS = {
    "words": "CAST(n_words AS DOUBLE)",
    "lines": "CAST(n_lines AS DOUBLE)",
    "word_length": _share("word_chars", "n_words", 1),
    "symbols": _share("n_symbols", "n_words"),
    "upper": _share("n_upper", "word_chars"),
    "dup_lines": _share("n_dup_lines", "n_lines"),
    "repeats": _share("n_repeat_words", "n_words"),
    "line_words": _share("n_words", "n_lines", 1),
    "shouts": _share("n_shouts", "n_words"),
    "bars": _share("n_bars", "n_words"),
    "digits": _share("n_digits", "word_chars"),
    "stops": _share("n_stops", "n_words"),
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATISTICS of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda what: (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("long")
    d = docs.select(
        F.struct(F.col(id_col).alias("doc_id"), count("!").alias("n_shouts"), count("|").alias("n_bars"), count(".").alias("n_stops"), F.length(F.regexp_replace(text, "[^0-9]", "")).cast("long").alias("n_digits")).alias("own"),
        F.col(text_col).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"),
    )
    base = base_statistics(d, id_col="own").select(F.col("doc_id.*"), *[c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")])
    return base.select("doc_id", *[F.expr(c).alias(k) for k, c in STATISTICS.items()])


class Rule(NamedTuple):
    #: (statistic, is_above, cut): value > cut or value <= cut
    terms: tuple[tuple[int, bool, float], ...]
    weight: float


class Ensemble(NamedTuple):
    bias: float
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        """The probability of label 1."""
        names = list(STATISTICS)
        total = F.lit(float(self.bias))
        for rule in self.rules:
            holds = F.lit(True)
            for stat, above, cut in rule.terms:
                holds &= (F.col(names[stat]) > float(cut)) if above else (F.col(names[stat]) <= float(cut))
            total = total + F.when(holds, F.lit(float(rule.weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def matches(x: np.ndarray, terms) -> np.ndarray:
    on = np.ones(len(x), dtype=bool)
    for stat, above, cut in terms:
        on &= (x[:, stat] > cut) == above
    return on


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple, rules: list, values: np.ndarray) -> None:
    """One regression tree by second-order gain; adds each node's path to rules and each leaf's value to values."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None)
    if depth:
        for stat, at in enumerate(cuts):
            v = x[rows, stat]
            place = np.searchsorted(at, v, side="left")  # v <= at[k] for all k >= place
            gs = np.bincount(place, gradient[rows], len(at) + 1).cumsum()[:-1]
            hs = np.bincount(place, hessian[rows], len(at) + 1).cumsum()[:-1]
            ns = np.bincount(place, minlength=len(at) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (stat, float(at[gain.argmax()])))
    if best[1] is None:
        values[rows] = -g / (h + 1)
        return
    stat, cut = best[1]
    low = x[rows, stat] <= cut
    for above, part in ((False, rows[low]), (True, rows[~low])):
        here = (*path, (stat, above, cut))
        rules.append(here)
        grow(x, gradient, hessian, part, cuts, depth - 1, here, rules, values)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Distinct rules of TREES boosted trees; rules of three terms or fewer that split the rows."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[:-1])) for k in range(x.shape[1])]
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    margin, rules = np.full(len(y), math.log(rate / (1 - rate))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        grow(x, p - y, p * (1 - p), np.arange(len(y)), cuts, DEPTH, (), rules, step)
        margin += RATE * step
    simple = dict.fromkeys(tuple(sorted(r)) for r in rules)
    return list(simple)


def lasso(r: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic loss with PENALTY on the weights' absolute values, by accelerated proximal gradient steps."""
    n, m = r.shape
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, b = np.zeros(m), math.log(rate / (1 - rate))
    z, c, t = w.copy(), b, 1.0
    # The largest eigenvalue of the loss's curvature, by power steps.
    v = np.ones(m + 1) / math.sqrt(m + 1)
    for _ in range(30):
        u = r @ v[:m] + v[m]
        v = np.append(r.T @ u, u.sum())
        size = np.linalg.norm(v)
        v /= size
    step = 4 * n / (size * 1.05)
    for _ in range(STEPS):
        e = (1 / (1 + np.exp(-(r @ z + c))) - y) / n
        nw = z - step * (r.T @ e)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * PENALTY, 0)
        nb = c - step * e.sum()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if len(y) == 0:
        return Ensemble(0.0, ())
    rate = y.mean()
    if rate in (0, 1):
        return Ensemble(20.0 if rate else -20.0, ())
    rules = tree_rules(x, y)
    if not rules:
        return Ensemble(math.log(rate / (1 - rate)), ())
    b, w = lasso(np.stack([matches(x, t) for t in rules], axis=1).astype(np.float64), y)
    return Ensemble(b, tuple(Rule(t, v) for t, v in zip(rules, w, strict=True) if abs(v) > 1e-6))


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Fit on at most `sample` rows that have a label and are not held out."""
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("double").alias("l_quality")).where("l_quality IS NOT NULL AND l_id IS NOT NULL").where(~held_out("l_id"))
    chosen = known.distinct().orderBy(F.xxhash64("l_id"), "l_id", "l_quality").limit(sample)
    rows = stats.join(chosen, stats["doc_id"] == chosen["l_id"]).orderBy("doc_id").select(*STATISTICS, "l_quality").limit(sample).toPandas().to_numpy(dtype=np.float64)
    rows = rows.reshape(-1, len(STATISTICS) + 1)
    return fit(rows[:, :-1], rows[:, -1])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    stats = stored(statistics(docs, id_col, text_col), "classifier-statistics")
    model = train(stats, labels, sample)
    return stats.select("doc_id", held_out().alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
