"""Discrimination, classification and calibration of predictions: y in {0, 1}, p in [0, 1], by any keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sondage.operators.ranks import by_edges, quantiles, running
from sondage.session import ship
from sondage.sources.files import written

EPS = 1e-6
#: Slopes beyond this are not identified.
STEEPEST = 25.0


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return F.log(p / (F.lit(1.0) - p))


def expit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a proportion, within [0, 1]; null without trials."""
    n = F.nullif(n, F.lit(0)).cast("double")
    p, z2 = hits / n, F.lit(z * z)
    middle, spread = p + z2 / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.greatest(F.lit(0.0), (middle - spread) / (1 + z2 / n)), F.least(F.lit(1.0), (middle + spread) / (1 + z2 / n))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null if b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion(threshold: Column, w: Column | None = None) -> dict[str, Column]:
    """Aggregates of the counts at p >= threshold."""
    hit, one = F.col("p") >= threshold, F.lit(1) if w is None else w
    cell = lambda a, b: F.sum(F.when(a & b, one).otherwise(0))
    pos, neg = F.col("y") == 1, F.col("y") == 0
    return {"tp": cell(pos, hit), "fp": cell(neg, hit), "tn": cell(neg, ~hit), "fn": cell(pos, ~hit)}


CELLS = ["tp", "fp", "tn", "fn"]
RATES = ["sensitivity", "specificity", "precision", "npv", "accuracy", "f1", "balanced_accuracy"]


def rates(df: DataFrame, prefix: str = "") -> DataFrame:
    """Rates from tp, fp, tn, fn, all with the prefix; null where a denominator is 0."""
    tp, fp, tn, fn = (F.col(prefix + c) for c in CELLS)
    named = lambda d: {prefix + n: c for n, c in d.items()}
    out = df.withColumns(named({"sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "precision": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn)}))
    s, c, q = (F.col(prefix + n) for n in RATES[:3])
    f1 = F.when(s + q > 0, 2 * s * q / (s + q)).otherwise(0.0)
    balanced = F.when(s.isNull(), c).when(c.isNull(), s).otherwise((s + c) / 2)
    return out.withColumns(named({"f1": f1, "balanced_accuracy": balanced}))


def usable(df: DataFrame) -> DataFrame:
    """The rows that a metric counts: outcome 0 or 1 and a score that is neither null nor NaN. All others are as if they were
    not there, in every metric alike, so counts add up; unscored() says how many they are."""
    return df.where(F.col("y").isin(0, 1) & F.col("p").isNotNull() & ~F.isnan("p"))


def unscored(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, n_unscored): the rows of each group, and those among them that no metric counts."""
    counts = F.coalesce(F.col("y").isin(0, 1) & F.col("p").isNotNull() & ~F.isnan("p"), F.lit(False))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~counts).alias("n_unscored"))


def threshold_metrics(df: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    return rates(usable(df).groupBy(*keys).agg(*[c.alias(n) for n, c in confusion(threshold).items()]))


def by_score(df: DataFrame, keys: list[str], w: Column | None = None) -> DataFrame:
    """Weight of positives and negatives at each distinct score."""
    one = F.lit(1.0) if w is None else w
    return usable(df).groupBy(*keys, "p").agg(F.sum(F.when(F.col("y") == 1, one).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 0, one).otherwise(0.0)).alias("neg"))


def _curve(scores: DataFrame, keys: list[str], any_range: bool = False) -> DataFrame:
    sums, totals = {"tp": F.col("pos"), "fp": F.col("neg")}, {"tp": "all_pos", "fp": "all_neg"}
    rows, bucket = by_edges(scores, keys, "p") if any_range else (scores, F.floor(F.col("p") * 256))
    return running(rows, keys, bucket, [F.col("p").desc()], sums, descending=True, totals=totals)


def curve(df: DataFrame, keys: list[str], w: Column | None = None, any_range: bool = False) -> DataFrame:
    """By distinct score: tp and fp of all scores at least as high, with the group's totals. Scores are in [0, 1] unless any_range."""
    scores = by_score(df, keys, w)
    return _curve(written(scores, "scores") if any_range else scores, keys, any_range)


def roc_auc(df: DataFrame, keys: list[str], w: Column | None = None, any_range: bool = False) -> DataFrame:
    """Weighted share of (positive, negative) pairs in order, ties a half; null with one class only."""
    rows = curve(df, keys, w, any_range)
    below = F.col("all_neg") - F.col("fp")
    agg = rows.groupBy(*keys).agg(F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("good"), F.max("all_pos").alias("np"), F.max("all_neg").alias("nn"))
    return agg.select(*keys, ratio(F.col("good"), F.col("np") * F.col("nn")).alias("auc"))


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    rows = curve(df, keys)
    return rows.groupBy(*keys).agg(F.sum(ratio(F.col("pos"), F.col("all_pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr_auc"))


def brier(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean squared error, and its gain over the mean outcome."""
    agg = usable(df).groupBy(*keys).agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.avg("y").alias("m"))
    return agg.select(*keys, "brier", (1 - ratio(F.col("brier"), F.col("m") * (1 - F.col("m")))).alias("brier_skill"))


def ece(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width; p = 1 is in the last."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    per = usable(df).groupBy(*keys, b.alias("b")).agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("p").alias("p"))
    return per.groupBy(*keys).agg((F.sum(F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("ece"))


def separation(df: DataFrame, keys: list[str]) -> DataFrame:
    side = lambda f, v: f(F.when(F.col("y") == v, F.col("p")))
    hit = (side(F.max, 0) < side(F.min, 1)) | (side(F.max, 1) < side(F.min, 0))
    return usable(df).groupBy(*keys).agg(F.coalesce(hit, F.lit(False)).alias("separates"))


#: Names of the columns of all_metrics, and how reports name them; a smaller value is better for the last.
HEADLINE = ["auc", "pr_auc", "sensitivity", "specificity", "precision", "npv", "f1", "balanced_accuracy", "brier", "slope", "intercept", "ece"]
LABELS = {
    "auc": "ROC-AUC", "pr_auc": "PR-AUC", "sensitivity": "Sensitivity (recall)", "specificity": "Specificity", "precision": "Precision (PPV)", "npv": "Negative predictive value", "f1": "F1 score",
    "balanced_accuracy": "Balanced accuracy", "accuracy": "Accuracy", "brier": "Brier score", "brier_skill": "Brier skill score", "slope": "Calibration slope", "intercept": "Calibration intercept", "ece": "Expected calibration error",
}
LOWER_IS_BETTER = ["brier", "ece"]


def bin_of(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1))


def all_metrics(df: DataFrame, keys: list[str], threshold: Column, extra: dict[str, Column] | None = None, bins: int = 10) -> DataFrame:
    """One row per group: n, n_positive, discrimination, Brier score, calibration, and counts and rates at p >= threshold.

    extra names further thresholds, whose counts and rates get the name in
    front. A threshold must be the same in all rows of a group. Everything comes
    from one table of distinct scores. AUCs are null with one class only. Only
    usable() rows count, also in n; a group without any has no row.
    """
    cuts = {"": threshold, **{f"{n}_": c for n, c in (extra or {}).items()}}
    at = {n: f"_cut{i}" for i, n in enumerate(cuts)}
    by = [*keys, *at.values()]
    base = written(by_score(df.withColumns({at[n]: c for n, c in cuts.items()}), by), "scores")
    rows = _curve(base, by)
    pos, neg, p = F.col("pos"), F.col("neg"), F.col("p")
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    n, mean = F.sum(pos + neg), F.sum(pos) / F.sum(pos + neg)
    brier_ = F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / n
    gaps = [F.abs(F.sum(F.when(bin_of(p, bins) == b, pos - (pos + neg) * p).otherwise(0.0))) for b in range(bins)]
    count = lambda c, hit: F.sum(F.when(hit, c).otherwise(0.0)).cast("long")
    sums = []
    for name, cut in at.items():
        hit = p >= F.col(cut)
        sums += [c.alias(name + k) for k, c in zip(CELLS, (count(pos, hit), count(neg, hit), count(neg, ~hit), count(pos, ~hit)))]
    out = rows.groupBy(*by).agg(
        n.cast("long").alias("n"), F.sum(pos).cast("long").alias("n_positive"),
        F.when(both, ratio(F.sum(pos * (F.col("all_neg") - F.col("fp") + neg / 2)), F.max("all_pos") * F.max("all_neg"))).alias("auc"),
        F.when(both, F.sum(ratio(pos, F.col("all_pos")) * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("pr_auc"),
        brier_.alias("brier"), (1 - ratio(brier_, mean * (1 - mean))).alias("brier_skill"), (sum(gaps[1:], gaps[0]) / n).alias("ece"), *sums,
    )
    for name in at:
        out = rates(out, name)
    return out.drop(*at.values()).join(_calibrated(base.groupBy(*keys, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), keys), keys)


#: Distinct scores of a group that one task solves; a larger group's steps are sums over all tasks.
LARGEST = 200_000


def calibration(df: DataFrame, keys: list[str], iterations: int = 60, tolerance: float = 1e-9, largest: int = LARGEST) -> DataFrame:
    """(keys, slope, intercept): logistic recalibration on logit(p) by Newton steps.

    The intercept is that of a model whose slope is 1. Steps are scaled so that
    no coefficient moves by more than 10. Null with one class or one score; the
    slope also with perfect separation, a singular step or a value beyond
    STEEPEST. After the last iteration the values reached are returned.

    A group's distinct scores are solved in one task. Groups with more than
    `largest` of them are few: their steps sum over all tasks, and the driver
    holds one row for each of these.
    """
    return _calibrated(written(by_score(df, keys), "scores"), keys, iterations, tolerance, largest)


class _Newton:
    """Both fits of one group; sums(a, b, c) gives what a step needs."""

    def __init__(self, usable: bool, split: bool):
        self.beta, self.c = (np.array([0.0, 1.0]) if usable and not split else None), 0.0 if usable else None
        self.moving, self.going = usable, usable and not split

    def step(self, r: dict, tolerance: float) -> None:
        if self.going:
            det = r["h00"] * r["h11"] - r["h01"] * r["h01"]
            step = np.array([r["h11"] * r["g0"] - r["h01"] * r["g1"], r["h00"] * r["g1"] - r["h01"] * r["g0"]]) / det if det else np.array([np.nan])
            if r["w"] <= 1e-12 or not np.isfinite(step).all():
                self.beta, self.going = None, False
            else:
                step *= min(1.0, 10.0 / max(np.abs(step).max(), 1e-300))
                self.beta = self.beta + step
                self.going = bool(np.abs(step).max() >= tolerance)
        if self.moving:
            if r["l00"] <= 1e-12:
                self.c, self.moving = None, False
            else:
                step = max(-10.0, min(10.0, r["k0"] / r["l00"]))
                self.c += step
                self.moving = abs(step) >= tolerance

    @property
    def now(self) -> tuple[float, float, float]:
        return (*(map(float, self.beta) if self.beta is not None else (0.0, 1.0)), float(self.c or 0.0))

    @property
    def slope(self) -> float | None:
        return float(self.beta[1]) if self.beta is not None and abs(self.beta[1]) <= STEEPEST else None


def _solve(part: pd.DataFrame, iterations: int, tolerance: float) -> tuple[float | None, float | None]:
    p, pos, neg = (part[c].to_numpy(float) for c in ("p", "pos", "neg"))
    clipped = np.clip(p, EPS, 1 - EPS)
    x, n = np.log(clipped / (1 - clipped)), pos + neg
    usable = pos.sum() > 0 and neg.sum() > 0 and x.min() < x.max()
    split = usable and (p[neg > 0].max() < p[pos > 0].min() or p[pos > 0].max() < p[neg > 0].min())
    fit = _Newton(bool(usable), bool(split))
    for _ in range(iterations):
        if not (fit.moving or fit.going):
            break
        a, b, c = fit.now
        mu, nu = 1 / (1 + np.exp(-(a + b * x))), 1 / (1 + np.exp(-(c + x)))
        w, miss = mu * (1 - mu), pos - n * mu
        fit.step({"g0": miss.sum(), "g1": (miss * x).sum(), "w": w.max(), "h00": (n * w).sum(), "h01": (n * w * x).sum(), "h11": (n * w * x * x).sum(), "k0": (pos - n * nu).sum(), "l00": (n * nu * (1 - nu)).sum()}, tolerance)
    return fit.slope, fit.c


def _sized(base: DataFrame, keys: list[str], largest: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups that one task can hold, and those of the others if there are any."""
    over = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > largest).select(*keys)
    if over.isEmpty():
        return base, None
    return base.join(over, keys, "left_anti"), base.join(over, keys, "left_semi")


def _calibrated(base: DataFrame, keys: list[str], iterations: int = 60, tolerance: float = 1e-9, largest: int = LARGEST) -> DataFrame:
    spark = base.sparkSession
    ship(spark)
    schema = base.select(*keys).schema.add("slope", "double").add("intercept", "double")
    few, many = _sized(base.select(*keys, "p", "pos", "neg"), keys, largest)

    def solve(key, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *_solve(part, iterations, tolerance))], columns=schema.names)

    out = few.groupBy(*keys).applyInPandas(solve, schema)
    if many is None:
        return out
    many = many.withColumns({"lp": logit(F.col("p")), "n": F.col("pos") + F.col("neg")})
    side = lambda f, c: f(F.when(F.col(c) > 0, F.col("p")))
    split = (side(F.max, "neg") < side(F.min, "pos")) | (side(F.max, "pos") < side(F.min, "neg"))
    usable = (F.sum("pos") > 0) & (F.sum("neg") > 0) & (F.min("lp") < F.max("lp"))
    facts = many.groupBy(*keys).agg(usable.alias("usable"), F.coalesce(split, F.lit(False)).alias("split")).collect()
    state = {tuple(r[k] for k in keys): _Newton(r.usable, r.split) for r in facts}
    for _ in range(iterations):
        live = [(*k, *v.now) for k, v in state.items() if v.moving or v.going]
        if not live:
            break
        now = spark.createDataFrame(live, base.select(*keys).schema.add("a", "double").add("b", "double").add("c", "double"))
        x, mu, nu = F.col("lp"), expit(F.col("a") + F.col("b") * F.col("lp")), expit(F.col("c") + F.col("lp"))
        w, miss = mu * (1 - mu), F.col("pos") - F.col("n") * mu
        sums = many.join(F.broadcast(now), keys).groupBy(*keys).agg(  # one row per group of over `largest` scores
            F.sum(miss).alias("g0"), F.sum(miss * x).alias("g1"), F.max(w).alias("w"), F.sum(F.col("n") * w).alias("h00"), F.sum(F.col("n") * w * x).alias("h01"),
            F.sum(F.col("n") * w * x * x).alias("h11"), F.sum(F.col("pos") - F.col("n") * nu).alias("k0"), F.sum(F.col("n") * nu * (1 - nu)).alias("l00"),
        ).collect()
        for r in sums:
            state[tuple(r[k] for k in keys)].step(r.asDict(), tolerance)
    return out.unionByName(spark.createDataFrame([(*k, v.slope, v.c) for k, v in state.items()], schema))


def reach_sensitivity(df: DataFrame, keys: list[str], target: float = 0.90) -> DataFrame:
    """The highest threshold among 0, the scores and 1 whose sensitivity is at least the target; 0.5 without positives."""
    rows = curve(df, keys)
    ok = F.max(F.when(F.col("tp") >= F.col("all_pos") * target, F.col("p")))
    found = rows.groupBy(*keys).agg(F.max("all_pos").alias("n"), ok.alias("t"))
    return found.select(*keys, F.when(F.col("n") == 0, 0.5).otherwise(F.coalesce("t", F.lit(0.0))).alias("threshold"))


def youden(df: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest threshold among 0, the scores and 1 with the highest sensitivity + specificity; 0.5 with one class."""
    rows = curve(df, keys).withColumn("j", F.round(ratio(F.col("tp"), F.col("all_pos")) - ratio(F.col("fp"), F.col("all_neg")), 12))
    best = rows.groupBy(*keys).agg(F.max(F.struct("j", (-F.col("p")).alias("t"))).alias("best"), F.min("all_pos").alias("a"), F.min("all_neg").alias("b"))
    at = F.when((F.col("a") == 0) | (F.col("b") == 0), 0.5).when(F.col("best.j") <= 0, 0.0).otherwise(-F.col("best.t"))
    return best.select(*keys, at.alias("threshold"))


def at_thresholds(df: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """tp, fp, tn, fn at the thresholds 1/steps .. (steps - 1)/steps, from a histogram of the scores over these."""
    # Number of thresholds that a score reaches; the division that makes the thresholds decides, not its inverse.
    grid = df.sparkSession.range(1, steps).select((F.col("id") / F.lit(float(steps))).alias("t"), F.col("id").alias("k"))
    raw = F.floor(F.col("p") * steps)
    k = F.when((raw + 1) / F.lit(float(steps)) <= F.col("p"), raw + 1).when(raw / F.lit(float(steps)) > F.col("p"), raw - 1).otherwise(raw)
    held = usable(df).groupBy(*keys, k.alias("r")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    agg = held.join(F.broadcast(grid)).groupBy(*keys, "t")  # at most steps rows of either side in a group
    hit = F.col("r") >= F.col("k")
    return agg.agg(*[F.sum(F.when(h, F.col(c)).otherwise(0)).alias(n) for n, h, c in (("tp", hit, "pos"), ("fp", hit, "neg"), ("tn", ~hit, "neg"), ("fn", ~hit, "pos"))])


def net_benefit(df: DataFrame) -> DataFrame:
    """Net benefit of treating above each threshold, and of treating all."""
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    odds = F.col("t") / (1 - F.col("t"))
    prevalence = (F.col("tp") + F.col("fn")) / n
    return df.withColumns({"net_benefit": F.col("tp") / n - F.col("fp") / n * odds, "treat_all": prevalence - (1 - prevalence) * odds})


def calibration_curve(df: DataFrame, keys: list[str], bins: int = 10, equal: str = "numbers") -> DataFrame:
    """Mean score and outcome, with Wilson bounds, in bins of equal numbers or of equal width.

    The edges of the first are distinct quantiles; a group with fewer than three
    of them gets bins of equal width. Empty bins have no row.
    """
    df = usable(df)
    df = usable(df)
    width = bin_of(F.col("p"), bins)
    if equal == "width":
        rows, b = df, width
    else:
        edges = quantiles(df, keys, "p", [i / bins for i in range(bins + 1)], "edges").withColumn("edges", F.array_sort(F.array_distinct("edges")))
        rows = df.join(edges, keys)
        by_number = F.greatest(F.lit(0), F.least(F.size("edges") - 2, F.size(F.filter("edges", lambda e: e <= F.col("p"))) - 1))
        b = F.when(F.size("edges") < 3, width).otherwise(by_number)
    per = rows.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.sum("y").alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return per.select(*keys, F.col("bin").cast("long").alias("bin"), "n", "mean_p", (F.col("hits") / F.col("n")).alias("observed"), low.alias("low"), high.alias("high"))


def _offset(p: np.ndarray, n: np.ndarray, prevalence: float) -> float:
    clipped = np.clip(p, EPS, 1 - EPS)
    x, low, high = np.log(clipped / (1 - clipped)), -30.0, 30.0
    while high - low >= 1e-10:
        middle = (low + high) / 2
        if (n / (1 + np.exp(-(x + middle)))).sum() / n.sum() > prevalence:
            high = middle
        else:
            low = middle
    return (low + high) / 2


def recalibrated_offset(df: DataFrame, keys: list[str], prevalence: float, largest: int = LARGEST) -> DataFrame:
    """(keys, offset): what to add on the logit scale for the mean score to be the prevalence, by bisection over distinct scores.

    Groups with more than `largest` distinct scores are bisected in sums over all
    tasks; the driver holds one row for each of these.
    """
    spark = df.sparkSession
    ship(spark)
    base = written(df.where(F.col("p").isNotNull() & ~F.isnan("p")).groupBy(*keys, "p").agg(F.count("*").alias("n")), "scores")
    schema = base.select(*keys).schema.add("offset", "double")
    few, many = _sized(base, keys, largest)

    def solve(key, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, _offset(part["p"].to_numpy(float), part["n"].to_numpy(float), prevalence))], columns=schema.names)

    out = few.groupBy(*keys).applyInPandas(solve, schema)
    if many is None:
        return out
    state = {tuple(r): [-30.0, 30.0] for r in many.select(*keys).distinct().collect()}
    while max(b - a for a, b in state.values()) >= 1e-10:
        now = spark.createDataFrame([(*k, (a + b) / 2) for k, (a, b) in state.items()], base.select(*keys).schema.add("mid", "double"))
        mean = F.sum(F.col("n") * expit(logit(F.col("p")) + F.col("mid"))) / F.sum("n")
        for r in many.join(F.broadcast(now), keys).groupBy(*keys).agg(mean.alias("m")).collect():  # one row per group of over `largest` scores
            a, b = state[tuple(r[k] for k in keys)]
            state[tuple(r[k] for k in keys)] = [a, (a + b) / 2] if r.m > prevalence else [(a + b) / 2, b]
    return out.unionByName(spark.createDataFrame([(*k, (a + b) / 2) for k, (a, b) in state.items()], schema))
