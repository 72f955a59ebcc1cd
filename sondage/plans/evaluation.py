"""Queries over the prediction table: metrics, curves, thresholds, calibration, folds, selection."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sondage.functions import rng
from sondage.operators import metrics as M
from sondage.operators.ranks import quantiles
from sondage.plans import plan
from sondage.plans.views import CELL, FOLDS, POOL, PREDS, RAW, folded, pooled, preds, raw, scores, tallied
from sondage.sources.files import written

R = lambda *names: ", ".join(f"round({n}, 9) AS {n}" for n in names)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


RATES = M.RATES


def rates_sql(source: str, keys: str, cut: str, name: str = "") -> str:
    """Confusion counts and rates at p >= cut, as full_rates; with a name, full_<name>, whose columns have it in front."""
    mark = f"{name}_" if name else ""
    shown = "*" if not name else f"{keys}, " + ", ".join(f"{c} AS {mark}{c}" for c in ("tp", "fp", "tn", "fn", *RATES))
    return f"""conf{mark} AS (SELECT {keys}, count(*) FILTER (WHERE y = 1 AND p >= {cut}) AS tp, count(*) FILTER (WHERE y = 0 AND p >= {cut}) AS fp,
      count(*) FILTER (WHERE y = 0 AND p < {cut}) AS tn, count(*) FILTER (WHERE y = 1 AND p < {cut}) AS fn FROM {source} GROUP BY {keys}),
    rates{mark} AS (SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS sensitivity, tn / nullif(tn + fp, 0)::DOUBLE AS specificity, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tn / nullif(tn + fn, 0)::DOUBLE AS npv, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy FROM conf{mark}),
    full_{name or "rates"} AS (SELECT {shown} FROM (SELECT *, CASE WHEN sensitivity + precision > 0 THEN 2 * sensitivity * precision / (sensitivity + precision) ELSE 0.0 END AS f1, CASE WHEN sensitivity IS NULL THEN specificity WHEN specificity IS NULL THEN sensitivity ELSE (sensitivity + specificity) / 2 END AS balanced_accuracy FROM rates{mark}))"""


def auc_sql(source: str, keys: str, name: str = "aucs") -> str:
    return f"""{name} AS (SELECT {keys}, (sum(mid) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y))) AS auc
      FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY p) + (count(*) OVER (PARTITION BY {keys}, p) - 1) / 2.0::DOUBLE AS mid FROM {source}) GROUP BY {keys})"""


def curve_sql(source: str, keys: str) -> str:
    on = f"PARTITION BY {keys}"
    return f"""sc AS (SELECT {keys}, p, sum(y)::DOUBLE AS pos, (count(*) - sum(y))::DOUBLE AS neg FROM {source} GROUP BY {keys}, p),
    crv AS (SELECT *, sum(pos) OVER ({on} ORDER BY p DESC) AS tp, sum(neg) OVER ({on} ORDER BY p DESC) AS fp, sum(pos) OVER ({on}) AS all_pos, sum(neg) OVER ({on}) AS all_neg FROM sc)"""


BRIER = lambda s, k: f"br AS (SELECT {k}, avg((p - y) * (p - y)) AS brier, 1 - avg((p - y) * (p - y)) / nullif(avg(y) * (1 - avg(y)), 0) AS brier_skill FROM {s} GROUP BY {k})"
ECE = lambda s, k, b=10: f"ec AS (SELECT {k}, sum(gap) / sum(n) AS ece FROM (SELECT {k}, least(floor(p * {b}), {b - 1}) AS b, count(*) AS n, abs(sum(y) - sum(p)) AS gap FROM {s} GROUP BY {k}, b) GROUP BY {k})"
AP = lambda k: f"ap AS (SELECT {k}, sum(pos / all_pos * tp / (tp + fp)) AS pr_auc FROM crv GROUP BY {k})"
C = "config, model"


@plan("pooled_predictions", f"WITH {POOL} SELECT config, model, sample, y, p, cut, n FROM pooled")
def pooled_predictions(spark, sf):
    return pooled(preds(spark, sf)).select("config", "model", "sample", "y", "p", "cut", "n")


@plan("threshold_metrics", f"WITH {RAW}, {rates_sql('raw', C, '0.5')} SELECT config, model, tp, fp, tn, fn, {R(*RATES)} FROM full_rates")
def threshold_metrics(spark, sf):
    return rounded(M.threshold_metrics(raw(spark, sf), CELL, F.lit(0.5)), *RATES)


@plan("roc_auc", f"WITH {RAW}, {auc_sql('raw', C)} SELECT config, model, {R('auc')} FROM aucs")
def roc_auc(spark, sf):
    return rounded(M.roc_auc(raw(spark, sf), CELL), "auc")


@plan("pr_auc", f"WITH {RAW}, {curve_sql('raw', C)}, {AP(C)} SELECT config, model, {R('pr_auc')} FROM ap")
def pr_auc(spark, sf):
    return rounded(M.average_precision(raw(spark, sf), CELL), "pr_auc")


@plan("brier", f"WITH {RAW}, {BRIER('raw', C)} SELECT config, model, {R('brier', 'brier_skill')} FROM br")
def brier(spark, sf):
    return rounded(M.brier(raw(spark, sf), CELL), "brier", "brier_skill")


@plan("ece", f"WITH {RAW}, {ECE('raw', C)} SELECT config, model, {R('ece')} FROM ec")
def ece(spark, sf):
    return rounded(M.ece(raw(spark, sf), CELL), "ece")


@plan("separates_perfectly", f"WITH {RAW} SELECT config, model, coalesce(max(p) FILTER (WHERE y = 0) < min(p) FILTER (WHERE y = 1) OR max(p) FILTER (WHERE y = 1) < min(p) FILTER (WHERE y = 0), false) AS separates FROM raw GROUP BY ALL")
def separates_perfectly(spark, sf):
    return M.separation(raw(spark, sf), CELL)


def newton_sql(source: str, keys: str, name: str = "fit") -> str:
    """Slope and intercept of each group as columns of <name>: 60 scaled Newton steps as recursive queries."""
    same = f"USING ({keys})"
    step = lambda x: f"{x} * least(1.0, 10.0 / greatest(abs(da), abs(db), 1e-300))"
    sums = "sum(pos - n * mu) AS g0, sum((pos - n * mu) * lp) AS g1, sum(n * mu * (1 - mu)) AS h00, sum(n * mu * (1 - mu) * lp) AS h01, sum(n * mu * (1 - mu) * lp * lp) AS h11"

    def walk(of: str, da: str, db: str) -> str:
        return f"""{of}(k, {keys}, a, b) AS (SELECT 0, {keys}, 0.0::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT {keys} FROM {name}_x)
      UNION ALL SELECT k + 1, {keys}, a + {step('da')}, b + {step('db')} FROM (SELECT *, {da} AS da, {db} AS db FROM (SELECT k, {keys}, a, b, {sums}
        FROM (SELECT {of}.*, lp, pos, n, 1 / (1 + exp(-(a + b * lp))) AS mu FROM {of} JOIN {name}_x {same} WHERE k < 60) GROUP BY k, {keys}, a, b)))"""

    return f"""{name}_x AS (SELECT {keys}, ln(p / (1 - p)) AS lp, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM (SELECT {keys}, y, greatest(1e-6, least(1 - 1e-6, p)) AS p FROM {source}) GROUP BY ALL),
    {walk(f'{name}_s', '(h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01)', '(h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)')}, {walk(f'{name}_i', 'greatest(-10.0, least(10.0, g0 / h00))', '0.0')},
    {name} AS (SELECT {keys}, s.b AS slope, i.a AS intercept FROM {name}_s s JOIN {name}_i i {same} WHERE s.k = 60 AND i.k = 60)"""


def bag_sql(source: str, keys: str, screening: str, bins: int = 10) -> str:
    """Every metric of each group, as all_metrics names them."""
    on = f"USING ({keys})"
    return f"""{rates_sql(source, keys, '0.5')}, {rates_sql(source, keys, screening, 'screening')}, {auc_sql(source, keys)}, {curve_sql(source, keys)}, {AP(keys)}, {BRIER(source, keys)}, {ECE(source, keys, bins)}, {newton_sql(source, keys)},
    bag AS (SELECT *, tp + fp + tn + fn AS n, tp + fn AS n_positive FROM full_rates JOIN full_screening {on} JOIN aucs {on} JOIN ap {on} JOIN br {on} JOIN ec {on} JOIN fit {on})"""


NAMES = ["auc", "pr_auc", "brier", "brier_skill", "ece", *RATES, *[f"screening_{r}" for r in RATES]]
BAG = "n, n_positive, " + ", ".join(f"{f}{c}" for f in ("", "screening_") for c in M.CELLS) + f", {R(*NAMES)}, round(slope, 6) AS slope, round(intercept, 6) AS intercept"


def bag(df, keys, screening, bins=10):
    """Every metric of each group, at 0.5 and at the group's screening threshold."""
    out = M.all_metrics(df.withColumn("_t", screening), keys, F.lit(0.5), {"screening": F.col("_t")}, bins)
    return rounded(out, *NAMES).withColumns({n: F.round(n, 6) for n in ("slope", "intercept")})


def mean_cut(df, keys):
    """df with c, the mean of cut over each group."""
    df = written(df, "rows")
    return df.join(df.groupBy(*keys).agg(F.round(F.avg("cut"), 9).alias("c")), keys)


WITH_CUT = lambda s, k: f"src AS (SELECT *, round(avg(cut) OVER (PARTITION BY {k}), 9) AS c FROM {s})"


@plan("all_metrics", f"WITH RECURSIVE {POOL}, {WITH_CUT('pooled', C)}, {bag_sql('src', C, 'c')} SELECT {C}, {BAG} FROM bag")
def all_metrics(spark, sf):
    return bag(mean_cut(pooled(preds(spark, sf)), CELL), CELL, F.col("c"))


@plan("metric_labels", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{M.LABELS[n]}', {n not in M.LOWER_IS_BETTER})" for i, n in enumerate(M.HEADLINE)) + ") AS t(place, metric, label, higher_is_better)")
def metric_labels(spark, sf):
    """The headline metrics in their order, with the names that reports use."""
    rows = [(i, n, M.LABELS[n], n not in M.LOWER_IS_BETTER) for i, n in enumerate(M.HEADLINE)]
    return spark.createDataFrame(rows, "place int, metric string, label string, higher_is_better boolean")


@plan("roc_curve", f"WITH {RAW}, {curve_sql('raw', C)} SELECT config, model, p, round(tp / all_pos, 9) AS tpr, round(fp / all_neg, 9) AS fpr FROM crv")
def roc_curve(spark, sf):
    return M.curve(raw(spark, sf), CELL).select(*CELL, "p", F.round(F.col("tp") / F.col("all_pos"), 9).alias("tpr"), F.round(F.col("fp") / F.col("all_neg"), 9).alias("fpr"))


@plan("pr_curve", f"WITH {RAW}, {curve_sql('raw', C)} SELECT config, model, p, round(tp / (tp + fp), 9) AS precision, round(tp / all_pos, 9) AS recall FROM crv")
def pr_curve(spark, sf):
    return M.curve(raw(spark, sf), CELL).select(*CELL, "p", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(F.col("tp") / F.col("all_pos"), 9).alias("recall"))


@plan("target_sensitivity_threshold", f"WITH {RAW}, {curve_sql('raw', C)} SELECT config, model, CASE WHEN max(all_pos) = 0 THEN 0.5 ELSE coalesce(max(p) FILTER (WHERE tp >= all_pos * 0.9::DOUBLE), 0.0) END AS threshold FROM crv GROUP BY ALL")
def target_sensitivity_threshold(spark, sf):
    return M.reach_sensitivity(raw(spark, sf), CELL)


@plan("youden_threshold", f"WITH {RAW}, {curve_sql('raw', C)} SELECT config, model, threshold FROM (SELECT config, model, CASE WHEN j > 0 THEN p ELSE 0.0 END AS threshold, row_number() OVER (PARTITION BY config, model ORDER BY j DESC, p) AS rn FROM (SELECT *, round(tp / all_pos - fp / all_neg, 12) AS j FROM crv)) WHERE rn = 1")
def youden_threshold(spark, sf):
    return M.youden(raw(spark, sf), CELL)


def grid_sql(n: int) -> str:
    return f"""grd AS (SELECT config, model, t, count(*) FILTER (WHERE y = 1 AND p >= t) AS tp, count(*) FILTER (WHERE y = 0 AND p >= t) AS fp, count(*) FILTER (WHERE y = 0 AND p < t) AS tn, count(*) FILTER (WHERE y = 1 AND p < t) AS fn
      FROM pooled, (SELECT i / {n}.0::DOUBLE AS t FROM range(1, {n}) r(i)) GROUP BY config, model, t)"""


@plan("net_benefit", f"WITH {POOL}, {grid_sql(20)} SELECT config, model, t, round(tp / n - fp / n * t / (1 - t), 9) AS net_benefit, round(prev - (1 - prev) * t / (1 - t), 9) AS treat_all FROM (SELECT *, (tp + fp + tn + fn)::DOUBLE AS n, (tp + fn) / (tp + fp + tn + fn)::DOUBLE AS prev FROM grd)")
def net_benefit(spark, sf):
    out = M.net_benefit(M.at_thresholds(scores(spark, sf), CELL, 20))
    return rounded(out.select(*CELL, "t", "net_benefit", "treat_all"), "net_benefit", "treat_all")


@plan("threshold_tradeoff", f"WITH {POOL}, {grid_sql(100)} SELECT config, model, t, CAST(fn AS BIGINT) AS missed, CAST(tp + fp AS BIGINT) AS referred, round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS sensitivity, round(tn / nullif(tn + fp, 0)::DOUBLE, 9) AS specificity FROM grd")
def threshold_tradeoff(spark, sf):
    out = M.rates(M.at_thresholds(scores(spark, sf), CELL, 100))
    return rounded(out.select(*CELL, "t", F.col("fn").cast("long").alias("missed"), (F.col("tp") + F.col("fp")).cast("long").alias("referred"), "sensitivity", "specificity"), "sensitivity", "specificity")


@plan("confusion_operating_points", f"WITH {POOL}, pts AS (SELECT *, 0.5::DOUBLE AS c, 'primary' AS point FROM pooled UNION ALL SELECT *, avg(cut) OVER (PARTITION BY config, model) AS c, 'screening' AS point FROM pooled), {rates_sql('pts', 'config, model, point', 'round(c, 9)')} SELECT config, model, point, tp, fp, tn, fn FROM full_rates")
def confusion_operating_points(spark, sf):
    p = pooled(preds(spark, sf))
    mean = p.groupBy(*CELL).agg(F.round(F.avg("cut"), 9).alias("c"))
    at = p.withColumn("c", F.lit(0.5)).withColumn("point", F.lit("primary")).unionByName(p.join(mean, CELL).withColumn("point", F.lit("screening")))
    return M.threshold_metrics(at, [*CELL, "point"], F.col("c")).select(*CELL, "point", "tp", "fp", "tn", "fn")


REP = "config, model, repeat"


@plan("metrics_per_repeat", f"WITH RECURSIVE {PREDS}, {WITH_CUT('preds', REP)}, {bag_sql('src', REP, 'c')} SELECT {REP}, {BAG} FROM bag")
def metrics_per_repeat(spark, sf):
    keys = [*CELL, "repeat"]
    return bag(mean_cut(preds(spark, sf), keys), keys, F.col("c"))


FOLD = "config, model, repeat, fold"


@plan("metrics_per_fold", f"WITH RECURSIVE {PREDS}, {bag_sql('preds', FOLD, 'cut', 5)} SELECT {FOLD}, {BAG} FROM bag")
def metrics_per_fold(spark, sf):
    return bag(preds(spark, sf), [*CELL, "repeat", "fold"], F.col("cut"), 5)


STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@plan("summarise_across_repeats", f"WITH {RAW}, {auc_sql('raw', REP)}, {BRIER('raw', REP)} SELECT config, model, " + ", ".join(f"round({f}({m}), 9) AS {m}__{n}" for m in ("auc", "brier") for n, f in STATS.items()) + f" FROM aucs JOIN br USING ({REP}) GROUP BY config, model")
def summarise_across_repeats(spark, sf):
    keys, df = [*CELL, "repeat"], raw(spark, sf)
    both = M.roc_auc(df, keys).join(M.brier(df, keys), keys)
    return both.groupBy(*CELL).agg(*[F.round(getattr(F, f)(m), 9).alias(f"{m}__{n}") for m in ("auc", "brier") for n, f in STATS.items()])


@plan("calibration_curve", f"""WITH {POOL}, e AS (SELECT config, model, list_sort(list_distinct(quantile_cont(p, [{', '.join(str(i / 10) for i in range(11))}]))) AS edges FROM pooled GROUP BY ALL),
  b AS (SELECT config, model, greatest(0, least(len(edges) - 2, len(list_filter(edges, lambda x: x <= p)) - 1)) AS bin, count(*)::DOUBLE AS n, avg(p) AS mean_p, sum(y) / count(*)::DOUBLE AS o FROM pooled JOIN e USING (config, model) GROUP BY 1, 2, 3)
  SELECT config, model, CAST(bin AS BIGINT) AS bin, CAST(n AS BIGINT) AS n, round(mean_p, 9) AS mean_p, round(o, 9) AS observed,
    round(greatest(0.0, (o + 3.8416 / (2 * n) - 1.96 * sqrt(o * (1 - o) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 9) AS low, round(least(1.0, (o + 3.8416 / (2 * n) + 1.96 * sqrt(o * (1 - o) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 9) AS high FROM b""")
def calibration_curve(spark, sf):
    return rounded(M.calibration_curve(written(scores(spark, sf), "rows"), CELL), "mean_p", "observed", "low", "high")


@plan("calibration_curve_width", f"WITH {POOL} SELECT config, model, least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS observed FROM pooled GROUP BY ALL")
def calibration_curve_width(spark, sf):
    return rounded(M.calibration_curve(scores(spark, sf), CELL, equal="width").drop("low", "high"), "mean_p", "observed")


@plan("logit_expit", f"WITH {RAW} SELECT sample, repeat, round(ln(p / (1 - p)), 9) AS lp, round(1 / (1 + exp(-ln(p / (1 - p)))), 9) AS back FROM raw")
def logit_expit(spark, sf):
    lp = M.logit(F.col("p"))
    return raw(spark, sf).select("sample", "repeat", F.round(lp, 9).alias("lp"), F.round(M.expit(lp), 9).alias("back"))


#: Outcomes drawn from the predictions themselves, for which the recalibration is near the identity.
DRAWN = "drawn AS (SELECT config, model, repeat, p, CAST(CAST('0x' || substr(md5('y:' || sample || ':' || repeat), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < p AS INTEGER) AS y FROM raw)"


def drawn(spark, sf):
    return raw(spark, sf).withColumn("y", (rng.uniform("y", F.col("sample"), F.col("repeat")) < F.col("p")).cast("int"))


@plan("calibration_slope", f"WITH RECURSIVE {RAW}, {DRAWN}, {newton_sql('drawn', C)} SELECT config, model, round(slope, 6) AS slope FROM fit")
def calibration_slope(spark, sf):
    return M.calibration(drawn(spark, sf), CELL).select(*CELL, F.round("slope", 6).alias("slope"))


@plan("calibration_intercept", f"WITH RECURSIVE {RAW}, {DRAWN}, {newton_sql('drawn', C)} SELECT config, model, round(intercept, 6) AS intercept FROM fit")
def calibration_intercept(spark, sf):
    return M.calibration(drawn(spark, sf), CELL).select(*CELL, F.round("intercept", 6).alias("intercept"))


@plan("calibration_per_repeat", f"WITH RECURSIVE {RAW}, {DRAWN}, {newton_sql('drawn', REP)} SELECT config, model, " + ", ".join(f"round({f}({m}), 6) AS {m}_{n}" for m in ("slope", "intercept") for n, f in (("median", "median"), ("min", "min"), ("max", "max"))) + ", count(*) FILTER (WHERE slope IS NULL) AS undefined FROM fit GROUP BY ALL")
def calibration_per_repeat(spark, sf):
    fit = M.calibration(drawn(spark, sf), [*CELL, "repeat"])
    per = [F.round(getattr(F, f)(m), 6).alias(f"{m}_{f}") for m in ("slope", "intercept") for f in ("median", "min", "max")]  # of five repeats
    return fit.groupBy(*CELL).agg(*per, F.count_if(F.col("slope").isNull()).alias("undefined"))


#: The offset at which the mean is 0.2, by Newton steps.
OFFSET = """ox AS (SELECT config, model, ln(p / (1 - p)) AS lp, count(*)::DOUBLE AS n FROM pooled GROUP BY ALL),
  oit(k, config, model, c) AS (SELECT 0, config, model, 0.0::DOUBLE FROM (SELECT DISTINCT config, model FROM ox) UNION ALL SELECT k + 1, config, model, c + greatest(-2.0, least(2.0, (0.2 * sum(n) - sum(n * mu)) / sum(n * mu * (1 - mu))))
    FROM (SELECT oit.*, n, 1 / (1 + exp(-(c + lp))) AS mu FROM oit JOIN ox USING (config, model) WHERE k < 25) GROUP BY k, config, model, c)"""


@plan("recalibrate_intercept", f"WITH RECURSIVE {POOL}, {OFFSET} SELECT config, model, round(c, 6) AS offset FROM oit WHERE k = 25")
def recalibrate_intercept(spark, sf):
    return M.recalibrated_offset(scores(spark, sf), CELL, 0.2).select(*CELL, F.round("offset", 6).alias("offset"))


@plan("stratified_kfold", f"WITH {PREDS} SELECT sample, repeat, y, fold FROM preds")
def stratified_kfold(spark, sf):
    return folded(raw(spark, sf)).select("sample", "repeat", "y", "fold")


GROUPS = f"""g AS (SELECT repeat, grp, CAST(2 * sum(y) > count(*) AS INTEGER) AS y FROM raw GROUP BY 1, 2),
  gf AS (SELECT repeat, grp, CAST((row_number() OVER (PARTITION BY repeat, y ORDER BY md5('fold:' || repeat || ':' || grp), grp) - 1) % {FOLDS} AS INTEGER) AS fold FROM g)"""


@plan("stratified_group_kfold", f"WITH {RAW}, {GROUPS} SELECT sample, repeat, grp, fold FROM raw JOIN gf USING (repeat, grp)")
def stratified_group_kfold(spark, sf):
    df = raw(spark, sf)
    groups = df.groupBy("repeat", "grp").agg((2 * F.sum("y") > F.count("*")).cast("int").alias("y"))
    folds = folded(groups.withColumnRenamed("grp", "sample")).select("repeat", F.col("sample").alias("grp"), "fold")
    return df.join(folds, ["repeat", "grp"]).select("sample", "repeat", "grp", "fold")


@plan("integrity_checks", f"WITH {PREDS} SELECT config, model, repeat, count(*) AS n, CAST(count(*) - count(DISTINCT sample) AS BIGINT) AS repeated, count(*) FILTER (WHERE p < 0 OR p > 1) AS outside FROM preds GROUP BY ALL")
def integrity_checks(spark, sf):
    return preds(spark, sf).groupBy(*CELL, "repeat").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("sample")).alias("repeated"), F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("outside"))


@plan("one_label_per_sample", f"WITH {RAW} SELECT count(*) AS samples, count(*) FILTER (WHERE hi <> lo) AS contradicted FROM (SELECT sample, min(y) AS lo, max(y) AS hi FROM (SELECT sample, CASE WHEN sample % 50 = 0 AND repeat = 1 THEN 1 - y ELSE y END AS y FROM raw) GROUP BY 1)")
def one_label_per_sample(spark, sf):
    """Samples whose predictions do not all have the same label (every fiftieth has been given another in one repeat)."""
    y = F.when((F.col("sample") % 50 == 0) & (F.col("repeat") == 1), 1 - F.col("y")).otherwise(F.col("y"))
    per = raw(spark, sf).select("sample", y.alias("y")).groupBy("sample").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return per.agg(F.count("*").alias("samples"), F.count_if(F.col("hi") != F.col("lo")).alias("contradicted"))


@plan("label_variants", f"WITH {RAW} SELECT sample, repeat, CASE WHEN y = 1 AND stratum = 'click' THEN 0 ELSE y END AS flipped, (y = 1 AND stratum = 'click') AS excluded FROM raw")
def label_variants(spark, sf):
    hit = (F.col("y") == 1) & (F.col("stratum") == "click")
    return raw(spark, sf).select("sample", "repeat", F.when(hit, 0).otherwise(F.col("y")).alias("flipped"), hit.alias("excluded"))


VAR = f"v AS (SELECT config, model, 'primary' AS variant, y, p FROM raw UNION ALL SELECT config, model, 'flipped', CASE WHEN stratum = 'click' THEN 0 ELSE y END, p FROM raw UNION ALL SELECT config, model, 'excluded', y, p FROM raw WHERE stratum <> 'click')"


def variant_aucs(spark, sf):
    """(config, model, variant, auc) with the labels as they are, with clicks as controls and without clicks."""
    df = tallied(raw(spark, sf), "stratum")
    click = F.col("stratum") == "click"
    variant = lambda d, name: d.select(*CELL, F.lit(name).alias("variant"), "y", "p", "w")
    every = variant(df, "primary").union(variant(df.withColumn("y", F.when(click, 0).otherwise(F.col("y"))), "flipped")).union(variant(df.where(~click), "excluded"))
    return M.roc_auc(every, [*CELL, "variant"], F.col("w"))


@plan("label_robustness", f"WITH {RAW}, {VAR}, {auc_sql('v', 'config, model, variant')} SELECT a.config, a.model, a.variant, round(a.auc, 9) AS auc, round(a.auc - b.auc, 9) AS delta FROM aucs a JOIN aucs b ON a.config = b.config AND a.model = b.model AND b.variant = 'primary' WHERE a.variant <> 'primary'")
def label_robustness(spark, sf):
    auc = written(variant_aucs(spark, sf), "aucs")
    base = auc.where("variant = 'primary'").select(*CELL, F.col("auc").alias("base"))
    return auc.where("variant != 'primary'").join(base, CELL).select(*CELL, "variant", F.round("auc", 9).alias("auc"), F.round(F.col("auc") - F.col("base"), 9).alias("delta"))


@plan("task_grid", f"WITH {RAW} SELECT a.config, b.model, c.repeat FROM (SELECT DISTINCT config FROM raw) a, (SELECT DISTINCT model FROM raw) b, (SELECT DISTINCT repeat FROM raw) c")
def task_grid(spark, sf):
    df = raw(spark, sf)
    return df.select("config").distinct().crossJoin(df.select("model").distinct()).crossJoin(df.select("repeat").distinct())  # dimensions of a few rows


@plan("argmax_per_group", f"WITH {RAW}, {auc_sql('raw', C)}, {BRIER('raw', C)} SELECT config, model, round(auc, 9) AS auc FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY round(auc, 9) DESC, round(brier, 9), model) AS rn FROM aucs JOIN br USING (config, model)) WHERE rn = 1")
def argmax_per_group(spark, sf):
    df = raw(spark, sf)
    both = rounded(M.roc_auc(df, CELL).join(M.brier(df, CELL), CELL), "auc", "brier")
    best = both.withColumn("rn", F.row_number().over(Window.partitionBy("config").orderBy(F.desc("auc"), "brier", "model")))  # one row per model
    return best.where("rn = 1").select("config", "model", "auc")


@plan("leakage_audit", f"WITH {RAW}, {auc_sql('raw', C)}, best AS (SELECT config, max(round(auc, 9)) AS auc FROM aucs GROUP BY config) SELECT a.config, a.auc, round(a.auc - b.auc, 9) AS inflation, round((a.auc - b.auc) / (1 - b.auc), 9) AS share FROM best a, best b WHERE b.config = 'f0'")
def leakage_audit(spark, sf):
    best = rounded(M.roc_auc(raw(spark, sf), CELL), "auc").groupBy("config").agg(F.max("auc").alias("auc"))
    base = best.where("config = 'f0'").select(F.col("auc").alias("base"))
    return best.crossJoin(base).select("config", "auc", F.round(F.col("auc") - F.col("base"), 9).alias("inflation"), F.round((F.col("auc") - F.col("base")) / (1 - F.col("base")), 9).alias("share"))


OPT = ["auc", "brier", "sensitivity"]


@plan("optimism", f"WITH {PREDS}, {rates_sql('preds', C, '0.5')}, {auc_sql('preds', C)}, {BRIER('preds', C)}, one AS (SELECT * FROM full_rates JOIN aucs USING ({C}) JOIN br USING ({C})), {rates_sql('preds', FOLD, '0.5', 'folds')}, {auc_sql('preds', FOLD, 'fauc')}, fbr AS (SELECT {FOLD}, avg((p - y) * (p - y)) AS brier FROM preds GROUP BY ALL), nested AS (SELECT {C}, avg(auc) AS n_auc, avg(brier) AS n_brier, avg(folds_sensitivity) AS n_sensitivity FROM full_folds JOIN fauc USING ({FOLD}) JOIN fbr USING ({FOLD}) GROUP BY ALL) SELECT {C}, " + ", ".join(f"round({m} - n_{m}, 9) AS {m}_optimism" for m in OPT) + f" FROM one JOIN nested USING ({C})")
def optimism(spark, sf):
    df = preds(spark, sf)
    of = lambda keys: M.all_metrics(df, keys, F.lit(0.5)).select(*keys, *OPT)
    nested = of([*CELL, "repeat", "fold"]).groupBy(*CELL).agg(*[F.avg(m).alias(f"n_{m}") for m in OPT])
    return of(CELL).join(nested, CELL).select(*CELL, *[F.round(F.col(m) - F.col(f"n_{m}"), 9).alias(f"{m}_optimism") for m in OPT])


@plan("ceiling_analysis", f"WITH {RAW}, {auc_sql('raw', C)}, m AS (SELECT config, min(round(auc, 9)) AS low, max(round(auc, 9)) AS high FROM aucs GROUP BY config) SELECT config, low, high, CASE WHEN 1 - low > 1e-9 THEN round((high - low) / (1 - low), 9) END AS closed FROM m")
def ceiling_analysis(spark, sf):
    m = rounded(M.roc_auc(raw(spark, sf), CELL), "auc").groupBy("config").agg(F.min("auc").alias("low"), F.max("auc").alias("high"))
    return m.withColumn("closed", F.when(1 - F.col("low") > 1e-9, F.round((F.col("high") - F.col("low")) / (1 - F.col("low")), 9)))


@plan("paired_comparison", f"WITH {RAW}, {auc_sql('raw', REP)}, w AS (SELECT model, repeat, round(max(auc) FILTER (WHERE config = 'f1') - max(auc) FILTER (WHERE config = 'f0'), 9) AS d FROM aucs GROUP BY ALL) SELECT model, count(*) FILTER (WHERE d > 0) AS wins, round(median(d), 9) AS median_delta, round(avg(d), 9) AS mean_delta FROM w GROUP BY model")
def paired_comparison(spark, sf):
    auc = M.roc_auc(raw(spark, sf), [*CELL, "repeat"]).groupBy("model", "repeat").pivot("config", ["f0", "f1"]).agg(F.first("auc"))
    d = auc.withColumn("d", F.round(F.col("f1") - F.col("f0"), 9))
    return d.groupBy("model").agg(F.count_if(F.col("d") > 0).alias("wins"), F.round(F.median("d"), 9).alias("median_delta"), F.round(F.avg("d"), 9).alias("mean_delta"))


@plan("median_iqr", f"WITH {RAW} SELECT config, model, round(median(p), 9) AS median, round(quantile_cont(p, 0.75) - quantile_cont(p, 0.25), 9) AS iqr, count(*) FILTER (WHERE p IS NULL) AS undefined FROM raw GROUP BY ALL")
def median_iqr(spark, sf):
    df = raw(spark, sf)
    q = quantiles(df, CELL, "p", [0.25, 0.5, 0.75], "q")
    undefined = df.groupBy(*CELL).agg(F.count_if(F.col("p").isNull()).alias("undefined"))
    return undefined.join(q, CELL, "left").select(*CELL, F.round(F.col("q")[1], 9).alias("median"), F.round(F.col("q")[2] - F.col("q")[0], 9).alias("iqr"), "undefined")


@plan("headline_wide", f"WITH {RAW}, {auc_sql('raw', REP)}, {BRIER('raw', REP)}, m AS (SELECT config, model, 'auc' AS metric, auc AS v FROM aucs UNION ALL SELECT config, model, 'brier', brier FROM br) SELECT config, model, metric, round(avg(v), 9) AS est, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi, round(stddev_samp(v), 9) AS sd FROM m GROUP BY ALL")
def headline_wide(spark, sf):
    keys, df = [*CELL, "repeat"], raw(spark, sf)
    both = M.roc_auc(df, keys).join(M.brier(df, keys), keys)
    long = both.unpivot(keys, ["auc", "brier"], "metric", "v")
    return long.groupBy(*CELL, "metric").agg(F.round(F.avg("v"), 9).alias("est"), F.round(F.percentile("v", 0.025), 9).alias("lo"), F.round(F.percentile("v", 0.975), 9).alias("hi"), F.round(F.stddev_samp("v"), 9).alias("sd"))
