"""Queries that resample, standardise and compare rankings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sondage.functions import rng
from sondage.operators import bootstrap as B
from sondage.operators import metrics as M
from sondage.operators import resample as S
from sondage.operators.ranks import numbered, quantiles
from sondage.plans import plan
from sondage.plans.evaluation import auc_sql
from sondage.plans.views import CELL, POOL, RAW, cuts, raw, scores
from sondage.session import table
from sondage.sources.files import written

C, DRAWS, CHECKPOINTS = "config, model", 2000, [100, 200, 500, 1000]
#: The draws of operators.bootstrap for groups of one block, which all cells of the tables that DuckDB reads are.
BOOT = f"""{POOL}, src AS (SELECT *, round(avg(cut) OVER (PARTITION BY {C}), 9) AS c FROM pooled),
  num AS (SELECT {C}, y, p, row_number() OVER (PARTITION BY {C}, y ORDER BY p, sample) - 1 AS slot FROM src),
  sizes AS (SELECT {C}, y, count(*) AS size FROM src GROUP BY ALL),
  sd AS (SELECT *, {rng.seed_sql("'boot:' || config || ':' || model || ':' || y || ':0:' || draw")} FROM sizes, (SELECT unnest(range(0, {DRAWS})) AS draw)),
  drw AS (SELECT {C}, y, draw, slot, count(*)::DOUBLE AS w FROM ({rng.positions_sql('(SELECT *, unnest(range(0, size)) AS j FROM sd)', f'{C}, y, draw', 'j', 'size', 'slot')}) GROUP BY ALL),
  sc AS (SELECT {C}, draw, p, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS neg FROM drw JOIN num USING ({C}, y, slot) GROUP BY ALL),
  cum AS (SELECT *, sum(pos) OVER (PARTITION BY {C}, draw ORDER BY p DESC) AS tps, sum(neg) OVER (PARTITION BY {C}, draw ORDER BY p DESC) AS fps, sum(pos) OVER (PARTITION BY {C}, draw) AS np, sum(neg) OVER (PARTITION BY {C}, draw) AS nn FROM sc),
  cuts AS (SELECT {C}, min(c) AS c FROM src GROUP BY ALL),
  raw_bts AS (SELECT {C}, draw, max(np) AS np, max(nn) AS nn, sum(pos * (nn - fps + neg / 2)) / (max(np) * max(nn)) AS auc, sum(pos / np * tps / (tps + fps)) AS pr_auc, sum(pos * (1 - p) * (1 - p) + neg * p * p) / (max(np) + max(nn)) AS brier,
    sum(CASE WHEN p >= 0.5 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 THEN neg ELSE 0 END) AS fp, sum(CASE WHEN p >= c THEN pos ELSE 0 END) AS stp, sum(CASE WHEN p >= c THEN neg ELSE 0 END) AS sfp FROM cum JOIN cuts USING ({C}) GROUP BY {C}, draw),
  gap AS (SELECT {C}, draw, sum(abs(g)) / sum(n) AS ece FROM (SELECT {C}, draw, least(floor(p * 10), 9) AS b, sum(pos - (pos + neg) * p) AS g, sum(pos + neg) AS n FROM sc GROUP BY ALL) GROUP BY ALL),
  bts AS (SELECT {C}, draw, auc, pr_auc, brier, 1 - brier / (np / (np + nn) * nn / (np + nn)) AS brier_skill, ece, {{rates}} FROM raw_bts JOIN gap USING ({C}, draw))"""


def _rates(tp: str, fp: str, mark: str) -> str:
    sens, spec, prec = f"({tp} / np)", f"((nn - {fp}) / nn)", f"({tp} / nullif({tp} + {fp}, 0))"
    each = {
        "sensitivity": sens, "specificity": spec, "precision": prec, "npv": f"(nn - {fp}) / nullif(nn - {fp} + np - {tp}, 0)", "accuracy": f"({tp} + nn - {fp}) / (np + nn)",
        "f1": f"CASE WHEN {sens} + {prec} > 0 THEN 2 * {sens} * {prec} / ({sens} + {prec}) ELSE 0.0 END", "balanced_accuracy": f"({sens} + {spec}) / 2",
    }
    return ", ".join(f"{v} AS {mark}{k}" for k, v in each.items())


BOOT = BOOT.replace("{rates}", f"{_rates('tp', 'fp', '')}, {_rates('stp', 'sfp', 'screening_')}")
LONG = lambda names: f"(UNPIVOT bts ON {', '.join(names)} INTO NAME metric VALUE value)"
#: Metrics that are followed over growing numbers of draws.
FOLLOWED = ["auc", "brier", "sensitivity"]


def source(spark, sf):
    return scores(spark, sf)


def rnd(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def boot(spark, sf):
    """Draws of all metrics. The cuts come by themselves, a row a cell, so that no fold meets a score."""
    return B.bootstrap_metrics(source(spark, sf).select(*CELL, "y", "p").join(written(cuts(spark, sf), "cuts"), CELL), CELL, DRAWS, 0.5, F.col("c"))


def uncut(df):
    """Draws of boot(), of which only metrics without `screening_` count: these need no cut, and so no folds."""
    return B.bootstrap_metrics(df.select(*CELL, "y", "p").na.drop(subset=CELL), CELL, DRAWS)


@plan("stratified_bootstrap_draws", f"WITH {BOOT} SELECT {C}, CAST(draw AS INTEGER) AS draw, " + ", ".join(f"round({m}, 9) AS {m}" for m in B.METRICS) + " FROM bts")
def stratified_bootstrap_draws(spark, sf):
    return rnd(boot(spark, sf), *B.METRICS)


@plan("bootstrap_ci", f"WITH {BOOT} SELECT {C}, metric, round(quantile_cont(value, 0.025), 9) AS lo, round(quantile_cont(value, 0.975), 9) AS hi, round(stddev_samp(value), 9) AS se, count(value) AS n_draws FROM {LONG(B.METRICS)} GROUP BY ALL")
def bootstrap_ci(spark, sf):
    return rnd(B.intervals(boot(spark, sf), CELL), "lo", "hi", "se")


@plan("bootstrap_checkpoints", f"WITH {BOOT} SELECT {C}, n, metric, round(quantile_cont(value, 0.025), 9) AS lo, round(quantile_cont(value, 0.975), 9) AS hi FROM {LONG(FOLLOWED)} JOIN (SELECT unnest({CHECKPOINTS}) AS n) c ON draw < n GROUP BY ALL")
def bootstrap_checkpoints(spark, sf):
    at = uncut(source(spark, sf)).withColumn("n", F.explode(F.array(*map(F.lit, CHECKPOINTS)))).where("draw < n")
    return rnd(B.intervals(at, [*CELL, "n"], FOLLOWED).select(*CELL, "n", "metric", "lo", "hi"), "lo", "hi")


SUBSETS = 50
GRID = f"grid AS (SELECT unnest({CHECKPOINTS}) AS n), rk AS (SELECT rep, draw, row_number() OVER (PARTITION BY rep ORDER BY md5('sub:' || rep || ':' || draw), draw) - 1 AS rk FROM (SELECT unnest(range(0, {SUBSETS})) AS rep), (SELECT unnest(range(0, {DRAWS})) AS draw))"


@plan("bootstrap_convergence", f"WITH {BOOT}, {GRID}, ends AS (SELECT {C}, n, rep, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi FROM bts JOIN rk USING (draw) JOIN grid ON rk < n GROUP BY ALL) SELECT {C}, n, round(avg(lo), 9) AS lo_mean, round(stddev_samp(lo), 9) AS lo_sd, round(avg(hi), 9) AS hi_mean, round(stddev_samp(hi), 9) AS hi_sd FROM ends GROUP BY ALL")
def bootstrap_convergence(spark, sf):
    """How far interval ends still move: their mean and deviation over random subsets of the draws."""
    every = spark.range(DRAWS).select(F.col("id").cast("int").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(SUBSETS - 1))).alias("rep"))
    order = Window.partitionBy("rep").orderBy(rng.hashed("sub", F.col("rep"), F.col("draw")), "draw")  # DRAWS rows
    ranks = every.withColumn("rk", F.row_number().over(order) - 1)
    at = ranks.withColumn("n", F.explode(F.array(*map(F.lit, CHECKPOINTS)))).where("rk < n").join(uncut(source(spark, sf)).select(*CELL, "draw", "auc"), "draw")
    ends = S.interval_of(at, [*CELL, "n", "rep"], "auc")
    return ends.groupBy(*CELL, "n").agg(*[F.round(f(e), 9).alias(f"{e}_{k}") for e in ("lo", "hi") for k, f in (("mean", F.avg), ("sd", F.stddev_samp))])


SPEC = "spc AS (SELECT config, model, sub, y, p FROM raw, (SELECT unnest(['all', 'click', 'purchase']) AS sub) WHERE y = 0 OR sub = 'all' OR sub = stratum)"


@plan("spectrum_analysis", f"WITH {RAW}, {SPEC}, {auc_sql('spc', 'config, model, sub')}, cnt AS (SELECT config, model, sub, sum(y)::BIGINT AS n_pos, count(*) - sum(y)::BIGINT AS n_neg FROM spc GROUP BY ALL) SELECT config, model, sub, n_pos, n_neg, round(auc, 9) AS auc FROM aucs JOIN cnt USING (config, model, sub) WHERE n_pos >= 3 AND n_neg >= 3")
def spectrum_analysis(spark, sf):
    subs = F.array(*map(F.lit, ("all", "click", "purchase")))
    df = raw(spark, sf).withColumn("sub", F.explode(subs)).where("y = 0 OR sub = 'all' OR sub = stratum")
    keys = [*CELL, "sub"]
    n = df.groupBy(*keys).agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg")).where("n_pos >= 3 AND n_neg >= 3")
    return rnd(M.roc_auc(df, keys).join(n, keys), "auc")


FEAT = """feat AS (SELECT c_custkey AS id, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS y, feature, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE x END AS x FROM
  (SELECT c_custkey, c_mktsegment, unnest(['acctbal', 'nation', 'key_mod']) AS feature, unnest([c_acctbal, c_nationkey::DOUBLE, (c_custkey % 97)::DOUBLE]) AS x FROM customer))"""
FAUC = f"{FEAT}, fx AS (SELECT feature, y, x AS p FROM feat WHERE x IS NOT NULL), {auc_sql('fx', 'feature')}"


def features(spark, sf):
    c = table(spark, sf, "customer")
    wide = c.select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_custkey") % 97).cast("double").alias("key_mod"))
    return wide.unpivot(["id", "y"], ["acctbal", "nation", "key_mod"], "feature", "x").withColumn("x", F.when(F.col("id") % 13 != 0, F.col("x")))


@plan("folded_auc", f"WITH {FAUC} SELECT feature, round(greatest(auc, 1 - auc), 9) AS auc FROM aucs")
def folded_auc(spark, sf):
    return S.single_predictors(features(spark, sf)).select("feature", F.round(S.folded(F.col("auc")), 9).alias("auc"))


@plan("best_single_predictor", f"WITH {FAUC} SELECT feature, round(greatest(auc, 1 - auc), 9) AS auc FROM aucs ORDER BY round(greatest(auc, 1 - auc), 9) DESC, feature LIMIT 1")
def best_single_predictor(spark, sf):
    return S.single_predictors(features(spark, sf)).select("feature", F.round(S.folded(F.col("auc")), 9).alias("auc")).orderBy(F.desc("auc"), "feature").limit(1)


@plan("separability_report", f"""WITH {FAUC}, e AS (SELECT feature, min(x) FILTER (WHERE y = 1) AS lo1, max(x) FILTER (WHERE y = 1) AS hi1, min(x) FILTER (WHERE y = 0) AS lo0, max(x) FILTER (WHERE y = 0) AS hi0 FROM feat WHERE x IS NOT NULL GROUP BY feature)
  SELECT feature, round(greatest(auc, 1 - auc), 9) AS auc, lo1, hi1, lo0, hi0, round(coalesce(greatest(0.0, least(hi0, hi1) - greatest(lo0, lo1)) / nullif(greatest(hi0, hi1) - least(lo0, lo1), 0), 1.0), 9) AS overlap, n_inside
  FROM e JOIN aucs USING (feature) JOIN (SELECT feature, count(*) AS n_inside FROM feat JOIN e USING (feature) WHERE x BETWEEN greatest(lo0, lo1) AND least(hi0, hi1) GROUP BY feature) USING (feature)""")
def separability_report(spark, sf):
    long = features(spark, sf).where("x IS NOT NULL")
    side = lambda f, v: f(F.when(F.col("y") == v, F.col("x")))
    e = long.groupBy("feature").agg(side(F.min, 1).alias("lo1"), side(F.max, 1).alias("hi1"), side(F.min, 0).alias("lo0"), side(F.max, 0).alias("hi0"))
    low, high = F.greatest("lo0", "lo1"), F.least("hi0", "hi1")
    overlap = F.coalesce(F.try_divide(F.greatest(F.lit(0.0), high - low), F.greatest("hi0", "hi1") - F.least("lo0", "lo1")), F.lit(1.0))
    inside = long.join(F.broadcast(e), "feature").where((F.col("x") >= low) & (F.col("x") <= high)).groupBy("feature").agg(F.count("*").alias("n_inside"))  # one row per feature
    auc = S.single_predictors(long).select("feature", F.round(S.folded(F.col("auc")), 9).alias("auc"))
    return e.join(auc, "feature").join(inside, "feature").select("feature", "auc", "lo1", "hi1", "lo0", "hi0", F.round(overlap, 9).alias("overlap"), "n_inside")


FOLDED = f"{FEAT}, fld AS (SELECT feat.*, repeat, CAST('0x' || substr(md5('nest:' || repeat || ':' || id), 1, 8) AS BIGINT) % 4 AS fold FROM feat, (SELECT unnest(range(0, 3)) AS repeat))"


@plan("nested_best_single", f"""WITH {FOLDED}, trn AS (SELECT repeat, k, feature, y, x AS p FROM fld, (SELECT unnest(range(0, 4)) AS k) WHERE fold <> k AND x IS NOT NULL), {auc_sql('trn', 'repeat, k, feature')},
  pick AS (SELECT repeat, k, feature, sign FROM (SELECT *, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS sign, row_number() OVER (PARTITION BY repeat, k ORDER BY round(greatest(auc, 1 - auc), 9) DESC, feature) AS rn FROM aucs) WHERE rn = 1)
  SELECT feature, sign, count(*) AS picks FROM pick GROUP BY 1, 2""")
def nested_best_single(spark, sf):
    return nested_picks(spark, sf)[1].groupBy("feature", "sign").agg(F.count("*").alias("picks"))


def nested_picks(spark, sf):
    """The training rows of each (repeat, k), the best feature of each and its sign, and all rows with their fold."""
    h = F.conv(F.substring(rng.hashed("nest", F.col("repeat"), F.col("id")), 1, 8), 16, 10).cast("long")
    df = features(spark, sf).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("fold", h % 4)
    train = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("fold != k")
    auc = S.single_predictors(train, ["repeat", "k"]).withColumns({"score": F.round(S.folded(F.col("auc")), 9), "sign": F.when(F.col("auc") >= 0.5, 1).otherwise(-1)})
    best = auc.withColumn("rn", F.row_number().over(Window.partitionBy("repeat", "k").orderBy(F.desc("score"), "feature"))).where("rn = 1")  # one row per feature
    return train, best.select("repeat", "k", "feature", "sign"), df


@plan("nested_best_single_auc")
def nested_best_single_auc(spark, sf):
    train, best, df = nested_picks(spark, sf)
    keys = ["repeat", "k", "feature", "sign"]
    middle = quantiles(train.join(best, keys[:3]), keys, "x", [0.5], "q").select(*keys, F.col("q")[0].alias("middle"))
    held = df.withColumnRenamed("fold", "k").join(middle, ["repeat", "k", "feature"])
    # A sample's score is the mean over the repeats.
    pooled_ = held.groupBy("id", "y").agg(F.avg(F.col("sign") * F.coalesce("x", "middle")).alias("score"))
    return M.roc_auc(pooled_.withColumnRenamed("score", "p").withColumn("pool", F.lit("out of fold")), ["pool"], any_range=True)


@plan("multivariable_lift", f"WITH {FAUC}, mm AS (SELECT c_custkey % 2 AS m, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS y, round(abs(c_acctbal) / 10000, 4) AS p FROM customer), {auc_sql('mm', 'm', 'model')} SELECT m, round(model.auc - (SELECT max(greatest(auc, 1 - auc)) FROM aucs), 9) AS lift FROM model")
def multivariable_lift(spark, sf):
    best = S.single_predictors(features(spark, sf)).agg(F.max(S.folded(F.col("auc"))).alias("best"))
    c = table(spark, sf, "customer")
    model = M.roc_auc(c.select((F.col("c_custkey") % 2).alias("m"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"), F.round(F.abs("c_acctbal") / 10000, 4).alias("p")), ["m"])
    return model.crossJoin(best).select("m", F.round(F.col("auc") - F.col("best"), 9).alias("lift"))


LIFT_DRAWS = 2000


def lift_draws(spark, sf, draws):
    """(m, draw, lift) on stratified resamples of the customers; both AUCs are of the same resample."""
    best = best_single_predictor(spark, sf).first()["feature"]  # one row
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2).alias("m"), F.round(F.abs("c_acctbal") / 10000, 4).alias("model"))
    rows = features(spark, sf).where(F.col("feature") == best).select("id", "y", F.col("x").alias("single"))
    arm = lambda name, p: F.struct(name.alias("arm"), F.col(p).alias("p"))
    aucs = S.drawn_aucs(rows.join(c, "id"), F.array(arm(F.col("m").cast("string"), "model"), arm(F.lit("single"), "single")), "id", draws)
    single = aucs.where("arm = 'single'").select("draw", S.folded(F.col("auc")).alias("single"))
    model = aucs.where("arm != 'single'").select(F.col("arm").cast("long").alias("m"), "draw", "auc")
    return model.join(single, "draw").select("m", "draw", (F.col("auc") - F.col("single")).alias("lift"))


@plan("multivariable_lift_interval")
def multivariable_lift_interval(spark, sf):
    return multivariable_lift(spark, sf).join(S.interval_of(lift_draws(spark, sf, LIFT_DRAWS), ["m"], "lift"), "m")


def wauc_sql(src: str) -> str:
    return f"ws AS (SELECT {C}, p, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS neg FROM {src} GROUP BY 1, 2, 3), wc AS (SELECT *, sum(neg) OVER (PARTITION BY {C} ORDER BY p) - neg AS below FROM ws), wa AS (SELECT {C}, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM wc GROUP BY {C})"


@plan("weighted_auc", f"WITH {RAW}, wsrc AS (SELECT *, (1 + sample % 3)::DOUBLE AS w FROM raw), {wauc_sql('wsrc')} SELECT {C}, round(auc, 9) AS auc FROM wa")
def weighted_auc(spark, sf):
    return rnd(M.roc_auc(raw(spark, sf), CELL, (1 + F.col("sample") % 3).cast("double")), "auc")


MIX = "mixt AS (SELECT unnest(['purchase', 'click']) AS stratum, unnest([0.8::DOUBLE, 0.2::DOUBLE]) AS target)"
STD = f"{MIX}, shr AS (SELECT stratum, count(*) / (SELECT count(*) FROM raw WHERE y = 1)::DOUBLE AS s FROM raw WHERE y = 1 GROUP BY 1), wsrc AS (SELECT raw.*, CASE WHEN y = 1 THEN coalesce(target, 0.0) / s ELSE 1.0::DOUBLE END AS w FROM raw LEFT JOIN mixt USING (stratum) LEFT JOIN shr USING (stratum))"


def standardised(spark, sf):
    mix = spark.createDataFrame([("purchase", 0.8), ("click", 0.2)], "stratum string, target double")
    return S.case_weights(raw(spark, sf), mix, "stratum")


@plan("standardised_auc", f"WITH {RAW}, {STD}, {wauc_sql('wsrc')}, ne AS (SELECT {C}, sum(w) * sum(w) / sum(w * w) AS n_eff FROM wsrc WHERE y = 1 GROUP BY {C}) SELECT {C}, round(auc, 9) AS auc, round(n_eff, 6) AS n_eff FROM wa JOIN ne USING ({C})")
def standardised_auc(spark, sf):
    df = standardised(spark, sf)
    n = df.where("y = 1").groupBy(*CELL).agg(F.round(S.kish(F.col("w")), 6).alias("n_eff"))
    return rnd(M.roc_auc(df, CELL, F.col("w")), "auc").join(n, CELL)


@plan("standardised_sensitivity", f"WITH {RAW}, {STD} SELECT {C}, round(sum(w) FILTER (WHERE p >= 0.5) / sum(w), 9) AS sensitivity FROM wsrc WHERE y = 1 GROUP BY {C}")
def standardised_sensitivity(spark, sf):
    return standardised(spark, sf).where("y = 1").groupBy(*CELL).agg(F.round(F.sum(F.when(F.col("p") >= 0.5, F.col("w"))) / F.sum("w"), 9).alias("sensitivity"))


SAT = "sat AS (SELECT c_nationkey AS k, f, round(0.5 + 0.4 * (1 - exp(-f * (1 + c_nationkey % 5))), 6) AS score FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85, 1.0]) AS f))"


def saturation(spark, sf):
    f = F.explode(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85, 1.0)]))
    k = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).distinct().withColumn("f", f)
    return k.withColumn("score", F.round(0.5 + 0.4 * (1 - F.exp(-F.col("f") * (1 + F.col("k") % 5))), 6))


@plan("fraction_to_reach", f"WITH {SAT}, t AS (SELECT *, max(score) OVER (PARTITION BY k) AS top FROM sat) SELECT k, min(f) FILTER (WHERE top > 0.5 AND score >= 0.5 + 0.9 * (top - 0.5) - 1e-9) AS fraction FROM t GROUP BY k")
def fraction_to_reach(spark, sf):
    s = saturation(spark, sf)
    top = s.groupBy("k").agg(F.max("score").alias("top"))
    hit = (F.col("top") > 0.5) & (F.col("score") >= 0.5 + 0.9 * (F.col("top") - 0.5) - 1e-9)
    return s.join(top, "k").groupBy("k").agg(F.min(F.when(hit, F.col("f"))).alias("fraction"))


DIAGNOSTICS = "dg AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 11) / 100.0::DOUBLE END AS lift, CASE WHEN c_custkey % 7 = 0 THEN 'nan'::DOUBLE ELSE (c_custkey % 9) / 10.0::DOUBLE END AS fraction, (c_custkey % 21 - 10) / 100.0::DOUBLE AS shift, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 25 - 12) / 100.0::DOUBLE END AS sensitivity_shift FROM customer)"
KNOWN = lambda c, hit: f"CASE WHEN isfinite({c}) THEN {hit} END"


@plan("flag", f"WITH {DIAGNOSTICS} SELECT k, {KNOWN('lift', 'lift < 0.05')} AS low_lift, {KNOWN('fraction', 'fraction < 0.25')} AS saturated, {KNOWN('shift', 'abs(shift) > 0.05')} AS casemix_auc, {KNOWN('sensitivity_shift', 'abs(sensitivity_shift) > 0.05')} AS casemix_sensitivity FROM dg")
def flag(spark, sf):
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(
        k.alias("k"), F.when(k % 5 != 0, (k % 11) / F.lit(100.0)).alias("lift"), F.when(k % 7 == 0, float("nan")).otherwise((k % 9) / F.lit(10.0)).alias("fraction"),
        ((k % 21 - 10) / F.lit(100.0)).alias("shift"), F.when(k % 3 != 0, (k % 25 - 12) / F.lit(100.0)).alias("sensitivity_shift"),
    )
    return d.select("k", *[c.alias(n) for n, c in S.flags("lift", "fraction", "shift", "sensitivity_shift").items()])


MIXES = 2000
CASEMIX = f"""{POOL}, base AS (SELECT {C}, stratum, p, row_number() OVER (PARTITION BY {C}, stratum ORDER BY md5('mix:' || sample), sample) - 1 AS slot FROM pooled WHERE y = 1),
  sz AS (SELECT {C}, stratum, count(*) AS n FROM base GROUP BY ALL), want AS (SELECT {C}, stratum, n, CAST(round_even(sum(n) OVER (PARTITION BY {C}) * target, 0) AS BIGINT) AS want FROM sz JOIN (SELECT unnest(['purchase', 'click']) AS stratum, unnest([0.8::DOUBLE, 0.2::DOUBLE]) AS target) USING (stratum)),
  pk AS (SELECT {C}, stratum, draw, CAST(floor(CAST('0x' || substr(md5('mix:' || stratum || ':' || config || ':' || model || ':' || draw || ':' || j), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * n) AS BIGINT) AS slot FROM (SELECT {C}, stratum, n, unnest(range(0, want)) AS j FROM want), (SELECT unnest(range(0, {MIXES})) AS draw)),
  dr AS (SELECT {C}, draw, p, stratum, slot, count(*) AS c FROM pk JOIN base USING ({C}, stratum, slot) GROUP BY ALL),
  ng AS (SELECT {C}, p, count(*)::DOUBLE AS n FROM pooled WHERE y = 0 GROUP BY ALL), pp AS (SELECT DISTINCT {C}, p FROM base),
  sc AS (SELECT {C}, p, sum(n) OVER w AS fp, coalesce(n, 0) AS own, sum(n) OVER (PARTITION BY {C}) AS nn FROM (SELECT {C}, p, max(n) AS n FROM (SELECT * FROM ng UNION ALL SELECT {C}, p, 0 FROM pp) GROUP BY ALL) WINDOW w AS (PARTITION BY {C} ORDER BY p DESC)),
  dp AS (SELECT {C}, draw, p, sum(c) AS c FROM dr GROUP BY ALL), cu AS (SELECT *, sum(c) OVER (PARTITION BY {C}, draw ORDER BY p DESC) AS tp, sum(c) OVER (PARTITION BY {C}, draw) AS m FROM dp JOIN sc USING ({C}, p)),
  per AS (SELECT {C}, draw, sum(c * (nn - fp + own / 2) / nn) / max(m) AS auc, sum(c / m * tp / (tp + fp)) AS pr_auc, sum(CASE WHEN p >= 0.5 THEN c ELSE 0 END) / max(m) AS sensitivity FROM cu GROUP BY ALL),
  us AS (SELECT {C}, draw, count(*) AS distinct_cases, max(c) AS reuse FROM dr GROUP BY ALL)"""
MEASURED = ["auc", "pr_auc", "sensitivity"]


@plan("casemix_simulation", f"WITH {CASEMIX} SELECT {C}, " + ", ".join(f"round({f}, 9) AS {m}_{n}" for m in MEASURED for n, f in (("mean", f"avg({m})"), ("lo", f"quantile_cont({m}, 0.025)"), ("hi", f"quantile_cont({m}, 0.975)"), ("se", f"stddev_samp({m}) / sqrt(count(*))"))) + f", round(avg(distinct_cases), 6) AS distinct_cases, max(reuse) AS reuse FROM per JOIN us USING ({C}, draw) GROUP BY ALL")
def casemix_simulation(spark, sf):
    """Metrics of each cell with 80 % of its cases from one stratum: mean, Monte-Carlo interval and error, and how cases are used."""
    mix = spark.createDataFrame([("purchase", 0.8), ("click", 0.2)], "stratum string, target double")
    draws = S.casemix(source(spark, sf), CELL, mix, "stratum", "sample", MIXES)
    stats = [F.round(c, 9).alias(f"{m}_{n}") for m in MEASURED for n, c in (("mean", F.avg(m)), ("lo", F.percentile(m, 0.025)), ("hi", F.percentile(m, 0.975)), ("se", F.stddev_samp(m) / F.sqrt(F.count("*"))))]
    return draws.groupBy(*CELL).agg(*stats, F.round(F.avg("distinct_cases"), 6).alias("distinct_cases"), F.max("reuse").alias("reuse"))


BALANCED = f"""{POOL}, base AS (SELECT {C}, stratum, p, row_number() OVER (PARTITION BY {C}, stratum ORDER BY md5('bal:' || sample), sample) - 1 AS slot FROM pooled WHERE y = 1),
  sz AS (SELECT *, min(n) OVER (PARTITION BY {C}) AS k FROM (SELECT {C}, stratum, count(*) AS n FROM base GROUP BY ALL)),
  sd AS (SELECT *, {rng.seed_sql("'bal:' || config || ':' || model || ':' || stratum || ':0:' || draw")} FROM sz, (SELECT unnest(range(0, {DRAWS})) AS draw)),
  ky AS ({rng.positions_sql('(SELECT *, unnest(range(0, n)) AS j FROM sd)', f'{C}, stratum, k, draw, j', 'j', '2147483648', 'key')}),
  pk AS (SELECT {C}, stratum, k, draw, j AS slot FROM ky QUALIFY row_number() OVER (PARTITION BY {C}, stratum, draw ORDER BY key, j) <= k),
  ng AS (SELECT {C}, p, count(*)::DOUBLE AS n FROM pooled WHERE y = 0 GROUP BY ALL), pp AS (SELECT DISTINCT {C}, p FROM base),
  sc AS (SELECT {C}, p, sum(n) OVER w AS fp, coalesce(n, 0) AS own, sum(n) OVER (PARTITION BY {C}) AS nn FROM (SELECT {C}, p, max(n) AS n FROM (SELECT * FROM ng UNION ALL SELECT {C}, p, 0 FROM pp) GROUP BY ALL) WINDOW w AS (PARTITION BY {C} ORDER BY p DESC)),
  per AS (SELECT {C}, draw, max(k) AS per_stratum, count(*) AS n_cases, avg((nn - fp + own / 2) / nn) AS auc, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) AS sensitivity FROM pk JOIN base USING ({C}, stratum, slot) JOIN sc USING ({C}, p) GROUP BY ALL)"""


@plan("severity_balanced", f"WITH {BALANCED} SELECT {C}, per_stratum, n_cases, count(*) AS draws, " + ", ".join(f"round({f}, 9) AS {m}_{n}" for m in ("auc", "sensitivity") for n, f in (("mean", f"avg({m})"), ("lo", f"quantile_cont({m}, 0.025)"), ("hi", f"quantile_cont({m}, 0.975)"))) + " FROM per GROUP BY ALL")
def severity_balanced(spark, sf):
    """AUC and sensitivity of each cell with as many cases of every stratum, none used twice: mean and Monte-Carlo interval."""
    draws = S.balanced(source(spark, sf), CELL, "stratum", "sample", DRAWS)
    stats = [F.round(c, 9).alias(f"{m}_{n}") for m in ("auc", "sensitivity") for n, c in (("mean", F.avg(m)), ("lo", F.percentile(m, 0.025)), ("hi", F.percentile(m, 0.975)))]
    return draws.groupBy(*CELL, "per_stratum", "n_cases").agg(F.count("*").alias("draws"), *stats)


IMP = "imp AS (SELECT CAST(l_linenumber AS VARCHAR) AS fold, 'x' || (l_partkey % 12) AS feature, round(avg(l_extendedprice) / 1000, 1) AS importance FROM lineitem GROUP BY 1, 2)"
RNK = "rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY importance DESC) + (count(*) OVER (PARTITION BY fold, importance) - 1) / 2.0::DOUBLE AS rnk FROM imp)"


def importance(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.groupBy(F.col("l_linenumber").cast("string").alias("fold"), F.concat(F.lit("x"), (F.col("l_partkey") % 12).cast("string")).alias("feature")).agg(F.round(F.avg("l_extendedprice") / 1000, 1).alias("importance"))


def ranked(spark, sf):
    return S.midranks(importance(spark, sf), ["fold"], "importance", "rnk", descending=True)


@plan("average_rank", f"WITH {IMP}, {RNK} SELECT fold, feature, rnk FROM rk")
def average_rank(spark, sf):
    return ranked(spark, sf).select("fold", "feature", "rnk")


@plan("top_k_sets", f"WITH {IMP} SELECT fold, array_to_string(list_sort(list(feature)), ',') AS top FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) AS rn FROM imp) WHERE rn <= 5 GROUP BY fold")
def top_k_sets(spark, sf):
    return S.top_sets(importance(spark, sf), 5).select("fold", F.array_join(F.array_sort("top"), ",").alias("top"))


@plan("kendalls_w", f"WITH {IMP}, {RNK}, s AS (SELECT feature, sum(rnk) AS r FROM rk GROUP BY 1) SELECT round(12 * var_pop(r) * count(*) / (power((SELECT count(DISTINCT fold) FROM imp), 2) * (power(count(*), 3) - count(*))), 9) AS w FROM s")
def kendalls_w(spark, sf):
    return rnd(S.kendalls_w(ranked(spark, sf), "feature", "fold", "rnk"), "w")


@plan("jaccard_top_k", f"WITH {IMP}, t AS (SELECT fold, list(feature) AS s FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) AS rn FROM imp) WHERE rn <= 5 GROUP BY fold) SELECT round(avg(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE), 9) AS jaccard FROM t a JOIN t b ON a.fold < b.fold")
def jaccard_top_k(spark, sf):
    return rnd(S.mean_jaccard(S.top_sets(importance(spark, sf), 5)), "jaccard")


@plan("stability_summary", f"WITH {IMP}, {RNK}, k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) <= 5 AS top FROM rk) SELECT feature, round(avg(importance), 9) AS mean, round(stddev_samp(importance), 9) AS sd, round(median(importance), 9) AS median, count(*) FILTER (WHERE importance > 0) AS positive, round(avg(rnk), 9) AS rank_mean, round(stddev_samp(rnk), 9) AS rank_sd, min(rnk) AS best, max(rnk) AS worst, round(avg(top::INTEGER), 9) AS top_freq FROM k GROUP BY feature")
def stability_summary(spark, sf):
    top = S.top_sets(importance(spark, sf), 5).select("fold", F.explode("top").alias("feature"), F.lit(1).alias("top"))
    df = ranked(spark, sf).join(top, ["fold", "feature"], "left")
    r = lambda c, n: F.round(c, 9).alias(n)
    return df.groupBy("feature").agg(
        r(F.avg("importance"), "mean"), r(F.stddev_samp("importance"), "sd"), r(F.median("importance"), "median"), F.count_if(F.col("importance") > 0).alias("positive"),
        r(F.avg("rnk"), "rank_mean"), r(F.stddev_samp("rnk"), "rank_sd"), F.min("rnk").alias("best"), F.max("rnk").alias("worst"), r(F.avg(F.coalesce("top", F.lit(0))), "top_freq"),
    )


@plan("rank_agreement", f"WITH {IMP}, a AS (SELECT feature, avg(importance) AS u, median(importance) AS v FROM imp GROUP BY 1), k AS (SELECT rank() OVER (ORDER BY round(u, 9)) + (count(*) OVER (PARTITION BY round(u, 9)) - 1) / 2.0::DOUBLE AS ru, rank() OVER (ORDER BY round(v, 9)) + (count(*) OVER (PARTITION BY round(v, 9)) - 1) / 2.0::DOUBLE AS rv FROM a) SELECT round(corr(ru, rv), 9) AS spearman FROM k")
def rank_agreement(spark, sf):
    a = importance(spark, sf).groupBy("feature").agg(F.round(F.avg("importance"), 9).alias("u"), F.round(F.median("importance"), 9).alias("v"))
    return S.midranks(S.midranks(a, [], "u", "ru"), [], "v", "rv").agg(F.round(F.corr("ru", "rv"), 9).alias("spearman"))


@plan("spearman_pairs", "WITH f AS (SELECT o_orderkey, unnest(['price', 'cust', 'key']) AS a, unnest([round(o_totalprice), o_custkey::DOUBLE, (o_orderkey % 1000)::DOUBLE]) AS x FROM orders), r AS (SELECT *, rank() OVER (PARTITION BY a ORDER BY x) + (count(*) OVER (PARTITION BY a, x) - 1) / 2.0::DOUBLE AS r FROM f) SELECT p.a, q.a AS b, round(corr(p.r, q.r), 6) AS rho FROM r p JOIN r q ON p.o_orderkey = q.o_orderkey AND p.a < q.a GROUP BY 1, 2")
def spearman_pairs(spark, sf):
    o = table(spark, sf, "orders")
    wide = o.select("o_orderkey", F.round("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"), (F.col("o_orderkey") % 1000).cast("double").alias("key"))
    return S.spearman_matrix(wide, "o_orderkey", ["cust", "key", "price"]).withColumn("rho", F.round("rho", 6))


@plan("column_permutation", "WITH a AS (SELECT c_custkey AS id, c_acctbal AS x, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer), b AS (SELECT x, row_number() OVER (ORDER BY md5('perm:3:' || id), id) AS pos FROM a) SELECT a.id, b.x FROM a JOIN b USING (pos)")
def column_permutation(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x")).withColumn("_all", F.lit(0))
    # Places in the order of the id: a hexadecimal key that sorts like it.
    placed = numbered(rows.withColumn("_h", F.lpad(F.hex("id"), 16, "0")).withColumn("_k", F.col("_h")), ["_all"], "_k", "pos", ["id"])
    mixed = numbered(rows.withColumn("_h", rng.hashed("perm", 3, F.col("id"))), ["_all"], "_h", "pos", ["id"])
    return placed.select("id", "pos").join(mixed.select("x", "pos"), "pos").select("id", "x")


SHAPE = "pts AS (SELECT l_linenumber AS fold, CAST(floor(l_quantity / 5) * 5 AS DOUBLE) AS x, round(avg(l_extendedprice) / 1000, 6) AS f FROM lineitem GROUP BY 1, 2), grid AS (SELECT unnest(range(0, 10)) * 5 + 2.5::DOUBLE AS g)"


@plan("shape_averaging", f"WITH {SHAPE}, seg AS (SELECT *, lead(x) OVER w AS nx, lead(f) OVER w AS nf FROM pts WINDOW w AS (PARTITION BY fold ORDER BY x)), it AS (SELECT fold, g, f + (nf - f) * (g - x) / (nx - x) AS v FROM seg JOIN grid ON g >= x AND g < nx) SELECT g, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS folds FROM it GROUP BY g")
def shape_averaging(spark, sf):
    pts = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("fold"), (F.floor(F.col("l_quantity") / 5) * 5).cast("double").alias("x")).agg(F.round(F.avg("l_extendedprice") / 1000, 6).alias("f"))
    by = Window.partitionBy("fold").orderBy("x")  # a curve's points
    seg = pts.withColumns({"nx": F.lead("x").over(by), "nf": F.lead("f").over(by)}).where("nx IS NOT NULL")
    grid = F.filter(F.array(*[F.lit(i * 5 + 2.5) for i in range(10)]), lambda g: (g >= F.col("x")) & (g < F.col("nx")))
    at = seg.withColumn("g", F.explode(grid)).withColumn("v", F.col("f") + (F.col("nf") - F.col("f")) * (F.col("g") - F.col("x")) / (F.col("nx") - F.col("x")))
    return at.groupBy("g").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"), F.count("*").alias("folds"))
