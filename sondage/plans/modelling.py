"""Queries that fit models: nested cross-validation, importance, transfer, saturation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sondage.operators import bootstrap as B
from sondage.operators import metrics as M
from sondage.operators import models as Z
from sondage.operators import trees as T
from sondage.operators.ranks import quantiles
from sondage.operators.ridge import nested_logistic
from sondage.operators.guard import FeatureSet, assert_clean, guard, select_columns
from sondage.plans import plan
from sondage.plans.views import folded
from sondage.session import table
from sondage.sources.files import written

FEATURES = ["price", "orders", "nation"]


def training(spark, sf, repeats: int = 2):
    """Customers with a few features and an outcome that depends on them."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_acctbal") + (F.col("c_nationkey") - 12) * 400 > 4500).cast("int").alias("y"))
    rows = c.join(o, "sample", "left").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return folded(rows)


def grid(spark, models, calibrations, repeats=2):
    return spark.createDataFrame([(m, c, r) for m in models for c in calibrations for r in range(repeats)], "model string, calibration string, repeat int")


@plan("nested_cv")
def nested_cv(spark, sf):
    return Z.nested_cv(training(spark, sf), FEATURES, grid(spark, ["dummy", "logreg", "additive", "kernel"], ["none"]))


@plan("nested_cv_trees")
def nested_cv_trees(spark, sf):
    """The models of 300 trees and eight parameter sets each: most of a grid's time."""
    return Z.nested_cv(training(spark, sf), FEATURES, grid(spark, ["random_forest", "xgboost"], ["none"]))


ROUNDS = 10


def held_out(spark, sf):
    """Training and test rows of each outer fold, k."""
    sides = training(spark, sf, 1).drop("repeat").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    sides = written(sides, "sides")
    return sides.where("fold != k").drop("fold"), sides.where("fold = k").drop("fold")


def tested(test, model, p):
    out = T.score(test, model, ["k"], "sample", FEATURES).withColumn("p", p).join(test.select("k", "sample", "y"), ["k", "sample"])
    return M.all_metrics(written(out.select("k", "sample", "y", "p"), "scored"), ["k"], F.lit(0.5)).select("k", "n", "auc", "pr_auc", "brier", "ece")


@plan("grown_forest")
def grown_forest(spark, sf):
    """Metrics by outer fold of forests of 100 trees that no task holds the training set of."""
    train, test = held_out(spark, sf)
    model = T.forest(train, ["k"], "sample", FEATURES, depth=3, leaf=5, trees=100, bins=64)
    return tested(test, model, F.col("total") / F.col("trees"))


@plan("grown_boosted")
def grown_boosted(spark, sf):
    """The same of boosted trees, ROUNDS of them: each is four Spark jobs."""
    train, test = held_out(spark, sf)
    return tested(test, written(T.boosted(train, ["k"], "sample", FEATURES, trees=ROUNDS), "model"), M.expit(F.col("total")))


@plan("tree_shapley")
def tree_shapley(spark, sf):
    """Mean absolute Shapley value of each feature over the test rows of each outer fold, and its rank."""
    train, test = held_out(spark, sf)
    model = written(T.boosted(train, ["k"], "sample", FEATURES, trees=ROUNDS), "model")
    mean = T.shapley(test, model, ["k"], "sample", FEATURES).groupBy("k", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.count("*").alias("n"))
    return mean.withColumn("rank", F.rank().over(Window.partitionBy("k").orderBy(F.desc("mean_abs"))))  # a row per feature


@plan("calibrated_nested_cv")
def calibrated_nested_cv(spark, sf):
    out = Z.nested_cv(training(spark, sf, 1), FEATURES, grid(spark, ["logreg"], ["none", "sigmoid", "isotonic"], 1), Z.Settings(ensemble=True))
    return M.brier(out, ["model", "calibration"])


@plan("dummy_prior", "WITH t AS (SELECT c_nationkey AS g, CAST(c_acctbal > 4500 AS INTEGER) AS y FROM customer) SELECT g, round(avg(y), 9) AS p FROM t GROUP BY g")
def dummy_prior(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.round(F.avg((F.col("c_acctbal") > 4500).cast("int")), 9).alias("p"))


@plan("impute_and_scale", "WITH t AS (SELECT c_custkey, c_nationkey % 5 AS fold, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS x FROM customer), m AS (SELECT k, median(x) AS med FROM t, (SELECT unnest(range(0, 5)) AS k) WHERE fold <> k GROUP BY k), s AS (SELECT k, avg(coalesce(x, med)) AS mu, stddev_pop(coalesce(x, med)) AS sd FROM t JOIN m ON fold <> k GROUP BY k) SELECT c_custkey, round((coalesce(x, med) - mu) / sd, 6) AS z FROM t JOIN m ON fold = m.k JOIN s ON fold = s.k")
def impute_and_scale(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("fold"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal")).alias("x"))
    train = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold != k")
    med = quantiles(train, ["k"], "x", [0.5], "q").select("k", F.col("q")[0].alias("med"))
    x = F.coalesce("x", "med")
    stats = train.join(med, "k").groupBy("k").agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"))
    return c.join(med.join(stats, "k"), F.col("fold") == F.col("k")).select("c_custkey", F.round((x - F.col("mu")) / F.col("sd"), 6).alias("z"))


@plan("permutation_importance")
def permutation_importance(spark, sf):
    return Z.permutation_importance(training(spark, sf, 1), FEATURES)


PERCENTS, SATURATION_REPEATS, RESAMPLES = [10, 20, 30, 40, 55, 70, 85, 100], 3, 200


@plan("saturation_curve")
def saturation_curve(spark, sf):
    per = Z.saturation(training(spark, sf, SATURATION_REPEATS), FEATURES, "logreg", PERCENTS, 5, "sat")
    return per.groupBy("percent").agg(F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("sd"), F.count("auc").alias("n"))


@plan("procedure_bootstrap")
def procedure_bootstrap(spark, sf):
    auc = Z.resampled_aucs(training(spark, sf, 1), FEATURES, "logreg", RESAMPLES, "proc")
    lo, hi = F.percentile("auc", 0.025), F.percentile("auc", 0.975)  # of RESAMPLES numbers
    return auc.agg(lo.alias("lo"), hi.alias("hi"), (hi - lo).alias("width"), F.stddev_samp("auc").alias("sd"), F.count("auc").alias("draws"), (F.lit(RESAMPLES) - F.count("auc")).alias("failures"))


def transferred(spark, sf):
    """Predictions for customers of the other nations, from a model that never saw them."""
    df = training(spark, sf, 1).withColumn("fold", F.when(F.col("nation") < 12, 1).otherwise(0))
    return written(nested_logistic(df, FEATURES, spark.createDataFrame([(0,)], "repeat int"), Z.Settings(outer=1)), "transfer")


@plan("frozen_transfer")
def frozen_transfer(spark, sf):
    """Metrics of the frozen model elsewhere with bootstrap intervals, as it is and with its scores moved to the prevalence there."""
    out = transferred(spark, sf)
    prevalence = out.agg(F.avg("y").alias("m")).first()["m"]
    offset = M.recalibrated_offset(out, ["model"], prevalence)
    moved = out.join(offset, "model").withColumn("p", M.expit(M.logit(F.col("p")) + F.col("offset"))).drop("offset")
    both = out.withColumn("arm", F.lit("frozen")).unionByName(moved.withColumn("arm", F.lit("recalibrated")))
    keys = ["arm", "model"]
    names = [*B.METRICS[:5], *M.RATES]
    point = M.all_metrics(both, keys, F.lit(0.5))
    long = point.unpivot(keys, [F.col(n) for n in [*names, "slope", "intercept"]], "metric", "value")
    return long.join(B.intervals(B.bootstrap_metrics(both, keys, 2000), keys, names), [*keys, "metric"], "left")


@plan("binned_vs_continuous")
def binned_vs_continuous(spark, sf):
    """Nested cross-validation on values and on their bins' midpoints, in the same folds: metrics of both arms and their difference."""
    df = training(spark, sf)
    binned = df.withColumns({"price": F.floor(F.col("price") / 40000) * 40000 + 20000, "orders": F.floor(F.col("orders") / 4) * 4.0 + 2, "nation": F.floor(F.col("nation") / 5) * 5.0 + 2})
    arms = [M.all_metrics(Z.nested_cv(d, FEATURES, grid(spark, ["logreg", "additive"], ["none"])), ["model", "repeat"], F.lit(0.5)).withColumn("arm", F.lit(n)) for n, d in (("continuous", df), ("binned", binned))]
    mean = arms[0].unionByName(arms[1]).groupBy("model", "arm").agg(*[F.avg(m).alias(m) for m in ("auc", "brier", "ece", "sensitivity")])
    long = mean.unpivot(["model", "arm"], ["auc", "brier", "ece", "sensitivity"], "metric", "value").groupBy("model", "metric").pivot("arm", ["continuous", "binned"]).agg(F.first("value"))
    return long.withColumn("cost", F.col("continuous") - F.col("binned"))


@plan("leakage_guard", "SELECT c_custkey, c_mktsegment FROM customer")
def leakage_guard(spark, sf):
    chosen = FeatureSet("plain", ("c_custkey", "c_mktsegment"))
    return assert_clean(guard(select_columns(table(spark, sf, "customer"), chosen.features), ["c_acctbal"]), chosen, ["c_acctbal"], "class")
