"""Report-level queries: deltas, best rows, wide tables and notes over metric tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sondage.functions.text import shown
from sondage.operators import bootstrap as B
from sondage.operators import linkage as L
from sondage.operators import metrics as M
from sondage.operators import resample as S
from sondage.plans import plan
from sondage.plans.evaluation import BRIER, DRAWN, REP, auc_sql, bag_sql, drawn, newton_sql, variant_aucs
from sondage.plans.linking import LEFT, PINS, RIGHT, counted, left, pinned, right
from sondage.plans.resampling import BOOT, CASEMIX, FAUC, casemix_simulation, features, uncut
from sondage.plans.views import CELL, RAW, raw, scores, tallied
from sondage.session import table
from sondage.sources.files import written

C = "config, model"


def rnd(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


#: Scores as they are, rounded to tenths and in halves: three encodings of one variable.
ENC = "enc AS (SELECT config, model, 'midpoint' AS encoding, y, p FROM raw UNION ALL SELECT config, model, 'tenths', y, round(p, 1) FROM raw UNION ALL SELECT config, model, 'halves', y, floor(p * 2) / 2 FROM raw)"
EAUC = f"{RAW}, {ENC}, {auc_sql('enc', 'config, model, encoding')}"


def encoded(spark, sf):
    df = tallied(raw(spark, sf))
    arm = lambda name, p: df.select(*CELL, F.lit(name).alias("encoding"), "y", p.alias("p"), "w")
    return arm("midpoint", F.col("p")).union(arm("tenths", F.round("p", 1))).union(arm("halves", F.floor(F.col("p") * 2) / 2))


def encoding_auc(spark, sf):
    return written(rnd(M.roc_auc(encoded(spark, sf), [*CELL, "encoding"], F.col("w")), "auc"), "aucs")


@plan("encoding_robustness", f"WITH {EAUC} SELECT a.config, a.model, a.encoding, round(round(a.auc, 9) - round(b.auc, 9), 9) AS delta FROM aucs a JOIN aucs b ON a.config = b.config AND a.model = b.model AND b.encoding = 'midpoint' WHERE a.encoding <> 'midpoint'")
def encoding_robustness(spark, sf):
    auc = encoding_auc(spark, sf)
    base = auc.where("encoding = 'midpoint'").select(*CELL, F.col("auc").alias("base"))
    return auc.where("encoding != 'midpoint'").join(base, CELL).select(*CELL, "encoding", F.round(F.col("auc") - F.col("base"), 9).alias("delta"))


COLUMNS = {"midpoint": 1, "tenths": 11, "halves": 3}
NCOL = "(SELECT unnest(['midpoint', 'tenths', 'halves']) AS encoding, unnest([1, 11, 3]) AS k)"
DELTAS = f"{EAUC}, d AS (SELECT a.encoding, round(a.auc, 9) AS auc, abs(round(round(a.auc, 9) - round(b.auc, 9), 9)) AS delta FROM aucs a JOIN aucs b ON a.config = b.config AND a.model = b.model AND b.encoding = 'midpoint')"


@plan("encoding_summary", f"WITH {DELTAS} SELECT encoding, count(*) AS cells, round(median(auc), 9) AS median_auc, max(delta) AS max_delta, max(k)::BIGINT AS most_columns FROM d JOIN {NCOL} USING (encoding) GROUP BY 1")
def encoding_summary(spark, sf):
    return encoding_table(spark, sf)


def encoding_table(spark, sf):
    auc = encoding_auc(spark, sf)
    base = auc.where("encoding = 'midpoint'").select(*CELL, F.col("auc").alias("base"))
    d = auc.join(base, CELL).withColumn("delta", F.abs(F.round(F.col("auc") - F.col("base"), 9)))
    wide = F.create_map(*[x for k, v in COLUMNS.items() for x in (F.lit(k), F.lit(v))])[F.col("encoding")]
    return d.groupBy("encoding").agg(F.count("*").alias("cells"), F.round(F.median("auc"), 9).alias("median_auc"), F.max("delta").alias("max_delta"), F.max(wide).cast("long").alias("most_columns"))


@plan("worst_encoding", f"WITH {DELTAS} SELECT encoding, max(delta) AS max_delta FROM d WHERE encoding <> 'midpoint' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def worst_encoding(spark, sf):
    return encoding_table(spark, sf).where("encoding != 'midpoint'").select("encoding", "max_delta").orderBy(F.desc("max_delta"), "encoding").limit(1)


@plan("best_row_per_featureset", f"WITH {RAW}, {auc_sql('raw', C)}, o AS (SELECT unnest([1, 2]) AS pos, unnest(['f1', 'f0']) AS config) SELECT pos, config, model, round(auc, 9) AS auc FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY round(auc, 9) DESC, model) AS rn FROM aucs) JOIN o USING (config) WHERE rn = 1")
def best_row_per_featureset(spark, sf):
    auc = rnd(M.roc_auc(raw(spark, sf), CELL), "auc")
    best = auc.groupBy("config").agg(F.max_by("model", F.struct("auc", -F.regexp_extract("model", r"(\d+)", 1).cast("int"))).alias("model"), F.max("auc").alias("auc"))
    order = spark.createDataFrame([(1, "f1"), (2, "f0")], "pos int, config string")
    return order.join(best, "config").select("pos", "config", "model", "auc")


@plan("arm_comparison", f"WITH {RAW}, {auc_sql('raw', C)} SELECT a.model, round(a.auc, 9) AS inside, round(b.auc, 9) AS outside, round(round(b.auc, 9) - round(a.auc, 9), 9) AS change FROM aucs a JOIN aucs b USING (model) WHERE a.config = 'f0' AND b.config = 'f1'")
def arm_comparison(spark, sf):
    auc = rnd(M.roc_auc(raw(spark, sf), CELL), "auc")
    arm = lambda c, n: auc.where(F.col("config") == c).select("model", F.col("auc").alias(n))
    return arm("f0", "inside").join(arm("f1", "outside"), "model").withColumn("change", F.round(F.col("outside") - F.col("inside"), 9))


@plan("label_variant_wide", f"WITH {RAW}, v AS (SELECT {C}, 'primary' AS variant, y, p FROM raw UNION ALL SELECT {C}, 'flipped', CASE WHEN stratum = 'click' THEN 0 ELSE y END, p FROM raw UNION ALL SELECT {C}, 'excluded', y, p FROM raw WHERE stratum <> 'click'), {auc_sql('v', 'config, model, variant')} SELECT {C}, round(max(auc) FILTER (WHERE variant = 'excluded') - max(auc) FILTER (WHERE variant = 'primary'), 9) AS excluded, round(max(auc) FILTER (WHERE variant = 'flipped') - max(auc) FILTER (WHERE variant = 'primary'), 9) AS flipped FROM aucs GROUP BY {C}")
def label_variant_wide(spark, sf):
    wide = variant_aucs(spark, sf).groupBy(*CELL).pivot("variant", ["primary", "excluded", "flipped"]).agg(F.first("auc"))
    return wide.select(*CELL, *[F.round(F.col(v) - F.col("primary"), 9).alias(v) for v in ("excluded", "flipped")])


FOUR = ["brier", "ece", "slope", "intercept"]


@plan("calibration_median_best", f"WITH RECURSIVE {RAW}, {DRAWN}, {newton_sql('drawn', REP)}, {BRIER('drawn', REP)}, ec AS (SELECT {REP}, sum(gap) / sum(n) AS ece FROM (SELECT {REP}, least(floor(p * 10), 9) AS b, count(*) AS n, abs(sum(y) - sum(p)) AS gap FROM drawn GROUP BY {REP}, b) GROUP BY {REP}) SELECT model, " + ", ".join(f"round(median({m}), 6) AS {m}" for m in FOUR) + f" FROM fit JOIN br USING ({REP}) JOIN ec USING ({REP}) GROUP BY model ORDER BY median(brier), model LIMIT 1")
def calibration_median_best(spark, sf):
    """Medians over cells and repeats of each method; that with the lowest Brier score."""
    per = M.all_metrics(drawn(spark, sf), [*CELL, "repeat"], F.lit(0.5))
    return per.groupBy("model").agg(*[F.round(F.median(m), 6).alias(m) for m in FOUR]).orderBy("brier", "model").limit(1)


CELLS = [("f0", "m0"), ("f0", "m2"), ("f1", "m1"), ("f1", "m2")]


SHOWN = ["auc", "brier", "sensitivity", "specificity", "slope", "intercept"]


@plan("model_comparison", f"WITH RECURSIVE {RAW}, {DRAWN}, {bag_sql('drawn', C, '0.5')} SELECT {C}, " + ", ".join(f"round({n}, 6) AS {n}" for n in SHOWN) + " FROM bag WHERE config || model IN ('f0m0', 'f0m2', 'f1m1', 'f1m2')")
def model_comparison(spark, sf):
    wanted = spark.createDataFrame(CELLS, "config string, model string")
    df = drawn(spark, sf).join(F.broadcast(wanted), CELL, "left_semi")  # four cells
    return M.all_metrics(df, CELL, F.lit(0.5)).select(*CELL, *[F.round(n, 6).alias(n) for n in SHOWN])


WIDE = ["auc", "brier", "sensitivity"]
SD = f"sds AS (SELECT {C}, " + ", ".join(f"stddev_samp({m}) AS {m}_sd" for m in WIDE) + f" FROM (SELECT {REP}, avg((p - y) * (p - y)) AS brier, count(*) FILTER (WHERE y = 1 AND p >= 0.5) / count(*) FILTER (WHERE y = 1)::DOUBLE AS sensitivity FROM preds GROUP BY ALL) JOIN rauc USING ({REP}) GROUP BY {C})"


@plan("headline_table", f"WITH {BOOT}, {auc_sql('preds', REP, 'rauc')}, {SD}, {auc_sql('pooled', C)}, est AS (SELECT {C}, auc, brier, sensitivity FROM aucs JOIN (SELECT {C}, avg((p - y) * (p - y)) AS brier, count(*) FILTER (WHERE y = 1 AND p >= 0.5) / count(*) FILTER (WHERE y = 1)::DOUBLE AS sensitivity FROM pooled GROUP BY ALL) USING ({C})), iv AS (SELECT {C}, " + ", ".join(f"quantile_cont({m}, {q}) AS {m}_{n}" for m in WIDE for n, q in (("lo", 0.025), ("hi", 0.975))) + f" FROM bts GROUP BY ALL) SELECT {C}, config <> 'f1' AS valid, " + ", ".join(f"round({m}{e}, 9) AS {m}{e}" for m in WIDE for e in ("", "_lo", "_hi", "_sd")) + f" FROM est JOIN iv USING ({C}) JOIN sds USING ({C})")
def headline_table(spark, sf):
    """A row for each cell: of each metric the estimate, its bootstrap interval and its deviation across repeats, and whether the
    feature set is a valid one."""
    df = written(scores(spark, sf), "rows")
    point = M.all_metrics(df, CELL, F.lit(0.5)).select(*CELL, *WIDE)
    spread = M.all_metrics(raw(spark, sf), [*CELL, "repeat"], F.lit(0.5)).groupBy(*CELL).agg(*[F.stddev_samp(m).alias(f"{m}_sd") for m in WIDE])
    long = B.intervals(uncut(df), CELL, WIDE)
    wide = long.groupBy(*CELL).pivot("metric", WIDE).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    out = point.join(spread, CELL).join(wide, CELL).withColumn("valid", F.col("config") != "f1")
    return out.select(*CELL, "valid", *[F.round(f"{m}{e}", 9).alias(f"{m}{e}") for m in WIDE for e in ("", "_lo", "_hi", "_sd")])


@plan("featureset_table", f"WITH {BOOT}, {auc_sql('pooled', C)}, top AS (SELECT config, model, auc FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY round(auc, 9) DESC, model) AS rn FROM aucs) WHERE rn = 1), iv AS (SELECT {C}, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi FROM bts GROUP BY ALL) SELECT {C}, round(top.auc, 9) AS auc, round(lo, 9) AS lo, round(hi, 9) AS hi, lo >= 0.99 AS saturated FROM top JOIN iv USING ({C})")
def featureset_table(spark, sf):
    """The best model of each feature set with its interval; saturated if even its lower end is 0.99 or more."""
    df = written(scores(spark, sf).select(*CELL, "y", "p"), "rows")
    auc = M.roc_auc(df, CELL).withColumn("auc", F.round("auc", 9))
    best = auc.withColumn("_r", F.row_number().over(Window.partitionBy("config").orderBy(F.desc("auc"), "model"))).where("_r = 1").drop("_r")  # one row per model
    out = best.join(B.intervals(uncut(df), CELL, ["auc"]), CELL)
    return out.select(*CELL, "auc", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), (F.col("lo") >= 0.99).alias("saturated"))


@plan("wilson_interval", "WITH g AS (SELECT c_nationkey AS g, count(*)::DOUBLE AS n, avg(CAST(c_acctbal > 4500 AS INTEGER)) AS o FROM customer GROUP BY 1) SELECT g, round(greatest(0.0, (o + 3.8416 / (2 * n) - 1.96 * sqrt(o * (1 - o) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 9) AS low, round(least(1.0, (o + 3.8416 / (2 * n) + 1.96 * sqrt(o * (1 - o) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 9) AS high FROM g")
def wilson_interval(spark, sf):
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 4500).alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return g.select("g", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


SIDE = "CASE WHEN abs(auc - 0.5) < 0.03 THEN 'undetermined' WHEN auc > 0.5 THEN 'up' ELSE 'down' END"
SHAPES = f"""{FAUC}, cuts AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM feat WHERE x IS NOT NULL GROUP BY 1),
  shp AS (SELECT feature, least(9, floor((x - lo) / (hi - lo) * 10)) AS b, avg(y) AS f FROM feat JOIN cuts USING (feature) WHERE x IS NOT NULL GROUP BY ALL),
  rks AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY b) AS rb, rank() OVER (PARTITION BY feature ORDER BY round(f, 9)) + (count(*) OVER (PARTITION BY feature, round(f, 9)) - 1) / 2.0::DOUBLE AS rf FROM shp),
  rho AS (SELECT feature, corr(rb, rf) AS rho FROM rks GROUP BY 1)"""


@plan("direction_summary", f"WITH {SHAPES} SELECT feature, {SIDE} AS direction, round(rho, 9) AS rho, CASE WHEN abs(auc - 0.5) < 0.03 THEN NULL ELSE (rho > 0) = (auc > 0.5) END AS agrees FROM aucs JOIN rho USING (feature)")
def direction_summary(spark, sf):
    """Whether the Spearman correlation of a feature's shape points where its AUC does; an AUC near a half says nothing."""
    auc, long = F.col("auc"), features(spark, sf).where("x IS NOT NULL")
    ends = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.least(F.lit(9), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10))
    shape = long.join(ends, "feature").groupBy("feature", b.cast("double").alias("b")).agg(F.round(F.avg("y"), 9).alias("f"))  # ten bins
    rho = S.midranks(S.midranks(shape, ["feature"], "b", "rb"), ["feature"], "f", "rf").groupBy("feature").agg(F.corr("rb", "rf").alias("rho"))
    side = F.when(F.abs(auc - 0.5) < 0.03, "undetermined").when(auc > 0.5, "up").otherwise("down")
    agrees = F.when(F.abs(auc - 0.5) >= 0.03, (F.col("rho") > 0) == (auc > 0.5))
    return S.single_predictors(features(spark, sf)).join(rho, "feature").select("feature", side.alias("direction"), F.round("rho", 9).alias("rho"), agrees.alias("agrees"))


@plan("direction_notes", f"WITH {FAUC} SELECT CASE WHEN abs(auc - 0.5) < 0.03 THEN 'undetermined' WHEN auc > 0.5 THEN 'up' ELSE 'down' END AS direction, string_agg(feature, ', ' ORDER BY feature) AS features FROM aucs GROUP BY 1")
def direction_notes(spark, sf):
    return direction_summary(spark, sf).groupBy("direction").agg(F.array_join(F.array_sort(F.collect_list("feature")), ", ").alias("features"))


@plan("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1")
def status_counts(spark, sf):
    o = table(spark, sf, "orders")
    known = F.col("o_orderstatus").isin("F", "O", "P")
    return o.where(F.when(known, True).otherwise(F.raise_error(F.lit("a status outside the vocabulary")).cast("boolean"))).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@plan("tier_composition", "SELECT p_brand, f AS tier, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS f FROM part) GROUP BY 1, 2")
def tier_composition(spark, sf):
    return table(spark, sf, "part").select("p_brand", F.explode(F.split("p_type", " ")).alias("tier")).groupBy("p_brand", "tier").agg(F.count("*").alias("n"))


@plan("literature_summary", f"{PINS}, n AS (SELECT s_nationkey AS study, count(*) AS pins FROM pins JOIN supplier ON j = s_suppkey GROUP BY 1) SELECT row_number() OVER (ORDER BY pins DESC, study) AS place, study, pins FROM n")
def literature_summary(spark, sf):
    """The studies in the order of their pins."""
    pins = pinned(spark, sf).join(table(spark, sf, "supplier"), F.col("j") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("study")).agg(F.count("*").alias("pins"))
    return pins.select(F.row_number().over(Window.orderBy(F.desc("pins"), "study")).cast("long").alias("place"), "study", "pins")  # one row per study


SHOWN_MIX = "format('{:.3f}', round(auc_mean, 3)) || ' (' || format('{:.3f}', round(auc_lo, 3)) || '-' || format('{:.3f}', round(auc_hi, 3)) || ')'"


@plan("casemix_report", f"WITH {CASEMIX}, m AS (SELECT {C}, avg(auc) AS auc_mean, quantile_cont(auc, 0.025) AS auc_lo, quantile_cont(auc, 0.975) AS auc_hi FROM per GROUP BY ALL) SELECT {C}, {SHOWN_MIX} AS shown FROM m")
def casemix_report(spark, sf):
    """The simulated case mix as a report shows it: mean AUC and its Monte-Carlo interval."""
    m = casemix_simulation(spark, sf)
    return m.select(*CELL, F.concat(shown(F.col("auc_mean")), F.lit(" ("), shown(F.col("auc_lo")), F.lit("-"), shown(F.col("auc_hi")), F.lit(")")).alias("shown"))


@plan("variable_subsets", f"WITH {LEFT}, {RIGHT} SELECT sub, count(*) AS edges FROM lft JOIN rgt ON lft.o = rgt.o, (SELECT unnest(['v1', 'v1 v2']) AS sub) WHERE coalesce(v1 BETWEEN v1_lo - 1e-9 AND v1_hi + 1e-9, true) AND (sub = 'v1' OR v2 BETWEEN v2_lo - 1e-9 AND v2_hi + 1e-9) GROUP BY 1")
def variable_subsets(spark, sf):
    arm = lambda names: counted(spark, sf, names).agg(F.lit(" ".join(names)).alias("sub"), L.matched_in()[0])
    return arm(["v1"]).union(arm(["v1", "v2"]))


@plan("negative_control", f"WITH {LEFT}, {RIGHT} SELECT count(*) AS edges FROM lft JOIN (SELECT j, o, v1 + 20000 AS v1 FROM rgt WHERE v1 IS NOT NULL) r ON lft.o = r.o WHERE v1 BETWEEN v1_lo - 1e-9 AND v1_hi + 1e-9 AND isfinite(v1_hi)")
def negative_control(spark, sf):
    far = right(spark, sf).where("v1 IS NOT NULL").withColumn("v1", F.col("v1") + 20000)
    finite = left(spark, sf).where(F.abs("v1_hi") != L.INF)
    return L.compatible(finite, far, ["v1"], "o").agg(L.matched_in()[0])
