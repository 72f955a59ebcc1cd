"""Operators against closed forms, brute force and adversarial input."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondage.functions import labels as L
from sondage.functions import rng
from sondage.operators import linkage, metrics, models, resample
from sondage.operators.guard import FeatureSet, LeakageError, assert_clean, gate, guard, select_columns
from sondage.operators.ranks import numbered, quantiles, running
from sondage.sources import files


@pytest.mark.parametrize(
    "label, lower, upper, rep",
    [
        ("1.019 - 1.021", 1.019, 1.021, 1.02), ("112 – 154", 112, 154, 133), ("-3 - -1", -3, -1, -2), ("9 - 4", 4, 9, 6.5), ("< 112", -math.inf, 112, 112), ("≤112", -math.inf, 112, 112),
        ("≥ 448", 448, math.inf, 448), (">=448", 448, math.inf, 448), ("> 2.5", 2.5, math.inf, 2.5), (" 7 ", 7, 7, 7), ("< 0", -math.inf, 0, 0), ("3 - 3", 3, 3, 3),
    ],
)
def test_parse_bin(spark, label, lower, upper, rep):
    b = spark.createDataFrame([(label,)], "label string").select(L.parse_bin(F.col("label")).alias("b")).first().b
    assert (b.lower, b.upper, b.rep) == pytest.approx((lower, upper, rep))


@pytest.mark.parametrize("label", ["", "p", "?", "abc", "1 - ", "< x", "-", "4 - 5 - 6", None])
def test_no_bin(spark, label):
    assert spark.createDataFrame([(label,)], "label string").select(L.parse_bin(F.col("label")).alias("b")).first().b is None


def test_interval_keeps_reversed_edges(spark):
    df = spark.createDataFrame([("9 - 4",), ("20-Dec",), ("?",)], "label string")
    rows = [r.b for r in df.select(L.parse_interval(F.col("label")).alias("b")).collect()]
    assert (rows[0].lower, rows[0].upper) == (9, 4) and (rows[1].lower, rows[1].upper) == (12, 20) and rows[2] is None


def scores(spark, rows):
    return spark.createDataFrame(rows, "g string, y int, p double")


def brute_auc(rows):
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_with_ties_and_one_class(spark):
    r = random.Random(1)
    rows = [("a", r.randint(0, 1), r.randint(0, 10) / 10) for _ in range(300)] + [("b", 1, 0.5)]
    found = {x.g: x.auc for x in metrics.roc_auc(scores(spark, rows), ["g"]).collect()}
    assert found["a"] == pytest.approx(brute_auc(rows[:-1])) and found["b"] is None


def test_weighted_auc_equals_repeated_rows(spark):
    r = random.Random(2)
    rows = [("a", r.randint(0, 1), r.randint(0, 20) / 20, r.randint(1, 4)) for _ in range(120)]
    df = spark.createDataFrame([(g, y, p, float(w)) for g, y, p, w in rows], "g string, y int, p double, w double")
    expanded = [(g, y, p) for g, y, p, w in rows for _ in range(w)]
    assert metrics.roc_auc(df, ["g"], F.col("w")).first().auc == pytest.approx(brute_auc(expanded))


def test_thresholds(spark):
    rows = [("a", 1, 0.9), ("a", 1, 0.8), ("a", 0, 0.7), ("a", 1, 0.4), ("a", 0, 0.2)]
    df = scores(spark, rows)
    assert metrics.reach_sensitivity(df, ["g"], 0.6).first().threshold == 0.8
    assert metrics.reach_sensitivity(df, ["g"], 0.9).first().threshold == 0.4
    assert metrics.youden(df, ["g"]).first().threshold == 0.8
    assert metrics.youden(scores(spark, [("a", 1, 0.3)]), ["g"]).first().threshold == 0.5


def test_rates_without_positives(spark):
    r = metrics.threshold_metrics(scores(spark, [("a", 0, 0.3), ("a", 0, 0.7)]), ["g"], F.lit(0.5)).first()
    assert r.sensitivity is None and r.specificity == 0.5 and r.f1 == 0 and r.balanced_accuracy == 0.5


def test_calibration_recovers_and_refuses(spark):
    r = np.random.Generator(np.random.PCG64(3))
    lp = r.normal(size=4000)
    y = r.random(4000) < 1 / (1 + np.exp(-(0.5 + 0.7 * lp)))
    rows = [("ok", int(a), float(1 / (1 + math.exp(-b)))) for a, b in zip(y, lp)] + [("split", 1, 0.9), ("split", 0, 0.1), ("same", 1, 0.5), ("same", 0, 0.5), ("one", 1, 0.2)]
    found = {x.g: x for x in metrics.calibration(scores(spark, rows), ["g"]).collect()}
    assert found["ok"].slope == pytest.approx(0.7, abs=0.12) and found["split"].slope is None and found["same"].slope is None and found["one"].intercept is None


def test_offset_meets_prevalence(spark):
    df = scores(spark, [("a", 0, p / 50) for p in range(1, 50)])
    t = metrics.recalibrated_offset(df, ["g"], 0.2).first().offset
    assert np.mean([1 / (1 + math.exp(-(math.log((p / 50) / (1 - p / 50)) + t))) for p in range(1, 50)]) == pytest.approx(0.2, abs=1e-6)


def test_running_sums_over_buckets(spark):
    r = random.Random(4)
    rows = [("a", r.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, p double")
    out = {x.p: x.c for x in running(df, ["g"], F.floor(F.col("p") * 7), ["p"], {"c": F.lit(1)}).collect()}
    assert [out[p] for _, p in sorted(rows)] == list(range(1, 201))


def test_numbers_are_a_permutation(spark):
    df = spark.range(500).withColumn("h", rng.hashed("x", F.col("id"))).withColumn("g", F.col("id") % 2)
    out = numbered(df, ["g"], "h", "n", ["id"]).collect()
    assert all(sorted(x.n for x in out if x.g == g) == list(range(250)) for g in (0, 1))


def test_bootstrap_keeps_class_sizes_and_seeds(spark):
    df = spark.createDataFrame([(i, "a", int(i % 3 == 0), i / 300) for i in range(300)], "sample long, g string, y int, p double")
    w = resample.bootstrap_weights(df, ["g"], "sample", 3)
    sums = {(x.draw, x.y): x.n for x in w.groupBy("draw", "y").agg(F.sum("w").alias("n")).collect()}
    assert set(sums.values()) == {100, 200} and len(sums) == 6
    other = resample.bootstrap_weights(df, ["g"], "sample", 3, seed="other")
    assert w.exceptAll(resample.bootstrap_weights(df, ["g"], "sample", 3)).count() == 0 and w.exceptAll(other).count() > 0


def brute_metrics(y, p, w, cut, low):
    """Metrics of weighted rows, by their definitions."""
    pos, neg = w * (y == 1), w * (y == 0)
    pairs = (p[:, None] > p[None, :]) + (p[:, None] == p[None, :]) / 2
    out = {"auc": pos @ pairs @ neg / (pos.sum() * neg.sum()), "brier": (w * (p - y) ** 2).sum() / w.sum()}
    out["pr_auc"] = sum(pos[p == t].sum() / pos.sum() * pos[p >= t].sum() / w[p >= t].sum() for t in np.unique(p) if w[p >= t].sum())
    b = np.minimum((p * 10).astype(int), 9)
    out["ece"] = sum(abs((w * (y - p))[b == k].sum()) for k in range(10)) / w.sum()
    for mark, t in (("", cut), ("screening_", low)):
        hit = p >= t
        out[mark + "sensitivity"], out[mark + "specificity"] = pos[hit].sum() / pos.sum(), neg[~hit].sum() / neg.sum()
        out[mark + "precision"] = pos[hit].sum() / w[hit].sum()
    return out


@pytest.mark.parametrize("block", [1 << 14, 40])
def test_bootstrap_counts_draws_by_score(spark, block):
    from sondage.operators import bootstrap

    r = np.random.Generator(np.random.PCG64(21))
    y, p = (r.random(300) < 0.4).astype(int), np.round(r.random(300), 2)
    df = spark.createDataFrame([("a", 7, int(a), float(b)) for a, b in zip(y, p)], "g string, h int, y int, p double")
    draws = {x.draw: x for x in bootstrap.bootstrap_metrics(df, ["g", "h"], 400, 0.5, 0.3, block=block).collect()}
    whole = brute_metrics(y, p, np.ones(300), 0.5, 0.3)
    assert sorted(draws) == list(range(400))
    # Around the metrics of all rows, with the spread of draws made by another generator.
    other = [brute_metrics(y, p, np.bincount(np.concatenate([r.choice(np.flatnonzero(y == k), (y == k).sum()) for k in (0, 1)]), minlength=300), 0.5, 0.3) for _ in range(150)]
    for m in ("auc", "pr_auc", "brier", "sensitivity", "screening_specificity", "precision"):
        mine, theirs = np.array([d[m] for d in draws.values()]), np.array([d[m] for d in other])
        assert abs(mine.mean() - theirs.mean()) < 5 * theirs.std() / 150**0.5 and 0.8 < mine.std() / theirs.std() < 1.25, m
    if block > 300:
        order = np.lexsort((np.arange(300), p))
        for d in (0, 17):
            w = np.zeros(300)
            for k in (0, 1):
                rows = order[y[order] == k]
                np.add.at(w, rows[rng.positions(rng.seeds([f"boot:a:7:{k}:0:{d}"])[0], len(rows), len(rows))], 1)
            want = brute_metrics(y, p, w, 0.5, 0.3)
            assert {m: draws[d][m] for m in want} == pytest.approx(want)
    assert whole["auc"] == pytest.approx(metrics.roc_auc(df, ["g"]).first().auc)


def test_all_metrics_against_definitions(spark):
    r = np.random.Generator(np.random.PCG64(22))
    y, p = (r.random(200) < 0.3).astype(int), np.round(r.random(200), 2)
    df = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(y, p)] + [("one", 1, 0.4)], "g string, y int, p double")
    rows = {x.g: x for x in metrics.all_metrics(df, ["g"], F.lit(0.5), {"screening": F.lit(0.3)}).collect()}
    want = brute_metrics(y, p, np.ones(200), 0.5, 0.3)
    assert {m: rows["a"][m] for m in want} == pytest.approx(want) and rows["a"].n == 200 and rows["a"].n_positive == y.sum()
    assert rows["one"].auc is None and rows["one"].pr_auc is None and rows["one"].slope is None and rows["one"].sensitivity == 0 and rows["one"].screening_sensitivity == 1


def test_large_groups_are_fitted_like_small_ones(spark):
    r = np.random.Generator(np.random.PCG64(23))
    rows = [(g, int(r.random() < 0.2 + 0.6 * q), q) for g in "ab" for q in r.random(200).round(3).tolist()] + [("c", 1, 0.9), ("c", 0, 0.2), ("c", 1, 0.1)]
    df = scores(spark, rows)
    small, large = ({x.g: (x.slope, x.intercept) for x in metrics.calibration(df, ["g"], largest=n).collect()} for n in (1000, 50))
    assert set(small) == set("abc") == set(large) and all(small[g] == pytest.approx(large[g]) for g in small)
    few, many = ({x.g: x.offset for x in metrics.recalibrated_offset(df, ["g"], 0.3, largest=n).collect()} for n in (1000, 50))
    assert few == pytest.approx(many, abs=1e-8)


def test_quantiles_are_exact_with_an_outlier(spark):
    r = np.random.Generator(np.random.PCG64(24))
    values = [*np.round(r.normal(size=500), 1).tolist(), 1e12]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0), ("b", None), ("c", None)], "g string, x double")
    found = {x.g: x.q for x in quantiles(df, ["g"], "x", [0, 0.1, 0.5, 0.975, 1], "q").collect()}
    assert found["a"] == pytest.approx(np.quantile(values, [0, 0.1, 0.5, 0.975, 1])) and found["b"] == [3.0] * 5 and "c" not in found


def test_missing_values_rank_last(spark):
    df = spark.createDataFrame([("a", "u", 1.0), ("a", "v", None), ("a", "w", 2.0), ("a", "x", 2.0), ("a", "z", 1e12)], "g string, f string, x double")
    ranks = lambda d: {x.f: x.r for x in resample.midranks(df, ["g"], "x", "r", descending=d).collect()}
    assert ranks(True) == {"z": 1, "w": 2.5, "x": 2.5, "u": 4, "v": 5} and ranks(False) == {"u": 1, "w": 2.5, "x": 2.5, "z": 4, "v": 5}


def test_linkage_against_nested_loop(spark):
    r = random.Random(5)
    inf = math.inf
    left = [(i, i % 2, *(r.choice([(-inf, inf), (-inf, 5.0), (5.0, inf), (float(k := r.randint(0, 9)), k + 2.0)]))) for i in range(60)]
    right = [(j, j % 2, r.choice([None, r.random() * 12])) for j in range(40)]
    a = spark.createDataFrame(left, "i long, o int, v_lo double, v_hi double")
    b = spark.createDataFrame(right, "j long, o int, v double")
    found = {(x.i, x.j) for x in linkage.edges(linkage.pairs(a, b, ["v"], "o", linkage.EPS, 3.0), ["v"]).collect()}
    assert found == {(i, j) for i, o, lo, hi in left for j, q, v in right if o == q and (v is None or lo - 1e-9 <= v <= hi + 1e-9)}


def test_fisher():
    import pandas as pd

    assert linkage.fisher(*[pd.Series([v]) for v in (8, 2, 1, 5)])[0] == pytest.approx(0.0349650, abs=1e-6)


def test_guards(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b__x", "class"])
    with pytest.raises(LeakageError):
        guard(df, ["b"])
    assert guard(df, ["b"], allow=["b"]) is df
    with pytest.raises(LeakageError):
        select_columns(df, ["a", "zz"])
    with pytest.raises(LeakageError):
        assert_clean(df, FeatureSet("f", ("a", "b", "class")), [], "class")
    with pytest.raises(LeakageError):
        assert_clean(df.select("a", "b__x"), FeatureSet("f", ("a",)), [], "class")
    with pytest.raises(LeakageError):
        FeatureSet("f", ("a",), valid=True, leaks=frozenset({"a"}))
    with pytest.raises(LeakageError):
        gate("OVERLAPPING", "INDEPENDENT")
    gate("INDEPENDENT", "INDEPENDENT")


def test_models_learn_and_stay_in_range():
    r = np.random.Generator(np.random.PCG64(7))
    x = r.normal(size=(300, 3))
    y = (r.random(300) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    for name in ("logreg", "additive", "kernel"):
        make, grid = models.MODELS[name][:2]
        p = make(x, y, **grid[-1])(x)
        assert ((p >= 0) & (p <= 1)).all() and models.auc(y, p) > 0.75
    step = models.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert (np.diff(step(np.linspace(0, 1, 20))) >= 0).all()


@pytest.mark.parametrize("name", ["random_forest", "xgboost"])
def test_trees_find_an_interaction(name):
    r = np.random.Generator(np.random.PCG64(8))
    x = np.column_stack([r.normal(size=(900, 2)), r.integers(0, 4, 900)])
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    make, grid = models.MODELS[name][:2]
    assert len(grid) == 8
    for options in (grid[0], grid[-1]):
        model = make(x[:600], y[:600], **options)
        p = model(x[600:])
        assert ((p >= 0) & (p <= 1)).all() and models.auc(y[600:], p) > 0.9
        assert (sum(len(t) for t in [model.trees]) if name == "xgboost" else sum(part[0] for part in model.parts)) == 300
    assert models.auc(y[600:], models.Logistic(x[:600], y[:600])(x[600:])) < 0.7


def test_a_tree_cuts_where_gini_is_least():
    r = np.random.Generator(np.random.PCG64(9))
    x, y = np.sort(r.normal(size=60))[:, None], (np.arange(60) >= 37).astype(float)
    y[[5, 50]] = 1 - y[[5, 50]]
    model = models.Forest(x, y, depth=1, trees=1)
    drawn = np.random.Generator(np.random.PCG64(11)).integers(0, 60, (1, 60))[0]
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean()) if len(v) else 0.0
    cuts = np.unique(x[drawn])
    least = min((cuts[1:] + cuts[:-1]) / 2, key=lambda c: gini(y[drawn][x[drawn, 0] <= c]) + gini(y[drawn][x[drawn, 0] > c]))
    assert model.parts[0][2][0] == least
    assert np.allclose(np.unique(model(x)), np.sort([y[drawn][x[drawn, 0] <= least].mean(), y[drawn][x[drawn, 0] > least].mean()]))


def test_nested_cv_has_all_six_models(spark, small):
    from sondage.plans import modelling

    both = modelling.nested_cv(spark, small).unionByName(modelling.nested_cv_trees(spark, small))
    n = {r.model: r["count"] for r in both.groupBy("model").count().collect()}
    assert set(n) == {"dummy", "logreg", "random_forest", "kernel", "xgboost", "additive"} == set(models.available_models()) and len(set(n.values())) == 1


def test_nested_cv_is_reproducible_and_whole(spark, small):
    from sondage.plans import modelling

    a, b = (modelling.nested_cv(spark, small).where("model = 'logreg'").select("model", "repeat", "sample", F.round("p", 10).alias("p")).collect() for _ in range(2))
    assert sorted(a) == sorted(b) and len(a) == len({(x.model, x.repeat, x.sample) for x in a})


def test_nested_best_single_auc_against_pandas(spark, small):
    from sondage.plans import resampling

    train, best, df = (d.toPandas() for d in resampling.nested_picks(spark, small))
    scores = {}
    for b in best.itertuples():
        middle = train[(train.repeat == b.repeat) & (train.k == b.k) & (train.feature == b.feature)].x.median()
        for r in df[(df.repeat == b.repeat) & (df.fold == b.k) & (df.feature == b.feature)].itertuples():
            scores.setdefault((r.id, r.y), []).append(b.sign * (middle if math.isnan(r.x) else r.x))
    y, p = np.array([k[1] for k in scores], float), np.array([np.mean(v) for v in scores.values()])
    assert abs(resampling.nested_best_single_auc(spark, small).first().auc - models.auc(y, p)) < 1e-6


def test_lift_interval_is_around_the_lift(spark, small):
    from sondage.plans import linking, resampling

    assert linking.provenance_gate(spark, small).count() == 1

    assert resampling.LIFT_DRAWS == 2000
    lift = {r.m: r.lift for r in resampling.multivariable_lift(spark, small).collect()}
    for r in resample.interval_of(resampling.lift_draws(spark, small, 50), ["m"], "lift").collect():
        assert r.n_draws == 50 and r.lo < lift[r.m] < r.hi


def test_resampling_has_all_its_draws(spark, small):
    from sondage.plans import PLANS, linking, modelling, resampling

    assert resampling.DRAWS == 2000 and resampling.CHECKPOINTS == [100, 200, 500, 1000] and linking.PERMUTATIONS == 200
    assert PLANS["copula_null"](spark, small).count() == 200
    assert PLANS["procedure_bootstrap"](spark, small).first().draws == 200
    curve = PLANS["saturation_curve"](spark, small).collect()
    assert sorted(r.percent for r in curve) == [10, 20, 30, 40, 55, 70, 85, 100] and max(r.n for r in curve) == 5 * modelling.SATURATION_REPEATS
    found = PLANS["null_exceedance"](spark, small).first()
    assert found.p_bound == round((found.exceed + 1) / 201, 9)


def test_checksum_gate(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    assert files.checksum_gate(spark, str(tmp_path), {"x.bin": good}).count() == 1
    with pytest.raises(files.SourceError):
        files.checksum_gate(spark, str(tmp_path), {"x.bin": "0" * 64})
    with pytest.raises(files.SourceError):
        files.checksum_gate(spark, str(tmp_path), {"y.bin": good})


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "l.csv").write_text("\n".join(f"row{i}" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = files.numbered_lines(spark, str(tmp_path / "l.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and all(r.value == f"row{r.line}" for r in rows)


def test_open_intervals_and_outliers_stay_cheap(spark):
    inf = math.inf
    a = spark.createDataFrame([(1, -inf, inf), (2, 5.0, inf), (3, -inf, 5.0), (4, 1.0, 2.0), (5, 1e10, 1e10)], "i long, v_lo double, v_hi double").withColumn("o", F.lit(0))
    values = [0.5, 1.0, 2.0, 4.9, 5.0, 7.5, 1e10, -1e10, None]
    b = spark.createDataFrame(list(enumerate(values)), "j long, v double").withColumn("o", F.lit(0))
    found = {(x.i, x.j) for x in linkage.pairs(a, b, ["v"], "o", linkage.EPS, 1.0).collect()}
    assert found == {(x.i, j) for x in a.collect() for j, v in enumerate(values) if v is None or x.v_lo <= v <= x.v_hi}
    none = linkage.pairs(a, b.where("v IS NULL"), ["v"], None, linkage.EPS, 1.0)
    assert none.count() == 5 and linkage.pairs(a, b.limit(0), ["v"], "o", linkage.EPS, 1.0).count() == 0


def test_normal_distribution(spark):
    from statistics import NormalDist

    from sondage.functions.normal import norm_cdf, norm_ppf

    p = [0.0, 1e-300, 1e-9, 0.01, 0.024, 0.3, 0.5, 0.9, 0.999999, 1.0]
    rows = spark.createDataFrame([(v,) for v in p], "p double").select("p", norm_ppf(F.col("p")).alias("x"), norm_cdf(norm_ppf(F.col("p"))).alias("q")).collect()
    assert rows[0].x == -math.inf and rows[-1].x == math.inf
    assert all(r.x == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-8, abs=1e-9) and r.q == pytest.approx(r.p, rel=1e-6) for r in rows[1:-1])
    x = [-40.0, -8.0, -1.0, 0.0, 2.5, 40.0]
    got = [r.q for r in spark.createDataFrame([(v,) for v in x], "x double").select(norm_cdf(F.col("x")).alias("q")).collect()]
    assert got == pytest.approx([NormalDist().cdf(v) for v in x], rel=1e-7, abs=1e-15)


def test_copula_keeps_marginals_gaps_and_correlation(spark):
    r = np.random.Generator(np.random.PCG64(25))
    z = r.standard_normal((400, 2)) @ np.linalg.cholesky([[1, 0.8], [0.8, 1]]).T
    rows = [(j, j % 2, float(round(np.exp(a), 1)), float(b) if j % 10 else None) for j, (a, b) in enumerate(z)]
    df = spark.createDataFrame(rows, "j long, s long, u double, v double")
    out = linkage.copula_draws(df, "s", ["u", "v"], 20).toPandas()
    assert len(out) == 8000 and set(out.u) <= {x[2] for x in rows} and out[out.j % 10 == 0].v.isna().all() and out[out.j % 10 != 0].v.notna().all()
    rho = out.dropna().groupby("draw")[["u", "v"]].apply(lambda d: d.u.rank().corr(d.v.rank()))
    assert 0.65 < rho.mean() < 0.85 and rho.std() > 0.005
    assert abs(np.median(out.u) - np.median([x[2] for x in rows])) < 0.15


def test_registry_names_what_it_knows():
    from sondage.operators.guard import Registry, UnknownName, Variable

    r = Registry((FeatureSet("a", ("x", "y")), FeatureSet("b", ("x",), valid=False)), (Variable("x", "legitimate_pre_index"), Variable("y", "diagnostic_criterion_input", "cheap", True)))
    assert r.by_name("a").features == ("x", "y") and r.valid_names() == ["a"] and [v.name for v in r.uncertain()] == ["y"] and [v.name for v in r.by_tier("cheap")] == ["y"]
    with pytest.raises(UnknownName, match="a, b"):
        r.by_name("c")
    with pytest.raises(UnknownName, match="cheap"):
        r.by_tier("dear")


def test_restricted_sets_by_rule(spark):
    from sondage.operators.guard import RESTRICTIONS, restricted_sets

    rows = [(3, "late", "consequence_of_advanced_disease", None, False, True), (1, "sc", "diagnostic_criterion_input", "creatinine", False, True), (2, "age", "legitimate_pre_index", None, False, True), (0, "bp", "legitimate_pre_index", None, True, None), (4, "odd", None, None, None, None)]
    df = spark.createDataFrame(rows, "place int, variable string, category string, limb string, uncertain boolean, low_cost boolean")
    found = {r.name: (r.n, r.features) for r in restricted_sets(df).collect()}
    assert list(found) and set(found) == {r[0] for r in RESTRICTIONS} and len(found) == 10
    assert found["full_valid (reference)"] == (5, "bp,sc,age,late,odd") and found["minus creatinine/eGFR information"] == (4, "bp,age,late,odd") and found["minus incorporation and consequences"] == (3, "bp,age,odd")
    assert found["pre-index available only"] == (2, "bp,age") and found["conservative pre-index (no uncertain)"] == (1, "age") == found["minimal low-cost conservative"]
    assert {r.n for r in restricted_sets(df.limit(0)).collect()} == {0}


def test_gate_refuses_an_overlap(spark):
    from sondage.operators.guard import gated

    df = spark.range(1)
    assert gated(df, "INDEPENDENT") is df and gated(df, "SAME-SOURCE", "SAME-SOURCE") is df
    with pytest.raises(LeakageError):
        gated(df, "OVERLAPPING")
    with pytest.raises(LeakageError):
        gated(df, "INDEPENDENT", "SAME-SOURCE")


def test_quoted_commas_keep_their_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\nunits,"x, y"\n1,"p, ""q"""\n2,\n')
    meta, rows = files.split_metadata(files.numbered_lines(spark, str(tmp_path / "m.csv")), 1, ["a", "b"])
    assert meta.first().b == "x, y" and [(r.a, r.b) for r in rows.orderBy("line").collect()] == [("1", 'p, "q"'), ("2", "")]
    (tmp_path / "x.arff").write_text("% c\n@relation r\n@attribute 'n m' numeric\n@attribute t {any}\n@data\n1.5,'a, b'\n?,plain\n")
    assert [tuple(r) for r in files.read_arff(spark, str(tmp_path / "x.arff")).collect()] == [(1.5, "a, b"), (None, "plain")]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        class getConf:
            def get(self, _):
                return None

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda k, d: None)

    with pytest.raises(files.SourceError):
        files.scratch(Session, "x")


def test_draws_of_a_mix(spark):
    r = np.random.Generator(np.random.PCG64(26))
    rows = [("g", i, int(i < 40), "a" if i % 4 else "b", round(float(r.random() * (1.2 if i < 40 else 1)) / 1.2, 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, sample int, y int, s string, p double")
    mix = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "s string, target double")
    out = resample.casemix(df, ["g"], mix, "s", "sample", 200).toPandas()
    pos = {s: [x[4] for x in rows if x[2] and x[3] == s] for s in "ab"}
    neg = np.array([x[4] for x in rows if not x[2]])
    place = lambda p: (neg < p).mean() + (neg == p).mean() / 2
    want = 0.25 * np.mean([place(p) for p in pos["a"]]) + 0.75 * np.mean([place(p) for p in pos["b"]])
    assert len(out) == 200 and abs(out.auc.mean() - want) < 0.02 and (out.distinct_cases <= 20).all() and (out.reuse >= 3).all()
    sens = 0.25 * np.mean([p >= 0.5 for p in pos["a"]]) + 0.75 * np.mean([p >= 0.5 for p in pos["b"]])
    assert abs(out.sensitivity.mean() - sens) < 0.03 and out.pr_auc.between(0, 1).all()


def test_lifts_are_those_of_rows_and_draws(spark, small, monkeypatch):
    """The draws of bootstrap_weights(), in many blocks, without a row for each of them."""
    from sondage.plans import resampling

    best = resampling.best_single_predictor(spark, small).first()["feature"]
    c = spark.read.parquet(f"{small}/customer.parquet").selectExpr("c_custkey AS id", "c_custkey % 2 AS m", "round(abs(c_acctbal) / 10000, 4) AS model")
    rows = resampling.features(spark, small).where(F.col("feature") == best).select("id", "y", F.col("x").alias("single")).join(c, "id")
    boot = resample.bootstrap_weights(rows, [], "id", 9).withColumn("w", F.col("w").cast("double"))
    model = metrics.roc_auc(boot.withColumn("p", F.col("model")), ["m", "draw"], F.col("w")).collect()
    single = {r.draw: max(r.auc, 1 - r.auc) for r in metrics.roc_auc(boot.where("single IS NOT NULL").withColumn("p", F.col("single")), ["draw"], F.col("w"), any_range=True).collect()}
    for name, value in {"WIDE": 8, "HIGH": 16, "PIECE": 4}.items():
        monkeypatch.setattr(resample, name, value)
    monkeypatch.setattr(resample, "bootstrap_weights", None)
    found = {(r.m, r.draw): r.lift for r in resampling.lift_draws(spark, small, 9).collect()}
    assert len(found) == 18 and found == pytest.approx({(r.m, r.draw): r.auc - single[r.draw] for r in model})


def test_draws_of_a_mix_over_blocks(spark, monkeypatch):
    """Every draw against brute force, with many blocks and ranges of scores, ties and a hot score; no pick is a row."""
    import hashlib

    for name, value in {"WIDE": 8, "HIGH": 16, "PIECE": 7}.items():
        monkeypatch.setattr(resample, name, value)
    monkeypatch.setattr(resample.rng, "uniform", None)
    r = np.random.Generator(np.random.PCG64(5))
    rows = [(i, int(i < 90), "ab"[i % 3 == 0], 0.7 if i % 4 == 0 else round(float(r.random()), 1 + i % 3)) for i in range(150)]
    df = spark.createDataFrame([("g", *x) for x in rows], "g string, sample int, y int, s string, p double")
    out = resample.casemix(df, ["g"], spark.createDataFrame([("a", 0.3), ("b", 0.7)], "s string, target double"), "s", "sample", 60).toPandas().set_index("draw")
    h = lambda x: hashlib.md5(x.encode()).hexdigest()
    neg = np.array([x[3] for x in rows if not x[1]])
    for d in range(60):
        taken, used = [], []
        for s, target in (("a", 0.3), ("b", 0.7)):
            base = sorted((h(f"mix:{x[0]}"), x[0], x[3]) for x in rows if x[1] and x[2] == s)
            picks = [int(int(h(f"mix:{s}:g:{d}:{j}")[:8], 16) / 2**32 * len(base)) for j in range(round(90 * target))]
            taken += [base[k][2] for k in picks]
            used += [picks.count(k) for k in set(picks)]
        taken = np.array(taken)
        auc = np.mean([(neg < p).mean() + (neg == p).mean() / 2 for p in taken])
        pr = np.mean([(taken >= p).sum() / ((taken >= p).sum() + (neg >= p).sum()) for p in taken])
        row = out.loc[d]
        assert (row.auc, row.pr_auc, row.sensitivity) == pytest.approx((auc, pr, (taken >= 0.5).mean())) and (row.distinct_cases, row.reuse) == (len(used), max(used))


def test_zoo_has_its_grids():
    assert {n: len(s.grid) for n, s in models.MODELS.items()} == {"dummy": 1, "logreg": 12, "additive": 2, "random_forest": 8, "xgboost": 8, "kernel": 12}
    assert all(s.label for s in models.MODELS.values())


def test_checked_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.csv").write_text("k,v\n1,x\n")
    raw = files.RawFile(str(tmp_path / "a.csv"), hashlib.sha256(b"k,v\n1,x\n").hexdigest())
    found = files.load(spark, raw, lambda p: files.read_strict(spark, p, ["k", "v"]))
    assert [tuple(r) for r in found.rows.collect()] == [("1", "x")] and found.file == raw
    with pytest.raises(files.SourceError):
        files.load(spark, files.RawFile(raw.path, "0" * 64), lambda p: spark.range(1))


def test_buckets_of_a_table_whose_rows_arrive_in_another_order_each_time(spark):
    """Approximate edges depend on the order of the rows; ranks must not."""
    from sondage.operators.ranks import by_edges, running

    def mixed(parts):
        yield pd.concat(parts).sample(frac=1)

    values = spark.range(0, 300_000, 1, 2).select((F.col("id") * 7919 % 300_000).cast("double").alias("x"))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # else one computation may happen to serve both
    try:
        rows, bucket = by_edges(values.mapInPandas(mixed, "x double"), [], "x")
        assert running(rows, [], bucket, ["x"], {"upto": F.lit(1)}).where("upto != x + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_ranks_of_draws_are_not_broadcast(spark):
    """However small they are compressed: repeated draws of few values."""
    rows = spark.range(4000).select((F.col("id") % 50).alias("draw"), (F.col("id") % 7).cast("double").alias("x"))
    ranked = resample.midranks(rows, ["draw"], "x", "r")
    ranked.collect()
    joins = [line for line in ranked._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert "SortMergeJoin" in joins[0]


def test_counts_of_draws_are_not_broadcast(spark):
    from sondage.operators.linkage import compatible

    lhs = spark.createDataFrame([(0, float(k), k + 1.0, 0.0, 2.0) for k in range(5)], "o int, a_lo double, a_hi double, b_lo double, b_hi double")
    rhs = spark.range(60).selectExpr("0 AS o", "id % 3 AS draw", "CAST(id % 5 AS DOUBLE) AS a", "CAST(id % 4 AS DOUBLE) AS b")
    found = compatible(lhs, rhs, ["a", "b"], "o", per=["draw"])
    got = {(r.a_lo, r.draw): r.n for r in found.collect()}
    held = [(i % 3, i % 5, i % 4) for i in range(60)]
    want = {(float(k), d): sum(e == d and k <= a <= k + 1 and b <= 2 for e, a, b in held) for k in range(5) for d in range(3)}
    # Ends reach 1e-9 further, which changes nothing here.
    assert {(round(a), d): n for (a, d), n in got.items()} == {(round(a), d): n for (a, d), n in want.items() if n}
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert "SortMergeJoin" in joins[0] and "SortMergeJoin" in joins[1]


def test_places_in_many_draws_are_not_broadcast(spark):
    rows = spark.range(2000).select((F.col("id") % 40).alias("draw"), F.col("id").alias("j")).withColumn("_h", rng.hashed("t", F.col("j")))
    placed = numbered(rows, ["draw"], "_h", "pos", ["j"], many=True)
    found = {(r.draw, r._h): r.pos for r in placed.collect()}
    for d in range(40):
        assert [found[d, h] for h in sorted(h for e, h in found if e == d)] == list(range(50))
    assert "Broadcast" not in placed._jdf.queryExecution().executedPlan().toString()
