"""Regressions that are trained in sums over tasks against the single-machine trainer; metrics with unusable scores; balanced draws."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import bootstrap, metrics, models, resample, ridge


@pytest.fixture(scope="module")
def people(spark):
    r = np.random.Generator(np.random.PCG64(7))
    x = r.normal(size=(240, 3)) * [1, 50, 0] + [0, 10, 4]
    y = (r.random(240) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] / 60)))).astype(int)
    gap = lambda v: None if r.random() < 0.1 else math.nan if r.random() < 0.1 else float(v)
    rows = [(i, int(y[i]), i % 2, int(r.integers(0, 3)), gap(x[i, 0]), gap(x[i, 1]), 4.0) for i in range(240)]
    return spark.createDataFrame(rows, "sample long, y int, repeat int, fold int, a double, b double, same double")


def test_many_fits_at_once_equal_single_ones(spark, people):
    features, keys = ["a", "b", "same"], ["repeat", "fold"]
    facts = ridge.scales(people, keys, features)
    grid = spark.createDataFrame([(0, 0.01, False), (1, 1.0, True), (2, 100.0, False)], "option int, c double, balanced boolean")
    some = ridge.scaled(people, facts, keys, features)
    got = {(r.repeat, r.fold, r.option): list(r.b) for r in ridge.fit(some.repartition(7), keys, 3, facts.select(*keys).crossJoin(grid)).collect()}
    local = people.toPandas()
    for (repeat, fold), part in local.groupby(keys):
        x, y = part[features].to_numpy(float), part["y"].to_numpy(float)
        for o, c, balanced in [tuple(r) for r in grid.collect()]:
            assert got.pop((repeat, fold, o)) == pytest.approx(models.Logistic(models.Scale(x)(x), y, c=c, balanced=balanced).b.tolist(), abs=1e-8)
    assert not got
    empty = people.limit(0)
    assert ridge.fit(ridge.scaled(empty, ridge.scales(empty, keys, features), keys, features), keys, 3, facts.select(*keys).crossJoin(grid)).count() == 0


def test_nested_logistic_equals_the_group_trainer(spark, people):
    settings = models.Settings(outer=3, inner=3)
    tasks = spark.createDataFrame([("logreg", "none", r) for r in range(2)], "model string, calibration string, repeat int")
    rows = lambda d: {(r.repeat, r.fold, r["sample"]): (r.y, r.params, pytest.approx(r.p, abs=1e-8), pytest.approx(r.cut, abs=1e-8), pytest.approx(r.inner_score, abs=1e-9)) for r in d.collect()}
    mine, other = rows(ridge.nested_logistic(people, ["a", "b"], tasks, settings)), {(r.repeat, r.fold, r["sample"]): (r.y, r.params, r.p, r.cut, r.inner_score) for r in models.nested_cv(people, ["a", "b"], tasks, settings).collect()}
    assert len(mine) == 240 and set(mine) == set(other) and all(other[k] == mine[k] for k in mine)


def test_a_task_as_one_group_and_rows_in_blocks_give_the_same_predictions(spark, people, monkeypatch):
    tasks = spark.createDataFrame([(m, "none", r) for m in ("dummy", "logreg", "additive") for r in range(2)], "model string, calibration string, repeat int")
    settings = models.Settings(outer=3, inner=2)
    rows = lambda: {(r.model, r.repeat, r.fold, r["sample"]): (r.y, r.params, pytest.approx(r.p), pytest.approx(r.cut), None if r.inner_score is None else pytest.approx(r.inner_score)) for r in models.nested_cv(people, ["a", "b"], tasks, settings).collect()}
    several = rows()
    monkeypatch.setattr(models, "MANY", 1)
    one = models.nested_cv(people, ["a", "b"], tasks, settings)
    # No copy of the rows by fold and parameter set: one group a task.
    assert "Generate" not in one._jdf.queryExecution().executedPlan().toString() and len(several) == 720 and rows() == several
    r = np.random.Generator(np.random.PCG64(1))
    x, y = r.normal(size=(500, 3)), (r.random(500) < 0.4).astype(float)
    whole = [m(x, y)(x) for m in (models.Logistic, models.Additive, models.Fourier)]
    monkeypatch.setattr(models, "BLOCK", 200), monkeypatch.setattr(models, "KEPT", 0)
    for p, make in zip(whole, (models.Logistic, models.Additive, models.Fourier)):
        assert make(x, y)(x) == pytest.approx(p, abs=1e-9)


def test_importance_sends_narrow_rows_to_its_groups(spark, people):
    assert dict(models._lean(people, ["a"], "repeat").dtypes) == {"repeat": "int", "sample": "bigint", "y": "tinyint", "fold": "smallint", "a": "double"}
    got = models.permutation_importance(people, ["a", "same"], 2)
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.fold, r.feature) for r in got.collect()} == {(k, f) for k in range(3) for f in ("a", "same")}


def test_ranks_by_hash_exchange_the_rows_once(spark):
    from sondage.functions import rng
    from sondage.operators.ranks import numbered

    df = spark.range(3000).selectExpr("id AS sample", "CASE WHEN id % 7 > 0 THEN id % 3 END AS g").withColumn("_h", rng.hashed("x", F.col("sample")))
    out = numbered(df, ["g"], "_h", "at", ["sample"]).drop("_h")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = df.toPandas().sort_values(["_h"]).assign(at=lambda d: d.groupby("g", dropna=False).cumcount())
    assert {r["sample"]: r.at for r in out.collect()} == dict(zip(want["sample"], want["at"]))


def test_unusable_scores_count_nowhere(spark):
    good = [("a", 1, 0.9), ("a", 0, 0.2), ("a", 1, 0.6), ("a", 0, 0.7), ("b", 1, 0.5)]
    bad = [("a", 1, None), ("a", 0, math.nan), ("a", None, 0.4), ("a", 2, 0.4), ("c", 1, math.nan), ("c", 0, None)]
    schema = "g string, y int, p double"
    clean, dirty = spark.createDataFrame(good, schema), spark.createDataFrame(bad + good, schema)
    half, keys = F.lit(0.5), ["g"]
    each = {
        "all": lambda d: metrics.all_metrics(d, keys, half), "auc": lambda d: metrics.roc_auc(d, keys), "ap": lambda d: metrics.average_precision(d, keys), "brier": lambda d: metrics.brier(d, keys), "ece": lambda d: metrics.ece(d, keys),
        "at": lambda d: metrics.threshold_metrics(d, keys, half), "sep": lambda d: metrics.separation(d, keys), "grid": lambda d: metrics.at_thresholds(d, keys, 10), "curve": lambda d: metrics.calibration_curve(d, keys, 2),
        "reach": lambda d: metrics.reach_sensitivity(d, keys), "youden": lambda d: metrics.youden(d, keys), "cal": lambda d: metrics.calibration(d, keys), "boot": lambda d: bootstrap.bootstrap_metrics(d, keys, 5),
    }
    for name, metric in each.items():
        a, b = (sorted(map(repr, metric(d).collect())) for d in (clean, dirty))
        assert a == b and a, name
    row = metrics.all_metrics(dirty, keys, half).where("g = 'a'").first()
    assert row.tp + row.fp + row.tn + row.fn == row.n == 4
    assert {r.g: (r.n, r.n_unscored) for r in metrics.unscored(dirty, keys).collect()} == {"a": (8, 4), "b": (1, 0), "c": (2, 2)}


@pytest.mark.parametrize("block", [1 << 14, 5])
def test_balanced_draws_take_nobody_twice(spark, block):
    r = np.random.Generator(np.random.PCG64(9))
    rows = [(i, "g", "early" if i < 40 else "late", 1, round(float(r.random()), 2)) for i in range(52)] + [(100 + i, "g", None, 0, round(float(r.random()) * 0.8, 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "sample long, k string, stage string, y int, p double")
    out = resample.balanced(df, ["k"], "stage", "sample", 300, block=block).toPandas()
    neg = np.array([x[4] for x in rows if not x[3]])
    place = {x[0]: (neg < x[4]).mean() + (neg == x[4]).mean() / 2 for x in rows if x[3]}
    late, early = [place[i] for i in range(40, 52)], [place[i] for i in range(40)]
    assert len(out) == 300 and set(out.per_stratum) == {12} and set(out.n_cases) == {24}
    # All of the smaller stratum in every draw, a subset of the other without repeats.
    rest = out.auc * 24 - sum(late)
    assert abs(rest.mean() / 12 - np.mean(early)) < 0.02 and sum(sorted(early)[:12]) - 1e-9 <= rest.min() and rest.max() <= sum(sorted(early)[-12:]) + 1e-9
    assert abs(rest.var() / (12 * np.var(early, ddof=1) * (1 - 12 / 40)) - 1) < 0.4
    assert resample.balanced(df.where("y = 1"), ["k"], "stage", "sample", 10).count() == 0


def test_rank_correlations_of_all_pairs(spark):
    import pandas as pd

    r = np.random.Generator(np.random.PCG64(11))
    x = pd.DataFrame({"g": r.integers(0, 2, 300), "u": r.integers(0, 9, 300).astype(float), "v": r.normal(size=300), "w": 1.0})
    x["v"] += x.u / 4
    x.loc[::7, "v"] = np.nan
    df = spark.createDataFrame([(i, int(a.g), a.u, None if i % 14 == 0 else a.v, a.w) for i, a in enumerate(x.itertuples())], "i long, g int, u double, v double, w double")
    got = {(p.g, p.a, p.b): p.rho for p in resample.spearman_matrix(df, "i", ["u", "v", "w"], ["g"]).collect()}
    for g, part in x.groupby("g"):
        ranks = part[["u", "v"]].rank()
        assert got[g, "u", "v"] == pytest.approx(ranks.u[ranks.v.notna()].corr(ranks.v.dropna())) and got[g, "u", "w"] is None
    assert len(got) == 6


@pytest.mark.parametrize("balanced", [False, True])
def test_a_forest_searched_in_pieces_is_the_same_and_cuts_between_neighbouring_doubles(balanced, monkeypatch):
    r = np.random.Generator(np.random.PCG64(3))
    x = np.column_stack([r.normal(size=400), r.integers(0, 5, 400), np.zeros(400)])
    y = (r.random(400) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    grow = lambda: models.Forest(x, y, leaf=2, balanced=balanced, trees=20)
    whole = grow()
    monkeypatch.setattr(models, "TOGETHER", 60)
    assert all(np.array_equal(a, b) for a, b in zip(whole.parts[0], grow().parts[0])) and np.array_equal(whole(x), grow()(x))
    # The mean of these two doubles is the greater one.
    low = np.nextafter(1.0, 2.0)
    two = np.repeat([low, np.nextafter(low, 2.0)], 20)[:, None]
    assert models.Forest(two, np.repeat([0.0, 1.0], 20), depth=1, trees=5)(two).tolist() == [0.0] * 20 + [1.0] * 20


def test_recoded_arms_do_not_read_the_rows_again(spark, small):
    from sondage.plans import evaluation, reports

    for arms in (reports.encoded(spark, small), evaluation.label_robustness(spark, small)):
        assert "events.parquet" not in arms._jdf.queryExecution().toString()


def test_what_needs_no_cut_assigns_no_folds(spark, small, monkeypatch):
    from sondage.plans import PLANS, views

    monkeypatch.setattr(views, "folded", lambda df, folds=5: pytest.fail("folds"))
    for name in ("net_benefit", "calibration_curve_width", "threshold_tradeoff", "featureset_table", "headline_table", "bootstrap_checkpoints"):
        assert PLANS[name](spark, small).columns
    # The repeats of a row are summed before they are exchanged, and nothing is ranked.
    assert "Window" not in PLANS["net_benefit"](spark, small)._jdf.queryExecution().toString()


def test_resamples_are_drawn_where_they_are_used(spark, people):
    import hashlib

    from sondage.functions import rng

    numbers = np.array([0, 7, 9, 10, 99, 100, 12345, 99999, 10**9, 2**32 - 1, 2**32, -3])
    for start in ("", "proc:3:", "x" * 45, "x" * 60):
        assert rng.first_words(start, numbers).tolist() == [int(hashlib.md5(f"{start}{n}".encode()).hexdigest()[:8], 16) for n in numbers]
        assert rng.first_words(start, numbers[:10]).tolist() == rng.first_words(start, numbers).tolist()[:10]
    settings, draws = models.Settings(outer=3, inner=2), 4
    df = people.withColumn("sample", F.col("sample") * 3)  # a row's place counts, not its number
    got = models.resampled_aucs(df, ["a", "b"], "logreg", draws, "proc", settings)
    # The rows travel to the lanes, not to the resamples; none is joined to a draw.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "SortMergeJoin" not in plan
    local = df.toPandas().sort_values("sample").reset_index(drop=True)
    parts = [local.iloc[[int(int(hashlib.md5(f"proc:{d}:{s}".encode()).hexdigest()[:8], 16) / 2**32 * 240) for s in local["sample"]]].assign(sample=local["sample"].to_numpy(), repeat=d) for d in range(draws)]
    rows = [(int(r.sample), int(r.y), int(r.repeat), int(r.fold), float(r.a), float(r.b)) for part in parts for r in part.itertuples()]
    copies = spark.createDataFrame(rows, "sample long, y int, repeat int, fold int, a double, b double")
    tasks = spark.createDataFrame([("logreg", "none", d) for d in range(draws)], "model string, calibration string, repeat int")
    want = {r.repeat: pytest.approx(r.auc) for r in metrics.roc_auc(models.nested_cv(copies, ["a", "b"], tasks, settings), ["repeat"]).collect()}
    assert {r.draw: r.auc for r in got.collect()} == want and len(want) == draws


def test_fits_side_by_side_that_start_near_their_end_are_the_same(monkeypatch):
    r = np.random.Generator(np.random.PCG64(2))
    x = r.normal(size=(4000, 3)) * [1, 0.3, 2]
    y = (r.random(4000) < 1 / (1 + np.exp(-x[:, 0] + 1))).astype(float)
    for make, some in ((models.Logistic, models.MODELS["logreg"].grid), (models.Fourier, [o for o in models.MODELS["kernel"].grid if o["gamma"] == 0.01])):
        monkeypatch.setattr(models, "LARGE", 1 << 14)
        alone = [make(x, y, **o)(x[:500]) for o in some]
        monkeypatch.setattr(models, "LARGE", 100)
        assert make.several(x, y, some, x[:500]) == pytest.approx(np.array(alone), abs=1e-9)
    assert models.auc(y, np.round(x[:, 0], 1) + 9) == pytest.approx(models.auc(y, np.round(x[:, 0], 1)), abs=1e-15)


def test_draws_of_a_mix_stay_in_their_lanes(spark, monkeypatch):
    r = np.random.Generator(np.random.PCG64(8))
    rows = [("gh"[i % 5 == 0], i, int(i < 60), "ab"[i % 3 == 0], round(float(r.random()), 1)) for i in range(140)] + [(None, 200, 1, "a", 0.5), ("g", 201, 1, None, 0.5)]
    df = spark.createDataFrame(rows, "g string, sample int, y int, s string, p double")
    mix = spark.createDataFrame([("a", 0.3), ("b", 0.7), ("c", 0.2)], "s string, target double")
    out = resample.casemix(df, ["g"], mix, "s", "sample", 30)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroups" not in plan and "SortMergeJoin" not in plan
    several = sorted(out.collect())
    monkeypatch.setattr(resample, "LANES", 1), monkeypatch.setattr(resample.rng, "PIECE", 16)
    assert len(several) == 60 and [tuple(r) for r in sorted(resample.casemix(df, ["g"], mix, "s", "sample", 30).collect())] == [pytest.approx(tuple(r)) for r in several]
    assert resample.casemix(df.where("y = 0"), ["g"], mix, "s", "sample", 30).count() == 0


def test_lanes_take_the_rows_once_for_many_jobs(spark, people):
    import pyarrow as pa

    def do(k, repeat, rows):
        yield pa.table({"k": [k], "repeat": [repeat], "n": [len(rows.y)], "sorted": [bool((np.diff(rows.sample) > 0).all())]})

    jobs = [(k, r) for r in (0, 1) for k in range(200)]
    out = models._lanes(people, ["a", "same"], jobs, do, "k long, repeat long, n long, sorted boolean")
    lanes = max(models.LANES, 2 * spark.sparkContext.defaultParallelism)
    assert out.rdd.getNumPartitions() == lanes < len(jobs)
    assert sorted(map(tuple, out.collect())) == sorted((k, r, 120, True) for k, r in jobs)


def test_pooled_violators_equal_one_by_one():
    r = np.random.Generator(np.random.PCG64(4))
    for p, y in ((r.random(400), r.random(400) < 0.4), (np.arange(300) / 300, np.r_[np.tile([0, 1], 100), np.zeros(100)]), (np.round(r.random(200), 1), r.random(200) < 0.5), (np.array([0.2, 0.1]), np.array([0, 1]))):
        y, blocks = y.astype(float), []
        for x, t in sorted(zip(p, y), key=lambda v: v[0]):
            blocks.append([t, 1, x])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                t, w, x = blocks.pop()
                blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + w, x]
        at = np.linspace(0, 1, 101)
        assert models.isotonic(p, y)(at) == pytest.approx(np.interp(at, [b[2] for b in blocks], [b[0] / b[1] for b in blocks]), abs=1e-12)
