"""Ridge logistic regressions of many training sets and penalties side by side, none of which is ever held by one task.

A Newton step needs a gradient and a matrix of each training set: parts of both
are summed where the rows are, and only these sums are shuffled. The
coefficients are a small table that is joined to the rows by the training set's
keys, so a set of any size, and any number of sets, are fitted in as many rounds
as the slowest takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sondage.operators import metrics as M
from sondage.operators.models import MODELS, Settings
from sondage.operators.ranks import by_edges, quantiles, running
from sondage.session import ship
from sondage.sources.files import remove, scratch, written

#: The intercept's penalty, the largest move of a step and the move that ends it, and how many steps there are at most.
FREE, LONGEST, STILL, STEPS = 1e-9, 10.0, 1e-8, 50
#: Training sets whose sums a task holds before it passes them on.
HELD = 500


def _same(a: DataFrame, keys: list[str], marks: list[str]) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marks)], F.lit(True))


def scales(train: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, middle, mean, sd): of each training set the features' medians, and mean and population deviation of the values with
    the gaps (null or NaN) filled by these. A feature without values has median 0, one without spread deviation 1."""
    clean = train.select(*keys, *[F.when(~F.isnan(f), F.col(f)).alias(f) for f in features])
    long = clean.unpivot(keys, features, "_f", "_x")
    middle = quantiles(long, [*keys, "_f"], "_x", [0.5], "_q").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_f", F.col("_q")[0]))).alias("_m"))  # a row per feature
    marks = [f"_k{i}" for i in range(len(keys))]
    named = middle.select(*[F.col(k).alias(m) for k, m in zip(keys, marks)], "_m")
    at = lambda f: F.coalesce(F.try_element_at("_m", F.lit(f)), F.lit(0.0))
    rows = clean.join(named, _same(clean, keys, marks), "left")
    filled = [F.coalesce(F.col(f), at(f)) for f in features]
    sd = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return rows.groupBy(*keys).agg(F.array(*[F.first(at(f)) for f in features]).alias("middle"), F.array(*[F.avg(c) for c in filled]).alias("mean"), F.array(*[sd(c) for c in filled]).alias("sd"))


def scaled(rows: DataFrame, facts: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """rows with _x0, _x1, ...: the features as their training set scales them."""
    marks = [f"_k{i}" for i in range(len(keys))]
    named = facts.select(*[F.col(k).alias(m) for k, m in zip(keys, marks)], "middle", "mean", "sd")
    value = lambda i, f: (F.coalesce(F.when(~F.isnan(f), F.col(f)), F.col("middle")[i]) - F.col("mean")[i]) / F.col("sd")[i]
    joined = rows.join(named, _same(rows, keys, marks))
    return joined.withColumns({f"_x{i}": value(i, f) for i, f in enumerate(features)}).drop(*marks, "middle", "mean", "sd")


def fit(train: DataFrame, keys: list[str], width: int, options: DataFrame) -> DataFrame:
    """(keys, option, b): intercept and coefficients of each training set under each of its options.

    train has keys, y and _x0 .. of number width; options has keys, option, c
    (the inverse penalty) and balanced (classes weigh alike). The intercept is
    free. Steps are those of a single-machine Newton: scaled so that no
    coefficient moves by more than LONGEST, until none moves by STILL. A set
    without rows has no result; rows with a null y count nowhere.
    """
    spark = train.sparkSession
    ship(spark)
    n, kinds = width + 1, dict(train.dtypes)
    x = [f"_x{i}" for i in range(width)]
    rows = written(train.where("y IS NOT NULL").select(*keys, F.col("y").cast("double").alias("y"), *x), "training")
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    weight = lambda count: F.when(F.col("balanced"), F.col("n") / (2 * F.greatest(count, F.lit(1)))).otherwise(1.0).cast("double")
    start = options.select(*keys, "option", "c", "balanced").join(size, keys)
    one = F.struct("option", F.col("c").cast("double").alias("c"), weight(F.col("n1")).alias("w1"), weight(F.col("n") - F.col("n1")).alias("w0"), F.array_repeat(F.lit(0.0), n).alias("b"), F.lit(True).alias("going"))
    path = scratch(spark, "state")
    state = written(start.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("o")), "state", path)  # a set's options
    named = "".join(f"`{k}` {kinds[k]}, " for k in keys)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}

        def sums():
            return pd.DataFrame([(*k, g.ravel(), h.ravel()) for k, (g, h) in held.items()], columns=[*keys, "g", "h"])

        for part in parts:
            for key, some in part.groupby(keys, sort=False, dropna=False):
                d = np.column_stack([np.ones(len(some)), some[x].to_numpy(float)])
                y, own = some["y"].to_numpy(float), some["o"].iloc[0]
                g, h = held.setdefault(key, (np.zeros((len(own), n)), np.zeros((len(own), n, n))))
                for k, o in enumerate(own):
                    if o["going"]:
                        w = np.where(y == 1, o["w1"], o["w0"])
                        mu = 1 / (1 + np.exp(-np.clip(d @ np.asarray(o["b"]), -30, 30)))
                        g[k] += d.T @ (w * (y - mu))
                        h[k] += (d * (w * mu * (1 - mu))[:, None]).T @ d
            if len(held) >= HELD:
                yield sums()
                held = {}
        if held:
            yield sums()

    def step(part: pd.DataFrame) -> pd.DataFrame:
        """A Newton step of one training set under each option, from the sums of the tasks that hold its rows."""
        own = part["o"].iloc[0]
        g, h = np.sum(np.stack(part["g"]), axis=0).reshape(len(own), n), np.sum(np.stack(part["h"]), axis=0).reshape(len(own), n, n)
        out = []
        for k, o in enumerate(own):
            b, going = np.asarray(o["b"], float), o["going"]
            if going:
                ridge = np.full(n, 1 / o["c"])
                ridge[0] = FREE
                move = np.linalg.solve(h[k] + np.diag(ridge), g[k] - ridge * b)
                most = np.abs(move).max()
                b, going = b + move * min(1.0, LONGEST / max(most, 1e-12)), bool(most >= STILL)
            out.append({**{c: o[c] for c in ("option", "c", "w1", "w0")}, "b": b.tolist(), "going": going})
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "o": [out]})

    schema = f"{named}o array<struct<option:int,c:double,w1:double,w0:double,b:array<double>,going:boolean>>"
    moving = F.exists("o", lambda o: o["going"])
    for _ in range(STEPS):
        if state.where(moving).isEmpty():
            break
        sets = state.where(moving)
        parts = rows.join(sets, keys).select(*keys, "y", *x, "o").mapInPandas(partial, f"{named}g array<double>, h array<double>")
        moved = parts.join(sets, keys).groupBy(*keys).applyInPandas(step, schema)
        last, path = path, scratch(spark, "state")
        state = written(moved.unionByName(state.where(~moving)), "state", path)
        remove(spark, last)
    return state.select(*keys, F.explode("o").alias("_o")).select(*keys, "_o.option", "_o.b")


def scored(rows: DataFrame, width: int, name: str = "p") -> DataFrame:
    """rows (with _x0 .. and b) with the probability that b gives them."""
    z = sum((F.col("b")[i + 1] * F.col(f"_x{i}") for i in range(width)), F.col("b")[0])
    return rows.withColumn(name, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))


def nested_logistic(data: DataFrame, features: list[str], repeats: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The prediction table of models.nested_cv() for `logreg` without calibration, with all training sets fitted by fit().

    data has sample (long), y, repeat, fold and features, repeats the repeats that
    are asked for. Of each repeat and outer fold the training rows are dealt into
    inner folds in the order of (y, sample); the option with the highest mean
    inner AUC, of equal ones the first, is fitted again on all of them. The
    threshold reaches the target sensitivity on the inner predictions.
    """
    grid = [(o, float(p["c"]), bool(p.get("balanced", False)), str(p)) for o, p in enumerate(MODELS["logreg"].grid)]
    options = data.sparkSession.createDataFrame(grid, "option int, c double, balanced boolean, params string")
    width, outer = len(features), ["repeat", "k"]
    mine = data.join(repeats.select("repeat").distinct(), "repeat").select("sample", "y", "repeat", "fold", *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
    features = [f"_f{i}" for i in range(width)]  # names that nothing here has
    sides = mine.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(settings.outer - 1))))
    train, test = sides.where("fold != k").drop("fold"), sides.where("fold = k")
    placed, bucket = by_edges(train, [*outer, "y"], "sample")
    placed = running(placed, [*outer, "y"], bucket, ["sample"], {"_i": F.lit(1)}).drop("_edges")
    zeros = train.groupBy(*outer).agg(F.count_if(F.col("y") == 0).alias("_zeros"))
    train = placed.join(zeros, outer).withColumn("inner", ((F.col("_i") - 1 + F.when(F.col("y") == 1, F.col("_zeros")).otherwise(0)) % settings.inner).cast("int"))
    train = written(train.drop("_i", "_zeros"), "train")

    each = [*outer, "i"]
    split = train.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(settings.inner - 1))))
    own, held = split.where("inner != i"), split.where("inner = i")
    facts = written(scales(own, each, features), "scales")
    sets = facts.select(*each).crossJoin(F.broadcast(options))  # the grid's options
    coefficients = fit(scaled(own, facts, each, features), each, width, sets)
    inner = written(scored(scaled(held, facts, each, features).join(coefficients, each), width).select(*each, "option", "y", "p"), "inner")
    score = M.roc_auc(inner, [*each, "option"]).groupBy(*outer, "option").agg(F.round(F.coalesce(F.avg("auc"), F.lit(0.0)), 12).alias("score"))
    best = score.groupBy(*outer).agg(F.max(F.struct("score", (-F.col("option")).alias("_o"))).alias("top"))
    best = written(best.select(*outer, (-F.col("top._o")).cast("int").alias("option"), F.col("top.score").alias("inner_score")), "best")
    cut = M.reach_sensitivity(inner.join(best, [*outer, "option"]), outer, settings.target_sensitivity).select(*outer, F.col("threshold").alias("cut"))

    facts = written(scales(train, outer, features), "scales")
    chosen = fit(scaled(train, facts, outer, features), outer, width, best.join(F.broadcast(options), "option"))
    out = scored(scaled(test, facts, outer, features).join(chosen, outer), width).join(best.drop("option"), outer).join(cut, outer).join(F.broadcast(options.select("option", "params")), "option")
    return out.select(F.lit("logreg").alias("model"), F.lit("none").alias("calibration"), "repeat", F.col("k").alias("fold"), "sample", "y", "p", "cut", "inner_score", "params")
