"""Stratified bootstrap of the metrics: exact draws with replacement, as counts by distinct score.

A group's distinct scores stand in blocks of about `block` rows in the order of
the score. The rows of a class that a draw takes are first split over the
blocks (a multinomial draw by the blocks' sizes), then over the rows of each
block. A task holds one block for some of the draws; what it returns are sums,
which add up to the metrics of the whole group. So neither the rows times the
draws nor a whole group are ever written or held.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sondage.functions import rng
from sondage.operators import metrics as M
from sondage.operators.ranks import running
from sondage.session import ship
from sondage.sources.files import written

BINS = 10
#: The metrics of a draw; those at a second threshold have `screening_` in front.
METRICS = ["auc", "pr_auc", "brier", "brier_skill", "ece", *M.RATES, *[f"screening_{r}" for r in M.RATES]]
SUMS = ["good", "precise", "square", "tp", "fp", "screening_tp", "screening_fp", *[f"gap{b}" for b in range(BINS)]]
#: Draws of a task, and cells of a matrix of draws and scores or blocks.
CHUNK, CELLS = 250, 2_000_000
#: Rows of a class in a block that are counted one by one; of more, which stand at few scores, the scores are looked up.
DENSE = 2_000_000
#: Tasks that there are at least, if the draws can be dealt to as many.
TASKS = 48


def _split(keys: list[str], seed: str, draws: int):
    def split(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        first, last = int(part["first"].iloc[0]), min(draws, int(part["first"].iloc[0] + part["per"].iloc[0]))
        out = {}
        for y, name in ((1, "pos"), (0, "neg")):
            size = part[name].to_numpy()
            total = int(size.sum())
            taken = np.tile(size, (last - first, 1))
            if len(size) > 1 and total:
                texts = [f"{seed}:{':'.join(str(part[k].iloc[0]) for k in keys)}:{y}:blocks:{d}" for d in range(first, last)]
                taken = np.array([np.random.Generator(np.random.PCG64(int(s))).multinomial(total, size / total) for s in rng.seeds(texts)])
            out[name], out[f"{name}_below"], out[f"all_{name}"] = list(taken.T), list((taken.cumsum(1) - taken).T), total
        return pd.DataFrame({**{k: part[k].to_numpy() for k in keys}, "block": part["block"].to_numpy(), "first": first, **out})

    return split


def _score(keys: list[str], seed: str):
    def counts(text: str, draws: range, taken: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each score is taken in each draw."""
        out = np.zeros((len(draws), len(upto)))
        size, some = int(upto[-1]), np.flatnonzero(np.diff(upto, prepend=0))
        first = np.concatenate(([0], upto[some[:-1]])) if len(some) else some
        for k, s in enumerate(rng.seeds([f"{text}:{d}" for d in draws])):
            if size and taken[k]:
                rows = rng.positions(s, int(taken[k]), size)
                if size <= DENSE:
                    out[k, some] = np.add.reduceat(np.bincount(rows, minlength=size), first)
                else:
                    out[k] = np.bincount(np.searchsorted(upto, rows, side="right"), minlength=len(upto))
        return out

    def score(rows: pd.DataFrame, splits: pd.DataFrame) -> pd.DataFrame:
        rows, found = rows.sort_values("p"), []
        if rows.empty:
            return pd.DataFrame(columns=[*keys, "draw", "all_pos", "all_neg", *SUMS])
        p, cut, low = rows["p"].to_numpy(), float(rows["cut"].iloc[0]), float(rows["low"].iloc[0])
        upto = {y: rows[c].to_numpy(np.int64).cumsum() for y, c in ((1, "pos"), (0, "neg"))}
        of_bin = np.eye(BINS)[np.minimum((p * BINS).astype(int), BINS - 1)]
        name = f"{seed}:{':'.join(str(rows[k].iloc[0]) for k in keys)}"
        step = max(1, CELLS // len(p))
        for s in splits.itertuples(index=False):
            for a in range(0, len(s.pos), step):
                some = slice(a, a + step)
                draws = range(int(s.first) + a, int(s.first) + min(a + step, len(s.pos)))
                pos, neg = (counts(f"{name}:{y}:{int(s.block)}", draws, np.asarray(t)[some], upto[y]) for y, t in ((1, s.pos), (0, s.neg)))
                under_pos = np.asarray(s.pos_below)[some, None] + pos.cumsum(1) - pos
                under_neg = np.asarray(s.neg_below)[some, None] + neg.cumsum(1) - neg
                tp, fp = s.all_pos - under_pos, s.all_neg - under_neg
                precise = (pos * tp / np.maximum(tp + fp, 1)).sum(1) / max(s.all_pos, 1)
                at = lambda c, t: c[:, p >= t].sum(1)  # noqa: B023, E731
                gap = (pos - (pos + neg) * p) @ of_bin
                sums = [(pos * (under_neg + neg / 2)).sum(1), precise, pos @ (1 - p) ** 2 + neg @ p**2, at(pos, cut), at(neg, cut), at(pos, low), at(neg, low), *gap.T]
                found.append(pd.DataFrame({**{k: rows[k].iloc[0] for k in keys}, "draw": draws, "all_pos": s.all_pos, "all_neg": s.all_neg, **dict(zip(SUMS, sums))}))
        return pd.concat(found) if found else pd.DataFrame(columns=[*keys, "draw", "all_pos", "all_neg", *SUMS])

    return score


def bootstrap_metrics(df: DataFrame, keys: list[str], draws: int, threshold: Column | float = 0.5, screening: Column | float = 0.5, *, seed: str = "boot", block: int = 1 << 14) -> DataFrame:
    """(keys, draw, METRICS) of draws of y, p by the keys, positives and negatives to their own numbers.

    Thresholds must be the same in all rows of a group. The draws are the same in
    every run. Metrics are null as in all_metrics; a group without usable() rows,
    those with an outcome and a score, has none.
    """
    spark = df.sparkSession
    ship(spark)
    column = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    base = M.by_score(df.withColumns({"cut": column(threshold), "low": column(screening)}), [*keys, "cut", "low"])
    size = F.col("pos") + F.col("neg")
    placed = running(base, keys, F.floor(F.col("p") * 256), ["p"], {"_upto": size})
    placed = placed.withColumn("block", F.floor((F.col("_upto") - size) / block)).select(*keys, "cut", "low", "p", F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"), "block")
    placed = written(placed, "scores")
    blocks = placed.groupBy(*keys, "block").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    per = blocks.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(CELLS) / F.count(F.lit(1))))).cast("int").alias("per"))
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
    tasks = blocks.join(per, on).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.col("per")))).drop(*[f"_{k}" for k in keys])
    named = base.select(*keys).schema.simpleString()[7:-1].replace(":", " ")
    named = f"{named}, " if keys else ""
    lists = "pos array<long>, pos_below array<long>, all_pos long, neg array<long>, neg_below array<long>, all_neg long"
    splits = tasks.groupBy(*keys, "first").applyInPandas(_split(keys, seed, draws), f"{named}block long, first int, {lists}")
    schema = f"{named}draw int, all_pos long, all_neg long, {', '.join(f'{s} double' for s in SUMS)}"
    # Where blocks are few, each goes to several tasks with a part of the draws.
    parts = max(1, min(-(-draws // CHUNK), TASKS // max(1, blocks.count())))
    by = [*keys, "block", "part"]
    splits = splits.withColumn("part", (F.floor(F.col("first") / CHUNK) % parts).cast("int"))
    every = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sums = every.groupBy(*by).cogroup(splits.groupBy(*by)).applyInPandas(_score(keys, seed), schema)
    total = sums.groupBy(*keys, "draw").agg(F.first("all_pos").alias("all_pos"), F.first("all_neg").alias("all_neg"), *[F.sum(s).alias(s) for s in SUMS])
    pos, neg, n = F.col("all_pos"), F.col("all_neg"), F.col("all_pos") + F.col("all_neg")
    both, brier = (pos > 0) & (neg > 0), F.col("square") / n
    out = total.withColumns({
        "auc": F.when(both, M.ratio(F.col("good"), pos * neg)), "pr_auc": F.when(both, F.col("precise")), "brier": brier, "brier_skill": 1 - M.ratio(brier, pos / n * neg / n),
        "ece": reduce(lambda a, b: a + b, [F.abs(f"gap{b}") for b in range(BINS)]) / n, **{f"{f}fn": pos - F.col(f"{f}tp") for f in ("", "screening_")}, **{f"{f}tn": neg - F.col(f"{f}fp") for f in ("", "screening_")},
    })
    return M.rates(M.rates(out), "screening_").select(*keys, "draw", *METRICS)


def intervals(draws: DataFrame, keys: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """(keys, metric, lo, hi, se, n_draws): percentile intervals of the metrics of a table of draws."""
    long = draws.unpivot(keys, [F.col(m) for m in metrics], "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"), F.stddev_samp("value").alias("se"), F.count("value").alias("n_draws"))
