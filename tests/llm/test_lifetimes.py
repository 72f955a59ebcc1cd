"""Aggregates by batch against sorting every batch by itself."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import lifetimes as L

SCHEMA = "g string, h int, value long, first int, last int"


def brute(rows, batches):
    out, groups = {}, {(g, h) for g, h, v, a, b in rows if a is not None and b is not None and max(a, 0) <= min(b, batches - 1)}
    for g, h in groups:
        for t in range(batches):
            here = [v for x, y, v, a, b in rows if (x, y) == (g, h) and a is not None and b is not None and a <= t <= b]
            some = sorted(v for v in here if v is not None)
            out[g, h, t] = (len(here), len(set(some)), sum(some), some[0] if some else None, some[-1] if some else None, some[(len(some) + 1) // 2 - 1] if some else None)
    return out


def moved(state, batches):
    out, empty = [], (0, 0, 0, None, None, None)
    for g, h, t in state:
        old = state[g, h, t - 1] if t else empty
        if old != state[g, h, t]:
            out.append((t, g, h, *[x for pair in zip(old, state[g, h, t]) for x in pair]))
    return out


@pytest.mark.parametrize("batches,block_rows,values", [(7, 1, 4), (130, 6, 50), (20, 50_000, 10**12), (5, 3, 1)])
def test_against_sorting(spark, batches, block_rows, values):
    r = random.Random(batches)
    rows = []
    for _ in range(400):
        a = r.choice([None, *range(-3, batches + 3)]) if r.random() < 0.3 else r.randrange(batches)
        b = None if r.random() < 0.05 else (a or 0) + r.randint(-2, batches)
        rows.append((r.choice(["hot", "hot", "hot", "x", "", None]), r.choice([1, 1, None]), r.choice([None, r.randint(-values, values), r.randint(0, 3)]), a, b))
    rows += [("hot", 1, 2, 0, batches - 1)] * 300 + [("never", 1, 5, 3, 2), ("none", 1, None, 0, 1), ("late", 1, 1, batches, batches + 5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit(1), "n": F.lit("x"), "batch": F.lit(2)}).repartition(5)
    state = L.maintained(df, ["g", "h"], batches=batches, block_rows=block_rows)
    expected = brute(rows, batches)
    assert {(x.g, x.h, x.batch): tuple(x[f] for f in L.FIGURES) for x in state.collect()} == expected
    got = [tuple(x) for x in L.changes(state, ["g", "h"]).collect()]
    assert sorted(got, key=repr) == sorted(moved(expected, batches), key=repr)


def test_counters():
    r, c, plain = random.Random(3), L.Counters(), [0] * 100
    for _ in range(200):
        mask, times = r.getrandbits(100), r.randint(0, 9)
        c.add(mask, times)
        for b in L.bits(mask):
            plain[b] += times
    assert c.numbers(100) == plain
    c = L.Counters(4)
    c.set(2, 13)
    assert not c.add(0b110, 2) and c.add(0b100, 2) == 0b100


def test_totals_that_overflow():
    cells = np.array([(2**62, 4, 0, 1)], L.CELL)
    with pytest.raises(OverflowError):
        L.spread(cells, cells["value"].astype(float) * 4, 2)


def test_awkward(awkward, nothing):
    lives = L.document_lives(awkward)
    rows = L.maintained(lives, ["source", "lang"], batches=120).collect()
    assert {(r.source, r.lang) for r in rows} <= {("a", "en"), ("b", "en"), ("", ""), ("b", "fr"), ("c", "en"), ("c", ""), ("", "fr"), ("a", "de")} and len(rows) % 120 == 0
    assert L.changes(L.maintained(L.document_lives(nothing), ["source", "lang"], batches=120), ["source", "lang"]).count() == 0
