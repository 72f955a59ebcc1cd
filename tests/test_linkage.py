"""Counting and matching of compatible records against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sondage.operators import linkage
from sondage.operators.counting import contained
from sondage.operators.matching import maximum_matching
from sondage.plans import PLANS, linking

INF, NAN = math.inf, math.nan
VARS = ["u", "v", "w"]
VARS2 = ["v1", "v2"]


def missing(x):
    return x is None or x != x


def fits(value, lo, hi):
    return missing(value) or (-INF if missing(lo) else lo) <= value <= (INF if missing(hi) else hi)


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(1)
    interval = lambda: r.choice([(-INF, INF), (-INF, 5.0), (5.0, INF), (None, 3.0), (NAN, NAN), (float(k := r.randint(0, 9)), k + 2.0), (7.0, 3.0), (11.0, INF)])
    value = lambda: r.choice([None, NAN, INF, -INF, float(r.randint(0, 9)), r.random() * 12])
    left = [(i, r.choice([0, 1, None]), *interval(), *interval(), *interval()) for i in range(120)] + [(120, 0, -INF, INF, -INF, INF, -INF, INF)]
    right = [(j, r.choice([0, 1, None]), r.randint(0, 2), value(), value(), value()) for j in range(150)]
    ends = ", ".join(f"{v}_{e} double" for v in VARS for e in ("lo", "hi"))
    return left, right, spark.createDataFrame(left, f"i long, o int, {ends}"), spark.createDataFrame(right, "j long, o int, d int, u double, v double, w double")


@pytest.mark.parametrize("variables", [["u"], ["v", "u"], VARS])
def test_counts_against_all_pairs(spark, sides, variables):
    left, right, a, b = sides
    at = [VARS.index(v) for v in variables]
    expected, per = {}, {}
    for row in left:
        own = [row[2 + 2 * k : 4 + 2 * k] for k in at]
        key = (row[1], *[(-INF, INF)[e] if missing(x) else x for pair in own for e, x in enumerate(pair)])
        fit = [x for x in right if x[1] == row[1] and all(fits(x[3 + k], *p) for k, p in zip(at, own))]
        times = expected.get(key, (0,))[0] + 1
        expected[key] = (times, len(fit), sum(x[0] for x in fit))
        for d in range(3):
            if n := sum(x[2] == d for x in fit):
                per[(*key, d)] = n
    names = ["o", *[f"{v}_{e}" for v in variables for e in ("lo", "hi")]]
    got = contained(a, b, variables, ["o"], total="j").collect()
    assert {tuple(r[c] for c in names): (r.times, r.n, int(r["sum"])) for r in got} == expected and len(got) == len(expected)
    assert {(*[r[c] for c in names], r.d): r.n for r in contained(a, b, variables, ["o"], per=["d"]).collect()} == per


def test_counts_of_empty_sides(sides):
    _, _, a, b = sides
    assert contained(a.limit(0), b, VARS, ["o"]).count() == 0
    assert {r.n for r in contained(a, b.limit(0), VARS, ["o"]).collect()} == {0}
    assert contained(a, b.limit(0), VARS, [], per=["d"]).count() == 0


def test_pairs_and_pins_with_missing_and_infinite_values(spark, sides):
    left, right, a, b = sides
    # Ends are known here: a missing label is an open interval before it comes to pairs.
    left = [tuple(-INF if k in (2, 4) and y is None else y for k, y in enumerate(x)) for x in left if not any(y != y for y in x[2:6])]
    a = spark.createDataFrame(left, a.schema)
    expected = {(x[0], y[0]) for x in left for y in right if x[1] is not None and x[1] == y[1] and fits(y[3], *x[2:4]) and fits(y[4], *x[4:6])}
    found = linkage.edges(linkage.pairs(a, b, ["u", "v"], "o", linkage.EPS, 2.0), ["u", "v"])
    assert sorted((r.i, r.j) for r in found.collect()) == sorted(expected)
    only = [i for i, _ in expected]
    pins = linkage.pins(a.where("o IS NOT NULL"), b, ["u", "v"], "o").collect()
    assert {(r.i, r.j) for r in pins} == {(i, j) for i, j in expected if only.count(i) == 1} and len(pins) == len({r.i for r in pins})
    odd = b.withColumn("u", F.lit(INF))  # no finite value at all
    assert linkage.pairs(a, odd, ["u"], "o", linkage.EPS, 2.0).count() == sum(x[1] is not None and x[1] == y[1] and fits(INF, *x[2:4]) for x in left for y in right)


def augmented(edges):
    """The size of a largest matching, a path at a time."""
    adjacent, right = {}, {}
    for i, j in edges:
        adjacent.setdefault(i, []).append(j)

    def augment(i, seen):
        for j in adjacent[i]:
            if j not in seen:
                seen.add(j)
                if j not in right or augment(right[j], seen):
                    right[j] = i
                    return True
        return False

    return sum(augment(i, set()) for i in adjacent)


def test_matching_is_a_largest(spark):
    r, edges = random.Random(3), []
    for g in range(30):  # many graphs side by side: sparse, dense, lopsided
        n, m = r.randint(1, 30), r.randint(1, 12)
        edges += [(g * 100 + r.randint(0, n), g * 100 + r.randint(0, m)) for _ in range(r.randint(1, 4) * n)]
    edges += [e for k in range(12) for e in ((9000 + k, 9000 + k), (9000 + k, 9001 + k))][:-1]  # a chain
    df = spark.createDataFrame(edges + [(None, 1), (1, None)], "i long, j long")
    found = [(x.i, x.j) for x in maximum_matching(df).collect()]
    assert set(found) <= set(edges) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found) == augmented(sorted(set(edges)))
    assert maximum_matching(df.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [linkage.CELLS, 0])
def test_matching_of_classes_is_a_largest(spark, sides, cells):
    """By flows between classes, and row by row where a task must not hold a group."""
    left, right, a, b = sides
    expected = {}
    for o in (0, 1):
        for d in range(3):
            found = [(x[0], y[0]) for x in left for y in right if x[1] == y[1] == o and y[2] == d and all(fits(y[3 + k], *x[2 + 2 * k : 4 + 2 * k]) for k in (0, 1))]
            expected[o, d] = augmented(sorted(found))
    got = linkage.matched(a, b, ["u", "v"], "o", 2.0, slack=0.0, per=["d"], cells=cells)
    assert {(r.o, r.d): r.matched for r in got.collect()} == expected
    more = linkage.matched(a.withColumn("k", F.col("i") % 2), b.where("d = 0"), ["u", "v"], "o", 2.0, slack=0.0, keep=["k"], cells=cells).where("o = 1")
    half = lambda k: [(x[0], y[0]) for x in left for y in right if x[0] % 2 == k and x[1] == y[1] == 1 and y[2] == 0 and all(fits(y[3 + v], *x[2 + 2 * v : 4 + 2 * v]) for v in (0, 1))]
    assert {r.k: r.matched for r in more.collect()} == {k: augmented(sorted(half(k))) for k in (0, 1)}


def test_matchings_of_plans_write_no_pairs(spark, small, monkeypatch):
    """They stay with classes, whatever the rows: pairs() is not called."""
    monkeypatch.setattr(linkage, "pairs", None)
    assert PLANS["maximum_matching"](spark, small).agg(F.sum("matched")).first()[0] > 0
    assert linking.matched_per_draw(spark, small, linking.shuffled(spark, small, 2), 2).count() == 2


def test_draws_of_few_rows_come_from_many_tasks(spark, small):
    r = linking.right(spark, small).withColumn("o", F.col("o").cast("long"))
    draws = [linkage.copula_draws(r, "o", VARS2, 2), linking.shuffled(spark, small, 2)]
    for d in draws:
        assert f", {linkage.TASKS}), REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString()


def test_exceedance_always_has_a_row(spark):
    a = spark.createDataFrame([(1, 0, 0.0, 1.0), (2, 0, 0.0, 1.0), (3, 1, 5.0, 6.0)], "i long, o int, v_lo double, v_hi double")
    b = spark.createDataFrame([(1, 0, 0.5), (2, 1, 9.0)], "j long, o int, v double")
    drawn = lambda rows: spark.createDataFrame(rows, "draw int, j long, o int, v double")
    row = lambda values, draws: tuple(linkage.exceedance(a, values, draws, ["v"], "o", 4).first())
    assert row(b, drawn([(0, 1, 0, 8.0), (2, 1, 0, 7.0)])) == (2, 0, pytest.approx(1 / 5))  # no draw has a pair
    assert row(b, drawn([(0, 1, 0, 0.1), (1, 1, 0, 8.0), (3, 1, 0, 1.0), (3, 2, 0, 0.0)])) == (2, 2, pytest.approx(3 / 5))
    assert row(b.where("j = 2"), drawn([(0, 1, 0, 8.0)])) == (0, 4, 1.0)  # nor has the real side


def test_match_fraction_is_of_the_interval_side(spark, small):
    """Sides of unequal size: 150 customers, 10 suppliers."""
    n = spark.read.parquet(f"{small}/customer.parquet").count()
    by_tolerance = PLANS["tolerance_match_fraction"](spark, small).collect()
    found = {(r.i, r.j) for r in linking.edges(spark, small).collect()}
    exact = next(r for r in by_tolerance if r.tol == 1e-9)
    assert exact.matched == augmented(sorted(found)) and exact.fraction == pytest.approx(exact.matched / n)
    check = PLANS["containment_check"](spark, small).first()
    assert check.matched == exact.matched and check.fraction == exact.fraction and check.draws == 50 and check.null_mean <= check.null_max <= 1
    draw = linking.shuffled(spark, small, 3).where("draw = 1").drop("draw")
    one = linkage.edges(linkage.pairs(linking.left(spark, small), draw, linking.VARS, "o", linkage.EPS, 500.0), linking.VARS)
    drawn = {r.draw: r.matched for r in linking.matched_per_draw(spark, small, linking.shuffled(spark, small, 3), 3).collect()}
    assert set(drawn) == {0, 1, 2} and drawn[1] == augmented(sorted((r.i, r.j) for r in one.collect()))


def test_a_gap_of_just_the_tolerance(spark):
    """Whether a value is in reach is decided by its gap, not by the end plus the tolerance, which rounds otherwise."""
    from pyspark.sql import functions as F

    from sondage.operators.linkage import compatible, pins

    ends = [500.0 * k for k in range(-2, 20)]
    lhs = spark.createDataFrame([(i, 0, e - 500, e) for i, e in enumerate(ends)], "i long, o int, v_lo double, v_hi double")
    close = [(e, round(e + g, 4)) for e in ends for g in (0.0099, 0.01, 0.0101)] + [(e, round(e - 500 - g, 4)) for e in ends for g in (0.0099, 0.01, 0.0101)]
    rhs = spark.createDataFrame([(j, 0, v) for j, (_, v) in enumerate(close)], "j long, o int, v double")
    gap = lambda e, v: max(e - 500 - v, v - e, 0.0)
    for tol in (0.0, 1e-3, 1e-2):
        found = {r.i: r.n for r in compatible(lhs, rhs, ["v"], "o", slack=F.lit(tol), keep=["i"]).collect()}
        assert found == {i: sum(gap(e, v) <= tol for _, v in close) for i, e in enumerate(ends)}
    lone = rhs.where(F.col("v") == 9500.01)
    assert 9500.01 - 9500 > 0.01 and pins(lhs, lone, ["v"], "o", 0.01).count() == 0


def test_pairs_of_one_hot_key_are_dealt_in_squares(spark, monkeypatch):
    """All intervals are open and all values alike: one key holds every pair."""
    import functools

    monkeypatch.setattr(linkage, "_met", functools.partial(linkage._met, dealt=16, most=500))
    left = spark.range(150).selectExpr("id AS i", "CAST(id * 2 % 2 AS INT) AS o", "double('-infinity') AS v_lo", "double('infinity') AS v_hi")
    right = spark.range(70).selectExpr("id AS j", "CAST(id % 2 AS INT) AS o", "1.0D AS v")
    got = linkage.edges(linkage.pairs(left, right, ["v"], "o", 1e-9, 500.0), ["v"])
    rows = got.groupBy(F.spark_partition_id()).count().collect()
    assert {tuple(r) for r in got.collect()} == {(i, j) for i in range(150) for j in range(0, 70, 2)} and got.count() == 150 * 35
    assert len(rows) > 4 and max(r["count"] for r in rows) < 150 * 35 / 2


def test_squares_of_pairs_grow_with_the_rows(spark, monkeypatch):
    from pyspark.sql import functions as F
    from sondage.operators import linkage

    monkeypatch.setattr(linkage, "SQUARES", 4)
    n = 300
    left, right = spark.range(n).selectExpr("id AS i", "0 AS k"), spark.range(n).selectExpr("id AS j", "0 AS k")
    met = linkage._met(left, right, ["k"], dealt=10)
    # Four squares of 150 and not 900 of 10: a row travels twice and not thirty times.
    assert met.select("_row", "_column").distinct().count() == 4
    assert met.select("i", "j").distinct().count() == n * n == met.count()
    assert met.groupBy("_row", "_column").agg(F.countDistinct("i").alias("n")).agg(F.max("n")).first()[0] < 200
