"""Trees grown in sums over tasks against learners in plain Python; Shapley values against all coalitions."""

import hashlib
import itertools
import math

import numpy as np
import pytest

from sondage.operators import trees as T

FEATURES = ["a", "b", "c"]


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.Generator(np.random.PCG64(3))
    rows = []
    for i in range(120):
        a, b = float(r.integers(0, 9)), float(r.integers(0, 5))
        y = int(r.random() < (0.8 if a > 4 and b > 1 else 0.25))
        rows.append(("g" if i % 3 else "h", i, y, None if i % 17 == 0 else math.nan if i % 19 == 0 else a, b, 1.0))
    return rows, spark.createDataFrame(rows, "k string, sample long, y int, a double, b double, c double").repartition(5)


def model_rows(model):
    return {(r.k, r.tree, r.node): (r.feature, r.cut, pytest.approx(r.value), pytest.approx(r.cover)) for r in model.collect()}


def low(v):
    return -math.inf if v is None or math.isnan(v) else v


def cuts_of(part, j):
    seen = sorted({r[3 + j] for r in part if low(r[3 + j]) > -math.inf})
    return [(p + q) / 2 for p, q in zip(seen, seen[1:])]


def options(node, part, j, loss):
    """The best (score, cut) of one feature in a node; of equal ones the lowest cut. Cuts are right above a bin with rows."""
    cuts = cuts_of(part, j)
    place = lambda r: sum(c < low(r[3 + j]) for c in cuts)
    used = sorted({place(r) for r, *_ in node})
    best = None
    for b in used[:-1]:
        s = loss([x for x in node if place(x[0]) <= b], [x for x in node if place(x[0]) > b])
        if s is not None and (best is None or s > best[0]):
            best = (s, cuts[b])
    return best, len(used) > 1


def forest_by_hand(part, k, tree, depth, leaf, balanced):
    n, ones = len(part), sum(r[2] for r in part)
    weight = lambda r: n / (2 * (ones if r[2] else n - ones)) if balanced else 1.0
    rows = [(r, weight(r) * sum(c <= draw("forest", tree, r[1]) for c in T.POISSON)) for r in part]
    out = {}

    def gini(left, right):
        if min(len(left), len(right)) < leaf:
            return None
        score, total = 0.0, 0.0
        for side in (left, right):
            w, p = sum(x[1] for x in side), sum(x[1] for x in side if x[0][2])
            score, total = score + (p * p + (w - p) ** 2) / w, total + w
        return round(score / total, T.DIGITS)

    def grow(node, number, level):
        w, pos = sum(x[1] for x in node), sum(x[1] for x in node if x[0][2])
        found = None
        if 0 < pos < w and len(node) >= 2 * leaf and (depth is None or level < depth):
            order = sorted(range(3), key=lambda j: hashlib.md5(f"forest:order:{tree}:{number}:{j}".encode()).hexdigest())
            each = [(j, *options(node, part, j, gini)) for j in order]
            tried = each[:1] if each[0][2] else [e for e in each if e[2]][:1]
            found = next(((j, b[1]) for j, b, _ in tried if b), None)
        out[k, tree, number] = (*(found or (None, None)), pos / w, w)
        if found:
            side = lambda x: low(x[0][3 + found[0]]) > found[1]
            grow([x for x in node if not side(x)], 2 * number, level + 1)
            grow([x for x in node if side(x)], 2 * number + 1, level + 1)

    if live := [x for x in rows if x[1] > 0]:
        grow(live, 1, 0)
    return out


@pytest.mark.parametrize("depth, leaf, balanced", [(None, 1, False), (3, 4, True)])
def test_forest_grows_the_trees_of_a_plain_learner(data, depth, leaf, balanced):
    rows, df = data
    got = model_rows(T.forest(df, ["k"], "sample", FEATURES, depth, leaf, balanced, trees=4))
    want = {}
    for k in "gh":
        for tree in range(1, 5):
            want |= forest_by_hand([r for r in rows if r[0] == k], k, tree, depth, leaf, balanced)
    assert len(got) > 20 and got == want


def boosted_by_hand(part, k, trees, depth, rate, ridge, least, share):
    mean = sum(r[2] for r in part) / len(part)
    base = math.log(mean / (1 - mean))
    margin, out = {r[1]: base for r in part}, {(k, 0, 1): (None, None, base, len(part))}
    for tree in range(1, trees + 1):
        p = {i: 1 / (1 + math.exp(-m)) for i, m in margin.items()}
        order = sorted(range(3), key=lambda j: hashlib.md5(f"boosted:columns:{tree}:{j}".encode()).hexdigest())[:2]
        sums = lambda node: (sum(p[r[1]] - r[2] for r, in node), sum(p[r[1]] * (1 - p[r[1]]) for r, in node))  # noqa: B023, E731
        half = lambda node: (s := sums(node))[0] ** 2 / (s[1] + ridge)  # noqa: B023, E731

        def gain(left, right):
            if min(sums(left)[1], sums(right)[1]) < least:  # noqa: B023
                return None
            g = half(left) + half(right) - half(left + right)  # noqa: B023
            return round(g, T.DIGITS) if g > T.GAIN else None

        def grow(node, every, number, level):
            g, h = sums(node)  # noqa: B023
            found = None
            if level < depth:
                for j in sorted(order):  # noqa: B023
                    best, _ = options(node, part, j, gain)  # noqa: B023
                    if best and (found is None or best[0] > found[0]):
                        found = (best[0], j, best[1])
            out[k, tree, number] = (*(found[1:] if found else (None, None)), -rate * g / (h + ridge), h)  # noqa: B023
            if found:
                side = lambda r: low(r[3 + found[1]]) > found[2]
                grow([x for x in node if not side(x[0])], [r for r in every if not side(r)], 2 * number, level + 1)
                grow([x for x in node if side(x[0])], [r for r in every if side(r)], 2 * number + 1, level + 1)
            else:
                for r in every:
                    margin[r[1]] += -rate * g / (h + ridge)

        grow([(r,) for r in part if draw("boosted", "rows", tree, r[1]) < share], part, 1, 0)
    return out, margin


def test_boosting_grows_the_trees_of_a_plain_learner_and_scores_add_up(spark, data):
    rows, df = data
    model = T.boosted(df, ["k"], "sample", FEATURES, 2, 0.3, 1.0, 0.8, 0.7, trees=4).cache()
    got, want, margins = model_rows(model), {}, {}
    for k in "gh":
        out, margin = boosted_by_hand([r for r in rows if r[0] == k], k, 4, 2, 0.3, 1.0, 1.0, 0.8)
        want |= out
        margins |= margin
    assert len(got) > 12 and got == want
    scored = {r["sample"]: r.total for r in T.score(df, model, ["k"], "sample", FEATURES).collect()}
    assert scored == pytest.approx(margins)


def coalitions(model, k, row):
    """Shapley values of one row from every coalition."""
    mine = {(r.tree, r.node): r for r in model if r.k == k}

    def value(tree, node, known):
        r = mine[tree, node]
        if r.feature is None:
            return r.value
        if r.feature in known:
            return value(tree, 2 * node + (low(row[3 + r.feature]) > r.cut), known)
        return sum(mine[tree, 2 * node + s].cover / r.cover * value(tree, 2 * node + s, known) for s in (0, 1))

    whole = lambda known: sum(value(t, 1, known) for t, n in mine if n == 1)
    out = []
    for j in range(3):
        rest, phi = [i for i in range(3) if i != j], 0.0
        for size in range(3):
            for s in itertools.combinations(rest, size):
                phi += math.factorial(size) * math.factorial(2 - size) / 6 * (whole({*s, j}) - whole(set(s)))
        out.append(phi)
    return out, whole(set()), whole({0, 1, 2})


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_shapley_values_are_those_of_all_coalitions(spark, data, kind):
    rows, df = data
    # A clashing name of a feature and extra columns change nothing.
    df = df.withColumnRenamed("a", "value").withColumnRenamed("b", "tree").withColumnRenamed("c", "level")
    names = ["value", "tree", "level"]
    model = (T.forest(df, ["k"], "sample", names, 4, trees=3) if kind == "forest" else T.boosted(df, ["k"], "sample", names, 3, 0.3, trees=3, columns=1)).cache()
    local = model.collect()
    phi = {}
    for r in T.shapley(df, model, ["k"], "sample", names).collect():
        phi.setdefault(r["sample"], {})[r.feature] = r.phi
    base = {r.k: r.expected for r in T.expected(model, ["k"]).collect()}
    total = {r["sample"]: r.total for r in T.score(df, model, ["k"], "sample", names).collect()}
    assert len(phi) == len(rows) and max(abs(v["value"]) for v in phi.values()) > 0.05
    for row in rows[::7]:
        want, mean, whole = coalitions(local, row[0], row)
        assert [phi[row[1]][n] for n in names] == pytest.approx(want, abs=1e-9)
        assert base[row[0]] == pytest.approx(mean) and total[row[1]] == pytest.approx(whole)
        assert sum(phi[row[1]].values()) + base[row[0]] == pytest.approx(total[row[1]])


def test_many_values_empty_and_one_sided_sets(spark, data):
    _, df = data
    many = spark.range(1000).selectExpr("'g' AS k", "id AS sample", "CAST(id % 10 >= 5 AS INT) AS y", "CAST(id AS DOUBLE) AS a", "CAST(NULL AS DOUBLE) AS b", "1D AS c")
    cuts = T.cut_points(many, ["k"], FEATURES, 16).first()["_cuts"]
    assert len(cuts[0]) == 15 and cuts[0][:2] == [62.5, 124.5] and cuts[1] == [] and cuts[2] == []
    same = df.selectExpr("k", "sample", "1 AS y", "a", "b", "c")
    assert {(r.node, r.feature, r.value) for r in T.forest(same, ["k"], "sample", FEATURES, trees=2).collect()} == {(1, None, 1.0)}
    assert {r.feature for r in T.boosted(same, ["k"], "sample", FEATURES, trees=2).collect()} == {None}
    nothing = T.forest(df.selectExpr("k", "sample", "CAST(NULL AS INT) AS y", "a", "b", "c"), ["k"], "sample", FEATURES, trees=2)
    assert nothing.count() == 0 and T.score(df, nothing, ["k"], "sample", FEATURES).count() == 0
    assert T.shapley(df, nothing, ["k"], "sample", FEATURES).count() == 0


def test_a_shallow_forest_makes_no_rows_by_tree_and_equals_the_way_of_joins(spark, data, monkeypatch):
    _, df = data
    grow = lambda: T.forest(df, ["k"], "sample", FEATURES, 2, 2, True, trees=3, bins=6)
    with monkeypatch.context() as m:
        m.setattr(T, "HELD", 0, raising=False)
        want = model_rows(grow())
        m.setattr(T, "NODES", 0, raising=False)
        totals = {r["sample"]: (pytest.approx(r.total), r.trees) for r in T.score(df, grow(), ["k"], "sample", FEATURES).collect()}
    monkeypatch.setattr(T, "_send", None)
    got = grow().cache()
    assert model_rows(got) == want and len(want) > 10
    plan = T.score(df, got, ["k"], "sample", FEATURES)
    assert {r["sample"]: (r.total, r.trees) for r in plan.collect()} == totals and "SortMergeJoin" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["grown_forest", "grown_boosted", "tree_shapley"])
def test_queries_have_all_folds(spark, small, name, monkeypatch):
    from sondage.plans import PLANS, modelling

    monkeypatch.setattr(modelling, "ROUNDS", 2)
    rows = PLANS[name](spark, small).collect()
    assert {r.k for r in rows} == set(range(5)) and len(rows) == (15 if name == "tree_shapley" else 5)
    assert all(r.n > 0 for r in rows)
