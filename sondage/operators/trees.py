"""Decision trees grown from histograms over many tasks: forests, boosting, scores and Shapley values.

A level of all trees of all training sets is grown at once: sums by (set, tree,
node, feature, bin) are one aggregate, the best split of a node follows from
these sums, and each row is sent on by an equi-join with the splits. So no
training set is ever in one task or group, and what is shuffled are sums, of at
most `bins` for a node and feature. Shallow forests have a bounded number of such
sums: there a row keeps its counts in all trees, finds its nodes anew at each level,
and only the tasks' sums become rows.

A model is a table (keys, tree, level, node, feature, cut, value, cover): the root
is node 1, the children of node i are 2i (at most the cut) and 2i + 1; a leaf has no
feature. `feature` is a place in the list of features. A missing value (null or NaN)
goes left everywhere. Trees have MOST levels at most, since a node is a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sondage.functions import rng
from sondage.operators.ranks import by_edges, running
from sondage.session import ship
from sondage.sources.files import remove, scratch, written

MOST = 60
#: The least share of a node's weight and the least gain that count as an improvement; ties are those of 12 digits.
DIGITS, GAIN = 12, 1e-6
#: Upper bounds of the probabilities of a Poisson count with mean 1, up to where they are 1 in doubles.
POISSON = [float(sum(np.exp(-1.0) / np.prod(np.arange(1, j + 1, dtype=float)) for j in range(i + 1))) for i in range(16)]
#: Levels that a row descends between two writes.
STRETCH = 8
#: Cells of a level's histograms, and nodes of a model, that a task may hold; more take the way of joins.
HELD, NODES = 4_000_000, 200_000


def _clean(f: str) -> Column:
    return F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))


def cut_points(rows: DataFrame, keys: list[str], features: list[str], bins: int = 256) -> DataFrame:
    """(keys, _cuts): for each feature in turn the cuts between its bins, as an array of arrays.

    A feature with at most `bins` values in a set has a cut half way between all
    neighbours; the values of another one are dealt by rank to `bins` parts of about equal
    numbers of rows, equal values to one, with cuts half way between the parts.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_f"), _clean(f).alias("_v")) for i, f in enumerate(features)])).alias("_e")
    values = written(rows.select(*keys, each).select(*keys, "_e.*").where("_v IS NOT NULL").groupBy(*keys, "_f", "_v").agg(F.count(F.lit(1)).alias("_n")), "values")
    number = written(values.groupBy(*keys, "_f").agg(F.count(F.lit(1)).alias("_d")), "number")
    by = [*keys, "_f"]
    few = values.join(number.where(F.col("_d") <= bins), by).groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_v"))  # at most `bins`
    middle = F.transform(F.slice("_v", 2, F.size("_v")), lambda v, i: (v + F.get("_v", i)) / 2)
    found = few.select(*by, middle.alias("_c"))
    many = number.where(F.col("_d") > bins)
    if not many.isEmpty():
        rows, bucket = by_edges(values.join(many.select(*by), by), by, "_v")
        rows = running(rows, by, bucket, ["_v"], {"_upto": F.col("_n")}, totals={"_upto": "_all"})
        part = rows.groupBy(*by, F.floor((F.col("_upto") - 1) * bins / F.col("_all")).alias("_q")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        half = (F.col("_hi") + F.lead("_lo").over(Window.partitionBy(*by).orderBy("_q"))) / 2  # at most `bins` rows
        found = found.unionByName(part.select(*by, half.alias("_h")).groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias("_c")))
    maps = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_f", "_c"))).alias("_m"))  # an entry a feature
    none = F.array().cast("array<double>")
    return maps.select(*keys, F.array(*[F.coalesce(F.try_element_at("_m", F.lit(i)), none) for i in range(len(features))]).alias("_cuts"))


def _binned(rows: DataFrame, cuts: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """rows with _b: of each feature the number of cuts below its value."""
    place = lambda i, f: F.size(F.filter(F.col("_cuts")[i], lambda c: c < F.coalesce(_clean(f), F.lit(float("-inf"))))).cast("short")
    return rows.join(cuts, keys).withColumn("_b", F.array(*[place(i, f) for i, f in enumerate(features)])).drop("_cuts")


def _edges(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """(by, _f, _bin, sums to the left as l_, of the node as a_, _last): the histogram of every node and feature in running sums."""
    long = rows.select(*by, *sums, F.posexplode("_b").alias("_f", "_bin"))
    return _sums(long.groupBy(*by, "_f", "_bin").agg(*[F.sum(s).alias(s) for s in sums]), by, sums)


def _sums(cells: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    whole = Window.partitionBy(*by, "_f")  # at most `bins` rows
    upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    named = {f"l_{s}": F.sum(s).over(upto) for s in sums} | {f"a_{s}": F.sum(s).over(whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for s in sums}
    return cells.withColumns({**named, "_last": F.lead("_bin").over(whole.orderBy("_bin")).isNull()})


def _send(rows: DataFrame, splits: DataFrame, by: list[str]) -> DataFrame:
    """Rows of split nodes in the children."""
    on = splits.where("feature IS NOT NULL").select(*by, "feature", "_bin")
    right = (F.col("_b")[F.col("feature")] > F.col("_bin")).cast("long")
    return rows.join(on, by).withColumn("node", F.col("node") * 2 + right).drop("feature", "_bin")


def _sets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, one a set, with a number _s of each."""
    return written(rows.withColumn("_s", F.row_number().over(Window.orderBy(*keys)) - 1), "sets")


def _packed(base: DataFrame, width: int, trees: int, seed: str) -> DataFrame:
    """(_s, y, _b0 .., _t): the rows of base (_s, _i, y, _b0 ..) with their Poisson counts in all trees, a byte each."""
    names = [f"_b{j}" for j in range(width)]
    salts = [f"{seed}:{t}:".encode() for t in range(1, trees + 1)]

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            code, seen = pd.factorize(part["_i"])  # the rows of a sample in several sets have the same counts
            heads = b"".join([hashlib.md5(t + i).digest()[:4] for i in (str(v).encode() for v in seen) for t in salts])
            u = np.frombuffer(heads, ">u4") / 4294967296.0
            times = np.searchsorted(POISSON, u, side="right").astype(np.uint8).reshape(-1, trees)
            out = part[["_s", "y", *names]].copy()
            out["_t"] = [times[c].tobytes() for c in code]
            yield out

    return base.select("_s", "_i", "y", *names).mapInPandas(draw, "_s int, y int, " + "".join(f"{n} short, " for n in names) + "_t binary")


def _level(packed: DataFrame, sets: int, width: int, trees: int, bins: int, level: int, splits: list, last: bool) -> DataFrame:
    """(_s, tree, node, _f, _bin, t0, t1, n0, n1): each task's sums of counts and of rows by class in the nodes of a level.

    splits has (feature, bin) of each level above, arrays by (tree, set, place in the level); a feature of -1 ends a row's way. The last level needs
    no more than the sums of one feature.
    """
    names, used, size = [f"_b{j}" for j in range(width)], 1 if last else width, 1 << level
    shape = (sets, size, used, bins, 2)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times, rows = np.zeros((trees, int(np.prod(shape)))), np.zeros((trees, int(np.prod(shape))))
        for part in parts:
            if not len(part):
                continue
            s, y = part["_s"].to_numpy(np.int64), part["y"].to_numpy(np.int64)
            b = part[names].to_numpy(np.int64)
            drawn = np.frombuffer(b"".join(part["_t"]), np.uint8).reshape(-1, trees)
            for t in range(trees):
                at = np.flatnonzero(drawn[:, t])
                place = np.zeros(len(at), np.int64)
                for up, (feature, cut) in enumerate(splits):
                    node = (s[at] << up) + place
                    f = feature[t].ravel()[node]
                    live = f >= 0
                    if not live.all():
                        at, place, node, f = at[live], place[live], node[live], f[live]
                    place = 2 * place + (b[at, f] > cut[t].ravel()[node])
                weight, first = drawn[at, t].astype(float), ((s[at] << level) + place) * used
                for j in range(used):
                    key = ((first + j) * bins + b[at, j]) * 2 + y[at]
                    times[t] += np.bincount(key, weight, times.shape[1])
                    rows[t] += np.bincount(key, minlength=times.shape[1])
        times, rows = times.reshape(trees, *shape), rows.reshape(trees, *shape)
        t, s, place, f, bin_ = np.nonzero(rows.sum(-1))
        at = (t, s, place, f, bin_)
        yield pd.DataFrame({"_s": s, "tree": t + 1, "node": size + place, "_f": f, "_bin": bin_, "t0": times[at][:, 0], "t1": times[at][:, 1], "n0": rows[at][:, 0].astype(int), "n1": rows[at][:, 1].astype(int)})

    return packed.mapInPandas(count, "_s int, tree int, node long, _f int, _bin int, t0 double, t1 double, n0 long, n1 long")


def _with_cuts(nodes: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    out = nodes.join(cuts, keys).withColumn("cut", F.col("_cuts")[F.col("feature")][F.col("_bin")])
    return out.select(*keys, "tree", "level", "node", "feature", "cut", "value", "cover")


def forest(train: DataFrame, keys: list[str], sample: str, features: list[str], depth: int | None = None, leaf: int = 1, balanced: bool = False, trees: int = 300, bins: int = 256, seed: str = "forest") -> DataFrame:
    """Gini trees on bootstrap samples of every training set (keys), grown side by side, a level at a time.

    In a tree a row counts as often as a Poisson count of mean 1 says, drawn from a
    hash of seed, tree and sample. A node tries as many features as the root of
    their number, in the order of a hash, and more only while none varies. Nodes of
    one class, of under 2 * leaf rows or at the depth stay leaves. The value of a
    leaf is its share of positives, classes weighing alike if balanced. Rows without an
    outcome of 0 or 1 count nowhere; a set without rows has no model. A level of
    more than HELD sums writes a row for each row and tree that is still in a node to
    split; other forests keep a row's counts in all trees with it.
    """
    spark = train.sparkSession
    rows = train.where("y IN (0, 1)").select(*keys, F.col(sample).cast("string").alias("_i"), F.col("y").cast("double").alias("y"), *features)
    cuts = written(cut_points(rows, keys, features, bins), "cuts")
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_p"))
    half = lambda c: F.col("_n") / (2 * F.greatest(c, F.lit(1.0)))
    class_weight = F.when(F.col("y") == 1, half(F.col("_p"))).otherwise(half(F.col("_n") - F.col("_p"))) if balanced else F.lit(1.0)
    binned = _binned(rows, cuts, keys, features)
    sums, by, levels, few = ["w", "p", "n", "ones"], [*keys, "tree", "node"], [], max(1, int(len(features) ** 0.5))
    size = _sets(size, keys)
    held = depth is not None and depth < 20 and size.count() * trees * 2**depth * len(features) * bins <= HELD
    if held:
        ship(spark)
        sets = size.count()
        here = binned.join(F.broadcast(size.select(*keys, "_s")), keys).select("_s", "_i", F.col("y").cast("int").alias("y"), *[F.col("_b")[j].alias(f"_b{j}") for j in range(len(features))])  # at most HELD sets
        packed, splits = written(_packed(here, len(features), trees, seed), "rows"), []
        for level in range(depth + 1):
            parts = _level(packed, sets, len(features), trees, bins, level, splits, level == depth)
            cells = parts.groupBy("_s", "tree", "node", "_f", "_bin").agg(*[F.sum(c).alias(c) for c in ("t0", "t1", "n0", "n1")]).join(F.broadcast(size), "_s")
            w0, w1 = (half(F.col("_n") - F.col("_p")), half(F.col("_p"))) if balanced else (F.lit(1.0), F.lit(1.0))
            p = F.col("t1") * w1
            cells = cells.select(*by, "_f", "_bin", (F.col("t0") * w0 + p).alias("w"), p.alias("p"), (F.col("n0") + F.col("n1")).alias("n"), F.col("n1").cast("double").alias("ones"))
            levels.append(written(_best(_sums(cells, by, sums), by, level, depth, leaf, few, seed), "level"))
            found = levels[-1].where("feature IS NOT NULL").join(size, keys).select("_s", "tree", "node", "feature", "_bin").toPandas()  # at most HELD nodes
            if found.empty:
                break
            feature, cut = np.full((trees, sets, 1 << level), -1), np.zeros((trees, sets, 1 << level), int)
            at = (found["tree"].to_numpy(int) - 1, found["_s"].to_numpy(int), found["node"].to_numpy(int) - (1 << level))
            feature[at], cut[at] = found["feature"].to_numpy(int), found["_bin"].to_numpy(int)
            splits.append((feature, cut))
        return _with_cuts(_union(levels), cuts, keys)
    base = binned.join(size, keys).select(*keys, "_i", "y", "_b", class_weight.alias("_w"))
    dealt = base.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).withColumn("_u", rng.uniform(seed, F.col("tree"), F.col("_i")))
    times = F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda c: c <= F.col("_u")))
    drawn = dealt.withColumn("_w", F.col("_w") * times).where("_w > 0").drop("_u", "_i")
    path = scratch(spark, "rows")
    now = drawn.select(*keys, "tree", F.lit(1).cast("long").alias("node"), F.col("_w").alias("w"), (F.col("_w") * F.col("y")).alias("p"), F.lit(1).alias("n"), F.col("y").alias("ones"), "_b")
    now = written(now, "rows", path)
    for level in range(MOST + 1):
        levels.append(written(_best(_edges(now, by, sums), by, level, depth, leaf, few, seed), "level"))
        if levels[-1].where("feature IS NOT NULL").isEmpty():
            break
        last, path = path, scratch(spark, "rows")
        now = written(_send(now, levels[-1], by), "rows", path)
        remove(spark, last)
    return _with_cuts(_union(levels), cuts, keys)


def _union(levels: list[DataFrame]) -> DataFrame:
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _best(e: DataFrame, by: list[str], level: int, depth: int | None, leaf: int, few: int, seed: str) -> DataFrame:
    """(by, level, feature, _bin, value, cover): the nodes of a forest's level with their splits, from their running sums."""
    c, d = F.col("a_w") - F.col("l_w"), F.col("a_p") - F.col("l_p")
    pure = (F.col("l_p") ** 2 + (F.col("l_w") - F.col("l_p")) ** 2) / F.col("l_w") + (d**2 + (c - d) ** 2) / c
    fair = ~F.col("_last") & (F.col("l_n") >= leaf) & (F.col("a_n") - F.col("l_n") >= leaf)
    best = F.max(F.when(fair, F.struct(F.round(pure / F.col("a_w"), DIGITS).alias("score"), (-F.col("_bin")).alias("at")))).alias("best")
    totals = [F.first(f"a_{s}").alias(s) for s in ("w", "p", "n", "ones")]
    per = e.groupBy(*by, "_f").agg(best, (F.count(F.lit(1)) > 1).alias("varies"), *totals)
    order = rng.hashed(seed, "order", F.col("tree"), F.col("node"), F.col("_f"))
    node = per.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order.alias("h"), F.col("_f"), "varies", "best"))).alias("all"), *[F.first(s).alias(s) for s in ("w", "p", "n", "ones")])  # an entry a feature
    first, varying = F.slice("all", 1, few), F.filter("all", lambda x: x["varies"])
    tried = F.filter(F.when(F.exists(first, lambda x: x["varies"]), first).otherwise(F.slice(varying, 1, 1)), lambda x: x["best"].isNotNull())
    # Of equal scores the feature that comes first in the hash's order.
    top = F.array_max(F.transform(tried, lambda x, i: F.struct(x["best"]["score"].alias("score"), (-i).alias("i"), x["_f"].alias("_f"), (-x["best"]["at"]).alias("at"))))
    wanted = (F.col("ones") > 0) & (F.col("ones") < F.col("n")) & (F.col("n") >= 2 * leaf) & F.lit(level < (MOST if depth is None else min(depth, MOST)))
    return node.withColumn("top", F.when(wanted, top)).select(*by, F.lit(level).alias("level"), F.col("top._f").alias("feature"), F.col("top.at").cast("int").alias("_bin"), (F.col("p") / F.col("w")).alias("value"), F.col("w").alias("cover"))


def boosted(train: DataFrame, keys: list[str], sample: str, features: list[str], depth: int = 3, rate: float = 0.1, ridge: float = 1.0, rows: float = 0.8, columns: float = 0.8, trees: int = 300, least: float = 1.0, bins: int = 256, seed: str = "boosted") -> DataFrame:
    """Trees on the gradients of the logistic loss of every training set (keys), one after the other, with second-order gains.

    Tree 0 is the log-odds of the set; the sum of the leaves is the logit of a
    score. A tree takes a share `rows` of the rows by a hash, and a share `columns` of the
    features. A node splits if a split gains over GAIN and leaves both sides a curvature of
    `least`; its cover is the sum of curvatures. A tree writes every row once, with its new margin, and
    depth times the sums of its nodes. Outcomes other than 0 and 1 as in forest().
    """
    spark = train.sparkSession
    usable = train.where("y IN (0, 1)").select(*keys, F.col(sample).cast("string").alias("_i"), F.col("y").cast("double").alias("y"), *features)
    cuts = written(cut_points(usable, keys, features, bins), "cuts")
    mean = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.avg("y")))
    start = written(usable.groupBy(*keys).agg(F.log(mean / (1 - mean)).alias("value"), F.count(F.lit(1)).cast("double").alias("cover")), "start")
    path = scratch(spark, "rows")
    now = written(_binned(usable, cuts, keys, features).join(start.select(*keys, F.col("value").alias("margin")), keys).select(*keys, "_i", "y", "_b", "margin"), "rows", path)
    none = F.lit(None).cast("int")
    out = start.select(*keys, F.lit(0).alias("tree"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("node"), none.alias("feature"), none.alias("_bin"), "value", "cover")
    found, by, p = [out], [*keys, "node"], 1 / (1 + F.exp(-F.col("margin")))
    for tree in range(1, trees + 1):
        order = sorted(range(len(features)), key=lambda j: hashlib.md5(f"{seed}:columns:{tree}:{j}".encode()).hexdigest())  # noqa: B023  # the same in all sets
        some = order[: max(1, int(columns * len(features)))]
        sums = now.withColumns({"g": p - F.col("y"), "h": p * (1 - p), "node": F.lit(1).cast("long")})
        drawn = sums.where(rng.uniform(seed, "rows", F.lit(tree), F.col("_i")) < rows) if rows < 1 else sums
        every, stay = sums, []
        for level in range(depth):
            e = _edges(drawn, by, ["g", "h"]).where(F.col("_f").isin(some))
            rg, rh = F.col("a_g") - F.col("l_g"), F.col("a_h") - F.col("l_h")
            gain = F.col("l_g") ** 2 / (F.col("l_h") + ridge) + rg**2 / (rh + ridge) - F.col("a_g") ** 2 / (F.col("a_h") + ridge)
            fair = ~F.col("_last") & (F.col("l_h") >= least) & (rh >= least) & (gain > GAIN)
            top = F.max(F.when(fair, F.struct(F.round(gain, DIGITS).alias("gain"), (-F.col("_f")).alias("_f"), (-F.col("_bin")).alias("at"), "l_g", "l_h"))).alias("top")
            got = e.groupBy(*by).agg(top, F.first("a_g").alias("g"), F.first("a_h").alias("h"))
            worth = lambda g, h: -rate * g / (h + ridge)
            got = got.select(*by, F.lit(tree).alias("tree"), F.lit(level).alias("level"), (-F.col("top._f")).alias("feature"), (-F.col("top.at")).cast("int").alias("_bin"), worth(F.col("g"), F.col("h")).alias("value"), F.col("h").alias("cover"), "g", "top.l_g", "top.l_h")
            got = written(got, "level")
            stay.append(got)
            drawn, every = _send(drawn, got, by), _forward(every, got, by)
        deep = stay[-1].where("feature IS NOT NULL")
        ends = F.explode(F.array(F.struct((F.col("node") * 2).alias("_c"), F.col("l_g").alias("_g"), F.col("l_h").alias("_h")), F.struct((F.col("node") * 2 + 1).alias("_c"), (F.col("g") - F.col("l_g")).alias("_g"), (F.col("cover") - F.col("l_h")).alias("_h"))))
        end = deep.select(*keys, "tree", ends.alias("_e")).select(*keys, F.col("_e._c").alias("node"), "tree", F.lit(depth).alias("level"), none.alias("feature"), none.alias("_bin"), worth(F.col("_e._g"), F.col("_e._h")).alias("value"), F.col("_e._h").alias("cover"))
        names = end.columns
        nodes = end
        for s in stay:
            nodes = nodes.unionByName(s.select(*names))
        found.append(nodes)
        leaves = nodes.where("feature IS NULL").select(*by, F.col("value").alias("_v"))
        last, path = path, scratch(spark, "rows")
        moved = every.join(leaves, by, "left").select(*keys, "_i", "y", "_b", (F.col("margin") + F.coalesce("_v", F.lit(0.0))).alias("margin"))
        now = written(moved, "rows", path)
        remove(spark, last)
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more.select(*nodes.columns))
    return _with_cuts(nodes, cuts, keys)


def _forward(rows: DataFrame, splits: DataFrame, by: list[str]) -> DataFrame:
    """Rows of split nodes in the children, the others where they are."""
    on = splits.where("feature IS NOT NULL").select(*by, "feature", "_bin")
    right = (F.col("_b")[F.col("feature")] > F.col("_bin")).cast("long")
    return rows.join(on, by, "left").withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right)).drop("feature", "_bin")


def score(rows: DataFrame, model: DataFrame, keys: list[str], sample: str, features: list[str]) -> DataFrame:
    """(keys, sample, total, trees): the sum of the leaves' values that a row reaches, and the number of trees of its set.

    The mean is a forest's score, expit(total) a boosted one. Rows of a set without a model have none.
    A model of up to NODES nodes goes to the rows as it is, and no row becomes one a tree.
    """
    if len(nodes := model.limit(NODES + 1).select(*keys, "tree", "node", "feature", "cut", "value").collect()) <= NODES:
        return _descend(rows, nodes, model, keys, sample, features)
    here = rows.select(*keys, sample, F.array(*[_clean(f) for f in features]).alias("_x"))
    now = here.join(model.where("node = 1").select(*keys, "tree"), keys).withColumn("node", F.lit(1).cast("long"))
    by, most = [*keys, "tree", "node"], model.agg(F.max("level")).first()[0] or 0
    for level in range(most):
        on = model.where((F.col("level") == level) & F.col("feature").isNotNull()).select(*by, "feature", "cut")
        right = F.coalesce(F.col("_x")[F.col("feature")] > F.col("cut"), F.lit(False)).cast("long")
        now = now.join(on, by, "left").withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right)).drop("feature", "cut")
        if level % STRETCH == STRETCH - 1:
            now = written(now, "descent")
    ended = now.join(model.where("feature IS NULL").select(*by, "value"), by)
    return ended.groupBy(*keys, sample).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("trees"))


def _descend(rows: DataFrame, nodes: list, model: DataFrame, keys: list[str], sample: str, features: list[str]) -> DataFrame:
    """score() of a model whose nodes are at hand."""
    spark = rows.sparkSession
    ship(spark)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    sets = _sets(model.where("node = 1").select(*keys).distinct(), keys)
    number = {tuple(r[k] for k in keys): r["_s"] for r in sets.collect()}  # at most NODES
    mine = sorted((number[key], r["tree"], r["node"], r["feature"], r["cut"], r["value"]) for r in nodes if (key := tuple(r[k] for k in keys)) in number)
    place = {m[:3]: i for i, m in enumerate(mine)}  # the children of a node follow each other
    at = {t: i for i, t in enumerate(sorted({m[1] for m in mine}))}
    root = np.full((max(1, len(at)), max(1, len(number))), -1)
    for s, t, n, *_ in mine:
        if n == 1:
            root[at[t], s] = place[s, t, n]
    feature = np.array([-1 if m[3] is None else m[3] for m in mine], int)
    cut = np.array([0.0 if m[4] is None else m[4] for m in mine])
    left = np.array([-1 if m[3] is None else place[m[0], m[1], 2 * m[2]] for m in mine], int)
    value = np.array([m[5] for m in mine], float)
    names = [f"_x{j}" for j in range(len(features))]

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, s = part[names].to_numpy(float), part["_s"].to_numpy(int)
            total, trees = np.zeros(len(part)), np.zeros(len(part), int)
            for first in root:
                here = first[s]
                row = np.flatnonzero(here >= 0)
                here = here[row]
                trees[row] += 1
                while len(live := np.flatnonzero(feature[here] >= 0)):
                    up = here[live]
                    here[live] = left[up] + (x[row[live], feature[up]] > cut[up])  # a gap compares as not more
                total[row] += value[here]
            out = part[[*keys, sample]].copy()
            out["total"], out["trees"] = total, trees
            yield out

    named = rows.select(*keys, sample, *[_clean(f).alias(n) for f, n in zip(features, names)])
    schema = "".join(f"`{c}` {kinds[c]}, " for c in [*keys, sample]) + "total double, trees long"
    return named.join(F.broadcast(sets), keys).mapInPandas(walk, schema)


def leaf_paths(model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tree, node, value, terms): of every leaf, for each feature on its path (lo, hi] and the share of the cover that stays on it."""
    entry = "array<struct<feature:int,lo:double,hi:double,share:double>>"
    now, by, done = model.where("node = 1").withColumn("path", F.array().cast(entry)), [*keys, "tree", "node"], None
    most = model.agg(F.max("level")).first()[0] or 0
    for level in range(most + 1):
        leaves = now.where("feature IS NULL").select(*by, "value", "path")
        done = leaves if done is None else done.unionByName(leaves)
        if level == most:
            break
        up = now.where("feature IS NOT NULL").select(*keys, "tree", F.col("node").alias("_up"), F.col("feature").alias("_f"), F.col("cut").alias("_c"), F.col("cover").alias("_all"), "path")
        below = model.where(F.col("level") == level + 1).withColumn("_up", F.floor(F.col("node") / 2).cast("long"))
        left, none = F.col("node") % 2 == 0, F.lit(None).cast("double")
        step = F.struct(F.col("_f").alias("feature"), F.when(left, none).otherwise(F.col("_c")).alias("lo"), F.when(left, F.col("_c")).alias("hi"), (F.col("cover") / F.col("_all")).alias("share"))
        now = below.join(up, [*keys, "tree", "_up"]).withColumn("path", F.concat("path", F.array(step))).select(*model.columns, "path")
        if level % STRETCH == STRETCH - 1:
            now = written(now, "paths")
    own = lambda j: F.filter("path", lambda e: e["feature"] == j)
    term = lambda j: F.struct(j.alias("feature"), F.array_max(F.transform(own(j), lambda e: e["lo"])).alias("lo"), F.array_min(F.transform(own(j), lambda e: e["hi"])).alias("hi"), F.aggregate(own(j), F.lit(1.0), lambda a, e: a * e["share"]).alias("share"))
    return done.select(*by, "value", F.transform(F.array_distinct(F.transform("path", lambda e: e["feature"])), term).alias("terms"))


def shapley(rows: DataFrame, model: DataFrame, keys: list[str], sample: str, features: list[str]) -> DataFrame:
    """(keys, sample, feature, phi): exact Shapley values of score()'s total, absent features being averaged by the trees' covers.

    A leaf gives a row its value times a product over the path's features: 1 or 0 if the
    feature is known and within the bounds or not, its share of the cover if it is absent. The weighted
    mean over all coalitions of the others is the integral of a polynomial of t in [0, 1], where each is known with
    probability t; Gauss-Legendre nodes make it a sum of a few terms. Values of a row add up to its
    total less the mean total by covers (see expected()). A row meets every leaf of its set; sums are partial
    where the rows are. A feature in no path has 0.
    """
    paths = written(leaf_paths(model, keys).where(F.size("terms") > 0).select(*keys, "value", "terms"), "paths")
    most = paths.agg(F.max(F.size("terms"))).first()[0] or 1
    at, weight = np.polynomial.legendre.leggauss(-(-most // 2))
    at, weight = (at + 1) / 2, weight / 2
    here = rows.select(*keys, sample, F.array(*[_clean(f) for f in features]).alias("_x"))
    x = lambda t: F.col("_x")[t["feature"]]
    within = lambda t: (t["lo"].isNull() | F.coalesce(x(t) > t["lo"], F.lit(False))) & (t["hi"].isNull() | F.coalesce(x(t) <= t["hi"], F.lit(True)))
    known = F.transform("terms", lambda t: F.struct(t["feature"].alias("f"), within(t).cast("double").alias("o"), t["share"].alias("z")))
    met = here.join(paths, keys).select(*keys, sample, "value", known.alias("_t"))
    others = lambda e, t: F.aggregate(F.filter("_t", lambda u: u["f"] != e["f"]), F.lit(1.0), lambda a, u: a * (u["z"] * (1 - t) + u["o"] * t))
    part = lambda e: F.col("value") * (e["o"] - e["z"]) * sum(float(w) * others(e, float(t)) for t, w in zip(at, weight))
    each = met.select(*keys, sample, F.explode(F.transform("_t", lambda e: F.struct(e["f"].alias("f"), part(e).alias("phi")))).alias("_e"))
    sums = each.groupBy(*keys, sample).agg(*[F.sum(F.when(F.col("_e.f") == i, F.col("_e.phi")).otherwise(0.0)).alias(f"_p{i}") for i in range(len(features))])
    every = rows.select(*keys, sample).join(model.select(*keys).distinct(), keys).join(sums, [*keys, sample], "left")
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(f"_p{i}", F.lit(0.0)).alias("phi")) for i, f in enumerate(features)])).alias("_e")
    return every.select(*keys, sample, named).select(*keys, sample, "_e.feature", "_e.phi")


def expected(model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected): the mean total by the trees' covers."""
    share = F.aggregate("terms", F.lit(1.0), lambda a, t: a * t["share"])
    return leaf_paths(model, keys).groupBy(*keys).agg(F.sum(F.col("value") * share).alias("expected"))
