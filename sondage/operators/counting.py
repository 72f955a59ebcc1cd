"""How many values lie within intervals of several variables, without the pairs.

Each variable's values and interval ends are ranked together, so an interval is a
range of ranks. A value stands in one node of each level of a binary tree over
the ranks, and a range is covered by at most two nodes of a level; within the
nodes of the variables before the last, sorted running sums over the last one's
ranks answer a range by the difference of two of them. Rows grow with values and
distinct intervals times the logarithm of their number for every variable but
one, however many pairs fit.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from sondage.operators.ranks import by_edges, running
from sondage.sources.files import written

INF = float("inf")
#: Ranks of a bucket of running sums.
WIDTH = 64


def present(c: str) -> Column:
    """A value; NaN is a missing one."""
    return F.when(~F.isnan(c), F.col(c).cast("double"))


def _ranks(queries: DataFrame, points: DataFrame, variables: list[str]) -> DataFrame:
    """(v, x, kind, rank) of the distinct ends and values of each variable: how many of its ends are up to x, kind 0 (lower end)
    coming before a value (1) and that before kind 2 (upper end) at the same x."""
    row = lambda v, k, c: F.struct(F.lit(v).alias("v"), F.lit(k).alias("kind"), F.col(c).alias("x"))
    ends = queries.select(F.explode(F.array(*[row(v, k, f"{v}_{e}") for v in variables for k, e in ((0, "lo"), (2, "hi"))])).alias("r"))
    held = points.select(F.explode(F.array(*[row(v, 1, v) for v in variables])).alias("r"))
    rows, bucket = by_edges(ends.union(held).select("r.*").where("x IS NOT NULL").distinct(), ["v"], "x")
    return running(rows, ["v"], bucket, ["x", "kind"], {"rank": F.when(F.col("kind") != 1, 1).otherwise(0)}).select("v", "x", "kind", "rank")


def _placed(queries: DataFrame, points: DataFrame, ranks: DataFrame, variables: list[str]) -> tuple[DataFrame, DataFrame]:
    """queries with the ranks _a_<var> and _b_<var> of their ends, points with _r_<var> of their values: one lies within if _a <= _r < _b."""
    for v in variables:
        of = lambda kind, x, name: ranks.where((F.col("v") == v) & (F.col("kind") == kind)).select(F.col("x").alias(x), F.col("rank").alias(name))  # noqa: B023, E731
        queries = queries.join(of(0, f"{v}_lo", f"_a_{v}"), f"{v}_lo").join(of(2, f"{v}_hi", f"_b_{v}"), f"{v}_hi")
        points = points.join(of(1, v, f"_r_{v}"), v, "left")
    return queries, points


def classes(intervals: DataFrame, values: DataFrame, variables: list[str], by: list[str], *, keep: list[str] = (), per: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(by, keep, _a_<var>, _b_<var>, times) of the different intervals and (by, per, _r_<var>, times) of the values that no
    interval tells apart: one lies within the other if each _r is -1, a missing value, or _a <= _r < _b.

    With intervals of a fixed set of bins there are as many of both however many
    rows there are. Missing values and ends are as in contained().
    """
    ends = [f"{v}_{e}" for v in variables for e in ("lo", "hi")]
    q = written(_distinct(intervals, variables, [*by, *keep]), "intervals")
    points = written(values.select(*by, *per, *[present(v).alias(v) for v in variables]).groupBy(*by, *per, *variables).agg(F.count(F.lit(1)).alias("times")), "points")
    ranges, ranked = _placed(q, points, written(_ranks(q, points, variables), "ranks"), variables)
    ranked = ranked.groupBy(*by, *per, *[F.coalesce(f"_r_{v}", F.lit(-1).cast("long")).alias(f"_r_{v}") for v in variables]).agg(F.sum("times").alias("times"))
    return ranges.drop(*ends), ranked


def _distinct(intervals: DataFrame, variables: list[str], by: list[str]) -> DataFrame:
    """(by, <var>_lo, <var>_hi, times): the different intervals; a null or NaN end is open."""
    ends = [f"{v}_{e}" for v in variables for e in ("lo", "hi")]
    open_ = {"lo": -INF, "hi": INF}
    named = intervals.select(*by, *[F.coalesce(present(e), F.lit(open_[e[-2:]])).alias(e) for e in ends])
    return named.groupBy(*by, *ends).agg(F.count(F.lit(1)).alias("times"))


def point_nodes(rank: str, levels: int) -> str:
    """SQL for the tree's nodes (level, n) that a rank lies in, one a level; a missing rank is in a node of its own."""
    every = f"transform(sequence(0, {levels}), k -> named_struct('level', k, 'n', shiftright({rank}, k)))"
    return f"CASE WHEN {rank} IS NULL THEN array(named_struct('level', -1, 'n', 0L)) ELSE {every} END"


def range_nodes(first: str, end: str, levels: int) -> str:
    """SQL for the nodes that together cover the ranks from first to before end: of each level those that lie in the range
    while their parent does not."""
    from_, to = (lambda k: f"(-shiftright(-{first}, {k}))"), (lambda k: f"(shiftright({end}, {k}) - 1)")
    lone = f"{from_('k')} <= {to('k')} AND (shiftright(n, 1) < {from_('k + 1')} OR shiftright(n, 1) > {to('k + 1')})"
    ends = f"filter(array_distinct(array({from_('k')}, {to('k')})), n -> {lone})"
    return f"flatten(transform(sequence(0, {levels}), k -> transform({ends}, n -> named_struct('level', k, 'n', n))))"


MISSING = "array(named_struct('level', -1, 'n', 0L))"


def contained(intervals: DataFrame, values: DataFrame, variables: list[str], by: list[str], *, keep: list[str] = (), per: list[str] = (), total: str | None = None) -> DataFrame:
    """(by, keep, <var>_lo, <var>_hi, times, per, n, and sum if total): of each distinct combination of intervals how many
    values rows lie within all of them, ends included.

    intervals has by, keep and the ends of each variable; times says how often a
    combination stands there. values has by, per and the variables: only rows
    with the same by count, and there is a result for each of the different per
    (with per, only where n > 0). sum adds up a long column of the values rows
    that count, as a decimal: where n is 1 it is that row's.

    A null or NaN value lies within every interval, a null or NaN end is open;
    infinite values lie within intervals whose end is infinite. Null in by is a
    group like any other; without intervals there are no rows.
    """
    keep, per = list(keep), list(per)
    ends = [f"{v}_{e}" for v in variables for e in ("lo", "hi")]
    q = _distinct(intervals, variables, [*by, *keep]).withColumn("_q", F.monotonically_increasing_id())
    q = written(q, "intervals")
    carry = [F.coalesce(F.sum(F.col(total).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("_t")] if total else []
    points = written(values.select(*by, *per, *[present(v).alias(v) for v in variables], *([total] if total else [])).groupBy(*by, *per, *variables).agg(F.count(F.lit(1)).alias("_n"), *carry), "points")
    sums = ["_n", *(["_t"] if total else [])]
    ranks = written(_ranks(q, points, variables), "ranks")
    levels = {r["v"]: int(r["top"]).bit_length() for r in ranks.groupBy("v").agg(F.max("rank").alias("top")).collect()}  # a row per variable
    ranges, ranked = _placed(q, points, ranks, variables)
    *before, last = variables
    nodes = [f"_node_{v}" for v in before]
    group = [f"_g{i}" for i in range(len(by))]
    ranges = ranges.select("_q", *[F.col(k).alias(g) for k, g in zip(by, group)], *[f"_{s}_{v}" for v in variables for s in "ab"])
    for v in before:
        ranges = ranges.withColumn(f"_node_{v}", F.expr(f"explode(concat({MISSING}, {range_nodes(f'_a_{v}', f'_b_{v}', levels.get(v, 0))}))"))
        ranked = ranked.withColumn(f"_node_{v}", F.expr(f"explode({point_nodes(f'_r_{v}', levels.get(v, 0))})"))
    # Missing values of the last variable stand below all ranks and count beside the range.
    cuts = F.when(F.col(f"_a_{last}") < F.col(f"_b_{last}"), F.array(F.struct(F.col(f"_b_{last}").alias("c"), F.lit(1).alias("s")), F.struct(F.col(f"_a_{last}").alias("c"), F.lit(-1).alias("s")))).otherwise(F.array())
    cuts = F.concat(cuts, F.array(F.struct(F.lit(0).cast("long").alias("c"), F.lit(1).alias("s"))))
    asked = ranges.withColumn("_e", F.explode(cuts)).select("_q", *group, *nodes, F.col("_e.c").alias("_c"), F.col("_e.s").alias("_s"))
    held = ranked.select(*[F.col(k).alias(g) for k, g in zip(by, group)], *per, *nodes, F.coalesce(f"_r_{last}", F.lit(-1).cast("long")).alias("_c"), *sums)
    held = held.groupBy(*group, *per, *nodes, "_c").agg(*[F.sum(s).alias(s) for s in sums])
    where = [*group, *nodes]
    same = lambda a, b, cols: reduce(and_, [a[c].eqNullSafe(b[c]) for c in cols], F.lit(True))
    marks = asked.select(*where, "_c").distinct()
    if per:
        there, wanted = held.select(*where, *per).distinct(), marks
        marks = wanted.join(there.hint("merge"), same(wanted, there, where)).select(*[wanted[c] for c in where], *[there[c] for c in per], wanted["_c"])
    rows = held.withColumn("_k", F.lit(1)).unionByName(marks.select(*where, *per, "_c", *[F.lit(0).cast(dict(held.dtypes)[s]).alias(s) for s in sums], F.lit(0).alias("_k")))
    upto = running(rows, [*where, *per], F.floor(F.col("_c") / WIDTH), ["_c", "_k"], {f"_u{s}": F.col(s) for s in sums}, many=True).where("_k = 0")
    upto = upto.select(*where, *per, "_c", *[f"_u{s}" for s in sums])
    # Rows of repeated draws take little room compressed and much in memory, so none of them is broadcast.
    found = asked.join(upto.hint("merge"), same(asked, upto, [*where, "_c"])).groupBy("_q", *per).agg(*[F.sum(F.col("_s") * F.col(f"_u{s}")).alias(f"_f{s}") for s in sums])
    out = q.join(found.hint("merge"), "_q", "inner" if per else "left").withColumn("n", F.coalesce("_f_n", F.lit(0)).cast("long"))
    return out.where("n > 0" if per else F.lit(True)).select(*by, *keep, *ends, "times", *per, "n", *([F.coalesce("_f_t", F.lit(0)).alias("sum")] if total else []))
