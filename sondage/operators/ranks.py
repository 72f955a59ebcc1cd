"""Ranks and running sums without a window over a whole group.

A group's rows are dealt into ordered buckets; sums by bucket give what lies
before each bucket, and a window within a bucket adds the rest. So a group that
holds most of the rows still spreads over as many tasks as it has buckets.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from sondage.sources.files import written


def running(df: DataFrame, keys: list[str], bucket: Column, order: list, sums: dict[str, Column], descending: bool = False, totals: dict[str, str] | None = None, many: bool = False) -> DataFrame:
    """df with each of sums accumulated in order, the row itself included; bucket must be monotone in the order.

    totals names columns for the sums of whole groups. The buckets' sums are
    joined null-safely: no filter is inferred for one side only, so an exchange
    that df ends with serves both sides. Where there are many groups, such as
    draws, so are buckets: many then keeps their sums from being broadcast.
    """
    rows = df.withColumn("_b", bucket)
    per = rows.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    group = Window.partitionBy(*keys)
    by = group.orderBy(F.col("_b").desc() if descending else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
    names = [*keys, "_b"]
    before = per.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(names)], *[F.coalesce(F.sum(f"_{n}").over(by), F.lit(0)).alias(f"_{n}") for n in sums],
        *[F.sum(f"_{n}").over(group).alias(t) for n, t in (totals or {}).items()],
    )
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(names)])
    inside = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before.hint("merge") if many else before, on)
    out = out.withColumns({n: F.col(f"_{n}") + F.sum(c).over(inside) for n, c in sums.items()})
    return out.drop("_b", *[f"_{n}" for n in sums], *[f"_key{i}" for i in range(len(names))])


def numbered(df: DataFrame, keys: list[str], hashed: str, name: str, ties: list[str], many: bool = False) -> DataFrame:
    """df with the 0-based rank of each row in the order of a hexadecimal hash, then of ties; many as in running().

    Unless there are many groups, the buckets' sizes are written first: a table that small
    meets the rows where they are ranked, so these are exchanged once, with the hash as bytes.
    """
    if many:
        out = running(df, keys, F.substring(hashed, 1, 3), [hashed, *ties], {name: F.lit(1)}, many=True)
        return out.withColumn(name, F.col(name) - 1)
    rows, names = df.withColumn("_b", F.substring(hashed, 1, 3)), [*keys, "_b"]
    per = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    before = written(per.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(names)], F.coalesce(F.sum("_n").over(by), F.lit(0)).alias("_before")), "before")
    inside = Window.partitionBy(*names).orderBy("_o", *ties)
    ranked = rows.withColumn("_o", F.unhex(hashed)).withColumn(name, F.row_number().over(inside)).drop("_o")
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(names)])
    out = ranked.join(before, on).withColumn(name, F.col("_before") + F.col(name) - 1)
    return out.drop("_b", "_before", *[f"_key{i}" for i in range(len(names))])


def by_edges(df: DataFrame, keys: list[str], value: str, buckets: int = 64) -> tuple[DataFrame, Column]:
    """df with a column _edges, and the bucket of value between these edges.

    The edges are approximate quantiles of each group, so buckets stay alike
    whatever the range: one outlier does not put all others into one bucket. A
    null is in the bucket below all others. The edges are written: they depend on
    the order in which partial sketches arrive, so a second computation of them
    would deal the rows into other buckets than those that were summed.
    """
    cuts = written(df.groupBy(*keys).agg(F.approx_percentile(value, [i / buckets for i in range(1, buckets)], 2000).alias("_edges")), "edges")
    rows = df.join(cuts.select(*[F.col(k).alias(f"_at{i}") for i, k in enumerate(keys)], "_edges"), reduce(and_, [F.col(k).eqNullSafe(F.col(f"_at{i}")) for i, k in enumerate(keys)], F.lit(True)))
    bucket = F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter(F.coalesce("_edges", F.array()), lambda e: e <= F.col(value))))
    return rows.drop(*[f"_at{i}" for i in range(len(keys))]), bucket


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], name: str, times: Column | None = None) -> DataFrame:
    """(keys, name): exact quantiles of each group's values, interpolated between neighbours, as an array; a row counts times.

    From counts of the distinct values and running sums over them, so no group's
    values meet in one task. Nulls do not count; a group without values has no row.
    """
    counts = written(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("_n")), "counts")
    rows, bucket = by_edges(counts, keys, value)
    rows = running(rows, keys, bucket, [value], {"_upto": F.col("_n")}, totals={"_upto": "_all"}).drop("_edges")
    # Of the 0-based places of the two neighbours of each quantile.
    place = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    holds = lambda at: (F.col("_upto") - F.col("_n") <= at) & (at < F.col("_upto"))
    parts = []
    for i, q in enumerate(probabilities):
        parts += [F.max(F.when(holds(F.floor(place(q))), F.col(value))).alias(f"_lo{i}"), F.max(F.when(holds(F.ceil(place(q))), F.col(value))).alias(f"_hi{i}")]
    found = rows.groupBy(*keys).agg(F.max("_all").alias("_all"), *parts)
    share = lambda q: place(q) - F.floor(place(q))
    each = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share(q) for i, q in enumerate(probabilities)]
    return found.select(*keys, F.array(*each).alias(name))
