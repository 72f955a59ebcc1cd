"""Aggregates of groups after each of many batches, from the batches that every item lives through.

A row's life is a run of batches, as a mask with a bit for each batch. The masks
of equal values, or-ed, say after which batches the value is there at all; a
group's values are scanned once in ascending order, and counters that hold one
bit of all batches' numbers in a mask (so that adding is a carry through masks)
count rows and different values and find ranks for all batches together. No
batch is computed for itself.

Values are dealt over tasks by ranges, so a group, or a value, with most of the
rows still spreads over many tasks. A task cuts its rows into blocks; sums by
block and batch say in which block a median lies, and only that one is scanned
again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sondage.llm.common import materialise, prepare

#: Rows of a block, but for what one more Arrow batch brings.
BLOCK = 50_000
CELL = np.dtype([("value", "<i8"), ("n", "<i8"), ("first", "<i4"), ("last", "<i4")])
FIGURES = ["n_rows", "n_distinct", "total", "least", "greatest", "median"]
SUMMARY = "block long, n_rows array<long>, n array<long>, inner array<long>, total array<long>, least array<long>, greatest array<long>, edges array<struct<value:long,batches:array<int>>>, cells binary"


def bits(mask: int) -> list[int]:
    """The places of a mask's set bits."""
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


class Counters:
    """A number for every batch; plane k is the mask of those batches whose number has bit k."""

    def __init__(self, width: int = 0):
        self.width, self.planes = width, [0] * width

    def set(self, batch: int, number: int) -> None:
        for k in range(self.width):
            if number >> k & 1:
                self.planes[k] |= 1 << batch

    def add(self, mask: int, times: int = 1) -> int:
        """Add times to the batches of the mask; the batches whose number ran over the width, if there is one."""
        planes, over, start = self.planes, 0, 0
        while times:
            if times & 1:
                carry, k = mask, start
                while carry:
                    if k == len(planes):
                        if self.width:
                            over |= carry
                            break
                        planes.append(0)
                    planes[k], carry = planes[k] ^ carry, planes[k] & carry
                    k += 1
            times >>= 1
            start += 1
            if start > len(planes) and not self.width:
                planes.append(0)
        return over

    def numbers(self, batches: int) -> list[int]:
        out = [0] * batches
        for k, plane in enumerate(self.planes):
            for b in bits(plane):
                out[b] += 1 << k
        return out


def spread(cells: np.ndarray, weights: np.ndarray, batches: int) -> list[int]:
    """Sums of the weights of the cells that live through each batch."""
    if float(np.abs(weights.astype(float)).sum()) >= 2.0**62:
        raise OverflowError("a total does not fit a long")
    step = np.zeros(batches + 1, np.int64)
    np.add.at(step, cells["first"], weights)
    np.subtract.at(step, cells["last"] + 1, weights)
    return np.cumsum(step)[:-1].tolist()


def scan(cells: np.ndarray, missing: np.ndarray, batches: int) -> tuple:
    """Of a block, ordered by value: what its rows add to each batch. The first and the last value may go on in other blocks:
    edges has them with their batches, and inner counts the values between."""
    some = cells[~missing]
    rows, items = Counters(), []
    ends = [1 << b for b in range(batches + 1)]
    last = None
    for value, n, a, b in some.tolist():
        mask = ends[b + 1] - ends[a]
        rows.add(mask, n)
        if value == last:
            items[-1][1] |= mask
        else:
            items.append([value, mask])
            last = value
    inner, least, greatest = Counters(), [None] * batches, [None] * batches
    for _, mask in items[1:-1]:
        inner.add(mask)
    for order, found in ((items, least), (items[::-1], greatest)):
        seen, every = 0, ends[batches] - 1
        for value, mask in order:
            if new := mask & ~seen:
                for b in bits(new):
                    found[b] = value
                seen |= new
                if seen == every:
                    break
    edges = [{"value": v, "batches": bits(m)} for v, m in (items[:1] + items[1:][-1:])]
    return (spread(cells, cells["n"], batches), rows.numbers(batches), inner.numbers(batches), spread(some, some["value"] * some["n"], batches), least, greatest, edges, some.tobytes())


def ranked(cells: np.ndarray, targets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(batch, value): of each target (batch, rank) the value with that rank, from 1, among the block's rows in the batch."""
    width = max([int(cells["n"].sum()), *(r for _, r in targets)]).bit_length() + 1
    counters, waiting, found = Counters(width), 0, []
    for batch, rank in targets:
        counters.set(batch, (1 << width) - rank)  # runs over when the rank is reached
        waiting |= 1 << batch
    for value, n, a, b in cells.tolist():
        if mask := ((1 << b + 1) - (1 << a)) & waiting:
            if over := counters.add(mask, n):
                found += [(batch, value) for batch in bits(over)]
                waiting &= ~over
                if not waiting:
                    break
    return found


def maintained(lives: DataFrame, keys: list[str], *, batches: int, block_rows: int = BLOCK) -> DataFrame:
    """(keys, batch, n_rows, n_distinct, total, least, greatest, median): every group of lives after every batch.

    lives has keys, value (long), first and last: the row is there after the
    batches first to last, both included; what lies before batch 0 or from
    `batches` on is left out, and a row whose last is before its first is never
    there. n_rows counts rows, the others their non-null values: n_distinct the
    different ones, median that of rank floor((n + 1) / 2), from 1. Without
    rows, n_rows, n_distinct and total are 0; without values, total is 0 and
    least, greatest and median are null.

    A null key is a group of its own; rows without first or last are never
    there, and a group without any life has no rows. Repeated rows count as
    often as they stand there; other columns are ignored. A total beyond a long
    is an error.
    """
    spark = lives.sparkSession
    prepare(spark)
    in_range = lives.where("first IS NOT NULL AND last IS NOT NULL").select(*keys, F.col("value").cast("long").alias("value"), F.greatest(F.col("first"), F.lit(0)).cast("int").alias("first"), F.least(F.col("last"), F.lit(batches - 1)).cast("int").alias("last"))
    cells = in_range.where("first <= last").groupBy(*keys, "value", "first", "last").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select(*keys, F.col("value").isNull().alias("missing"), F.coalesce("value", F.lit(0).cast("long")).alias("value"), "first", "last", "n")
    order = [*keys, "missing", "value", "first", "last"]
    kinds = dict(cells.dtypes)
    typed = "".join(f"`{k}` {kinds[k]}, " for k in keys)

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, group, size = TaskContext.get().partitionId() << 32, [], None, 0

        def made():
            rows = pd.concat(held, ignore_index=True)
            packed = np.zeros(len(rows), CELL)
            for c in CELL.names:
                packed[c] = rows[c].to_numpy()
            return pd.DataFrame([(*group, block, *scan(packed, rows["missing"].to_numpy(bool), batches))], columns=[*keys, *names])

        for part in parts:
            for key, rows in part.groupby(keys, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if held and (key != group or size >= block_rows):
                    yield made()
                    block, held, size = block + 1, [], 0
                held.append(rows)
                group, size = key, size + len(rows)
        if held:
            yield made()

    names = [f.split(" ")[0] for f in SUMMARY.split(", ")]
    sums = materialise(cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(blocks, typed + SUMMARY), "blocks")
    per = sums.select(*keys, "block", F.posexplode(F.arrays_zip("n_rows", "n", "inner", "total", "least", "greatest")).alias("batch", "f")).select(*keys, "block", "batch", "f.*")
    # A value at the end of a block counts once, however many blocks have it.
    edges = sums.select(*keys, F.explode("edges").alias("e")).select(*keys, "e.value", F.explode("e.batches").alias("batch")).distinct()

    batch = Window.partitionBy(*keys, "batch")  # a row per block
    before = F.sum("n").over(batch.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    rank = F.floor((F.sum("n").over(batch) + 1) / 2)
    at = per.where("n > 0").select("block", "batch", "n", before.alias("before"), rank.alias("rank"))
    at = at.where("before < rank AND rank <= before + n").groupBy("block").agg(F.collect_list(F.struct("batch", (F.col("rank") - F.col("before")).alias("rank"))).alias("targets"))  # one per batch
    again = sums.select(*keys, "block", "cells").join(at.hint("merge"), "block").select(*keys, "cells", "targets")

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                targets = [(t["batch"], t["rank"]) for t in row[-1]]
                got = ranked(np.frombuffer(row[-2], CELL), targets)
                yield pd.DataFrame([(*row[:-2], b, v) for b, v in got], columns=[*keys, "batch", "median"])

    middle = again.mapInPandas(find, typed + "batch int, median long")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    figures = per.select(*keys, "batch", "n_rows", F.col("inner").alias("n_distinct"), "total", "least", "greatest", none.alias("median"))
    one = edges.select(*keys, "batch", zero.alias("n_rows"), F.lit(1).cast("long").alias("n_distinct"), zero.alias("total"), *[none.alias(c) for c in ("least", "greatest", "median")])
    found = middle.select(*keys, "batch", *[zero.alias(c) for c in ("n_rows", "n_distinct", "total")], *[none.alias(c) for c in ("least", "greatest")], "median")
    how = {"n_rows": F.sum, "n_distinct": F.sum, "total": F.sum, "least": F.min, "greatest": F.max, "median": F.max}
    return figures.unionByName(one).unionByName(found).groupBy(*keys, "batch").agg(*[f(c).alias(c) for c, f in how.items()])


def changes(state: DataFrame, keys: list[str]) -> DataFrame:
    """(batch, keys, old_*, new_*) of the batches after which a group's figures are others than before; nothing precedes the
    first batch. state has every batch of its groups, as maintained() gives it."""
    order = Window.partitionBy(*keys).orderBy("batch")  # a row per batch
    empty = {"n_rows": 0, "n_distinct": 0, "total": 0}
    both = state.select("batch", *keys, *[c for f in FIGURES for c in (F.lag(f, 1, empty.get(f)).over(order).alias(f"old_{f}"), F.col(f).alias(f"new_{f}"))])
    moved = F.lit(False)
    for f in FIGURES:
        moved = moved | ~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))
    return both.where(moved)


def document_lives(docs: DataFrame, *, batches: int = 120, stays: int = 15, again: int = 3) -> DataFrame:
    """(source, lang, value, first, last) of documents (doc_id, source, lang, n_chars) that come and go.

    Of the crc32 h of doc_id as text, the batch that a row enters is h mod
    batches and its stay q is floor(h / batches) mod stays; it leaves after q
    batches, and if `again` divides q it is back from then on, with q added to
    its value. Null source and lang are empty; a null doc_id is the text `null`.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("n_chars").alias("value"), (h % batches).alias("b"), (F.floor(h / batches) % stays).alias("q"))
    life = lambda value, first, last: F.struct(value.alias("value"), first.cast("int").alias("first"), last.cast("int").alias("last"))
    stay = life(F.col("value"), F.col("b"), F.col("b") + F.col("q") - 1)
    back = F.when(F.col("q") % again == 0, life(F.col("value") + F.col("q"), F.col("b") + F.col("q"), F.lit(batches - 1)))
    return rows.select("source", "lang", F.explode(F.array_compact(F.array(stay, back))).alias("l")).select("source", "lang", "l.*")


BATCHES = 120


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    keys = ["source", "lang"]
    return changes(maintained(document_lives(docs, batches=BATCHES), keys, batches=BATCHES), keys)


_NEW = "count(v.doc) AS n_rows, count(DISTINCT v.value) AS n_distinct, CAST(coalesce(sum(v.value), 0) AS BIGINT) AS total, min(v.value) AS least, max(v.value) AS greatest, list_sort(list(v.value) FILTER (v.value IS NOT NULL))[(count(v.value) + 1) // 2] AS median"
_LAG = ", ".join(f"lag({f}, 1, {0 if f in ('n_rows', 'n_distinct', 'total') else 'NULL'}) OVER w AS old_{f}, {f} AS new_{f}" for f in FIGURES)
SQL = f"""
WITH h AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_chars, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), 'null'), ''), lambda c: ascii(c)::BIGINT)),
       lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM documents),
r AS (SELECT source, lang, n_chars, h % {BATCHES} AS b, h // {BATCHES} % 15 AS q FROM h),
l AS (SELECT source, lang, n_chars AS value, b AS a, b + q - 1 AS z FROM r UNION ALL SELECT source, lang, n_chars + q, b + q, {BATCHES - 1} FROM r WHERE q % 3 = 0),
v AS (SELECT source, lang, value, unnest(range(a, least(z, {BATCHES - 1}) + 1)) AS batch, 1 AS doc FROM l),
g AS (SELECT * FROM (SELECT DISTINCT source, lang FROM r), (SELECT unnest(range({BATCHES})) AS batch)),
s AS (SELECT g.batch, g.source, g.lang, {_NEW} FROM g LEFT JOIN v USING (source, lang, batch) GROUP BY ALL),
c AS (SELECT CAST(batch AS INTEGER) AS batch, source, lang, {_LAG} FROM s WINDOW w AS (PARTITION BY source, lang ORDER BY batch))
SELECT * FROM c WHERE {" OR ".join(f"old_{f} IS DISTINCT FROM new_{f}" for f in FIGURES)}
"""
