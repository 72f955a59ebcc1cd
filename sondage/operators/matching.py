"""Largest matchings of bipartite graphs whose edges are spread over many tasks.

Every phase grows alternating trees from all unmatched left nodes at once, layer
by layer: each right node that is reached goes to one tree, by the smallest hash
among the offers, so trees share no node; its partner carries on. A tree that
reaches unmatched right nodes takes the path to one of them and stops growing.
Paths of different trees have no node in common, so all are turned at once. A
phase in which no tree finds one proves the matching to be a largest: the trees
then hold all that unmatched nodes can reach.

Only joins and aggregates, so neither a component nor a node's edges need fit
into a task. Many graphs are matched side by side if their nodes have different
numbers.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sondage.sources.files import remove, scratch, written

PATH = "array<struct<i:bigint,j:bigint>>"


def maximum_matching(edges: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """(i, j) of a largest matching: edges of which no two share an i or a j.

    i and j are longs, each side with numbers of its own; repeated edges change
    nothing and edges with a null are left out. Which largest matching it is
    depends on hashes of the numbers alone. What a phase writes is removed when
    it ends.
    """
    spark = edges.sparkSession
    some = edges.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).where("i IS NOT NULL AND j IS NOT NULL").distinct()
    some = written(some, "edges")
    left, right = some.select("i").distinct(), some.select("j").distinct()
    last, phase = scratch(spark, "matching"), 0
    match = written(spark.createDataFrame([], "i long, j long"), "matching", last)
    while True:
        rights = right.join(match.withColumnRenamed("i", "mate"), "j", "left")
        roots = left.join(match, "i", "left_anti")
        frontier = roots.select("i", F.col("i").alias("root"), F.array().cast(PATH).alias("path"))
        taken: list[DataFrame] = []
        paths: list[DataFrame] = []
        folders: list[str] = []
        while True:
            offers = some.join(frontier, "i")
            if taken:
                offers = offers.join(reduce(DataFrame.unionByName, taken), "j", "left_anti")
            least = F.xxhash64(F.lit(phase), "root", "j")
            step = F.struct("root", F.concat("path", F.array(F.struct("i", "j"))).alias("path"))
            won = offers.groupBy("j").agg(F.min_by(step, least).alias("w")).join(rights, "j")
            folders.append(scratch(spark, "layer"))
            layer = written(won.select("j", "mate", "w.root", "w.path"), "layer", folders[-1])
            ends = layer.where("mate IS NULL").groupBy("root").agg(F.min_by("path", F.xxhash64(F.lit(phase), "j")).alias("path"))
            counts = layer.agg(F.count_if(F.col("mate").isNull()).alias("free"), F.count("mate").alias("held")).first()
            taken.append(layer.select("j"))
            if counts["free"]:
                paths.append(ends)
            if not counts["held"]:
                break
            on = layer.where("mate IS NOT NULL")
            if counts["free"]:
                on = on.join(ends, "root", "left_anti")
            frontier = on.select(F.col("mate").alias("i"), "root", "path")
        if not paths:
            for folder in folders:
                remove(spark, folder)
            return match
        new = reduce(DataFrame.unionByName, paths).select(F.explode("path").alias("e")).select("e.i", "e.j")
        path = scratch(spark, "matching")
        match = written(match.join(new, "i", "left_anti").unionByName(new), "matching", path)
        for folder in [last, *folders]:
            remove(spark, folder)
        last, phase = path, phase + 1


def largest_flow(supply: np.ndarray, demand: np.ndarray, fits: np.ndarray) -> int:
    """The size of a largest matching of supply[a] equal left nodes with demand[b] equal right ones where fits[a, b].

    What rows take from what is left, those with few columns first; then paths
    to a column with something left, from all rows with something left at once,
    until there is none.
    """
    supply, demand = supply.astype(np.int64), demand.astype(np.int64)
    flow = np.zeros(fits.shape, np.int64)
    for a in np.argsort(fits.sum(1), kind="stable"):
        free = np.where(fits[a], demand, 0)
        upto = np.minimum(free.cumsum(), supply[a])
        flow[a] = np.diff(upto, prepend=0)
        supply[a] -= flow[a].sum()
        demand -= flow[a]
    while True:
        from_row, from_column = np.full(len(demand), -1), np.full(len(supply), -1)
        seen, rows, ends = supply > 0, list(np.flatnonzero(supply > 0)), []
        while rows:
            columns = []
            for a in rows:
                new = np.flatnonzero(fits[a] & (from_row < 0))
                from_row[new] = a
                columns += list(new)
            ends += [b for b in columns if demand[b] > 0]
            rows = []
            for b in columns:
                new = np.flatnonzero((flow[:, b] > 0) & ~seen)
                seen[new], from_column[new] = True, b
                rows += list(new)
        if not ends:
            return int(flow.sum())
        for b in ends:
            path, a = [(from_row[b], b)], from_row[b]
            while from_column[a] >= 0:
                path += [(a, from_column[a])]
                a = from_row[from_column[a]]
                path += [(a, path[-1][1])]
            on, off = path[::2], path[1::2]
            moved = min(supply[a], demand[b], *[flow[x] for x in off])
            if moved > 0:  # an earlier path may have taken it
                for x in on:
                    flow[x] += moved
                for x in off:
                    flow[x] -= moved
                supply[a] -= moved
                demand[b] -= moved
