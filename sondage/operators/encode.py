"""Interval labels to features: bin maps, encodings, issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sondage.functions.labels import is_missing, parse_bin
from sondage.functions.normal import norm_ppf


def bin_map(cells: DataFrame) -> DataFrame:
    """The distinct interval labels of each column in order: col, label, lower, upper, rep, pos (from 0), n."""
    bins = cells.select("col", "label", parse_bin(F.col("label")).alias("b")).where("b IS NOT NULL").distinct()
    by = Window.partitionBy("col")
    pos = (F.row_number().over(by.orderBy("rep", "label")) - 1).cast("long")
    return bins.select("col", "label", "b.*").withColumns({"pos": pos, "n": F.count(F.lit(1)).over(by)})


def cell_issues(cells: DataFrame) -> DataFrame:
    """Cells that are missing or no interval, with the reason."""
    reason = F.when(is_missing(F.col("raw")), "missing").otherwise("unparsed")
    return cells.where(parse_bin(F.col("raw")).isNull()).select("line", "raw", reason.alias("reason"))


def encoded(cells: DataFrame, bins: DataFrame, kind: str) -> DataFrame:
    """Cells with x: the label's midpoint, position, or normal score of its position; null if it is no interval.

    Normal scores are made once for each bin, before the join with the cells.
    """
    if kind == "midpoint":
        value = F.col("rep")
    elif kind == "index":
        value = F.col("pos").cast("double")
    else:
        value = norm_ppf((F.col("pos") + F.lit(0.5)) / F.col("n"))
    return cells.join(bins.select("col", "label", value.alias("x")), ["col", "label"], "left")


def onehot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A 0/1 column for each level; a missing label is null in all of them."""
    flags = {f"{column}__{v.lower()}": F.when(F.col(column).isNotNull(), (F.col(column) == v).cast("int")) for v in levels}
    return df.withColumns(flags)


def monotonicity(bins: DataFrame) -> DataFrame:
    """Ties, inversions and overlaps of neighbouring bins, for columns with two bins or more."""
    order = Window.partitionBy("col").orderBy("pos")
    nxt = bins.withColumns({"low": F.lead("lower").over(order), "next": F.lead("rep").over(order)})
    finite = (F.abs("upper") != float("inf")) & (F.abs("low") != float("inf"))
    out = nxt.groupBy("col").agg(
        F.count("*").alias("n_bins"), F.count_if(F.col("next") == F.col("rep")).alias("ties"),
        F.count_if(F.col("next") < F.col("rep")).alias("inversions"), F.count_if((F.col("upper") > F.col("low")) & finite).alias("overlaps"),
    )
    return out.where("n_bins >= 2")
