"""Data-quality audits: levels, missingness, association, purity, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def long(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids, variable, level) for each cell; levels as text."""
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(ids, columns, "variable", "level")


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    return long(df, [], columns).groupBy("variable").agg(F.count_if(F.col("level").isNull()).alias("n_missing"), F.count("*").alias("n"))


def level_counts(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """Count and share of every level, missing ones included."""
    counts = long(df, ids or [], columns).groupBy("variable", "level").agg(F.count("*").alias("n"))
    total = counts.groupBy("variable").agg(F.sum("n").alias("total"))
    return counts.join(total, "variable").withColumn("share", F.col("n") / F.col("total"))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """The commonest level of each variable, the first by name among equals, and its share."""
    counts = level_counts(df, columns)
    most = counts.groupBy("variable").agg(F.max("n").alias("n"))
    tied = counts.join(most, ["variable", "n"])
    return tied.groupBy("variable").agg(F.min("level").alias("mode"), F.max("share").alias("share"), F.max("n").alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 and the bias-corrected association of two variables, from their counts."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    total = cells.agg(F.sum("o").cast("double").alias("n"))
    # Levels of both variables: cells without rows count too.
    grid = rows.crossJoin(cols).crossJoin(total).join(cells, ["a", "b"], "left")
    e = F.col("ra") * F.col("cb") / F.col("n")
    o = F.coalesce("o", F.lit(0))
    agg = grid.agg(F.sum((o - e) * (o - e) / e).alias("chi2"), F.max("n").alias("n"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("k"))
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    denominator = F.least(rc - 1, kc - 1)
    return agg.select("chi2", F.when((r >= 2) & (k >= 2) & (denominator > 0), F.sqrt(phi / denominator)).alias("v"))


def weighted_purity(df: DataFrame, column: str, y: str) -> DataFrame:
    """Share of rows whose outcome is the commoner one of their level."""
    per = df.groupBy(column).agg(F.count("*").alias("n"), F.avg(y).alias("p"))
    return per.agg((F.sum(F.col("n") * F.greatest(F.col("p"), 1 - F.col("p"))) / F.sum("n")).alias("purity"))


def repeated_rows(df: DataFrame, columns: list[str], line: str) -> DataFrame:
    """Lines that repeat an earlier line's values in the columns."""
    first = df.groupBy(*columns).agg(F.min(line).alias("first"), F.count("*").alias("n")).where("n > 1")
    same = [df[c].eqNullSafe(first[c]) for c in columns]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(first, on).where(F.col(line) != F.col("first")).select(line, "first")


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row by column level, the levels given."""
    counted = df.groupBy(F.coalesce(F.col(row).cast("string"), F.lit("<missing>")).alias(row)).pivot(column, values).count()
    return counted.na.fill(0)
