"""Cohorts from relational event data under a temporal guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_positive(admissions: DataFrame, subject: str, time: str, positive: Column) -> DataFrame:
    """Time of the first positive admission of each subject that has one."""
    return admissions.where(positive).groupBy(subject).agg(F.min(time).alias("first_positive"))


def guarded(measurements: DataFrame, first: DataFrame, subject: str, time: str) -> DataFrame:
    """Measurements taken before the subject's first positive admission; subjects without one keep all."""
    joined = measurements.join(first, subject, "left")
    return joined.where(F.col("first_positive").isNull() | (F.col(time) < F.col("first_positive")))


def earliest(measurements: DataFrame, subject: str, item: str, time: str, value: str, tie: list[str]) -> DataFrame:
    """The earliest non-null value of each (subject, item); equal times are settled by the tie columns."""
    order = F.struct(time, *tie)
    return measurements.where(F.col(value).isNotNull()).groupBy(subject, item).agg(F.min_by(value, order).alias("value"))


def cohort(subjects: DataFrame, admissions: DataFrame, measurements: DataFrame, *, subject: str, admit: str, positive: Column, time: str, item: str, value: str, tie: list[str], items: list) -> DataFrame:
    """One row per subject: label and the earliest guarded value of each item."""
    first = first_positive(admissions, subject, admit, positive)
    kept = guarded(measurements.where(F.col(item).isin(items)), first, subject, time)
    wide = earliest(kept, subject, item, time, value, tie).groupBy(subject).pivot(item, items).agg(F.first("value"))
    for i in items:
        wide = wide.withColumnRenamed(str(i), f"item_{i}")
    out = subjects.select(subject).join(first, subject, "left").join(wide, subject, "left")
    return out.withColumn("label", F.col("first_positive").isNotNull().cast("int")).drop("first_positive")
