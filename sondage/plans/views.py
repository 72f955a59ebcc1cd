"""The prediction table that the metric queries share, and its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.functions import rng
from sondage.operators.ranks import numbered
from sondage.session import table
from sondage.sources.files import written

REPEATS, FOLDS = 5, 5
CELL = ["config", "model"]

U = "CAST('0x' || substr(md5('p:' || event_id || ':' || repeat), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
RAW = f"""raw AS (SELECT event_id AS sample, CAST(repeat AS INTEGER) AS repeat, 'm' || (user_id % 3) AS model, 'f' || (event_id % 2) AS config, event_type AS stratum, user_id AS grp,
  CAST(event_type IN ('purchase', 'click') AS INTEGER) AS y, round(greatest(0.001, least(0.999, 1.0 - exp(-value / 50.0) + ({U} - 0.5) * 0.1)), 4)::DOUBLE AS p
  FROM events, (SELECT unnest(range(0, {REPEATS})) AS repeat))"""
PREDS = RAW + f""", preds AS (SELECT *, 0.3::DOUBLE + fold * 0.01::DOUBLE AS cut FROM (SELECT *, CAST((row_number() OVER (PARTITION BY repeat, y ORDER BY md5('fold:' || repeat || ':' || sample), sample) - 1) % {FOLDS} AS INTEGER) AS fold FROM raw))"""
POOL = PREDS + ", pooled AS (SELECT config, model, sample, min(y) AS y, round(avg(p), 6) AS p, round(avg(cut), 6) AS cut, min(stratum) AS stratum, count(*) AS n FROM preds GROUP BY 1, 2, 3)"


def raw(spark, sf):
    e = table(spark, sf, "events").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    noise = (rng.uniform("p", F.col("event_id"), F.col("repeat")) - 0.5) * 0.1
    p = F.round(F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.lit(1.0) - F.exp(-F.col("value") / 50.0) + noise)), 4)
    return e.select(
        F.col("event_id").alias("sample"), "repeat", F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.concat(F.lit("f"), (F.col("event_id") % 2).cast("string")).alias("config"), F.col("event_type").alias("stratum"), F.col("user_id").alias("grp"),
        F.col("event_type").isin("purchase", "click").cast("int").alias("y"), p.alias("p"),
    )


def folded(df, folds: int = FOLDS):
    """Stratified folds: rows of each (repeat, y) in the order of a hash, dealt in turn."""
    hashed = df.withColumn("_h", rng.hashed("fold", F.col("repeat"), F.col("sample")))
    out = numbered(hashed, ["repeat", "y"], "_h", "fold", ["sample"])
    return out.withColumn("fold", (F.col("fold") % folds).cast("int")).drop("_h")


def preds(spark, sf):
    return folded(raw(spark, sf)).withColumn("cut", F.lit(0.3) + F.col("fold") * F.lit(0.01))


def pooled(df):
    """Predictions of a sample averaged over repeats; without a cut if df has none."""
    cut = [F.round(F.avg("cut"), 6).alias("cut")] if "cut" in df.columns else []
    return df.groupBy("config", "model", "sample").agg(F.min("y").alias("y"), F.round(F.avg("p"), 6).alias("p"), *cut, F.min("stratum").alias("stratum"), F.count("*").alias("n"))


def scores(spark, sf):
    """pooled() for what needs no cut: no fold is assigned, and the repeats of a row meet before they are exchanged."""
    return pooled(raw(spark, sf))


def tallied(df, *by):
    """How many rows, w, of each cell, what else is named, outcome and score: arms that recode these need the rows no more."""
    return written(df.groupBy(*CELL, *by, "y", "p").agg(F.count(F.lit(1)).cast("double").alias("w")), "tallied")


def cuts(spark, sf):
    """(config, model, c): the mean of a cell's cuts over its samples, from rows without their scores."""
    return pooled(preds(spark, sf)).groupBy(*CELL).agg(F.round(F.avg("cut"), 9).alias("c"))
