"""Mixing sources to target weights by hash thresholds.

Sizes are summed by source and by the leading bits of a hash of each document;
the bucket in which a source's budget ends is found in those sums, and only that
bucket is split further. A document is taken if its hash is at most its source's
threshold, so the rows themselves are never sorted and a rerun takes the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sondage.llm.common import OWN, materialise, packed, unpacked
from sondage.operators.ranks import running

#: Bits of the hash that each level of buckets adds; the last level is the whole hash.
LEVELS = (8, 16, 24, 32, 60)
BITS = 60


def word_count(text: str) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(words, "")).cast("long")


def _in_order(rows: DataFrame, order: list, sums: dict[str, Column], name: str) -> DataFrame:
    """rows with sums over all of them up to each one in order, the row itself included: rows are sorted over many tasks and
    written, and sums by sorted part give what lies before each part."""
    parted = materialise(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    return running(parted, [], F.shiftright("_m", 33), ["_m"], sums).drop("_m")


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: float, share: float) -> DataFrame:
    """Target of each source: the weights share the total, no target is over cap times its source's size.

    sizes has one row per source (source, source_size). Sources by code point,
    null last, get the weights in turn. A source that meets its cap stops there
    and the rest is shared anew by weight, which ends at one level: targets are
    min(cap * size, level * weight). Sources can be many: no window holds all.
    """
    by_name = F.col("source").asc_nulls_last()
    rows = _in_order(sizes.select("source", "source_size"), [by_name], {"place": F.lit(1)}, "sources")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = rows.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * float(cap)).alias("most"))
    # In the order in which caps are met, what the sources before each one take.
    rows = _in_order(rows, [F.col("most") / F.col("weight"), by_name], {"upto": F.col("most"), "weights": F.col("weight")}, "filled")
    all_ = rows.agg((F.sum("source_size") * float(share)).alias("total"), F.sum("weight").alias("all_weight"))
    rows = rows.crossJoin(all_)  # one row
    rows = rows.withColumn("level", (F.col("total") - (F.col("upto") - F.col("most"))) / (F.col("all_weight") - (F.col("weights") - F.col("weight"))))
    rows = materialise(rows.withColumn("full", F.col("most") <= F.col("weight") * F.col("level")).select("source", "source_size", "weight", "most", "level", "full"), "levels")
    last = rows.where("NOT full").agg(F.max("level").alias("last"))  # that of the first in order; later ones are lower
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.coalesce("last", F.lit(0.0)))
    return rows.crossJoin(last).select("source", "source_size", target.alias("target"))


def marked(docs: DataFrame) -> DataFrame:
    """docs with size (words), h (the hash that decides) and key (the source; null is one too)."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))
    h = F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    return docs.withColumns({"size": word_count("text"), "h": h, "key": key})


def thresholds(rows: DataFrame, weights: tuple[int, ...], cap: float, share: float) -> DataFrame:
    """(key, source_size, target, whole, threshold) of each source: how often all of it is taken, and up to which hash once more."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.first("key").alias("key"))
    goal = targets(per, weights, cap, share).join(per.select("key", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = materialise(goal.select("key", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("budget")), "goal")

    # bound: all hashes under it are taken, with `before` words; the budget ends within the bucket [bound, bound + width).
    edge = goal.where("budget > 0").select("key", "budget", F.lit(0).cast("long").alias("bound"), F.lit(0).cast("long").alias("before"))
    width = BITS
    for bits in LEVELS:
        inside = rows.where("size > 0").join(edge, "key").where((F.col("h") >= F.col("bound")) & (F.col("h") < F.col("bound") + F.lit(1 << width)))
        low = F.shiftleft(F.shiftright("h", BITS - bits), BITS - bits)
        sums = inside.groupBy("key", "budget", "before", low.alias("low")).agg(F.sum("size").alias("n"))
        run = F.col("before") + F.sum("n").over(Window.partitionBy("key").orderBy("low"))
        ends = sums.withColumn("run", run).where(F.col("run") >= F.col("budget"))
        first = ends.groupBy("key").agg(F.min_by(F.struct("budget", "low", "run", "n"), F.col("low")).alias("e"))
        edge = materialise(first.select("key", "e.budget", F.col("e.low").alias("bound"), (F.col("e.run") - F.col("e.n")).alias("before"), F.col("e.n").alias("n")), "edge")
        width = BITS - bits
    nearer = (F.col("before") + F.col("n") - F.col("budget")) < (F.col("budget") - F.col("before"))
    last = edge.select("key", F.when(nearer, F.col("bound")).otherwise(F.col("bound") - 1).alias("threshold"))
    return materialise(goal.join(last, "key", "left"), "thresholds")


def taken(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Rows with their source's figures and copies; the hash alone decides, without sorting."""
    copies = F.col("whole") + (F.col("h") <= F.coalesce(F.col("threshold"), F.lit(-1))).cast("long")
    return rows.join(goal, "key").withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """The mix of docs (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    copies is how often the mix takes the document and taken is copies * size.
    Every document is taken floor(target / source_size) times; those whose hash
    is under their source's threshold once more. No sum of a source misses its
    target by more than half the documents that share one hash.

    Null and empty texts have size 0; a null source is a source of its own, and
    a null doc_id is hashed as such. Rows alike in doc_id and text share a hash
    and are taken alike. Without rows there are no rows; a source of size 0 has
    target 0. Other columns are ignored.
    """
    rows = marked(docs.select("doc_id", "text", F.col("source").cast("string").alias("source")))
    rows = materialise(rows.select("doc_id", "source", "size", "h", "key"), "sizes")
    out = taken(rows, thresholds(rows, weights, cap, share))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixture(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """The documents that the mix takes, with all their columns and how often it takes them: copies, or `copies_` if docs
    has a column of that name; rules as in mix()."""
    plain = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    rows = materialise(marked(plain).select("source", "size", "h", "key"), "sizes")
    goal = thresholds(rows, weights, cap, share).select("key", "whole", "threshold")
    whole = packed(docs, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source").cast("string"))
    rows = taken(marked(whole).select(OWN, "size", "h", "key"), goal).where("copies > 0")
    return unpacked(rows, docs, copies=F.col("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, n, 3.0::DOUBLE * n AS most, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((k - 1) % 3) + 1] AS weight, sum(n) OVER () AS total, sum([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((k - 1) % 3) + 1]) OVER () AS all_weight FROM s),
l AS (SELECT *, (total - coalesce(sum(most) OVER f, 0)) / (all_weight - coalesce(sum(weight) OVER f, 0)) AS level FROM w
      WINDOW f AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, n, CASE WHEN most <= weight * level THEN most ELSE weight * max(CASE WHEN most > weight * level THEN level END) OVER () END AS target FROM l),
g AS (SELECT source, n, target, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
b AS (SELECT *, target - whole * n AS budget FROM g),
u AS (SELECT source, h, sum(size) AS n FROM d WHERE size > 0 GROUP BY source, h),
r AS (SELECT u.source, u.h, u.n, budget, sum(u.n) OVER (PARTITION BY u.source ORDER BY u.h) AS run FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source),
x AS (SELECT source, max(h) AS threshold FROM r WHERE budget > 0 AND run - n < budget AND (run < budget OR run - budget < budget - (run - n)) GROUP BY source)
SELECT d.doc_id, d.size, CAST(b.n AS BIGINT) AS source_size, b.target,
       CAST(d.size * (b.whole + CASE WHEN d.h <= coalesce(x.threshold, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
