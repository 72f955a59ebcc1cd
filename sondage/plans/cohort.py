"""Queries that rebuild a cohort: customers as patients, orders as admissions, order lines as measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.operators import ehr
from sondage.plans import plan
from sondage.session import table

ITEMS = [1, 2, 3, 4]

#: The relational core that the statements below share.
FIRST = "first_pos AS (SELECT o_custkey AS subject, min(o_orderdate) AS first_positive FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"
LABS = "labs AS (SELECT o_custkey AS subject, l_linenumber AS item, l_shipdate AS charttime, l_quantity AS val, l_orderkey, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
GUARD = "kept AS (SELECT labs.* FROM labs LEFT JOIN first_pos USING (subject) WHERE first_positive IS NULL OR charttime < first_positive)"


def tables(spark, sf):
    """Subjects, admissions and measurements."""
    subjects = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"))
    orders = table(spark, sf, "orders")
    admissions = orders.select(F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("admit"), "o_orderpriority")
    labs = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("subject"), F.col("l_linenumber").alias("item"), F.col("l_shipdate").alias("charttime"), F.col("l_quantity").alias("val"), "l_orderkey", "l_partkey", "l_suppkey"
    )
    return subjects, admissions, labs



@plan(
    "ehr_cohort",
    f"""WITH {FIRST}, {LABS}, {GUARD},
    early AS (SELECT subject, item, val FROM (SELECT *, row_number() OVER (PARTITION BY subject, item ORDER BY charttime, l_orderkey, l_partkey, l_suppkey, val) AS rn FROM kept WHERE val IS NOT NULL) WHERE rn = 1)
    SELECT c_custkey AS subject, CAST(first_positive IS NOT NULL AS INTEGER) AS label,
      max(CASE WHEN item = 1 THEN val END) AS item_1, max(CASE WHEN item = 2 THEN val END) AS item_2,
      max(CASE WHEN item = 3 THEN val END) AS item_3, max(CASE WHEN item = 4 THEN val END) AS item_4
    FROM customer LEFT JOIN first_pos ON c_custkey = first_pos.subject LEFT JOIN early ON c_custkey = early.subject GROUP BY 1, 2""",
)
def ehr_cohort(spark, sf):
    subjects, admissions, labs = tables(spark, sf)
    return ehr.cohort(
        subjects, admissions, labs, subject="subject", admit="admit", positive=F.col("o_orderpriority") == "1-URGENT",
        time="charttime", item="item", value="val", tie=["l_orderkey", "l_partkey", "l_suppkey", "val"], items=ITEMS,
    )


@plan("first_positive", f"WITH {FIRST} SELECT * FROM first_pos")
def first_positive(spark, sf):
    _, admissions, _ = tables(spark, sf)
    return ehr.first_positive(admissions, "subject", "admit", F.col("o_orderpriority") == "1-URGENT")


@plan("temporal_guard", f"WITH {FIRST}, {LABS}, {GUARD} SELECT item, count(*) AS n, count(DISTINCT subject) AS subjects FROM kept GROUP BY item")
def temporal_guard(spark, sf):
    _, admissions, labs = tables(spark, sf)
    first = ehr.first_positive(admissions, "subject", "admit", F.col("o_orderpriority") == "1-URGENT")
    return ehr.guarded(labs, first, "subject", "charttime").groupBy("item").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


@plan("earliest_per_key", f"WITH {LABS} SELECT subject, item, val AS value FROM (SELECT *, row_number() OVER (PARTITION BY subject, item ORDER BY charttime, l_orderkey, l_partkey, l_suppkey, val) AS rn FROM labs WHERE val IS NOT NULL) WHERE rn = 1")
def earliest_per_key(spark, sf):
    return ehr.earliest(tables(spark, sf)[2], "subject", "item", "charttime", "val", ["l_orderkey", "l_partkey", "l_suppkey", "val"])


@plan("advanced_stage", "SELECT o_custkey AS subject, max(o_orderpriority) AS stage FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' GROUP BY 1")
def advanced_stage(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"))
    return o.groupBy(F.col("o_custkey").alias("subject")).agg(F.max("o_orderpriority").alias("stage"))


@plan("left_join_two_keys", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem LEFT JOIN (SELECT o_orderkey, o_custkey, o_orderpriority, 1 AS one FROM orders WHERE o_orderstatus = 'F') o ON l_orderkey = o_orderkey AND l_linenumber = one")
def left_join_two_keys(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), "o_orderpriority")
    return table(spark, sf, "lineitem").join(o, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", "o_orderpriority")


@plan("cohort_coverage", f"WITH {FIRST}, {LABS}, {GUARD} SELECT i.item, count(DISTINCT subject) AS subjects, round(count(DISTINCT subject) / (SELECT count(*) FROM customer)::DOUBLE, 9) AS coverage FROM (SELECT unnest([1, 2, 3, 4]) AS item) i LEFT JOIN (SELECT * FROM kept WHERE val IS NOT NULL) k ON k.item = i.item GROUP BY i.item")
def cohort_coverage(spark, sf):
    wide = ehr_cohort(spark, sf)
    counts = wide.agg(F.count("*").alias("n"), *[F.count(f"item_{i}").alias(str(i)) for i in ITEMS])
    long = counts.unpivot("n", [str(i) for i in ITEMS], "item", "subjects")
    return long.select(F.col("item").cast("int").alias("item"), "subjects", F.round(F.col("subjects") / F.col("n"), 9).alias("coverage"))
