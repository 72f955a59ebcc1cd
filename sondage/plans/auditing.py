"""Queries that audit the tables' quality, and report-level summaries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sondage.operators import audit as A
from sondage.operators.guard import CONSEQUENCE, CRITERION, DERIVED, EARLY, RESTRICTIONS, SEDIMENT, restricted_sets
from sondage.operators.ranks import quantiles
from sondage.plans import plan
from sondage.session import table

VARS = ["l_linenumber", "l_returnflag", "l_linestatus"]
LONG = "lng AS (SELECT 'l_linenumber' AS variable, CAST(l_linenumber AS VARCHAR) AS level FROM lineitem UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem)"
GAPS = "gap AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS nat, CAST(c_acctbal < 4500 AS INTEGER) AS y FROM customer)"


def lines(spark, sf):
    return table(spark, sf, "lineitem")


def gaps(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(key % 7 != 0, F.col("c_mktsegment")).alias("seg"), F.when(key % 11 != 0, F.col("c_nationkey")).alias("nat"), (F.col("c_acctbal") < 4500).cast("int").alias("y")
    )


@plan("value_counts", f"WITH {LONG} SELECT variable, level, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY variable)::DOUBLE, 9) AS share FROM lng GROUP BY 1, 2")
def value_counts(spark, sf):
    return A.level_counts(lines(spark, sf), VARS).select("variable", "level", "n", F.round("share", 9).alias("share"))


@plan("modal_value", f"WITH {LONG}, c AS (SELECT variable, level, count(*) AS n FROM lng GROUP BY 1, 2) SELECT variable, level AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, level) AS rn FROM c) WHERE rn = 1")
def modal_value(spark, sf):
    return A.modes(lines(spark, sf), VARS).select("variable", "mode", "n")


MOSTLY = "SELECT * FROM lng UNION ALL SELECT 'mostly', CASE WHEN l_orderkey % 20 = 0 THEN 'other' ELSE 'same' END FROM lineitem"


@plan("near_constant", f"WITH {LONG}, c AS (SELECT variable, count(*) AS n FROM ({MOSTLY}) GROUP BY variable, level) SELECT variable, round(max(n) / sum(n)::DOUBLE, 9) AS share FROM c GROUP BY variable HAVING max(n) / sum(n)::DOUBLE >= 0.9")
def near_constant(spark, sf):
    """Variables of which one level has 90 % of the rows or more."""
    rows = lines(spark, sf).withColumn("mostly", F.when(F.col("l_orderkey") % 20 == 0, "other").otherwise("same"))
    return A.modes(rows, [*VARS, "mostly"]).where("share >= 0.9").select("variable", F.round("share", 9).alias("share"))


@plan("missingness", f"WITH {GAPS} SELECT 'seg' AS variable, count(*) FILTER (WHERE seg IS NULL) AS n_missing, count(*) AS n FROM gap UNION ALL SELECT 'nat', count(*) FILTER (WHERE nat IS NULL), count(*) FROM gap")
def missingness(spark, sf):
    return A.missingness(gaps(spark, sf), ["seg", "nat"])


@plan("crosstab", f"WITH {GAPS} SELECT coalesce(seg, '<missing>') AS seg, count(*) FILTER (WHERE y = 0) AS \"0\", count(*) FILTER (WHERE y = 1) AS \"1\" FROM gap GROUP BY 1")
def crosstab(spark, sf):
    return A.crosstab(gaps(spark, sf), "seg", "y", [0, 1])


@plan("pivot_mean", "SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS \"O\", round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS \"F\" FROM lineitem GROUP BY 1")
def pivot_mean(spark, sf):
    return lines(spark, sf).groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.round(F.avg("l_quantity"), 6))


@plan("functional_dependency", "SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS levels FROM orders GROUP BY 1")
def functional_dependency(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_orderstatus").alias("levels"))


@plan("duplicate_rows", "SELECT event_id AS line, first FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events) WHERE event_id <> first")
def duplicate_rows(spark, sf):
    return A.repeated_rows(table(spark, sf, "events").withColumnRenamed("event_id", "line"), ["user_id", "event_type"], "line")


@plan("stage_purity", f"WITH {GAPS} SELECT seg, count(*) AS n, round(avg(y), 9) AS outcome FROM gap GROUP BY seg")
def stage_purity(spark, sf):
    return gaps(spark, sf).groupBy("seg").agg(F.count("*").alias("n"), F.round(F.avg("y"), 9).alias("outcome"))


@plan("weighted_purity", f"WITH {GAPS}, p AS (SELECT seg, count(*) AS n, avg(y) AS p FROM gap GROUP BY seg) SELECT round(sum(n * greatest(p, 1 - p)) / sum(n), 9) AS purity FROM p")
def weighted_purity(spark, sf):
    return A.weighted_purity(gaps(spark, sf), "seg", "y").select(F.round("purity", 9).alias("purity"))


@plan("cramers_v", f"""WITH {GAPS}, c AS (SELECT seg AS a, nat AS b, count(*) AS o FROM gap WHERE seg IS NOT NULL AND nat IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY b), n AS (SELECT sum(o)::DOUBLE AS n FROM c),
  x AS (SELECT sum(power(coalesce(o, 0) - ra * cb / n, 2) / (ra * cb / n)) AS chi2, max(n) AS n, count(DISTINCT r.a)::DOUBLE AS r, count(DISTINCT k.b)::DOUBLE AS k FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b)
  SELECT round(chi2, 6) AS chi2, round(sqrt(greatest(0.0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / least(r - (r - 1) * (r - 1) / (n - 1) - 1, k - (k - 1) * (k - 1) / (n - 1) - 1)), 9) AS v FROM x""")
def cramers_v(spark, sf):
    return A.cramers_v(gaps(spark, sf), "seg", "nat").select(F.round("chi2", 6).alias("chi2"), F.round("v", 9).alias("v"))


@plan("clinical_rules", "SELECT 'low_balance' AS rule, c_custkey AS line FROM customer WHERE c_acctbal < -990 UNION ALL SELECT 'high_building', c_custkey FROM customer WHERE c_acctbal > 9900 AND c_mktsegment = 'BUILDING'")
def clinical_rules(spark, sf):
    """A row for each line that breaks a rule."""
    hits = F.array_compact(F.array(F.when(F.col("c_acctbal") < -990, "low_balance"), F.when((F.col("c_acctbal") > 9900) & (F.col("c_mktsegment") == "BUILDING"), "high_building")))
    return table(spark, sf, "customer").select(F.explode(hits).alias("rule"), F.col("c_custkey").alias("line"))


@plan("anomaly_peers", "WITH a AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal < -990) SELECT c_mktsegment, count(*) AS n FROM customer SEMI JOIN a USING (c_nationkey) GROUP BY 1")
def anomaly_peers(spark, sf):
    c = table(spark, sf, "customer")
    return c.join(c.where("c_acctbal < -990").select("c_nationkey"), "c_nationkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@plan("class_distribution", f"WITH {GAPS} SELECT count(*) AS n, sum(y)::BIGINT AS n_pos, round(avg(y), 9) AS share, round(greatest(avg(y), 1 - avg(y)) / least(avg(y), 1 - avg(y)), 9) AS imbalance, round(least(sum(y), count(*) - sum(y)) / 28.0, 9)::DOUBLE AS per_predictor FROM gap")
def class_distribution(spark, sf):
    y = F.avg("y")
    return gaps(spark, sf).agg(
        F.count("*").alias("n"), F.sum("y").alias("n_pos"), F.round(y, 9).alias("share"), F.round(F.greatest(y, 1 - y) / F.least(y, 1 - y), 9).alias("imbalance"),
        F.round(F.least(F.sum("y"), F.count("*") - F.sum("y")) / F.lit(28.0), 9).alias("per_predictor"),
    )


@plan("summary_items", f"WITH {GAPS} SELECT 'rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM gap UNION ALL SELECT 'positives', CAST(sum(y) AS VARCHAR) FROM gap UNION ALL SELECT 'segments', CAST(count(DISTINCT seg) AS VARCHAR) FROM gap")
def summary_items(spark, sf):
    one = gaps(spark, sf).agg(F.count("*").cast("string").alias("rows"), F.sum("y").cast("string").alias("positives"), F.countDistinct("seg").cast("string").alias("segments"))
    return one.unpivot([], ["rows", "positives", "segments"], "item", "value")


@plan("registry_summary", "SELECT r_name, count(*) AS n, count(*) FILTER (WHERE n_nationkey % 3 = 0) AS n_excluded, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def registry_summary(spark, sf):
    joined = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n"), F.count_if(F.col("n_nationkey") % 3 == 0).alias("n_excluded"), F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("names"))


ORDER = ["EUROPE", "ASIA", "NOWHERE", "AFRICA"]


@plan("leakage_taxonomy", "WITH o AS (SELECT unnest(range(1, 5)) AS pos, unnest(['EUROPE', 'ASIA', 'NOWHERE', 'AFRICA']) AS r_name) SELECT pos, r_name, string_agg(n_name, ', ' ORDER BY n_name) AS names, CASE WHEN bool_and(n_nationkey % 2 = 0) THEN 'excluded' WHEN bool_or(n_nationkey % 2 = 0) THEN 'partly' ELSE 'kept' END AS decision FROM o JOIN region USING (r_name) JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def leakage_taxonomy(spark, sf):
    order = spark.createDataFrame([(i, n) for i, n in enumerate(ORDER, 1)], "pos long, r_name string")
    joined = order.join(table(spark, sf, "region"), "r_name").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    even = F.col("n_nationkey") % 2 == 0
    decision = F.when(F.bool_and(even), "excluded").when(F.bool_or(even), "partly").otherwise("kept")
    return joined.groupBy("pos", "r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"), decision.alias("decision"))


@plan("registry_counts", "WITH o AS (SELECT unnest(range(1, 5)) AS pos, unnest(['EUROPE', 'ASIA', 'NOWHERE', 'AFRICA']) AS r_name) SELECT pos, r_name, count(*) AS n FROM o JOIN region USING (r_name) JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def registry_counts(spark, sf):
    order = spark.createDataFrame([(i, n) for i, n in enumerate(ORDER, 1)], "pos long, r_name string")
    return order.join(table(spark, sf, "region"), "r_name").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("pos", "r_name").agg(F.count("*").alias("n"))


@plan("ordered_reindex", "WITH o AS (SELECT unnest(range(1, 5)) AS pos, unnest(['EUROPE', 'ASIA', 'NOWHERE', 'AFRICA']) AS r_name) SELECT pos, o.r_name, coalesce(n, 0) AS n FROM o LEFT JOIN (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1) c USING (r_name)")
def ordered_reindex(spark, sf):
    order = spark.createDataFrame([(i, n) for i, n in enumerate(ORDER, 1)], "pos long, r_name string")
    counts = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    return order.join(counts, "r_name", "left").select("pos", "r_name", F.coalesce("n", F.lit(0)).alias("n"))


@plan("registry_lookup", "SELECT DISTINCT p_brand FROM part WHERE list_contains(string_split(p_name, ' '), string_split(p_type, ' ')[1]) OR p_size > 45")
def registry_lookup(spark, sf):
    hit = F.array_contains(F.split("p_name", " "), F.split("p_type", " ")[0]) | (F.col("p_size") > 45)
    return table(spark, sf, "part").where(hit).select("p_brand").distinct()


@plan("configuration_features", "SELECT DISTINCT p_brand, unnest(string_split(p_type, ' ')) AS feature FROM part")
def configuration_features(spark, sf):
    return table(spark, sf, "part").select("p_brand", F.explode(F.split("p_type", " ")).alias("feature")).distinct()


RULES = "CASE n_nationkey % 7 WHEN 0 THEN 'diagnostic_criterion_input' WHEN 1 THEN 'possible_criterion_sediment' WHEN 2 THEN 'consequence_of_advanced_disease' WHEN 3 THEN 'deterministic_outcome_derivative' ELSE 'legitimate_pre_index' END"


@plan("ten_restricted_sets", f"""WITH v AS (SELECT n_nationkey AS k, n_name AS f, {RULES} AS c, n_nationkey % 5 = 0 AS u, n_nationkey < 15 AS cheap FROM nation),
  s AS (SELECT k, f, cheap, unnest([{", ".join(f"'{r[0]}'" for r in RESTRICTIONS)}]) AS name, c, u FROM v)
  SELECT name, count(*) AS n, string_agg(f, ',' ORDER BY k) AS features FROM s WHERE CASE name WHEN 'full_valid (reference)' THEN true WHEN 'minus creatinine/eGFR information' THEN f <> 'NATION_0' AND c <> 'deterministic_outcome_derivative' WHEN 'minus albuminuria information' THEN f <> 'NATION_7'
    WHEN 'minus criterion inputs only (strict)' THEN c <> 'diagnostic_criterion_input' WHEN 'minus all incorporation-risk variables' THEN c NOT IN ('diagnostic_criterion_input', 'possible_criterion_sediment') WHEN 'minus consequences of advanced disease' THEN c <> 'consequence_of_advanced_disease'
    WHEN 'minus incorporation and consequences' THEN c NOT IN ('diagnostic_criterion_input', 'possible_criterion_sediment', 'consequence_of_advanced_disease') WHEN 'pre-index available only' THEN c = 'legitimate_pre_index'
    WHEN 'conservative pre-index (no uncertain)' THEN c = 'legitimate_pre_index' AND NOT u ELSE c = 'legitimate_pre_index' AND NOT u AND cheap END GROUP BY name""")
def ten_restricted_sets(spark, sf):
    k, name = F.col("n_nationkey"), F.col("n_name")
    category = F.when(k % 7 == 0, CRITERION).when(k % 7 == 1, SEDIMENT).when(k % 7 == 2, CONSEQUENCE).when(k % 7 == 3, DERIVED).otherwise(EARLY)
    limb = F.when(name == "NATION_0", "creatinine").when(name == "NATION_7", "albuminuria")
    return restricted_sets(table(spark, sf, "nation").select(k.alias("place"), name.alias("variable"), category.alias("category"), limb.alias("limb"), (k % 5 == 0).alias("uncertain"), (k < 15).alias("low_cost")))


@plan("restricted_feature_sets", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT f)), ',') AS features FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS f FROM part) WHERE f NOT IN (SELECT unnest(string_split(p_type, ' ')) FROM part WHERE p_size = 1 AND p_brand = 'Brand#11') GROUP BY p_brand")
def restricted_feature_sets(spark, sf):
    part = table(spark, sf, "part")
    barred = part.where("p_size = 1 AND p_brand = 'Brand#11'").select(F.explode(F.split("p_type", " ")).alias("f"))
    return part.select("p_brand", F.explode(F.split("p_type", " ")).alias("f")).join(barred, "f", "left_anti").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("features"))


#: The conditional counts of a table of studies: name, DuckDB condition.
STUDIES = [
    ("large", "p_size > 25"), ("small", "p_size < 10"), ("dear", "p_retailprice > 1000"), ("with_a", "p_name LIKE '%a%'"), ("two_words", "p_name LIKE '% %'"), ("brand_low", "p_brand < 'Brand#2'"), ("economy", "p_type LIKE 'ECONOMY%'"),
    ("even", "p_partkey % 2 = 0"), ("priced", "p_retailprice IS NOT NULL"), ("between", "p_size BETWEEN 10 AND 20"), ("cheap_and_large", "p_retailprice < 950 AND p_size > 25"), ("named", "length(p_name) > 10"),
]


@plan("prior_work_summary", "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in STUDIES) + ", round(median(p_retailprice), 6) AS median_price FROM part")
def prior_work_summary(spark, sf):
    part = table(spark, sf, "part")
    counts = part.agg(F.count("*").alias("n"), *[F.count_if(F.expr(c)).alias(n) for n, c in STUDIES])
    return counts.crossJoin(quantiles(part, [], "p_retailprice", [0.5], "q").select(F.round(F.col("q")[0], 6).alias("median_price")))  # a row each


@plan("hyperparam_frequency", "WITH c AS (SELECT l_returnflag AS model, CAST(l_linenumber AS VARCHAR) AS param, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT model, param AS mode, round(n / total::DOUBLE, 9) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY model) AS total, row_number() OVER (PARTITION BY model ORDER BY n DESC, param) AS rn FROM c) WHERE rn = 1")
def hyperparam_frequency(spark, sf):
    c = lines(spark, sf).groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").cast("string").alias("param")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("model")  # one row per setting
    ranked = c.withColumns({"total": F.sum("n").over(by), "rn": F.row_number().over(by.orderBy(F.desc("n"), "param"))})
    return ranked.where("rn = 1").select("model", F.col("param").alias("mode"), F.round(F.col("n") / F.col("total"), 9).alias("share"))


@plan("set_operations", "SELECT key, side FROM (SELECT c_nationkey AS key, 'both' AS side FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT c_nationkey, 'left' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier))")
def set_operations(spark, sf):
    c, s = table(spark, sf, "customer").select("c_nationkey"), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    side = lambda d, n: d.select(F.col("c_nationkey").alias("key"), F.lit(n).alias("side"))
    return side(c.intersect(s), "both").union(side(c.subtract(s), "left"))


@plan("union_all_misaligned", "SELECT c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def union_all_misaligned(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True).select("name", "segment", "balance")


@plan("distinct_on_subset", "SELECT c_mktsegment, c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2")
def distinct_on_subset(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))


@plan("head_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def head_n(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)


@plan("all_null_rows", f"WITH {GAPS} SELECT c_custkey FROM gap WHERE coalesce(seg, CAST(nat AS VARCHAR)) IS NULL")
def all_null_rows(spark, sf):
    return gaps(spark, sf).where(F.coalesce("seg", F.col("nat").cast("string")).isNull()).select("c_custkey")


@plan("semi_filter", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_filter(spark, sf):
    keep = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(keep, "o_custkey", "left_semi").agg(F.count("*").alias("n"))


@plan("anti_filter", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_filter(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@plan("boolean_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02 AND l_returnflag = 'R'")
def boolean_filter(spark, sf):
    return lines(spark, sf).where("l_quantity > 45 AND l_discount < 0.02 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber")


@plan("custom_domain_order", "WITH o AS (SELECT unnest(range(1, 4)) AS pos, unnest(['R', 'A', 'N']) AS flag) SELECT pos, flag, count(*) AS n FROM o JOIN lineitem ON flag = l_returnflag GROUP BY 1, 2")
def custom_domain_order(spark, sf):
    order = spark.createDataFrame([(1, "R"), (2, "A"), (3, "N")], "pos long, flag string")
    return lines(spark, sf).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n")).join(order, "flag").select("pos", "flag", "n")


@plan("scalar_json", "SELECT event_id, props->>'$.k' AS k FROM events")
def scalar_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
