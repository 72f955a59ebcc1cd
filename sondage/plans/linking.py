"""Queries that link customers, binned into intervals, with suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.functions import rng
from sondage.operators import linkage as L
from sondage.operators.guard import gated
from sondage.operators import resample as S
from sondage.operators.ranks import numbered, quantiles
from sondage.plans import plan
from sondage.plans.evaluation import auc_sql
from sondage.session import table
from sondage.sources.files import written

VARS = ["v1", "v2"]
LEFT = """lft AS (SELECT c_custkey AS i, c_nationkey % 3 AS o, CASE WHEN c_custkey % 10 IN (0, 1) THEN '-inf'::DOUBLE ELSE floor(c_acctbal / 500) * 500 END AS v1_lo,
  CASE WHEN c_custkey % 10 = 0 THEN 'inf'::DOUBLE ELSE floor(c_acctbal / 500) * 500 + 500 END AS v1_hi, (c_nationkey - 3)::DOUBLE AS v2_lo, (c_nationkey + 3)::DOUBLE AS v2_hi FROM customer)"""
RIGHT = "rgt AS (SELECT s_suppkey AS j, s_nationkey % 3 AS o, CASE WHEN s_suppkey % 15 <> 0 THEN s_acctbal END AS v1, s_nationkey::DOUBLE AS v2 FROM supplier)"
GAP = lambda v: f"CASE WHEN {v} IS NULL THEN 0.0 ELSE greatest({v}_lo - {v}, {v} - {v}_hi, 0.0) END"
BASE = f"WITH {LEFT}, {RIGHT}, gaps AS (SELECT i, j, {GAP('v1')} AS v1_gap, {GAP('v2')} AS v2_gap, lft.o = rgt.o AS same FROM lft, rgt)"
EDGES = f"{BASE}, edg AS (SELECT i, j FROM gaps WHERE same AND v1_gap <= 1e-9 AND v2_gap <= 1e-9)"
COUNTS = f"{EDGES}, cnt AS (SELECT lft.i, count(j) AS n FROM lft LEFT JOIN edg USING (i) GROUP BY 1)"
PINS = f"{EDGES}, pins AS (SELECT i, min(j) AS j FROM edg GROUP BY 1 HAVING count(*) = 1)"


def left(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey") % 10
    low = F.floor(F.col("c_acctbal") / 500) * 500
    return c.select(
        F.col("c_custkey").alias("i"), (F.col("c_nationkey") % 3).alias("o"), F.when(k.isin(0, 1), -L.INF).otherwise(low).alias("v1_lo"), F.when(k == 0, L.INF).otherwise(low + 500).alias("v1_hi"),
        (F.col("c_nationkey") - 3).cast("double").alias("v2_lo"), (F.col("c_nationkey") + 3).cast("double").alias("v2_hi"),
    )


def right(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("j"), (F.col("s_nationkey") % 3).alias("o"), F.when(F.col("s_suppkey") % 15 != 0, F.col("s_acctbal")).alias("v1"), F.col("s_nationkey").cast("double").alias("v2"))


def gaps(spark, sf, slack=L.EPS, outcome="o"):
    return L.pairs(left(spark, sf), right(spark, sf), VARS, outcome, slack, 500.0)


def edges(spark, sf):
    return L.edges(gaps(spark, sf), VARS)


def counted(spark, sf, variables=VARS, outcome="o", **more):
    """Compatible right rows of each distinct combination of the left side's intervals."""
    return L.compatible(left(spark, sf), right(spark, sf), variables, outcome, **more)


def pinned(spark, sf):
    return L.pins(left(spark, sf), right(spark, sf), VARS, "o")


BINS = "map AS (SELECT DISTINCT floor(c_acctbal / 500)::BIGINT::VARCHAR AS label, floor(c_acctbal / 500) * 500 AS lo, floor(c_acctbal / 500) * 500 + 500 AS hi FROM customer WHERE c_custkey % 3 <> 0)"


@plan("interval_bounds", f"WITH {BINS}, lab AS (SELECT c_custkey AS i, CASE WHEN c_custkey % 8 <> 0 THEN floor(c_acctbal / 500)::BIGINT::VARCHAR END AS label FROM customer) SELECT i, coalesce(lo, '-inf'::DOUBLE) AS lo, coalesce(hi, 'inf'::DOUBLE) AS hi FROM lab LEFT JOIN map USING (label)")
def interval_bounds(spark, sf):
    """Bounds of each label by the map of bins; a missing or unknown label covers everything."""
    c = table(spark, sf, "customer")
    low = F.floor(F.col("c_acctbal") / 500)
    bins = c.where("c_custkey % 3 != 0").select(low.cast("string").alias("label"), (low * 500).cast("double").alias("lo"), (low * 500 + 500).cast("double").alias("hi")).distinct()
    return L.interval_bounds(c.select(F.col("c_custkey").alias("i"), F.when(F.col("c_custkey") % 8 != 0, low.cast("string")).alias("label")), bins).select("i", "lo", "hi")


@plan("compatibility_edges", f"{EDGES} SELECT i, j FROM edg")
def compatibility_edges(spark, sf):
    return edges(spark, sf)


@plan("partner_stats", f"{COUNTS} SELECT count(*) FILTER (WHERE n > 0) AS with_partner, round(avg(n), 9) AS mean, median(n) AS median, max(n) AS most, max(n) = 1 AS one_to_one FROM cnt")
def partner_stats(spark, sf):
    return L.partner_stats(counted(spark, sf)).withColumn("mean", F.round("mean", 9))


@plan("unique_pins", f"{PINS} SELECT i, j FROM pins")
def unique_pins(spark, sf):
    return pinned(spark, sf)


@plan("leave_one_variable_out", f"{BASE} SELECT dropped, count(*) AS edges, count(DISTINCT i) AS matched FROM gaps, (SELECT unnest(['none', 'v1', 'v2']) AS dropped) WHERE same AND (dropped = 'v1' OR v1_gap <= 1e-9) AND (dropped = 'v2' OR v2_gap <= 1e-9) GROUP BY 1")
def leave_one_variable_out(spark, sf):
    arms = {"none": VARS, "v2": ["v1"], "v1": ["v2"]}
    one = lambda name: counted(spark, sf, arms[name]).agg(F.lit(name).alias("dropped"), *L.matched_in())
    return one("none").union(one("v2")).union(one("v1"))


TOLERANCES = [0.0, 1e-9, 1e-6, 1e-3, 1e-2]


@plan("tolerance_sensitivity", f"{BASE}, tl AS (SELECT tol, i, count(*) AS n FROM gaps, (SELECT unnest({TOLERANCES}) AS tol) WHERE same AND greatest(v1_gap, v2_gap) <= tol GROUP BY ALL) SELECT tol, sum(n)::BIGINT AS edges, count(*) AS matched, count(*) FILTER (WHERE n = 1) AS pins, round(sum(n) / (SELECT count(*) FROM lft)::DOUBLE, 9) AS mean_partners, max(n) AS most FROM tl GROUP BY tol")
def tolerance_sensitivity(spark, sf):
    return tolerances(spark, sf)


def tolerances(spark, sf):
    wide = left(spark, sf).withColumn("tol", F.explode(F.array(*map(F.lit, TOLERANCES))))
    n, every = F.col("n"), F.sum("times").alias("_all")
    found = L.compatible(wide, right(spark, sf), VARS, "o", slack=F.col("tol"), keep=["tol"])
    per = found.groupBy("tol").agg(*L.matched_in(), F.sum(F.when(n == 1, F.col("times")).otherwise(0)).alias("pins"), F.max("n").alias("most"), every).where("edges > 0")
    return per.select("tol", "edges", "matched", "pins", F.round(F.col("edges") / F.col("_all"), 9).alias("mean_partners"), "most")


def left_rows(spark, sf):
    return left(spark, sf).agg(F.count("*").alias("n"))


@plan("tolerance_match_fraction")
def tolerance_match_fraction(spark, sf):
    """The largest matching at each tolerance, as a share of the left rows, those with the intervals."""
    wide = left(spark, sf).withColumn("tol", F.explode(F.array(*map(F.lit, TOLERANCES))))
    sizes = L.matched(wide, right(spark, sf), VARS, "o", 500.0, slack=F.col("tol"), keep=["tol"]).groupBy("tol").agg(F.sum("matched").alias("matched"))
    steps = spark.createDataFrame([(t,) for t in TOLERANCES], "tol double")
    out = steps.join(sizes, "tol", "left").crossJoin(left_rows(spark, sf))
    return out.select("tol", F.coalesce("matched", F.lit(0)).alias("matched"), (F.coalesce("matched", F.lit(0)) / F.col("n")).alias("fraction"))


@plan("outcome_excluded", f"{BASE} SELECT count(*) AS edges FROM gaps WHERE v1_gap <= 1e-9 AND v2_gap <= 1e-9")
def outcome_excluded(spark, sf):
    return counted(spark, sf, outcome=None).agg(L.matched_in()[0])


@plan("bin_edge_forensics", f"""WITH {LEFT}, {RIGHT}, w AS (SELECT i, round(v1_lo) AS edge FROM lft WHERE isfinite(v1_lo) UNION SELECT -j, round(v1, 0) FROM rgt WHERE j % 4 = 0 AND v1 IS NOT NULL), e AS (SELECT DISTINCT edge FROM w), r AS (SELECT CASE WHEN j % 2 = 0 THEN round(v1, 0) ELSE v1 END AS v1 FROM rgt WHERE v1 IS NOT NULL),
  d AS (SELECT quantile_cont(v1, [{', '.join(str(k / 10) for k in range(1, 10))}]) AS q FROM r)
  SELECT edge, EXISTS (SELECT 1 FROM r WHERE abs(v1 - edge) <= 1e-9) AS seen, round(list_min(list_transform(q, lambda x: abs(x - edge))), 6) AS to_decile FROM e, d""")
def bin_edge_forensics(spark, sf):
    """Of each finite bin edge: whether a value lies on it (within 1e-9), and how far the nearest decile of the values is."""
    r = right(spark, sf).where("v1 IS NOT NULL").select("j", F.when(F.col("j") % 2 == 0, F.round("v1", 0)).otherwise(F.col("v1")).alias("v1"))
    some = right(spark, sf).where("v1 IS NOT NULL AND j % 4 = 0").select(F.round("v1", 0).alias("edge"))
    e = left(spark, sf).where(F.abs("v1_lo") != L.INF).select(F.round("v1_lo").alias("edge")).union(some).distinct()
    return L.edge_forensics(e, r, "v1")


@plan("classify_verdict", "WITH f AS (SELECT s_suppkey AS k, (s_suppkey % 21) / 20.0 AS f, 0.3::DOUBLE AS m, (s_suppkey % 4) / 50.0 AS s, s_suppkey % 17 = 0 AS same FROM supplier) SELECT k, CASE WHEN same THEN 'SAME-SOURCE' WHEN f >= m + 0.1 AND coalesce((f - m) / nullif(s, 0), 'inf'::DOUBLE) >= 5 THEN CASE WHEN f >= 0.95 THEN 'SAME-SOURCE' ELSE 'OVERLAPPING' END ELSE 'INDEPENDENT' END AS verdict FROM f")
def classify_verdict(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("k"), L.verdict((k % 21) / F.lit(20.0), F.lit(0.3), (k % 4) / F.lit(50.0), k % 17 == 0).alias("verdict"))


CAT = f"{PINS}, c AS (SELECT CASE WHEN j % 9 <> 0 THEN s_nationkey % 4 END AS cand, c_mktsegment AS intern, count(*) AS n FROM pins JOIN customer ON i = c_custkey JOIN supplier ON j = s_suppkey GROUP BY 1, 2), m AS (SELECT cand, intern, n, sum(n) OVER (PARTITION BY cand)::BIGINT AS total, row_number() OVER (PARTITION BY cand ORDER BY n DESC, intern) AS rn FROM c)"


@plan("categorical_agreement", f"{CAT} SELECT cand, intern AS majority, n, total - n AS contradictions FROM m WHERE rn = 1")
def categorical_agreement(spark, sf):
    return agreement(spark, sf).select("cand", "majority", "n", "contradictions")


def agreement(spark, sf):
    pins = pinned(spark, sf).join(table(spark, sf, "customer"), F.col("i") == F.col("c_custkey")).join(table(spark, sf, "supplier"), F.col("j") == F.col("s_suppkey"))
    counts = pins.groupBy(F.when(F.col("j") % 9 != 0, F.col("s_nationkey") % 4).alias("cand"), F.col("c_mktsegment").alias("majority")).agg(F.count("*").alias("n"))
    total = counts.groupBy(F.col("cand").alias("_c")).agg(F.sum("n").alias("total"))
    return L.majority(counts, "cand", "majority").join(total, F.col("cand").eqNullSafe(F.col("_c"))).withColumn("contradictions", F.col("total") - F.col("n"))


@plan("categorical_mapping", f"{CAT} SELECT coalesce(sum(total) FILTER (WHERE cand IS NULL), 0)::BIGINT AS missing, coalesce(sum(total - n) FILTER (WHERE cand IS NOT NULL), 0)::BIGINT AS contradictions, coalesce(string_agg(cand || '->' || intern, '; ' ORDER BY cand) FILTER (WHERE cand IS NOT NULL), '') AS mapping FROM m WHERE rn = 1")
def categorical_mapping(spark, sf):
    """Which internal value each candidate value stands for, as text, and what contradicts it or is missing."""
    a, known = agreement(spark, sf), F.col("cand").isNotNull()
    parts = F.transform(F.array_sort(F.collect_list(F.when(known, F.struct("cand", "majority")))), lambda s: F.concat(s["cand"].cast("string"), F.lit("->"), s["majority"]))  # one row per value
    total = lambda c, w: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0).cast("long"))
    return a.agg(total("total", ~known).alias("missing"), total("contradictions", known).alias("contradictions"), F.array_join(parts, "; ").alias("mapping"))


@plan("matched_pair_sample", f"{PINS} SELECT i, j, v1_lo, v1_hi, v1 FROM pins JOIN lft USING (i) JOIN rgt USING (j) ORDER BY md5('audit:' || i), i LIMIT 12")
def matched_pair_sample(spark, sf):
    picked = pinned(spark, sf).orderBy(rng.hashed("audit", F.col("i")), "i").limit(12)
    return picked.join(left(spark, sf).select("i", "v1_lo", "v1_hi"), "i").join(right(spark, sf).select("j", "v1"), "j")


@plan("held_out_crosscheck", f"{PINS} SELECT 'nation' AS variable, count(*) FILTER (WHERE c_nationkey = s_nationkey) AS agree, count(*) FILTER (WHERE c_nationkey <> s_nationkey) AS disagree FROM pins JOIN customer ON i = c_custkey JOIN supplier ON j = s_suppkey")
def held_out_crosscheck(spark, sf):
    pins = pinned(spark, sf).join(table(spark, sf, "customer"), F.col("i") == F.col("c_custkey")).join(table(spark, sf, "supplier"), F.col("j") == F.col("s_suppkey"))
    same = F.col("c_nationkey") == F.col("s_nationkey")
    return pins.agg(F.lit("nation").alias("variable"), F.count_if(same).alias("agree"), F.count_if(~same).alias("disagree"))


RECOVER = f"{PINS}, rec AS (SELECT lft.i, lft.o, lft.v1_lo, rgt.v1 AS value, CASE WHEN rgt.v1 IS NULL THEN 'imputed' ELSE 'observed' END AS provenance FROM pins JOIN lft USING (i) JOIN rgt USING (j))"


def recovered(spark, sf):
    out = pinned(spark, sf).join(left(spark, sf), "i").join(right(spark, sf).drop("o", "v2"), "j")
    return out.select("i", "o", "v1_lo", F.col("v1").alias("value"), F.when(F.col("v1").isNull(), "imputed").otherwise("observed").alias("provenance"))


@plan("recover", f"{RECOVER} SELECT i, value, provenance FROM rec")
def recover(spark, sf):
    return recovered(spark, sf).select("i", "value", "provenance")


@plan("recovery_coverage", f"{RECOVER} SELECT count(*) AS pinned, round(count(value) / (SELECT count(*) FROM lft)::DOUBLE, 9) AS coverage FROM rec")
def recovery_coverage(spark, sf):
    n = left(spark, sf).agg(F.count("*").alias("all"))
    return recovered(spark, sf).agg(F.count("*").alias("pinned"), F.count("value").alias("seen")).crossJoin(n).select("pinned", F.round(F.col("seen") / F.col("all"), 9).alias("coverage"))


BC = "bc AS (SELECT 'value' AS feature, CAST(c_acctbal > 3000 OR c_custkey % 5 = 0 AS INTEGER) AS y, c_acctbal AS p FROM customer UNION ALL SELECT 'binned', CAST(c_acctbal > 3000 OR c_custkey % 5 = 0 AS INTEGER), floor(c_acctbal / 2000) FROM customer)"


@plan("binning_cost", f"WITH {BC}, {auc_sql('bc', 'feature')} SELECT round(max(greatest(auc, 1 - auc)) FILTER (WHERE feature = 'value'), 9) AS continuous, round(max(greatest(auc, 1 - auc)) FILTER (WHERE feature = 'binned'), 9) AS binned FROM aucs")
def binning_cost(spark, sf):
    c = table(spark, sf, "customer")
    y = ((F.col("c_acctbal") > 3000) | (F.col("c_custkey") % 5 == 0)).cast("int")
    long = c.select(y.alias("y"), F.col("c_acctbal").alias("value"), F.floor(F.col("c_acctbal") / 2000).cast("double").alias("binned")).unpivot("y", ["value", "binned"], "feature", "x")
    auc = S.single_predictors(long).withColumn("auc", F.round(S.folded(F.col("auc")), 9))
    return auc.agg(F.max(F.when(F.col("feature") == "value", F.col("auc"))).alias("continuous"), F.max(F.when(F.col("feature") == "binned", F.col("auc"))).alias("binned"))


TWO = "two AS (SELECT c_mktsegment AS g, count(*) FILTER (WHERE c_acctbal > 0 AND c_nationkey < 12) AS a, count(*) FILTER (WHERE c_acctbal > 0 AND c_nationkey >= 12) AS b, count(*) FILTER (WHERE c_acctbal <= 0 AND c_nationkey < 12) AS c, count(*) FILTER (WHERE c_acctbal <= 0 AND c_nationkey >= 12) AS d FROM customer GROUP BY 1)"


def two_by_two(spark, sf):
    rich, low = F.col("c_acctbal") > 0, F.col("c_nationkey") < 12
    t = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("g"))
    return t.agg(F.count_if(rich & low).alias("a"), F.count_if(rich & ~low).alias("b"), F.count_if(~rich & low).alias("c"), F.count_if(~rich & ~low).alias("d"))


LABELLED = "lb AS (SELECT c_mktsegment AS g, CASE WHEN c_nationkey < 12 THEN c_nationkey % 5 END AS label FROM customer), lc AS (SELECT g, label, count(*) AS n FROM lb WHERE label IS NOT NULL GROUP BY ALL), lm AS (SELECT g, label AS mode, n / sum(n) OVER (PARTITION BY g)::DOUBLE AS share, row_number() OVER (PARTITION BY g ORDER BY n DESC, label) AS rn FROM lc)"


@plan("imputation_audit", f"WITH {TWO}, {LABELLED} SELECT g, a, b, c, d, round(a * d / nullif(b * c, 0)::DOUBLE, 9) AS odds_ratio, mode, round(share, 9) AS share FROM two JOIN lm USING (g) WHERE rn = 1")
def imputation_audit(spark, sf):
    """Of each group the label that missing rows were given most often and its share, the 2 x 2 counts and their odds ratio."""
    given = table(spark, sf, "customer").where("c_nationkey < 12").groupBy(F.col("c_mktsegment").alias("g"), (F.col("c_nationkey") % 5).alias("mode")).agg(F.count("*").alias("n"))
    total = given.groupBy("g").agg(F.sum("n").alias("_all"))
    mode = L.majority(given, "g", "mode").join(total, "g").select("g", "mode", F.round(F.col("n") / F.col("_all"), 9).alias("share"))
    return two_by_two(spark, sf).withColumn("odds_ratio", F.round(F.try_divide((F.col("a") * F.col("d")).cast("double"), F.col("b") * F.col("c")), 9)).join(mode, "g")


CHOOSE = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


@plan("fisher_exact", f"""WITH {TWO}, m AS (SELECT *, a + b + c + d AS n, a + b AS r, a + c AS k FROM two), x AS (SELECT *, unnest(range(greatest(0, k - (n - r)), least(r, k) + 1)) AS x FROM m),
  q AS (SELECT g, a, b, c, d, x, exp({CHOOSE('r', 'x')} + {CHOOSE('(n - r)', '(k - x)')} - {CHOOSE('n', 'k')}) AS q FROM x)
  SELECT g, a, b, c, d, round(least(1.0, sum(q) FILTER (WHERE q <= (SELECT s.q FROM q s WHERE s.g = q.g AND s.x = s.a) * (1 + 1e-7))), 9) AS p FROM q GROUP BY ALL""")
def fisher_exact(spark, sf):
    from sondage.session import ship

    ship(spark)
    return two_by_two(spark, sf).withColumn("p", F.round(F.pandas_udf(L.fisher, "double")("a", "b", "c", "d"), 9))


@plan("blood_pressure_audit", "SELECT o_orderpriority AS level, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(median(o_totalprice), 6) AS median FROM orders GROUP BY 1")
def blood_pressure_audit(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("level"), "o_totalprice")
    middle = quantiles(o, ["level"], "o_totalprice", [0.5], "q").select("level", F.round(F.col("q")[0], 6).alias("median"))
    return o.groupBy("level").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).join(middle, "level", "left")


def shuffled(spark, sf, draws):
    """The right side with each variable permuted in every draw."""
    # A small file is one task's, and so would all its draws be.
    r = right(spark, sf).repartition(L.TASKS, "j").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    out = numbered(r.select("draw", "j", "o").withColumn("_h", F.lpad(F.hex("j"), 16, "0")).withColumn("_k", F.substring(rng.hashed("place", F.col("j")), 1, 16)), ["draw"], "_k", "pos", ["j"], many=True)
    for v in VARS:
        col = numbered(r.select("draw", "j", v).withColumn("_h", rng.hashed("shuffle", v, F.col("draw"), F.col("j"))), ["draw"], "_h", "pos", ["j"], many=True)
        out = out.join(col.select("draw", "pos", v).hint("merge"), ["draw", "pos"])  # as many rows as out, however little they take compressed
    return out.select("draw", "j", "o", *VARS)


PERMUTATIONS, COPULA_DRAWS = 200, 200


@plan("null_exceedance", f"""WITH {LEFT}, {RIGHT}, pl AS (SELECT j, o, row_number() OVER (ORDER BY substr(md5('place:' || j), 1, 16), j) AS pos FROM rgt),
  sh AS (SELECT draw, pl.j, pl.o, a.v1, b.v2 FROM (SELECT unnest(range(0, {PERMUTATIONS})) AS draw), pl JOIN (SELECT d, v1, row_number() OVER (PARTITION BY d ORDER BY md5('shuffle:v1:' || d || ':' || j), j) AS pos FROM rgt, (SELECT unnest(range(0, {PERMUTATIONS})) AS d)) a ON a.pos = pl.pos
    JOIN (SELECT d, v2, row_number() OVER (PARTITION BY d ORDER BY md5('shuffle:v2:' || d || ':' || j), j) AS pos FROM rgt, (SELECT unnest(range(0, {PERMUTATIONS})) AS d)) b ON b.pos = pl.pos WHERE a.d = draw AND b.d = draw),
  e AS (SELECT draw, count(*) AS edges FROM lft JOIN sh ON lft.o = sh.o WHERE {GAP('v1')} <= 1e-9 AND {GAP('v2')} <= 1e-9 GROUP BY 1),
  d AS (SELECT draw, coalesce(edges, 0) AS edges FROM (SELECT unnest(range(0, {PERMUTATIONS})) AS draw) LEFT JOIN e USING (draw)),
  r AS (SELECT count(*) AS real FROM lft JOIN rgt ON lft.o = rgt.o WHERE {GAP('v1')} <= 1e-9 AND {GAP('v2')} <= 1e-9)
  SELECT real, count(*) FILTER (WHERE edges >= real) AS exceed, round((count(*) FILTER (WHERE edges >= real) + 1) / {PERMUTATIONS + 1}.0, 9)::DOUBLE AS p_bound FROM d, r GROUP BY real""")
def null_exceedance(spark, sf):
    return L.exceedance(left(spark, sf), right(spark, sf), shuffled(spark, sf, PERMUTATIONS), VARS, "o", PERMUTATIONS).withColumn("p_bound", F.round("p_bound", 9))


@plan("maximum_matching")
def maximum_matching_by_outcome(spark, sf):
    """The size of a largest matching of each outcome's left and right rows."""
    return L.matched(left(spark, sf), right(spark, sf), VARS, "o", 500.0).where("matched > 0")


SHUFFLES = 50


@plan("containment_check")
def containment_check(spark, sf):
    """The share of left rows that a largest matching pairs, and the same of shuffled right sides: mean, deviation and maximum."""
    drawn = shuffled(spark, sf, SHUFFLES).unionByName(right(spark, sf).withColumn("draw", F.lit(SHUFFLES)))  # the last draw is the real side
    per = matched_per_draw(spark, sf, drawn, SHUFFLES + 1).crossJoin(left_rows(spark, sf)).withColumn("f", F.col("matched") / F.col("n"))
    real, f = F.col("draw") == SHUFFLES, F.when(F.col("draw") < SHUFFLES, F.col("f"))
    return per.agg(
        F.max(F.when(real, F.col("matched"))).alias("matched"), F.max(F.when(real, F.col("f"))).alias("fraction"),
        F.avg(f).alias("null_mean"), F.stddev_samp(f).alias("null_sd"), F.max(f).alias("null_max"), F.count(f).alias("draws"),
    )


def matched_per_draw(spark, sf, rhs, draws):
    """(draw, matched) of the largest matchings of the left side with each draw's right side (draw, j, o, variables)."""
    sizes = L.matched(left(spark, sf), rhs, VARS, "o", 500.0, per=["draw"]).groupBy("draw").agg(F.sum("matched").alias("matched"))
    return spark.range(draws).select(F.col("id").alias("draw")).join(sizes, "draw", "left").select("draw", F.coalesce("matched", F.lit(0)).alias("matched"))


def copula(spark, sf, draws=None):
    r = right(spark, sf).withColumn("o", F.col("o").cast("long"))
    return written(L.copula_draws(r, "o", VARS, draws or COPULA_DRAWS), "copula")


@plan("containment_verdict")
def containment_verdict(spark, sf):
    """The verdict of the matched fraction and its null, as a gate reads it."""
    c = containment_check(spark, sf)
    return c.select("fraction", "null_mean", "null_sd", L.verdict(F.col("fraction"), F.col("null_mean"), F.col("null_sd"), F.lit(False)).alias("verdict"))


@plan("provenance_gate")
def provenance_gate(spark, sf):
    """The rows behind a gate that lets everything through but an OVERLAPPING source; with that it raises."""
    found = written(containment_verdict(spark, sf), "verdict")
    return gated(found, found.first()["verdict"])


@plan("copula_null")
def copula_null(spark, sf):
    null = copula(spark, sf)
    per = null.groupBy("draw").agg(F.round(F.corr("v1", "v2"), 6).alias("corr"))
    return per.join(matched_per_draw(spark, sf, null, COPULA_DRAWS), "draw").crossJoin(left_rows(spark, sf)).withColumn("fraction", F.col("matched") / F.col("n"))


@plan("copula_diagnostics")
def copula_diagnostics(spark, sf):
    """Medians, deviations, Spearman correlations of the real rows and of all draws, and drawn values that no row has."""
    real, null = right(spark, sf).withColumn("draw", F.lit(-1)), copula(spark, sf)
    both = real.select("draw", "j", *VARS).unionByName(null.select("draw", "j", *VARS)).withColumn("side", F.when(F.col("draw") < 0, "real").otherwise("null"))
    middle = quantiles(both, ["side"], "v1", [0.5], "m").select("side", F.col("m")[0].alias("median"))
    ranks = both.where("v1 IS NOT NULL AND v2 IS NOT NULL")
    for v in VARS:
        ranks = S.midranks(ranks, ["draw"], v, f"r_{v}")
    rho = ranks.groupBy("side", "draw").agg(F.corr("r_v1", "r_v2").alias("rho")).groupBy("side").agg(F.avg("rho").alias("spearman"))
    sd = both.groupBy("side").agg(F.stddev_samp("v1").alias("sd"))
    outside = null.join(real.select("v1").distinct(), "v1", "left_anti").where("v1 IS NOT NULL").agg(F.count("*").alias("off_support"))
    return middle.join(sd, "side").join(rho, "side").crossJoin(outside)


@plan("null_diagnostics_summary")
def null_diagnostics_summary(spark, sf):
    """Mean and greatest difference between the real and the drawn Spearman correlation over pairs of variables, and where."""
    real, null = right(spark, sf).withColumn("draw", F.lit(-1)), copula(spark, sf, 50)
    wide = lambda d: d.withColumn("v3", F.col("v1") % 1000).select("draw", "j", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(v).alias("x")) for v in ("v1", "v2", "v3")])).alias("s"))
    long = wide(real).unionByName(wide(null)).select("draw", "j", F.col("s.v").alias("v"), F.col("s.x").alias("x")).where("x IS NOT NULL")
    ranked = S.midranks(long, ["draw", "v"], "x", "r").select("draw", "j", "v", "r")
    other = ranked.select("draw", "j", F.col("v").alias("w"), F.col("r").alias("q"))
    rho = ranked.join(other.hint("merge"), ["draw", "j"]).where("v < w").groupBy("draw", F.concat_ws("-", "v", "w").alias("pair")).agg(F.corr("r", "q").alias("rho"))
    gap = rho.groupBy("pair").agg(F.abs(F.avg(F.when(F.col("draw") >= 0, F.col("rho"))) - F.max(F.when(F.col("draw") < 0, F.col("rho")))).alias("gap"))
    return gap.agg(F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), F.max_by("pair", "gap").alias("at"))


@plan("row_permutation_degeneracy", f"{EDGES}, r AS (SELECT count(*) AS edges, count(DISTINCT i) AS matched FROM edg) SELECT draw, edges, matched FROM r, (SELECT unnest(range(0, 20))::INTEGER AS draw)")
def row_permutation_degeneracy(spark, sf):
    """Edges after permuting whole rows: the same in every draw, so such a permutation is no null."""
    r = right(spark, sf).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19))))
    keys = numbered(r.select("draw", "j").withColumn("_h", rng.hashed("rows", F.col("draw"), F.col("j"))), ["draw"], "_h", "pos", ["j"], many=True).select("draw", "pos", F.col("j").alias("_new"))
    rows = numbered(r.withColumn("_k", F.lpad(F.hex("j"), 16, "0")), ["draw"], "_k", "pos", ["j"], many=True)
    moved = rows.join(keys, ["draw", "pos"]).select("draw", F.col("_new").alias("j"), "o", *VARS)
    found = L.compatible(left(spark, sf), moved, VARS, "o", per=["draw"])
    return found.groupBy("draw").agg(*L.matched_in())
