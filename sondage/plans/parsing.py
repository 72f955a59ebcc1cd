"""Queries over interval labels, vocabularies and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.functions import labels as L
from sondage.functions.normal import cdf_sql, norm_cdf, norm_ppf, ppf_sql
from sondage.functions import rng
from sondage.operators import encode
from sondage.plans import plan
from sondage.session import table

#: Customers' keys and balances as interval labels in all their spellings, with missing tokens and errors between them.
CELLS = r"""cells AS (SELECT c_custkey AS line, CASE c_custkey % 10
  WHEN 0 THEN chr(160) || '< ' || (c_custkey % 50) WHEN 1 THEN (c_custkey % 50) || ' - ' || (c_custkey % 50 + 12)
  WHEN 2 THEN '≥ ' || (c_custkey % 50) || '.5' WHEN 3 THEN (c_custkey % 50 + 7) || ' – ' || (c_custkey % 50)
  WHEN 4 THEN ' p ' WHEN 5 THEN '?' WHEN 6 THEN '-' || (c_custkey % 50) || '  ' WHEN 7 THEN '⩽' || (c_custkey % 50)
  WHEN 8 THEN (c_custkey % 28 + 1) || '-' || CASE c_custkey % 3 WHEN 0 THEN 'Jan' WHEN 1 THEN 'Dec' ELSE 'Foo' END
  ELSE '> ' || (c_custkey % 50) END AS label,
  CASE c_custkey % 6 WHEN 0 THEN 's1' WHEN 1 THEN 's3' WHEN 2 THEN 's5' WHEN 3 THEN NULL WHEN 4 THEN 's2' ELSE 's4' END AS stage,
  CAST(c_acctbal < 4500 AS INTEGER) AS y, c_nationkey AS grp FROM customer)"""

NORM = r"trim(regexp_replace(replace(replace(replace(replace(label, '≥', '>='), '⩾', '>='), '≤', '<='), '⩽', '<='), '[\s' || chr(160) || ']+', ' ', 'g'))"
NUM = r"[+-]?\d+(?:\.\d+)?"
RNG = rf"^({NUM})\s*[-–—]\s*({NUM})$"
REST = r"TRY_CAST(trim(regexp_replace(t, '^[<>]=?', '')) AS DOUBLE)"


def parsed(text: str, swap: bool) -> str:
    lo, hi = (f"CAST(regexp_extract(t, '{RNG}', {k}) AS DOUBLE)" for k in (1, 2))
    a, b = (f"least({lo}, {hi})", f"greatest({lo}, {hi})") if swap else (lo, hi)
    case = lambda r, g, l, n: f"CASE WHEN regexp_matches(t, '{RNG}') THEN {r} WHEN t LIKE '>%' AND {REST} IS NOT NULL THEN {g} WHEN t LIKE '<%' AND {REST} IS NOT NULL THEN {l} WHEN regexp_matches(t, '^{NUM}$') THEN {n} END"  # noqa: E731, E741
    n = "TRY_CAST(t AS DOUBLE)"
    return (
        f"parsed AS (SELECT *, {case(a, REST, chr(39) + '-inf' + chr(39) + '::DOUBLE', n)} AS lower, {case(b, chr(39) + 'inf' + chr(39) + '::DOUBLE', REST, n)} AS upper, "
        f"{case(f'({a} + {b}) / 2.0::DOUBLE', REST, REST, n)} AS rep FROM (SELECT *, {text} AS t FROM cells))"
    )


BIN = f"WITH {CELLS}, {parsed(NORM, True)}"
MISSING = "lower(t) IN ('', 'p', '?', 'na', 'nan', 'null', '-')"


def cells(spark, sf):
    c = table(spark, sf, "customer")
    key, small = F.col("c_custkey"), (F.col("c_custkey") % 50)
    s = lambda x: x.cast("string")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else s(x) for x in xs])
    month = F.when(key % 3 == 0, "Jan").when(key % 3 == 1, "Dec").otherwise("Foo")
    label = (
        F.when(key % 10 == 0, cat(" < ", small)).when(key % 10 == 1, cat(small, " - ", small + 12)).when(key % 10 == 2, cat("≥ ", small, ".5"))
        .when(key % 10 == 3, cat(small + 7, " – ", small)).when(key % 10 == 4, F.lit(" p ")).when(key % 10 == 5, F.lit("?")).when(key % 10 == 6, cat("-", small, "  "))
        .when(key % 10 == 7, cat("⩽", small)).when(key % 10 == 8, cat(key % 28 + 1, "-", month)).otherwise(cat("> ", small))
    )
    stage = F.when(key % 6 == 0, "s1").when(key % 6 == 1, "s3").when(key % 6 == 2, "s5").when(key % 6 == 4, "s2").when(key % 6 == 5, "s4")
    return c.select(key.alias("line"), label.alias("label"), stage.alias("stage"), (F.col("c_acctbal") < 4500).cast("int").alias("y"), F.col("c_nationkey").alias("grp"))


@plan("normalise_label", f"WITH {CELLS} SELECT line, {NORM} AS norm FROM cells")
def normalise_label(spark, sf):
    return cells(spark, sf).select("line", L.normalise_label(F.col("label")).alias("norm"))


@plan("parse_bin", f"{BIN} SELECT line, lower, upper, rep FROM parsed")
def parse_bin(spark, sf):
    return cells(spark, sf).withColumn("b", L.parse_bin(F.col("label"))).select("line", "b.lower", "b.upper", "b.rep")


@plan("is_bin_label", f"{BIN} SELECT line, rep IS NOT NULL AS is_bin, {MISSING} AS is_missing FROM parsed")
def is_bin_label(spark, sf):
    return cells(spark, sf).select("line", L.parse_bin(F.col("label")).isNotNull().alias("is_bin"), L.is_missing(F.col("label")).alias("is_missing"))


EXCEL = r"""CASE WHEN regexp_matches(trim(label), '^\s*(\d+)\s*-\s*([A-Za-z]{3})\s*$') AND lower(regexp_extract(trim(label), '([A-Za-z]{3})', 1)) IN ('jan', 'dec')
  THEN CASE lower(regexp_extract(trim(label), '([A-Za-z]{3})', 1)) WHEN 'jan' THEN '1' ELSE '12' END || ' - ' || CAST(regexp_extract(trim(label), '(\d+)', 1) AS INTEGER) ELSE trim(label) END"""


@plan("undo_excel_date", f"WITH {CELLS} SELECT line, {EXCEL} AS undone FROM cells")
def undo_excel_date(spark, sf):
    return cells(spark, sf).select("line", L.undo_excel_date(F.regexp_replace("label", r"^[\s\u00a0]+|[\s\u00a0]+$", "")).alias("undone"))


@plan("parse_interval", f"WITH raw AS (WITH {CELLS} SELECT line, {EXCEL} AS label FROM cells), cells AS (SELECT * FROM raw WHERE label NOT IN ('', '?')), {parsed(NORM, False)} SELECT raw.line, lower, upper FROM raw LEFT JOIN parsed USING (line)")
def parse_interval(spark, sf):
    return cells(spark, sf).withColumn("b", L.parse_interval(F.col("label"))).select("line", "b.lower", "b.upper")


@plan("stage_ordinal", f"WITH {CELLS} SELECT line, CASE stage WHEN 's1' THEN 1.0::DOUBLE WHEN 's2' THEN 2.0 WHEN 's3' THEN 3.0 WHEN 's4' THEN 4.0 WHEN 's5' THEN 5.0 END AS ordinal, CASE WHEN y = 1 THEN 'pos' ELSE 'neg' END AS target FROM cells")
def stage_ordinal(spark, sf):
    return cells(spark, sf).select("line", L.stage_ordinal(F.col("stage")).alias("ordinal"), F.when(F.col("y") == 1, "pos").otherwise("neg").alias("target"))


@plan("to_numeric_coerce", f"WITH {CELLS} SELECT line, TRY_CAST(trim(label) AS DOUBLE) AS x FROM cells")
def to_numeric_coerce(spark, sf):
    return cells(spark, sf).select("line", L.number(F.col("label")).alias("x"))


@plan("strip_label", r"WITH t AS (SELECT c_custkey AS line, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || chr(9) ELSE c_mktsegment END AS label FROM customer) SELECT line, regexp_replace(regexp_replace(label, '^\s+', ''), '\s+$', '') AS label, regexp_replace(regexp_replace(label, '^\s+', ''), '\s+$', '') <> label AS defect FROM t")
def strip_label(spark, sf):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit("\t"))).otherwise(F.col("c_mktsegment"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("line"), L.strip_label(raw).alias("label"), (L.strip_label(raw) != raw).alias("defect"))


TOKENS = list(L.DIPSTICK)
DIP = "CASE " + " ".join(f"WHEN s = '{k}' THEN {v}::DOUBLE" for k, v in L.DIPSTICK.items()) + " END"


@plan("dipstick_map", "WITH t AS (SELECT l_orderkey, l_linenumber, lower(trim(v)) AS s FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 25 = 24 THEN ' Unknown' ELSE ' ' || upper([" + ", ".join(f"'{t}'" for t in TOKENS) + f"][l_partkey % 24 + 1]) END AS v FROM lineitem)) SELECT l_orderkey, l_linenumber, s, {DIP} AS level FROM t")
def dipstick_map(spark, sf):
    token = F.upper(F.element_at(F.array(*map(F.lit, TOKENS)), (F.col("l_partkey") % 24 + 1).cast("int")))
    raw = F.when(F.col("l_partkey") % 25 == 24, " Unknown").otherwise(F.concat(F.lit(" "), token))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lower(F.trim(raw)).alias("s"), L.lookup(L.DIPSTICK, raw).alias("level"))


@plan("unit_scale", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 2 THEN l_quantity * 1000.0::DOUBLE ELSE l_quantity END AS scaled FROM lineitem")
def unit_scale(spark, sf):
    scaled = F.when(F.col("l_linenumber") == 2, F.col("l_quantity") * 1000.0).otherwise(F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scaled.alias("scaled"))


@plan("normalise_categorical", "WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Yes' || chr(9) WHEN 1 THEN ' no' WHEN 2 THEN 'Abnormal' WHEN 3 THEN '3.5' WHEN 4 THEN '?' ELSE 'good' END AS v FROM orders) SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 3.5 WHEN 5 THEN 0.0 END AS x FROM t")
def normalise_categorical(spark, sf):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "Yes\t").when(k == 1, " no").when(k == 2, "Abnormal").when(k == 3, "3.5").when(k == 4, "?").otherwise("good")
    return table(spark, sf, "orders").select("o_orderkey", L.normalise_category(raw).alias("x"))


@plan("deterministic_dataset_seed", "SELECT n_nationkey, CAST(CAST('0x' || substr(sha256('20240601:' || n_name), 1, 8) AS BIGINT) % 2147483647 AS BIGINT) AS seed FROM nation")
def deterministic_dataset_seed(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", rng.dataset_seed(20240601, F.col("n_name")).alias("seed"))


@plan("fold_seed", "SELECT n_nationkey, CAST((20240601 * 1000003::BIGINT + n_nationkey * 10007 + n_regionkey * 101 + 7) % 2147483647 AS BIGINT) AS seed FROM nation")
def fold_seed(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", rng.fold_seed(F.lit(20240601), F.col("n_nationkey"), F.col("n_regionkey"), F.lit(7)).alias("seed"))


BINMAP = f"{BIN}, bins AS (SELECT DISTINCT grp % 3 AS col, t AS label, lower, upper, rep FROM parsed WHERE rep IS NOT NULL), bin_map AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY rep, label) - 1 AS pos, count(*) OVER (PARTITION BY col) AS n FROM bins)"


def bin_cells(spark, sf):
    return cells(spark, sf).select("line", "y", (F.col("grp") % 3).alias("col"), L.normalise_label(F.col("label")).alias("label"), F.col("label").alias("raw"))


@plan("build_bin_map", f"{BINMAP} SELECT col, label, lower, upper, rep, CAST(pos AS BIGINT) AS pos FROM bin_map")
def build_bin_map(spark, sf):
    return encode.bin_map(bin_cells(spark, sf)).select("col", "label", "lower", "upper", "rep", "pos")


@plan("cell_issues", f"{BIN} SELECT line, label AS raw, CASE WHEN {MISSING} THEN 'missing' ELSE 'unparsed' END AS reason FROM parsed WHERE rep IS NULL")
def cell_issues(spark, sf):
    return encode.cell_issues(bin_cells(spark, sf))


@plan("enc_midpoint", f"{BIN} SELECT line, rep AS x FROM parsed")
def enc_midpoint(spark, sf):
    c = bin_cells(spark, sf)
    return encode.encoded(c, encode.bin_map(c), "midpoint").select("line", "x")


@plan("enc_bin_index", f"{BINMAP} SELECT line, CAST(pos AS DOUBLE) AS x FROM parsed LEFT JOIN bin_map ON grp % 3 = col AND t = bin_map.label")
def enc_bin_index(spark, sf):
    c = bin_cells(spark, sf)
    return encode.encoded(c, encode.bin_map(c), "index").select("line", "x")


@plan("enc_rank_normal", f"{BINMAP}, sized AS (SELECT *, (pos + 0.5::DOUBLE) / count(*) OVER (PARTITION BY col) AS u FROM bin_map) SELECT line, round({ppf_sql('u')}, 9) AS x FROM parsed LEFT JOIN sized ON grp % 3 = col AND t = sized.label")
def enc_rank_normal(spark, sf):
    c = bin_cells(spark, sf)
    return encode.encoded(c, encode.bin_map(c), "rank_normal").select("line", F.round("x", 9).alias("x"))


UNIT = "u AS (SELECT p_partkey, (p_partkey % 999 + 0.5::DOUBLE) / 999 AS p FROM part)"


@plan("normal_scores", f"WITH {UNIT}, z AS (SELECT *, {ppf_sql('p')} AS z FROM u) SELECT p_partkey, round(z, 9) AS z, round({cdf_sql('z')}, 9) AS p FROM z")
def normal_scores(spark, sf):
    """Normal quantiles of a share, and the share below each."""
    z = norm_ppf((F.col("p_partkey") % 999 + F.lit(0.5)) / F.lit(999.0))
    return table(spark, sf, "part").select("p_partkey", z.alias("z")).select("p_partkey", F.round("z", 9).alias("z"), F.round(norm_cdf(F.col("z")), 9).alias("p"))


@plan("date_parse", "SELECT o_orderkey, try_strptime(t, '%Y-%m-%dT%H:%M:%S') AS stamp FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS t FROM orders)")
def date_parse(spark, sf):
    """ISO timestamps from text; what is none becomes null."""
    k = F.col("o_orderkey")
    text = F.when(k % 7 == 0, "unknown").when(k % 11 == 0, None).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf, "orders").select("o_orderkey", F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("stamp"))


@plan("enc_onehot", "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_mktsegment = '{s}' AS INTEGER) END AS seg__{s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "MACHINERY")) + " FROM customer")
def enc_onehot(spark, sf):
    c = table(spark, sf, "customer").withColumn("seg", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")))
    return encode.onehot(c, "seg", ["AUTOMOBILE", "BUILDING", "MACHINERY"]).select("c_custkey", "seg__automobile", "seg__building", "seg__machinery")


@plan("encoded_feature_names", f"{BINMAP} SELECT 'v' || col || '__' || label AS name FROM bin_map")
def encoded_feature_names(spark, sf):
    return encode.bin_map(bin_cells(spark, sf)).select(F.concat(F.lit("v"), F.col("col").cast("string"), F.lit("__"), F.col("label")).alias("name"))


@plan("bin_monotonicity", f"{BINMAP}, nxt AS (SELECT *, lead(lower) OVER w AS nl, lead(upper) OVER w AS nu, lead(rep) OVER w AS nr FROM bin_map WINDOW w AS (PARTITION BY col ORDER BY pos)) SELECT col, count(*) AS n_bins, CAST(count(*) FILTER (WHERE nr = rep) AS BIGINT) AS ties, CAST(count(*) FILTER (WHERE nr < rep) AS BIGINT) AS inversions, CAST(count(*) FILTER (WHERE upper > nl AND isfinite(upper) AND isfinite(nl)) AS BIGINT) AS overlaps FROM nxt GROUP BY col HAVING count(*) >= 2")
def bin_monotonicity(spark, sf):
    return encode.monotonicity(encode.bin_map(bin_cells(spark, sf)))


@plan("bin_structure", f"{BIN} SELECT t AS label, count(*) AS n, min(line) AS lo, max(line) AS hi, max(line) - min(line) AS span, round(avg(y), 6) AS outcome FROM parsed WHERE rep IS NOT NULL GROUP BY t")
def bin_structure(spark, sf):
    c = bin_cells(spark, sf).where(L.parse_bin(F.col("raw")).isNotNull())
    return c.groupBy("label").agg(F.count("*").alias("n"), F.min("line").alias("lo"), F.max("line").alias("hi"), (F.max("line") - F.min("line")).alias("span"), F.round(F.avg("y"), 6).alias("outcome"))
