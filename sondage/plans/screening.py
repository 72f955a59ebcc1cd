"""Queries that screen text, read and write files, and format reports."""

from __future__ import annotations

import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from sondage.functions import text as X
from sondage.plans import plan
from sondage.session import table
from sondage.sources import files as S

STRIP = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')"


@plan("decode_html", f"SELECT page_id, {STRIP} AS text FROM pages")
def decode_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


TERMS = {"the": "article", "login": "form", "der ": "german", "no such words": "never"}
TERM_SQL = "terms AS (SELECT unnest(['the', 'login', 'der ', 'no such words']) AS term, unnest(['article', 'form', 'german', 'never']) AS meaning)"


@plan("term_scan", f"""WITH flat AS (SELECT page_id, {STRIP} AS t FROM pages), {TERM_SQL}, hit AS (SELECT page_id, term, meaning, strpos(lower(t), term) AS pos, t FROM flat, terms WHERE contains(lower(t), term))
  SELECT page_id, term, meaning, trim(substr(t, greatest(0, pos - 1 - 20) + 1, least(len(t), pos - 1 + 20) - greatest(0, pos - 1 - 20)), ' ') AS quote FROM hit
  UNION ALL SELECT page_id, '', '', '' FROM flat WHERE page_id NOT IN (SELECT page_id FROM hit)""")
def term_scan(spark, sf):
    flat = table(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("t"))
    # A fixed dictionary: matched row by row, without a join.
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(m).alias("meaning")) for t, m in TERMS.items()])
    low = F.lower("t")
    hits = F.filter(terms, lambda x: F.contains(low, x["term"]))
    none = F.array(F.struct(F.lit("").alias("term"), F.lit("").alias("meaning")))
    out = flat.withColumn("h", F.explode(F.when(F.size(hits) > 0, hits).otherwise(none)))
    quote = F.when(F.col("h.term") == "", "").otherwise(X.sentence_around(F.col("t"), F.expr("locate(h.term, lower(t))"), 40))
    return out.select("page_id", "h.term", "h.meaning", quote.alias("quote"))


@plan("verdict_classifier", "WITH d AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, CASE WHEN a AND b AND c THEN 'explicit_link' WHEN a AND b THEN 'mentions_both' WHEN a THEN 'mentions_only' ELSE 'no_match' END AS verdict FROM (SELECT doc_id, contains(t, 'token') OR contains(t, 'password') AS a, contains(t, 'the') OR contains(t, 'der') AS b, contains(t, '@') OR contains(t, '###') AS c FROM d)")
def verdict_classifier(spark, sf):
    low = F.lower("text")
    a, b, c = X.any_of(low, ["token", "password"]), X.any_of(low, ["the", "der"]), X.any_of(low, ["@", "###"])
    verdict = F.when(a & b & c, "explicit_link").when(a & b, "mentions_both").when(a, "mentions_only").otherwise("no_match")
    return table(spark, sf, "documents").select("doc_id", verdict.alias("verdict"))


@plan("release_class", "WITH d AS (SELECT conv_id, turn, lower(text) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN m AND (a OR b) THEN 'merged' WHEN a AND b THEN 'both' WHEN a THEN 'first' WHEN b THEN 'second' ELSE 'unclear' END AS release FROM (SELECT conv_id, turn, contains(t, 'tion') AS a, contains(t, 'ing') AS b, contains(t, 'with') AS m FROM d)")
def release_class(spark, sf):
    low = F.lower("text")
    a, b, m = low.contains("tion"), low.contains("ing"), low.contains("with")
    release = F.when(m & (a | b), "merged").when(a & b, "both").when(a, "first").when(b, "second").otherwise("unclear")
    return table(spark, sf, "conversations").select("conv_id", "turn", release.alias("release"))


@plan("max_percent_in_text", r"WITH t AS (SELECT o_orderkey, 'scores ' || (o_orderkey % 100) || '.5% and ' || (o_custkey % 90 + 10) || ' % of 7%' AS s FROM orders) SELECT o_orderkey, list_max(list_filter(list_transform(regexp_extract_all(s, '(\d{2}\.?\d*)\s*%', 1), lambda x: CAST(x AS DOUBLE)), lambda x: x BETWEEN 50 AND 100)) AS best FROM t")
def max_percent_in_text(spark, sf):
    s = F.concat(F.lit("scores "), (F.col("o_orderkey") % 100).cast("string"), F.lit(".5% and "), (F.col("o_custkey") % 90 + 10).cast("string"), F.lit(" % of 7%"))
    return table(spark, sf, "orders").withColumn("s", s).select("o_orderkey", X.largest_percent(F.col("s")).alias("best"))


@plan("inverted_index_text", "SELECT item_id, array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ') AS text FROM benchmark")
def inverted_index_text(spark, sf):
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("pos", "word"))
    index = words.groupBy("item_id", "word").agg(F.collect_list("pos").alias("positions"))  # word -> positions
    back = index.select("item_id", "word", F.explode("positions").alias("pos")).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    joined = back.select("item_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))
    return table(spark, sf, "benchmark").select("item_id").join(joined, "item_id", "left").select("item_id", F.coalesce("text", F.lit("")).alias("text"))


@plan("marker_block", r"WITH p AS (SELECT page_id, strpos(html, '<title>') AS a, strpos(html, '</title>') AS b, html FROM pages) SELECT page_id, trim(regexp_replace(substr(html, a + 7, b - a - 7), '\s+', ' ', 'g'), ' ') AS block FROM p WHERE a > 0 AND b > a")
def marker_block(spark, sf):
    p = table(spark, sf, "pages").withColumns({"a": F.locate("<title>", "html"), "b": F.locate("</title>", "html")}).where("a > 0 AND b > a")
    return p.select("page_id", F.trim(F.regexp_replace(F.col("html").substr(F.col("a") + 7, F.col("b") - F.col("a") - 7), r"\s+", " ")).alias("block"))


@plan("latex_escape", r"SELECT p_partkey, replace(replace(replace(replace(replace(p_brand || '_' || p_size || '% & $#', '&', '\&'), '%', '\%'), '_', '\_'), '#', '\#'), '$', '\$') AS x FROM part")
def latex_escape(spark, sf):
    s = F.concat("p_brand", F.lit("_"), F.col("p_size").cast("string"), F.lit("% & $#"))
    return table(spark, sf, "part").select("p_partkey", X.latex_escape(s).alias("x"))


@plan("format_ci", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE format('{:.3f}', round(p_retailprice / 7, 3)) END AS shown FROM part")
def format_ci(spark, sf):
    v = F.when(F.col("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice") / 7)
    return table(spark, sf, "part").select("p_partkey", X.shown(v).alias("shown"))


NATION = ["n_nationkey", "n_name", "n_regionkey"]


def nation_csv(spark, sf):
    path = S.scratch(spark, "nation")
    n = table(spark, sf, "nation").select(*NATION)
    n.orderBy("n_nationkey").coalesce(1).write.option("header", True).csv(path)
    return path


@plan("csv_scan_strict", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_scan_strict(spark, sf):
    return S.read_strict(spark, nation_csv(spark, sf), NATION)


@plan("csv_scan_typed", "SELECT n_nationkey, n_regionkey FROM nation")
def csv_scan_typed(spark, sf):
    return S.read_typed(spark, nation_csv(spark, sf), "n_nationkey int, n_name string, n_regionkey int", ["n_nationkey", "n_regionkey"])


@plan("csv_scan_nafilter_off", "SELECT n_nationkey::VARCHAR AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'None' ELSE '' END AS v FROM nation")
def csv_scan_nafilter_off(spark, sf):
    path = S.scratch(spark, "none")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, "None").otherwise("").alias("v")).write.option("header", True).csv(path)
    return S.read_strict(spark, path, ["k", "v"])


@plan("metadata_row_split", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS BIGINT) AS line, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation QUALIFY row_number() OVER (ORDER BY n_nationkey) > 2")
def metadata_row_split(spark, sf):
    _, records = S.split_metadata(S.numbered_lines(spark, nation_csv(spark, sf)), 2, NATION)
    return records.select("line", "n_nationkey", "n_name")


@plan("metadata_row_verify", "SELECT array_to_string(list_sort(list(DISTINCT n_name)), ',') AS names, bool_or(n_name = 'NATION_01' OR n_nationkey = 1) AS has_second FROM nation WHERE n_nationkey < 2")
def metadata_row_verify(spark, sf):
    meta, _ = S.split_metadata(S.numbered_lines(spark, nation_csv(spark, sf)), 2, NATION)
    return meta.agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"), F.bool_or(F.col("n_nationkey") == "1").alias("has_second"))


@plan("json_scan", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_scan(spark, sf):
    path = S.scratch(spark, "json")
    table(spark, sf, "nation").select("n_nationkey", "n_name").write.json(path)
    return spark.read.schema("n_nationkey long, n_name string").json(path)


@plan("sinks_round_trip", "SELECT source, count(*) AS n, sum(r_regionkey)::BIGINT AS keys FROM region, (SELECT unnest(['csv', 'csv_gz', 'json']) AS source) GROUP BY 1")
def sinks_round_trip(spark, sf):
    path = S.scratch(spark, "sinks")
    S.write_all(table(spark, sf, "region"), path)
    schema, out = "r_regionkey long, r_name string", None
    for kind in ("csv", "csv_gz", "json"):
        back = spark.read.schema(schema).json(f"{path}/json") if kind == "json" else S.read_typed(spark, f"{path}/{kind}", schema)
        one = back.agg(F.lit(kind).alias("source"), F.count("*").alias("n"), F.sum("r_regionkey").alias("keys"))
        out = one if out is None else out.union(one)
    return out


NATION_TEXT = "(SELECT string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS c FROM nation)"
CHECKSUM = f"SELECT 'nation.txt' AS file, strlen(c)::BIGINT AS length, sha256(c) AS sha256 FROM {NATION_TEXT}"


def nation_text(spark, sf):
    """A folder with one file, and its bytes."""
    rows = sorted(tuple(r) for r in table(spark, sf, "nation").select("n_nationkey", "n_name").collect())  # 25 rows
    path, data = S.scratch(spark, "files"), "\n".join(f"{k},{n}" for k, n in rows).encode()
    S.put(spark, f"{path}/nation.txt", data)
    return path, data


@plan("file_checksum", CHECKSUM)
def file_checksum(spark, sf):
    return S.checksums(spark, nation_text(spark, sf)[0])


@plan("checksum_gate", CHECKSUM)
def checksum_gate(spark, sf):
    path, data = nation_text(spark, sf)
    return S.checksum_gate(spark, path, {"nation.txt": hashlib.sha256(data).hexdigest()})


@plan("yaml_scan", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def yaml_scan(spark, sf):
    path = S.scratch(spark, "yaml")
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    S.put(spark, f"{path}/nations.yaml", ("nations:\n" + "".join(f"  - key: {r[0]}\n    name: '{r[1]}'\n" for r in rows)).encode())
    found = S.read_yaml(spark, f"{path}/nations.yaml")["nations"]
    return spark.createDataFrame([(d["key"], d["name"]) for d in found], "n_nationkey long, n_name string")


@plan("zip_extract", f"SELECT 'nations.zip' AS archive, 'in/nation.txt' AS entry, strlen(c)::BIGINT AS length, sha256(c) AS sha256 FROM {NATION_TEXT}")
def zip_extract(spark, sf):
    path, data = nation_text(spark, sf)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/", b"")
        z.writestr("in/nation.txt", data)
    S.put(spark, f"{path}/zip/nations.zip", held.getvalue())
    return S.read_zip(spark, f"{path}/zip").select("archive", "entry", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))


@plan("xlsx_scan", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey / 2.0::DOUBLE END AS half FROM nation")
def xlsx_scan(spark, sf):
    """A worksheet with shared strings, header names in white space and empty cells."""
    rows = sorted(tuple(r) for r in table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").collect())  # 25 rows
    names = [" n_nationkey ", "n_name", "half\n", *[n for _, n, _ in rows]]
    string = lambda ref, k: f'<c r="{ref}" t="s"><v>{k}</v></c>'
    body = [f'<row r="1">{string("A1", 0)}{string("B1", 1)}{string("D1", 2)}</row>']
    for i, (k, _, region) in enumerate(rows, 2):
        body.append(f'<row r="{i}"><c r="A{i}"><v>{k}</v></c>{string(f"B{i}", i + 1)}{f"""<c r="D{i}"><v>{region / 2}</v></c>""" if k % 4 else ""}</row>')
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{n}</t></si>" for n in names) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{''.join(body)}</sheetData></worksheet>")
    path = S.scratch(spark, "xlsx")
    S.put(spark, f"{path}/nations.xlsx", held.getvalue())
    return S.read_xlsx(spark, path, "n_nationkey long, n_name string, half double")


PARTS = "SELECT p_partkey::VARCHAR AS k, CASE p_partkey % 4 WHEN 0 THEN 'a, \"b\"' WHEN 1 THEN '' WHEN 2 THEN 'x' || chr(160) || 'y' ELSE p_name END AS v FROM part"


def awkward_parts(spark, sf):
    """A row for each part: commas and quotes, empty cells and no-break spaces."""
    k = F.col("p_partkey")
    v = F.when(k % 4 == 0, 'a, "b"').when(k % 4 == 1, "").when(k % 4 == 2, "x\u00a0y").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(k.cast("string").alias("k"), v.alias("v"))


@plan("csv_awkward_cells", PARTS)
def csv_awkward_cells(spark, sf):
    path = S.scratch(spark, "parts")
    awkward_parts(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return S.read_strict(spark, path, ["k", "v"])


@plan("json_awkward_cells", PARTS)
def json_awkward_cells(spark, sf):
    path = S.scratch(spark, "parts")
    awkward_parts(spark, sf).write.json(path)
    return spark.read.schema("k string, v string").json(path)


@plan("arff_scan", "SELECT n_nationkey::DOUBLE AS key, n_name AS name, CASE WHEN n_regionkey <> 2 THEN n_regionkey::DOUBLE END AS region FROM nation")
def arff_scan(spark, sf):
    path = S.scratch(spark, "arff")
    head = spark.createDataFrame([("@relation nation",), ("@attribute 'key' numeric",), ("@attribute name {any}",), ("@attribute 'region' numeric",), ("@data",)], "value string")
    body = table(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", "n_name", F.when(F.col("n_regionkey") == 2, "?").otherwise(F.col("n_regionkey").cast("string"))).alias("value"))
    head.union(body).coalesce(1).write.text(path)
    return S.read_arff(spark, path)


@plan("junit_table", "SELECT n_name AS name, 'suite' AS classname, n_nationkey / 10.0::DOUBLE AS time FROM nation")
def junit_table(spark, sf):
    path = S.scratch(spark, "junit")
    case = F.format_string('<testcase name="%s" classname="suite" time="%s"></testcase>', "n_name", (F.col("n_nationkey") / F.lit(10.0)).cast("string"))
    suite = F.concat(F.lit("<testsuite>"), F.array_join(F.collect_list(case), "\n"), F.lit("</testsuite>"))
    table(spark, sf, "nation").agg(suite.alias("value")).write.text(path)
    return S.read_junit(spark, path)


@plan("markdown_table", "SELECT -1::BIGINT AS line, '| r_regionkey | r_name |' AS text UNION ALL SELECT 0, '|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def markdown_table(spark, sf):
    return S.markdown(table(spark, sf, "region"), ["r_regionkey"])


@plan("header_strip", "SELECT r_regionkey, r_name FROM region")
def header_strip(spark, sf):
    r = table(spark, sf, "region").toDF(" r_regionkey ", "r_name\t")
    return r.toDF(*[c.strip() for c in r.columns])
