"""Reading and writing files with declared schemas; everything goes through Spark's own file systems."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from sondage.session import ship


class SourceError(ValueError):
    """A source that is missing or not what it is declared to be."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or under a folder of our own where that is unset and Spark runs in one process.

    A cluster's executors do not share a local folder, so there the setting must be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise SourceError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sondage-")
    path = f"{base.rstrip('/')}/sondage-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return path


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as Parquet in the shared folder, or at a path there, and read back: what follows does not compute it again."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that scratch() gave."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file, such as a manifest, to any store that Spark writes to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> bytes:
    """The content of one small file."""
    rows = spark.read.format("binaryFile").load(path).select("content").take(1)
    if not rows:
        raise SourceError(f"{path} is missing")
    return bytes(rows[0]["content"])


def read_yaml(spark: SparkSession, path: str):
    """The document of a YAML file, which is read on the driver: configuration, not data."""
    try:
        import yaml
    except ImportError as e:
        raise SourceError("YAML needs the yaml package") from e
    return yaml.safe_load(get(spark, path))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(archive, entry, content) of the files in zip archives; an archive is opened by one task."""
    ship(spark)

    def entries(parts):
        for part in parts:
            for archive, data in zip(part["path"], part["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"archive": [archive.rsplit("/", 1)[-1]], "entry": [info.filename], "content": [z.read(info)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(entries, "archive string, entry string, content binary")


def _sheet(data: bytes, sheet: int) -> list[list[str | None]]:
    """The cells of a worksheet as text, with the gaps of sparse rows filled."""
    name = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: "".join(t.text or "" for t in e.iter() if name(t) == "t")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    out = []
    for row in (e for e in root.iter() if name(e) == "row"):
        cells: list[str | None] = []
        for c in (e for e in row if name(e) == "c"):
            at = 0
            for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                at = at * 26 + ord(letter) - 64
            value = next((e.text for e in c if name(e) == "v"), None)
            if c.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif c.get("t") == "inlineStr":
                value = text(c)
            cells += [None] * ((at or len(cells) + 1) - 1 - len(cells)) + [value]
        out.append(cells)
    return out


def read_xlsx(spark: SparkSession, path: str, schema: str, sheet: int = 1) -> DataFrame:
    """The rows of a worksheet below its header, whose names are stripped; only the columns of schema, cast to its types.

    A workbook is one file and is parsed by one task.
    """
    ship(spark)
    wanted = T.StructType.fromDDL(schema).names

    def rows(parts):
        for part in parts:
            for data in part["content"]:
                head, *body = _sheet(bytes(data), sheet) or [[]]
                head = [(h or "").strip() for h in head]
                absent = [c for c in wanted if c not in head]
                if absent:
                    raise SourceError(f"absent columns: {', '.join(absent)}")
                at = [head.index(c) for c in wanted]
                yield pd.DataFrame([[r[i] if i < len(r) else None for i in at] for r in body if any(v is not None for v in r)], columns=wanted, dtype=object)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"`{c}` string" for c in wanted))
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])


def read_strict(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, every cell as text, nothing read as null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("nullValue", "\u0000").option("emptyValue", "").option("escape", '"').csv(path)
    return df.na.fill("")


def read_typed(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and a declared schema; only the columns asked for are parsed."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, lines from 1: each split's lines go on from the number of lines before it."""
    lines = spark.read.text(path).withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = lines.groupBy("_p").count().select("_p", before.alias("_n"))  # one row per split
    return lines.join(offset, "_p").select((F.col("_n") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("line"), "value")


def split_metadata(lines: DataFrame, n: int, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(metadata, records) of numbered CSV lines: the header, then n metadata rows, then records with their line."""
    cells = F.from_csv("value", ", ".join(f"`{c}` string" for c in columns), {"emptyValue": "", "nullValue": "\u0000", "escape": '"'})
    out = lines.where("line > 1").select("line", cells.alias("_c")).select("line", "_c.*").na.fill("", columns)
    return out.where(F.col("line") <= n + 1), out.where(F.col("line") > n + 1)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF: numeric attributes as doubles, nominal ones as trimmed text, `?` as null."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v"))
    heads = [r.v for r in lines.where(F.lower("v").startswith("@attribute")).collect()]  # the header alone
    if not heads:
        raise SourceError(f"{path} declares no attributes")
    found = [re.match(r"@attribute\s+'?([^'{]+?)'?\s+(\{.*\}|\S+)$", h, re.IGNORECASE) for h in heads]
    names = ", ".join(f"c{i} string" for i in range(len(found)))
    cells = F.from_csv("v", names, {"quote": "'", "escape": "\\", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    rows = lines.where(~F.col("v").startswith("@") & ~F.col("v").startswith("%") & (F.col("v") != "")).select(cells.alias("_c"))
    cell = lambda i: F.nullif(F.trim(F.col(f"_c.c{i}")), F.lit("?"))
    return rows.select(*[(cell(i).try_cast("double") if m[2].lower() in ("numeric", "real", "integer") else cell(i)).alias(m[1].strip()) for i, m in enumerate(found)])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def checksum_gate(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """The checksums, if all expected files are there with the expected hash; else SourceError."""
    found = checksums(spark, path).where(F.col("file").isin(list(expected)))
    seen = {r.file: r.sha256 for r in found.collect()}  # the expected files alone
    for name, digest in expected.items():
        if name not in seen:
            raise SourceError(f"{name} is missing")
        if seen[name] != digest:
            raise SourceError(f"{name} is not the file that was declared")
    return found


@dataclass(frozen=True)
class RawFile:
    """A file that must be there with a known hash."""

    path: str
    sha256: str


@dataclass(frozen=True)
class Loaded:
    """The rows of a file whose hash was the expected one."""

    file: RawFile
    rows: DataFrame


def load(spark: SparkSession, file: RawFile, read: Callable[[str], DataFrame]) -> Loaded:
    """The rows that read makes of a file, if its hash is the expected one; else SourceError."""
    checksum_gate(spark, file.path, {file.path.rsplit("/", 1)[-1]: file.sha256})
    return Loaded(file, read(file.path))


def write_all(df: DataFrame, path: str) -> None:
    """The same rows as CSV, gzip CSV and JSON."""
    df.write.option("header", True).csv(f"{path}/csv")
    df.write.option("header", True).option("compression", "gzip").csv(f"{path}/csv_gz")
    df.write.json(f"{path}/json")


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of JUnit XML files: name, classname, time."""
    return spark.read.format("xml").option("rowTag", "testcase").schema("_name string, _classname string, _time double").load(path).toDF("name", "classname", "time")


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a Markdown table in order, header included; for report-sized tables."""
    cells = lambda cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
    body = df.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("line"), cells([F.col(c).cast("string") for c in df.columns]).alias("text"))
    head = df.sparkSession.createDataFrame([(-1, "| " + " | ".join(df.columns) + " |"), (0, "|" + "---|" * len(df.columns))], "line long, text string")
    return head.union(body)
