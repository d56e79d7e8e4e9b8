"""Readers of tables: CSV, TSV, JSON, Parquet, text, rows given in code."""

from __future__ import annotations

import csv
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weft.errors import OpError

FORMATS = ("csv", "tsv", "json", "jsonl", "parquet", "txt")


def read_table(spark: SparkSession, path: str, fmt: str = "", encoding: str = "UTF-8", schema: str | None = None) -> DataFrame:
    """A table by its format, else by the ending of its path. CSV cells are text unless a schema says otherwise; one without anything is null, quotes around nothing are an empty text.

    Encoding ``auto`` takes UTF-8, with a byte order mark or without, if every line is valid in
    it, else GB18030 (then a row is a line); a file that is neither is refused. Excel files are refused by name: no reader for them is installed.
    """
    fmt = (fmt or path.rstrip("/").rpartition(".")[2]).lower()
    if fmt in ("xls", "xlsx", "excel"):
        raise OpError("read_table", "fmt", "Excel files cannot be read here; save them as CSV or Parquet")
    if fmt not in FORMATS:
        raise OpError("read_table", "fmt", f"{fmt!r} is not one of {', '.join(FORMATS)}")
    if encoding == "auto" and fmt in ("csv", "tsv") and encoding_of(spark, path) == "GB18030":
        return _decoded_table(spark, path, "\t" if fmt == "tsv" else ",")
    encoding = "UTF-8" if encoding == "auto" else encoding
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt in ("csv", "tsv"):
        df = reader.csv(path, header=True, sep="\t" if fmt == "tsv" else ",", encoding=encoding, multiLine=True, escape='"', quote='"', nullValue=f"null {uuid.uuid4()}")  # no cell reads so
        return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    if fmt == "json":
        return reader.json(path, multiLine=True)
    if fmt == "jsonl":
        return reader.json(path)
    return spark.read.text(path) if fmt == "txt" else reader.parquet(path)


@F.arrow_udf(StringType())
def _from_gb18030(raw: pa.Array) -> pa.Array:
    """The text of bytes in GB18030, which Spark does not decode; null where it is not valid."""
    out = []
    for x in raw.to_pylist():
        try:
            out.append(None if x is None else x.decode("gb18030"))
        except UnicodeDecodeError:
            out.append(None)
    return pa.array(out, pa.string())


def _decoded_table(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """A table of lines in GB18030; the first line, wherever a file has it, is the heading."""
    lines = spark.read.text(path).select(_from_gb18030(F.col("value").cast("binary")).alias("value"))
    head = lines.first()
    if head is None:
        raise OpError("read_table", "path", f"{path} is empty")
    names = next(csv.reader([head["value"]], delimiter=sep))
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = lines.where(F.col("value") != head["value"]).select(F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"'}).alias("r"))
    return rows.select("r.*")


def encoding_of(spark: SparkSession, path: str) -> str:
    """``UTF-8`` or ``GB18030``, whichever decodes every line of a text file."""
    if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty():
        return "UTF-8"
    if spark.read.text(path).where(_from_gb18030(F.col("value").cast("binary")).isNull()).isEmpty():
        return "GB18030"
    raise OpError("read_table", "encoding", f"{path} is neither UTF-8 nor GB18030; name its encoding")


def from_rows(spark: SparkSession, rows: list[dict], schema: str | None = None) -> DataFrame:
    """A table of rows given in code; columns in order of first appearance, missing cells null."""
    if not rows and not schema:
        raise OpError("from_rows", "rows", "without rows a schema is needed")
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema or names)
