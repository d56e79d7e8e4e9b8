"""Writers, and a store of datasets with versions."""

from __future__ import annotations

import html
import posixpath
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.errors import OpError, need_columns
from weft.operators.columns import neutralise_formulas
from weft.operators.order import numbered
from weft.runtime import checkpoint
from weft.sources.lineage import Lineage

ALIASES = {"md": "markdown", "xls": "excel", "xlsx": "excel", "text": "txt"}
FORMATS = ("csv", "json", "parquet", "txt", "html", "markdown")
#: Rows that the page formats, which are for reading, may have.
PAGE_ROWS = 10_000


def export(df: DataFrame, path: str, fmt: str, text_column: str = "", max_records_per_file: int = 0) -> str:
    """Write a table; files are written by tasks, into a folder. HTML and Markdown are for reading and take ``PAGE_ROWS`` rows at most.

    CSV cells that a spreadsheet would run as a formula get a leading quote, and CSV files start
    with a byte order mark, so that spreadsheets read them as UTF-8. Blanks at the ends of cells stay, and
    an empty cell is in quotes while a missing one is nothing. Returns the path.
    """
    fmt = ALIASES.get(fmt.lower(), fmt.lower())
    if fmt == "excel":
        raise OpError("export", "fmt", "Excel files cannot be written here; use csv or parquet")
    if fmt not in FORMATS:
        raise OpError("export", "fmt", f"{fmt!r} is not one of {', '.join(FORMATS)}")
    if fmt == "txt":
        need_columns("export", "text_column", df, [text_column])
        df.select(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("value")).write.text(path)
    elif fmt in ("html", "markdown"):
        rows = df.limit(PAGE_ROWS + 1).collect()
        if len(rows) > PAGE_ROWS:
            raise OpError("export", "fmt", f"{fmt} pages have at most {PAGE_ROWS} rows; use csv or parquet")
        cell = (lambda v: html.escape("" if v is None else str(v))) if fmt == "html" else (lambda v: ("" if v is None else str(v)).replace("|", "\\|").replace("\n", " "))
        if fmt == "html":
            body = ["<table>", "<tr>" + "".join(f"<th>{cell(c)}</th>" for c in df.columns) + "</tr>", *("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows), "</table>"]
        else:
            body = ["| " + " | ".join(map(cell, df.columns)) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
        df.sparkSession.createDataFrame([("\n".join(body),)], "value string").coalesce(1).write.text(path)
    else:
        out = neutralise_formulas(df) if fmt == "csv" else df
        out = out.withColumnRenamed(out.columns[0], f"\ufeff{out.columns[0]}") if fmt == "csv" else out
        writer = out.write.option("maxRecordsPerFile", max_records_per_file)
        writer.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False) if fmt == "csv" else writer.json(path) if fmt == "json" else writer.parquet(path)
    return path


def tagged_path(path: str, tag: str) -> str:
    """A path with ``tag`` before the ending of its name; as it is without a tag."""
    root, end = posixpath.splitext(path)
    return f"{root}{tag}{end}" if tag else path


def stamped_path(spark: SparkSession, path: str, now: datetime | None = None) -> str:
    """A path with the moment before the ending of its name, and a number if it is there already, so that no export replaces another."""
    stamp, k = f"-{now or datetime.now():%Y%m%d-%H%M%S}", 1
    files = spark._jvm.org.apache.hadoop.fs
    while True:
        out = tagged_path(path, stamp if k == 1 else f"{stamp}-{k}")
        place = files.Path(out)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return out
        k += 1


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "graphml", clusters: DataFrame | None = None) -> str:
    """A network as ``graphml``, ``gml``, ``pajek`` or ``csv``. nodes: node, ...; edges: a, b, weight; clusters: node, cluster.

    Tasks write the lines; the parts of the folder, one after the other, are the file. Edges
    whose ends are not among the nodes go. ``csv`` gives a folder each of nodes, edges and clusters.
    """
    need_columns("export_graph", "nodes", nodes, ["node"])
    need_columns("export_graph", "edges", edges, ["a", "b", "weight"])
    if fmt == "csv":
        export(nodes, f"{path}/nodes", "csv")
        export(edges, f"{path}/edges", "csv")
        if clusters is not None:
            export(clusters.select("node", "cluster").orderBy("cluster", "node"), f"{path}/clusters", "csv")
        return path
    if fmt not in ("graphml", "gml", "pajek"):
        raise OpError("export_graph", "fmt", f"{fmt!r} is not one of graphml, gml, pajek, csv")
    listed = checkpoint(numbered(nodes.select(F.col("node").cast("string").alias("node")).where("node is not null").distinct(), ["node"]))
    end = lambda c: listed.select(F.col("node").alias(c), F.col("number").alias(f"n{c}"))
    drawn = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.format_string("%s", F.col("weight").cast("double")).alias("w")).join(end("a"), "a").join(end("b"), "b")
    name = F.col("node")
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        name = F.replace(name, F.lit(sign), F.lit(code))
    node, edge, head, middle, tail = {
        "pajek": (F.format_string('%d "%s"', "number", F.replace("node", F.lit('"'), F.lit("'"))), F.format_string("%d %d %s", "na", "nb", "w"), [F.format_string("*Vertices %d", "n")], ["*Edges"], []),
        "gml": (F.format_string('  node [ id %d label "%s" ]', F.col("number"), name), F.format_string("  edge [ source %d target %d weight %s ]", "na", "nb", "w"), ["graph ["], [], ["]"]),
        "graphml": (
            F.format_string('<node id="n%d"><data key="l">%s</data></node>', F.col("number"), name),
            F.format_string('<edge source="n%d" target="n%d"><data key="w">%s</data></edge>', "na", "nb", "w"),
            ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="w" for="edge" attr.name="weight" attr.type="double"/><key id="l" for="node" attr.name="label" attr.type="string"/>', '<graph edgedefault="undirected">'],
            [],
            ["</graph>", "</graphml>"],
        ),
    }[fmt]
    count = listed.agg(F.count(F.lit(1)).alias("n"))
    fixed = lambda section, lines: [count.select(F.lit(section).alias("s"), F.lit(i).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), (F.lit(t) if isinstance(t, str) else t).alias("value")) for i, t in enumerate(lines)]
    parts = [*fixed(0, head), listed.select(F.lit(1).alias("s"), F.col("number").alias("x"), F.lit(0).cast("long").alias("y"), node.alias("value")), *fixed(2, middle), drawn.select(F.lit(3).alias("s"), F.col("na").alias("x"), F.col("nb").alias("y"), edge.alias("value")), *fixed(4, tail)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows.orderBy("s", "x", "y").select("value").write.text(path)
    return path


class Watch:
    """Captures of one table in a shared folder, each compared with the one before."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], value: str):
        self.data, self.keys, self.value = Lineage(spark, folder), keys, value

    def capture(self, df: DataFrame) -> DataFrame:
        """Keep the sums of the value by key, and give what changed since the last capture as in ``compare_snapshots``; all is new the first time."""
        from weft.operators.joins import compare_snapshots

        need_columns("watch", "columns", df, [*self.keys, self.value])
        now = df.groupBy(*self.keys).agg(F.sum(self.value).alias(self.value))
        number = self.data.latest() + 1
        self.data.append(now.withColumn("capture", F.lit(number)))
        every = self.data.read()
        return compare_snapshots(every.where(F.col("capture") == number - 1), every.where(F.col("capture") == number), self.keys, self.value)
