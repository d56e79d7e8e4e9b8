"""Tables behind charts of flows, two measures, points and word clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.errors import need_columns, need_one_of, need_positive
from weft.functions.scalars import number, strip

#: Aggregations of chart values.
AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "median": lambda c: F.percentile(c, F.lit(0.5)), "count": F.count}


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _measure(op: str, df: DataFrame, column: str, agg: str) -> Column:
    need_one_of(op, "agg", agg, AGGREGATES)
    if not column:
        return F.count(F.lit(1)).cast("double")
    need_columns(op, "column", df, [column])
    return AGGREGATES[agg](number(_col(column))).cast("double")


def sankey_links(df: DataFrame, source: str, target: str, value_col: str = "", agg: str = "sum") -> DataFrame:
    """``(source, target, value)``: rows, or a figure of ``value_col``, of each pair of cells; links of no weight and null ends go."""
    need_columns("sankey_links", "columns", df, [source, target])
    pairs = df.where(_col(source).isNotNull() & _col(target).isNotNull())
    links = pairs.groupBy(_col(source).cast("string").alias("source"), _col(target).cast("string").alias("target")).agg(_measure("sankey_links", df, value_col, agg).alias("value"))
    return links.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != 0))


def sankey_nodes(df: DataFrame, source: str, target: str) -> DataFrame:
    """``(node)``: all names of either end, sorted; a name on both sides is one node."""
    need_columns("sankey_nodes", "columns", df, [source, target])
    pairs = df.where(_col(source).isNotNull() & _col(target).isNotNull())
    return pairs.select(F.explode(F.array(_col(source).cast("string"), _col(target).cast("string"))).alias("node")).distinct().orderBy("node")


def dual_line(df: DataFrame, x: str, y: str = "", agg: str = "sum", y2: str = "", agg2: str = "mean") -> DataFrame:
    """``(x, left, right)``: two measures of each cell of one column, in its order; without a column a measure counts rows."""
    need_columns("dual_line", "x", df, [x])
    return df.where(_col(x).isNotNull()).groupBy(_col(x).alias("x")).agg(_measure("dual_line", df, y, agg).alias("left"), _measure("dual_line", df, y2, agg2).alias("right")).orderBy("x")


def scatter(df: DataFrame, x: str, y: str, group: str = "") -> DataFrame:
    """``(x, y)``, with ``group`` a third column, of the rows whose both cells read as numbers."""
    need_columns("scatter", "columns", df, [x, y, *([group] if group else [])])
    out = df.select(number(_col(x)).alias("x"), number(_col(y)).alias("y"), *([_col(group).cast("string").alias("group")] if group else []))
    return out.where("x is not null and y is not null and abs(x) <> double('infinity') and abs(y) <> double('infinity')")


def word_cloud(df: DataFrame, word_col: str, value_col: str = "", agg: str = "sum", top_n: int = 200) -> DataFrame:
    """``(word, value)``: the ``top_n`` words of a column by rows or by a figure; values of 0 and less say nothing."""
    need_columns("word_cloud", "word_col", df, [word_col])
    need_positive("word_cloud", "top_n", top_n)
    words = df.withColumn("__word", strip(_col(word_col).cast("string"))).where("__word <> ''")
    return words.groupBy(F.col("__word").alias("word")).agg(_measure("word_cloud", df, value_col, agg).alias("value")).where("value > 0").orderBy(F.desc("value"), "word").limit(top_n)
