"""Grouped figures and the tables behind charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.errors import OpError, need_columns, need_one_of
from weft.functions.scalars import number

FUNCTIONS = ("sum", "count", "mean", "min", "max", "median", "std", "var", "first", "last", "nunique")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def measure(column: str, func: str, order_by: str | None = None) -> Column:
    """An aggregate under its usual table name; the sum of no numbers is 0; first and last follow ``order_by``."""
    need_one_of("aggregate", "func", func, FUNCTIONS)
    c = _col(column)
    n = number(c)
    if func in ("first", "last"):
        if not order_by:
            raise OpError("aggregate", "order_by", f"{func} needs an order")
        key = F.when(c.isNotNull(), _col(order_by))
        return F.min_by(c, key) if func == "first" else F.max_by(c, key)
    return {"sum": F.coalesce(F.sum(n), F.lit(0.0)), "count": F.count(c), "mean": F.avg(n), "min": F.min(c), "max": F.max(c), "median": F.median(n), "std": F.stddev_samp(n), "var": F.var_samp(n), "nunique": F.count_distinct(c)}[func]


def groupby_agg(df: DataFrame, group_col: str, agg_col: str, agg_func: str = "sum", order_col: str = "", agg_metrics: list[tuple[str, str]] = (), row_order: str | None = None) -> DataFrame:
    """A row for each group but null: the measure under its column's name, further ones as ``column_func``.

    Ordered by the least ``order_col`` of each group, else by group.
    """
    op = "groupby_agg"
    need_columns(op, "columns", df, [group_col, agg_col, *([order_col] if order_col else []), *[c for c, _ in agg_metrics]])
    names, measures = [], []
    for k, (c, f) in enumerate([(agg_col, agg_func), *agg_metrics]):
        name = c if not k else f"{c}_{f}"
        while name in (*names, group_col):
            name += "_2"
        names.append(name)
        measures.append(measure(c, f, row_order).alias(name))
    rank = F.min(number(_col(order_col)) if order_col else _col(group_col)).alias("__rank")
    out = df.where(_col(group_col).isNotNull()).groupBy(_col(group_col)).agg(*measures, rank)
    return out.orderBy("__rank", _col(group_col)).drop("__rank")


def query(df: DataFrame, op: str, column: str = "", by: list[str] = (), agg: str = "count", where: tuple | None = None, columns: list[str] = (), limit: int = 200) -> DataFrame:
    """A bounded question: ``count``, a scalar, ``value_counts``, ``groupby`` (null is a group) or ``filter``.

    where: ``(column, comparison, value)``; here ``contains`` is a plain substring.
    """
    if where:
        c, comparison, value = where
        need_columns("query", "where", df, [c])
        need_one_of("query", "where", comparison, ("eq", "ne", "gt", "gte", "lt", "lte", "contains"))
        if comparison == "contains":
            df = df.where(F.coalesce(F.contains(_col(c).cast("string"), F.lit(str(value))), F.lit(False)))
        else:
            from weft.operators.columns import condition

            df = df.where(condition(df, c, comparison, value) & _col(c).isNotNull())
    scalars = {"sum", "mean", "median", "min", "max", "std", "nunique"}
    if op == "count":
        return df.agg(F.count(F.lit(1)).alias("count"))
    if op in scalars:
        need_columns("query", "column", df, [column])
        n = number(_col(column))
        return df.agg({"sum": F.sum(n), "mean": F.avg(n), "median": F.median(n), "min": F.min(n), "max": F.max(n), "std": F.stddev_samp(n), "nunique": F.count_distinct(_col(column))}[op].alias(op))
    if op == "value_counts":
        need_columns("query", "column", df, [column])
        value = F.coalesce(_col(column).cast("string"), F.lit("(missing)"))
        return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(limit)
    if op == "groupby":
        need_columns("query", "by", df, by)
        measures = [F.count(F.lit(1)).alias("count")] if agg == "count" else [measure(c, agg).alias(f"{c}_{agg}") for c in columns[:20]]
        return df.groupBy(*map(_col, by)).agg(*measures).orderBy(*map(_col, by)).limit(limit)
    if op == "filter":
        return df.select(*map(_col, (columns or df.columns)[:40])).limit(limit)
    raise OpError("query", "op", f"{op!r} is not one of count, value_counts, groupby, filter, {', '.join(sorted(scalars))}")


def compare_platform(df: DataFrame, platform_col: str, value_col: str = "", agg: str = "mean") -> DataFrame:
    """Count and measure by platform (null as empty text), most rows first; a group without numbers has a null measure."""
    need_columns("compare_platform", "columns", df, [platform_col, *([value_col] if value_col else [])])
    need_one_of("compare_platform", "agg", agg, ("sum", "mean"))
    measures = [F.count(F.lit(1)).alias("n")]
    if value_col:
        n = number(_col(value_col))
        measures.append((F.sum(n) if agg == "sum" else F.avg(n)).alias(f"{value_col}_{agg}"))
    return df.groupBy(F.coalesce(_col(platform_col).cast("string"), F.lit("")).alias("platform")).agg(*measures).orderBy(F.desc("n"), "platform")


def sentiment_evolution(df: DataFrame, period_col: str, label_col: str, score_col: str = "", positive: tuple = ("positive",), neutral: tuple = ("neutral",), negative: tuple = ("negative",)) -> DataFrame:
    """Counts and shares of the labels by period, an index ``(pos - neg) / total``, each period's part of all rows,
    and with a score its count and intensity ``mean(|score - 0.5|) * 2``. Rows without a period do not count."""
    need_columns("sentiment_evolution", "columns", df, [period_col, label_col, *([score_col] if score_col else [])])
    label = _col(label_col).cast("string")
    count = lambda words: F.sum(label.isin(*words).cast("long"))
    measures = [F.coalesce(count(w), F.lit(0)).alias(n) for n, w in (("positive", positive), ("neutral", neutral), ("negative", negative))]
    if score_col:
        s = number(_col(score_col))
        measures += [F.count(s).alias("score_n"), F.round(F.avg(F.abs(s - 0.5)) * 2, 4).alias("intensity")]
    out = df.where(_col(period_col).isNotNull()).groupBy(_col(period_col).alias("period")).agg(*measures, F.count(F.lit(1)).alias("total"))
    total = F.col("total")
    pct = lambda c: F.round(F.col(c) * 100.0 / total, 2).alias(f"{c}_pct")
    every = F.sum("total").over(Window.partitionBy())  # one row a period
    more = [F.col("score_n"), F.col("intensity")] if score_col else []
    return out.select("period", "positive", "neutral", "negative", (total - F.col("positive") - F.col("neutral") - F.col("negative")).alias("other"), "total", pct("positive"), pct("neutral"), pct("negative"), F.round((F.col("positive") - F.col("negative")) / total, 4).alias("sentiment_index"), F.round(total * 100.0 / every, 2).alias("volume_pct"), *more).orderBy("period")


def label_counts(df: DataFrame, column: str, share: bool = False) -> DataFrame:
    """How often each label occurs, most first; with ``share`` in percent as well."""
    need_columns("label_counts", "column", df, [column])
    out = df.where(_col(column).isNotNull()).groupBy(_col(column).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    out = out.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2)) if share else out
    return out.orderBy(F.desc("n"), "label")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two codings over rows coded twice: ``n, observed, expected, kappa`` (1 if all agree)."""
    need_columns("kappa", "a/b", df, [a, b])
    cells = df.where(_col(a).isNotNull() & _col(b).isNotNull()).groupBy(_col(a).cast("string").alias("a"), _col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("x"))
    cols = cells.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("y"))
    by = rows.join(cols, "label").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("chance"))
    out = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")).crossJoin(F.broadcast(by))  # one row each
    observed, expected = F.col("same") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return out.select("n", observed.alias("observed"), expected.alias("expected"), F.when(observed == 1, 1.0).otherwise((observed - expected) / (1 - expected)).alias("kappa"))


def chart_aggregate(df: DataFrame, x: str, y: str, func: str = "sum", order_by: str | None = None) -> DataFrame:
    """One measure by category, categories in order of first appearance (least ``order_by``), else by name; a category without numbers has null."""
    need_columns("chart_aggregate", "columns", df, [x, y, *([order_by] if order_by else [])])
    n = number(_col(y))
    value = F.sum(n) if func == "sum" else measure(y, func, order_by)
    out = df.where(_col(x).isNotNull()).groupBy(_col(x).alias("x")).agg(value.alias("value"), F.min(_col(order_by or x)).alias("__at"))
    return out.orderBy("__at", "x").drop("__at")


#: Cells that a pivot may have (a fixed limit of charts).
MATRIX_CELLS = 40_000


def pivot(df: DataFrame, x: str, y: str, value: str = "", func: str = "count") -> DataFrame:
    """A row for each y, a column for each x. The x values take one job; over ``MATRIX_CELLS`` cells are refused."""
    need_columns("pivot", "columns", df, [x, y, *([value] if value else [])])
    xs = [r[0] for r in df.select(_col(x).cast("string")).where(_col(x).isNotNull()).distinct().orderBy(x).limit(MATRIX_CELLS + 1).collect()]
    rows = df.agg(F.count_distinct(_col(y))).first()[0]
    if len(xs) * rows > MATRIX_CELLS:
        raise OpError("pivot", "x/y", f"{len(xs)} x {rows} cells are over {MATRIX_CELLS}")
    cells = df.groupBy(_col(y).alias("y")).pivot(x, xs) if dict(df.dtypes)[x] == "string" else df.withColumn(x, _col(x).cast("string")).groupBy(_col(y).alias("y")).pivot(x, xs)
    out = cells.agg(F.count(F.lit(1)) if func == "count" else measure(value, func))
    return (out.fillna(0, subset=xs) if func == "count" else out).orderBy("y")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``(bin, low, high, n)`` for equal widths, closed on the right, the least value in the first; one job for the range."""
    need_columns("histogram", "column", df, [column])
    n = number(_col(column))
    low, high = df.agg(F.min(n), F.max(n)).first()
    if low is None:
        raise OpError("histogram", "column", f"{column} has no number")
    width = (high - low) / bins or 1.0
    k = F.least(F.greatest(F.ceil((n - low) / width), F.lit(1)), F.lit(bins)).cast("int")
    counts = df.where(n.isNotNull()).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("low"), (F.lit(low) + F.col("bin") * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


def box_stats(df: DataFrame, group_col: str, column: str) -> DataFrame:
    """``n, low, q1, median, q3, high`` by group; the whiskers end at the outermost values within 1.5 box lengths."""
    need_columns("box_stats", "columns", df, [group_col, column])
    rows = df.select(_col(group_col).alias("g"), number(_col(column)).alias("v")).where("g is not null and v is not null")
    q = rows.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    q = q.select("g", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = rows.join(q, "g").where((F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach))
    ends = inside.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return q.join(ends, "g").select(F.col("g").alias("group"), "n", "low", "q1", "median", "q3", "high").orderBy("group")


def stacked_shares(df: DataFrame, x: str, fields: list[str]) -> DataFrame:
    """Sums of the fields by category and their shares of all of them in percent (null where the total is 0)."""
    need_columns("stacked_shares", "columns", df, [x, *fields])
    out = df.where(_col(x).isNotNull()).groupBy(_col(x).alias("x")).agg(*[F.sum(number(_col(f))).alias(f) for f in fields])
    total = sum((F.coalesce(_col(f), F.lit(0.0)) for f in fields), F.lit(0.0))
    return out.select("x", *map(_col, fields), *[F.round(F.try_divide(_col(f) * 100, total), 2).alias(f"{f}_share") for f in fields]).orderBy("x")


def model_agreement(df: DataFrame, id_col: str, model_col: str, label_col: str) -> DataFrame:
    """``(a, b, shared, agreement)`` for each ordered pair of models: the part of shared ids, in percent, that they label alike."""
    need_columns("model_agreement", "columns", df, [id_col, model_col, label_col])
    rows = df.select(_col(id_col).alias("id"), _col(model_col).cast("string").alias("m"), _col(label_col).cast("string").alias("l")).where("l is not null")
    a, b = rows.select("id", F.col("m").alias("a"), F.col("l").alias("la")), rows.select("id", F.col("m").alias("b"), F.col("l").alias("lb"))
    return a.join(b, "id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.round(F.avg((F.col("la") == F.col("lb")).cast("double")) * 100, 2).alias("agreement")).orderBy("a", "b")


def h_index(df: DataFrame, node_col: str, citations_col: str) -> DataFrame:
    """``(node, documents, citations, h)``: h documents have h citations or more."""
    need_columns("h_index", "columns", df, [node_col, citations_col])
    rows = df.select(_col(node_col).alias("node"), F.coalesce(number(_col(citations_col)), F.lit(0.0)).alias("c")).where("node is not null")
    by_count = rows.groupBy("node", "c").agg(F.count(F.lit(1)).alias("k"))
    at_least = F.sum("k").over(Window.partitionBy("node").orderBy(F.desc("c")))
    ranked = by_count.withColumn("at_least", at_least)
    return ranked.groupBy("node").agg(F.sum("k").alias("documents"), F.sum(F.col("c") * F.col("k")).alias("citations"), F.max(F.least("at_least", F.floor("c"))).alias("h")).orderBy("node")


def profile(df: DataFrame) -> DataFrame:
    """``(column, type, rows, nulls, distinct)`` in one pass over the table."""
    parts = [x for c in df.columns for x in (F.sum(_col(c).isNull().cast("long")).alias(f"n:{c}"), F.count_distinct(_col(c)).alias(f"d:{c}"))]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *parts)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.coalesce(_col(f"n:{c}"), F.lit(0)).alias("nulls"), _col(f"d:{c}").alias("distinct")) for c, t in df.dtypes])
    return one.select("rows", F.explode(items).alias("x")).select("x.column", "x.type", "rows", "x.nulls", "x.distinct")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``rows`` and ``duplicates``: how many rows repeat an earlier one."""
    return df.groupBy(*map(_col, df.columns)).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
