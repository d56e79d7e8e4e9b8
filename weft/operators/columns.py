"""Steps that select, clean, convert, filter and derive columns. One narrow projection each, no shuffle
(but for fills, which need an order, and bins of equal width, which need the range)."""

from __future__ import annotations

import ast
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from weft.errors import OpError, need_columns, need_one_of
from weft.functions.scalars import blank_to_null, moment, number, strip, truth
from weft.runtime import checkpoint

COMPARISONS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "not_contains", "in", "not_in", "is_null", "not_null")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def select_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The named columns in that order; all of them if none is named."""
    need_columns("select_columns", "columns", df, columns or [])
    return df.select(*map(_col, columns)) if columns else df


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """New names; swaps are allowed, blank names and clashes with columns that stay are refused."""
    if not mapping or any(not a.strip() or not b.strip() for a, b in mapping.items()):
        raise OpError("rename_columns", "mapping", "give at least one pair, and no blank names")
    need_columns("rename_columns", "mapping", df, mapping)
    names = [mapping.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise OpError("rename_columns", "mapping", "two columns would have one name")
    return df.toDF(*names)


def strip_whitespace(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns (all by default) without white space at either end."""
    need_columns("strip_whitespace", "columns", df, columns or [])
    texts = set(_text_columns(df))
    return df.withColumns({c: strip(_col(c)) for c in columns or df.columns if c in texts})


def convert_type(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """``str``, ``int``, ``float``, ``bool`` or ``datetime``; unreadable cells become null, bool has no null.

    ``int`` fails on a number with a fraction when the rows are computed.
    """
    need_columns("convert_type", "column", df, [column])
    need_one_of("convert_type", "dtype", dtype, ("str", "int", "float", "bool", "datetime"))
    c = _col(column)
    if dtype == "str":
        out = c.cast("string")
    elif dtype == "float":
        out = number(c)
    elif dtype == "bool":
        out = truth(c)
    elif dtype == "datetime":
        out = moment(c, df.schema[column].dataType)
    else:
        n = number(c)
        broken = F.concat(F.lit(f"convert_type: {column}: not a whole number: "), c.cast("string"))
        out = F.when(n == F.floor(n), n.cast("long")).when(n.isNotNull(), F.raise_error(broken).cast("long"))
    return df.withColumn(column, out)


def fill_null(df: DataFrame, columns: list[str] | None = None, value=None, method: str | None = None, order_by: list[str] | None = None, group_by: list[str] | None = None) -> DataFrame:
    """Null and empty cells of the columns get ``value``, or their neighbour's by ``ffill``/``pad`` or ``bfill``/``backfill``.

    Filling from neighbours needs ``order_by``; ``group_by`` keeps it within groups and so
    distributed. Without value and method nothing changes.
    """
    columns = columns or df.columns
    need_columns("fill_null", "columns", df, columns)
    if value is None and not method:
        return df
    if method:
        need_one_of("fill_null", "method", method, ("ffill", "pad", "bfill", "backfill"))
        if not order_by:
            raise OpError("fill_null", "order_by", "rows have no order of their own; name the columns that order them")
        need_columns("fill_null", "order_by", df, order_by)
    texts = set(_text_columns(df))
    cells = {c: blank_to_null(_col(c)) if c in texts else _col(c) for c in columns}
    if not method:
        return df.withColumns({c: F.coalesce(cell, F.lit(value).cast(df.schema[c].dataType)) for c, cell in cells.items()})
    back = method in ("ffill", "pad")
    # a frame up to the last row is worked out anew for each row, one from the first row is carried along: bfill goes through the rows backwards
    turned = [_col(c).asc_nulls_first() if back else _col(c).desc_nulls_last() for c in order_by]
    carried = lambda cell, w: F.last(cell, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if group_by:
        w = Window.partitionBy(*map(_col, group_by)).orderBy(*turned)
        return df.withColumns({c: carried(cell, w) for c, cell in cells.items()})
    # without groups: ranges of the order, each filled on its own, then from the ranges before (or after) it
    keys = [_col(c) for c in order_by]
    parts = checkpoint(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    end = F.max_by if back else F.min_by
    ends = parts.groupBy("__part").agg(*[end(cell, F.when(cell.isNotNull(), F.struct(*keys))).alias(f"__e{i}") for i, cell in enumerate(cells.values())])
    along = Window.orderBy(F.asc("__part") if back else F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    others = ends.select("__part", *[F.last(f"__e{i}", ignorenulls=True).over(along).alias(f"__e{i}") for i in range(len(cells))])
    w = Window.partitionBy("__part").orderBy(*turned)
    filled = parts.withColumns({f"__f{i}": carried(cell, w) for i, cell in enumerate(cells.values())}).join(F.broadcast(others), "__part")
    return filled.withColumns({c: F.coalesce(f"__f{i}", f"__e{i}") for i, c in enumerate(cells)}).select(*df.columns)


def drop_null(df: DataFrame, columns: list[str] | None = None, how: str = "any") -> DataFrame:
    """Rows with a null or empty cell in any (or all) of the columns go; empty cells of other rows become null."""
    columns = columns or df.columns
    need_columns("drop_null", "columns", df, columns)
    need_one_of("drop_null", "how", how, ("any", "all"))
    texts = set(_text_columns(df))
    return df.withColumns({c: blank_to_null(_col(c)) for c in columns if c in texts}).dropna(how, subset=columns)


def condition(df: DataFrame, column: str, op: str, value=None) -> Column:
    """The test of ``filter_rows`` as a Column that is never null."""
    need_columns("filter_rows", "column", df, [column])
    need_one_of("filter_rows", "op", op, COMPARISONS)
    c, kind = _col(column), df.schema[column].dataType
    if isinstance(kind, StringType) and op in ("eq", "ne", "in", "not_in"):
        # numbers of a text column count as such if all its cells are numbers: one row of figures says so
        numeric = bool(df.agg(F.bool_and(number(c).isNotNull() | c.isNull()) & F.bool_or(c.isNotNull())).first()[0])
    else:
        numeric = isinstance(kind, NumericType)

    def as_number(v):
        try:
            return float(str(v).strip())
        except ValueError:
            return None

    def equal(v):
        same = c.cast("string") == F.lit(str(v))
        return same | (number(c) == F.lit(as_number(v))) if numeric and as_number(v) is not None else same

    sure = lambda test: F.coalesce(test, F.lit(False))
    if op in ("eq", "ne"):
        return sure(equal(value)) if op == "eq" else ~sure(equal(value))
    if op in ("gt", "gte", "lt", "lte"):
        bound = as_number(value)
        if bound is None:
            raise OpError("filter_rows", "value", f"{value!r} is not a number")
        n = number(c)
        return sure({"gt": n > bound, "gte": n >= bound, "lt": n < bound, "lte": n <= bound}[op])
    if op in ("contains", "not_contains"):
        try:
            re.compile(str(value))
        except re.error as e:
            raise OpError("filter_rows", "value", f"{value!r} is not a regular expression: {e}") from None
        found = sure(c.cast("string").rlike(str(value)))
        return found if op == "contains" else ~found
    if op in ("in", "not_in"):
        items = [x.strip() for x in value.split(",")] if isinstance(value, str) else list(value or [])
        if not items:
            raise OpError("filter_rows", "value", "the list is empty")
        same = c.cast("string").isin(*map(str, items))
        numbers = [as_number(x) for x in items]
        numbers = numbers if None not in numbers else []
        same = sure(same | number(c).isin(*numbers) if numeric and numbers else same)
        return same if op == "in" else ~same
    blank = c.isNull() | (c.cast("string") == "")
    return blank if op == "is_null" else ~blank


def filter_rows(df: DataFrame, column: str, op: str, value=None, keep: str = "keep") -> DataFrame:
    """Rows that pass (``keep``) or fail (``exclude``) one of twelve comparisons; null passes only ``ne``, ``not_*`` and ``is_null``."""
    need_one_of("filter_rows", "keep", keep, ("keep", "exclude"))
    test = condition(df, column, op, value)
    return df.where(test if keep == "keep" else ~test)


_OPERATORS = (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow, ast.UAdd, ast.USub)


def column_calc(df: DataFrame, new_col: str, expr: str) -> DataFrame:
    """``new_col`` from arithmetic over columns (names, or any name in back-ticks) and numbers.

    ``+ - * / // % **`` and signs; nothing is called. Division by zero gives an infinity or NaN.
    """
    op = "column_calc"
    if not expr.strip() or len(expr) > 500:
        raise OpError(op, "expr", "give an expression of at most 500 characters")
    names: dict[str, str] = {}

    def quoted(m):
        names[f"quoted_{len(names)}"] = m[1]
        return f"quoted_{len(names) - 1}"

    try:
        tree = ast.parse(re.sub(r"`([^`]+)`", quoted, expr), mode="eval").body
    except SyntaxError as e:
        raise OpError(op, "expr", f"{expr!r}: {e.msg}") from None
    if sum(1 for _ in ast.walk(tree)) > 200:
        raise OpError(op, "expr", "it has too many parts")

    def ratio(a, b):
        over = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
        return F.when(b != 0, F.try_divide(a, b)).when(b == 0, over)

    def build(node) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            name = names.get(node.id, node.id)
            need_columns(op, "expr", df, [name])
            return number(_col(name))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, _OPERATORS):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.BinOp) and isinstance(node.op, _OPERATORS):
            a, b = build(node.left), build(node.right)
            if isinstance(node.op, ast.Pow):
                if not isinstance(node.right, ast.Constant) or abs(node.right.value) > 64:
                    raise OpError(op, "expr", "an exponent must be a number up to 64")
                return F.pow(a, b)
            kinds = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: ratio(a, b), ast.FloorDiv: lambda: F.when(b != 0, F.floor(F.try_divide(a, b)).cast("double")).otherwise(ratio(a, b)), ast.Mod: lambda: F.when(b != 0, a - b * F.floor(F.try_divide(a, b))).when(b == 0, F.lit(float("nan")))}
            return kinds[type(node.op)]()
        raise OpError(op, "expr", f"{ast.unparse(node)!r} is not arithmetic over columns and numbers")

    return df.withColumn(new_col, build(tree))


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of ``bins`` equal widths, the first a thousandth of the range lower so that the least value is inside."""
    if low == high:
        low, high = low - (0.001 * abs(low) or 0.001), high + (0.001 * abs(high) or 0.001)
        return np.linspace(low, high, bins + 1).tolist()
    edges = np.linspace(low, high, bins + 1)
    edges[0] -= (high - low) * 0.001
    return edges.tolist()


def bin_column(df: DataFrame, column: str, bins: int | list[float], labels: list[str] | None = None, new_col: str | None = None) -> DataFrame:
    """Intervals ``(a, b]``: as many of equal width, or between the given edges; null outside and for what is no number.

    A number of bins takes one job for the range of the column.
    """
    op = "bin_column"
    need_columns(op, "column", df, [column])
    value = number(_col(column))
    if isinstance(bins, int) and not isinstance(bins, bool):
        if bins < 1:
            raise OpError(op, "bins", f"{bins} is under 1")
        low, high = df.agg(F.min(value), F.max(value)).first()
        if low is None:
            raise OpError(op, "column", f"{column} has no number")
        edges = bin_edges(low, high, bins)
    else:
        edges = [float(x) for x in bins]
        if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
            raise OpError(op, "bins", "edges must ascend")
    labels = labels or [f"({a:.6g}, {b:.6g}]" for a, b in zip(edges, edges[1:], strict=False)]
    if len(labels) != len(edges) - 1:
        raise OpError(op, "labels", f"{len(labels)} labels for {len(edges) - 1} bins")
    out = F.lit(None).cast("string")
    for a, b, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((value > a) & (value <= b), label).otherwise(out)
    return df.withColumn(new_col or f"{column}_bin", out)


def extract_time(df: DataFrame, column: str, new_col: str = "date", part: str = "date") -> DataFrame:
    """``date`` (text), ``hour``, ``weekday`` (Monday 0), ``month`` or ``year`` of a moment; null where unreadable."""
    need_columns("extract_time", "column", df, [column])
    need_one_of("extract_time", "part", part, ("date", "hour", "weekday", "month", "year"))
    t = moment(_col(column), df.schema[column].dataType)
    return df.withColumn(new_col, {"date": F.date_format(t, "yyyy-MM-dd"), "hour": F.hour(t), "weekday": F.weekday(t), "month": F.month(t), "year": F.year(t)}[part])


def bin_time(df: DataFrame, column: str, edges: list[str], labels: list[str], new_col: str = "stage", order_new_col: str = "") -> DataFrame:
    """The stage ``[edge, next edge)`` of a calendar day; ``order_new_col`` gets its number from 1."""
    op = "bin_time"
    need_columns(op, "column", df, [column])
    if len(edges) != len(labels) + 1:
        raise OpError(op, "edges", f"{len(edges)} edges for {len(labels)} labels; one more is needed")
    if any(not re.fullmatch(r"\d{4}-\d{2}-\d{2}", e) for e in edges) or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise OpError(op, "edges", "days as YYYY-MM-DD, ascending")
    day = moment(_col(column), df.schema[column].dataType).cast("date")
    stage, order = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (a, b, label) in reversed(list(enumerate(zip(edges, edges[1:], labels, strict=False), 1))):
        inside = (day >= F.lit(a).cast("date")) & (day < F.lit(b).cast("date"))
        stage, order = F.when(inside, label).otherwise(stage), F.when(inside, k).otherwise(order)
    df = df.withColumn(new_col, stage)
    return df.withColumn(order_new_col, order) if order_new_col else df


def time_filter(df: DataFrame, column: str, start: str = "", end: str = "") -> DataFrame:
    """Rows of the days from start to end, both inside; unreadable moments go."""
    op = "time_filter"
    need_columns(op, "column", df, [column])
    if bool(start) != bool(end) or not start:
        raise OpError(op, "start/end", "give both ends of the range")
    for name, v in (("start", start), ("end", end)):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", v):
            raise OpError(op, name, f"{v!r} is not a day as YYYY-MM-DD")
    if start > end:
        raise OpError(op, "start", "it is after end")
    day = moment(_col(column), df.schema[column].dataType).cast("date")
    return df.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def neutralise_formulas(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would run get a leading quote."""
    return df.withColumns({c: F.when(_col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), _col(c))).otherwise(_col(c)) for c in _text_columns(df)})


def localise(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Display names for keys; keys without one stay."""
    need_columns("localise", "column", df, [column])
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    return df.withColumn(column, F.coalesce(table[_col(column)], _col(column))) if names else df


def explode_links(df: DataFrame, column: str, new_col: str = "link") -> DataFrame:
    """A row for each http(s) address in a cell; cells without one give none."""
    need_columns("explode_links", "column", df, [column])
    return df.withColumn(new_col, F.explode(F.regexp_extract_all(_col(column).cast("string"), F.lit(r"(https?://[^\s,;，；、|]+)"), F.lit(1))))
