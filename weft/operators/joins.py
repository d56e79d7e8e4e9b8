"""Two-table steps: joins, key matching, coverage, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType

from weft.errors import OpError, need_columns, need_one_of
from weft.functions.scalars import folded, url_key
from weft.functions.texts import nfkc, normalized_key
from weft.runtime import checkpoint, spread

HOW = ("inner", "left", "right", "outer", "cross")
MODES = ("exact", "trim", "url", "text")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def join_tables(df: DataFrame, other: DataFrame, how: str = "inner", left_on: str = "", right_on: str = "") -> DataFrame:
    """An equi-join in which null meets null. Equal key names give one key column; other shared names get ``_x`` and ``_y``."""
    op = "join_tables"
    need_one_of(op, "how", how, HOW)
    left_names, right_names = df.columns, other.columns
    if how != "cross":
        need_columns(op, "left_on", df, [left_on])
        need_columns(op, "right_on", other, [right_on])
    one_key = how != "cross" and left_on == right_on
    shared = (set(left_names) & set(right_names)) - ({left_on} if one_key else set())
    a, b = df.toDF(*[f"l{i}" for i in range(len(left_names))]), other.toDF(*[f"r{i}" for i in range(len(right_names))])
    if how == "cross":
        out = a.crossJoin(b)  # asked for by name
    else:
        lk, rk = F.col(f"l{left_names.index(left_on)}"), F.col(f"r{right_names.index(right_on)}")
        out = a.join(b, lk.eqNullSafe(rk), how)
    columns = []
    for i, c in enumerate(left_names):
        key = F.coalesce(F.col(f"l{i}"), F.col(f"r{right_names.index(right_on)}")) if one_key and c == left_on else F.col(f"l{i}")
        columns.append(key.alias(f"{c}_x" if c in shared else c))
    columns += [F.col(f"r{i}").alias(f"{c}_y" if c in shared else c) for i, c in enumerate(right_names) if not (one_key and c == right_on)]
    return out.select(*columns)


def match_key(df: DataFrame, columns: list[str], mode: str = "exact", ignore_case: bool = False) -> Column:
    """One text for a composite key; null if any part is blank, and null matches nothing."""
    need_one_of("match_key", "mode", mode, MODES)
    parts = []
    for c in columns:
        cell = _col(c)
        if isinstance(df.schema[c].dataType, IntegralType):
            parts.append(cell.cast("string"))  # no folding changes a whole number
            continue
        if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
            text = F.when((cell == F.floor(cell)) & (F.abs(cell) < 1e15), cell.cast("long").cast("string")).otherwise(cell.cast("string"))
        else:
            text = F.regexp_replace(cell.cast("string"), r"^(-?\d+)\.0+$", "$1")
        text = {"exact": lambda t: t, "trim": lambda t: folded(nfkc(t)), "url": url_key, "text": normalized_key}[mode](text)
        text = F.lower(text) if ignore_case else text
        parts.append(F.get(F.transform(F.array(text), lambda t: F.when(F.trim(t) != "", t)), F.lit(0)))  # the text is worked out once
    if len(parts) == 1:
        return parts[0]
    return F.get(F.transform(F.array(F.array(*parts)), lambda p: F.when(F.forall(p, lambda x: x.isNotNull()), F.array_join(p, "\u001f"))), F.lit(0))


def anti_join(df: DataFrame, other: DataFrame, left_on: str, right_on: str = "", mode: str = "exact", keep: str = "exclude", ignore_case: bool = False, swap_tables: bool = False) -> DataFrame:
    """Rows of ``df`` whose key is not (``exclude``) or is (``keep``) among the other table's; blank keys match nothing.

    Keys are comma-separated columns. ``mode``: ``exact``, ``trim`` (white space folded),
    ``url`` (one spelling of an address), ``text`` (as normalised for duplicates).
    """
    op = "anti_join"
    need_one_of(op, "keep", keep, ("exclude", "keep"))
    if swap_tables:
        df, other, left_on, right_on = other, df, right_on or left_on, left_on
    ls, rs = [x.strip() for x in left_on.split(",")], [x.strip() for x in (right_on or left_on).split(",")]
    if len(ls) != len(rs):
        raise OpError(op, "right_on", f"{len(rs)} columns for {len(ls)} of left_on")
    need_columns(op, "left_on", df, ls)
    need_columns(op, "right_on", other, rs)
    if mode == "text":  # costly: by all tasks
        df, other = spread(df), spread(other)
    keys = other.select(match_key(other, rs, mode, ignore_case).alias("__key")).distinct()
    keys = (checkpoint(keys) if mode == "text" else keys).where("__key is not null")
    names = [f"d{i}" for i in range(len(df.columns))]
    rows = df.select(F.struct(*[_col(c).alias(n) for c, n in zip(df.columns, names, strict=True)]).alias("__row"), match_key(df, ls, mode, ignore_case).alias("__of"))
    found = rows.join(keys, F.col("__of") == F.col("__key"), "left_semi" if keep == "keep" else "left_anti")
    return found.select(*[F.col(f"__row.{n}").alias(c) for c, n in zip(df.columns, names, strict=True)])


def reply_graph(df: DataFrame, author_col: str, article_col: str, floor_col: str, parent_col: str, order_by: str | None = None) -> DataFrame:
    """``(source, target, weight)``: how often an author replies to another one within an article.

    The first author of a floor (least ``order_by``) counts; replies to oneself and to missing
    floors do not.
    """
    need_columns("reply_graph", "columns", df, [author_col, article_col, floor_col, parent_col, *([order_by] if order_by else [])])
    rows = df.select(_col(author_col).cast("string").alias("author"), _col(article_col).alias("article"), _col(floor_col).cast("string").alias("floor"), _col(parent_col).cast("string").alias("parent"), (_col(order_by) if order_by else F.lit(0)).alias("ord")).where("author is not null and author <> ''")
    tops = rows.where("floor is not null and (parent is null or parent = '')").groupBy("article", F.col("floor").alias("parent")).agg(F.min_by("author", F.struct("ord", "author")).alias("target"))
    replies = rows.where("parent is not null and parent <> ''").select("article", "parent", F.col("author").alias("source"))
    return replies.join(tops, ["article", "parent"]).where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")).orderBy(F.desc("weight"), "source", "target")


def verify(listed: DataFrame, result: DataFrame, left_on: str, right_on: str, expected_col: str = "", mode: str = "exact", tolerance: int = 0, per_link_limit: int = 0, output_mode: str = "all") -> DataFrame:
    """The list with what was collected for each key: expected, collected, gap, completion in percent, status.

    status: ``complete``, ``incomplete``, ``missing``, ``excess``, or ``unverifiable`` without a
    key or an expected number. ``gaps`` keeps all but complete rows.
    """
    op = "verify"
    need_one_of(op, "output_mode", output_mode, ("all", "gaps"))
    need_columns(op, "left_on", listed, [left_on, *([expected_col] if expected_col else [])])
    need_columns(op, "right_on", result, [right_on])
    counts = result.select(match_key(result, [right_on], mode).alias("__key")).where("__key is not null").groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    key = match_key(listed, [left_on], mode)
    expected = _col(expected_col).try_cast("long") if expected_col else F.lit(None).cast("long")
    expected = F.least(expected, F.lit(per_link_limit)) if per_link_limit else expected
    out = listed.withColumn("__of", key).withColumn("expected", expected).join(counts, F.col("__of") == F.col("__key"), "left")
    out = out.withColumn("collected", F.coalesce("__n", F.lit(0)))
    gap = F.col("expected") - F.col("collected")
    out = out.withColumn("gap", gap).withColumn("completion", F.when(F.col("expected") > 0, F.round(F.col("collected") * 100.0 / F.col("expected"), 2)))
    status = F.when(F.col("__of").isNull(), "unverifiable").when((F.col("collected") == 0) & (F.coalesce("expected", F.lit(1)) > 0), "missing").when(F.col("expected").isNull(), "unverifiable").when(F.col("gap") > tolerance, "incomplete").when(F.col("gap") < -tolerance, "excess").otherwise("complete")
    out = out.withColumn("status", status).drop("__of", "__key", "__n")
    return out.where("status <> 'complete'") if output_mode == "gaps" else out


def diff(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows that differ over the shared columns: ``change`` is ``added`` or ``removed``, as often as the row;
    with keys also ``changed``, with the new values and the names of the changed columns."""
    shared = [c for c in before.columns if c in after.columns]
    if not shared:
        raise OpError("diff", "after", "the tables share no column")
    need_columns("diff", "keys", before.select(*map(_col, shared)), keys or [])
    a, b = before.select(*map(_col, shared)), after.select(*map(_col, shared))
    if not keys:
        return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))
    rest = [c for c in shared if c not in keys]
    x, y = a.select(F.struct(*map(_col, shared)).alias("a"), *[_col(k).alias(f"ka{i}") for i, k in enumerate(keys)]), b.select(F.struct(*map(_col, shared)).alias("b"), *[_col(k).alias(f"kb{i}") for i, k in enumerate(keys)])
    test = F.lit(True)
    for i in range(len(keys)):
        test = test & F.col(f"ka{i}").eqNullSafe(F.col(f"kb{i}"))
    both = x.join(y, test, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col("a")[c].eqNullSafe(F.col("b")[c]), F.lit(c)) for c in rest])) if rest else F.array().cast("array<string>")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return both.withColumn("change", kind).where("change is not null").select(*[F.coalesce(F.col("b")[c], F.col("a")[c]).alias(c) for c in shared], "change", F.when(F.col("change") == "changed", F.array_join(changed, ",")).otherwise("").alias("columns"))


def compare_snapshots(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Figures of two captures by key: ``before, after, delta, change`` (``new``, ``gone``, ``up``, ``down``, ``same``)."""
    need_columns("compare_snapshots", "columns", before, [*keys, value])
    need_columns("compare_snapshots", "columns", after, [*keys, value])
    a = before.groupBy(*map(_col, keys)).agg(F.sum(_col(value)).alias("before"))
    b = after.groupBy(*map(_col, keys)).agg(F.sum(_col(value)).alias("after"))
    x, y = F.col("before"), F.col("after")
    kind = F.when(x.isNull(), "new").when(y.isNull(), "gone").when(y > x, "up").when(y < x, "down").otherwise("same")
    return a.join(b, keys, "full_outer").withColumn("delta", F.coalesce(y, F.lit(0)) - F.coalesce(x, F.lit(0))).withColumn("change", kind)


def lookup(df: DataFrame, column: str, aliases: DataFrame, alias_col: str, value_col: str, new_col: str) -> DataFrame:
    """The value of a cell in an alias table, compared without case and outer space; null without one.

    Several rows of one alias give the least value. Spark broadcasts the table if it is small.
    """
    need_columns("lookup", "column", df, [column])
    need_columns("lookup", "aliases", aliases, [alias_col, value_col])
    fold = lambda c: F.lower(folded(c.cast("string")))
    table = aliases.groupBy(fold(_col(alias_col)).alias("__alias")).agg(F.min(_col(value_col)).alias(new_col))
    return df.drop(new_col).join(table, fold(_col(column)) == F.col("__alias"), "left").drop("__alias")


def merge_tables(tables: list[DataFrame], names: list[str] | None = None, source_col: str = "source_name") -> DataFrame:
    """All rows of tables with equal sets of columns, in the first one's order; with names, where each row is from."""
    op = "merge_tables"
    if len(tables) < 2:
        raise OpError(op, "tables", "give two tables at least")
    for k, t in enumerate(tables[1:], 2):
        if set(t.columns) != set(tables[0].columns):
            odd = sorted(set(t.columns) ^ set(tables[0].columns))
            raise OpError(op, "tables", f"table {k} differs in the columns {', '.join(odd)}")
    stamped = [t.withColumn(source_col, F.lit(n)) if names and source_col not in t.columns else t for t, n in zip(tables, names or tables, strict=True)]
    out = stamped[0]
    for t in stamped[1:]:
        out = out.unionByName(t)
    return out


def fuse(tables: list[DataFrame], fields: dict[str, list[str]], names: list[str], id_fields: list[str]) -> DataFrame:
    """Tables of different shape as one: each field is the first of its candidate columns that a table has.

    ``record_id`` is the SHA-1 of the id fields and the number of the occurrence among equal ones; ``origin`` names the table.
    """
    need_columns("fuse", "id_fields", tables[0].sparkSession.createDataFrame([], ",".join(f"`{f}` string" for f in fields)), id_fields)
    parts = []
    for t, n in zip(tables, names, strict=True):
        found = {f: [c for c in candidates if c in t.columns] for f, candidates in fields.items()}
        parts.append(t.select(*[(F.coalesce(*[F.nullif(F.trim(_col(c).cast("string")), F.lit("")) for c in cs]) if cs else F.lit(None).cast("string")).alias(f) for f, cs in found.items()], F.lit(n).alias("origin")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    content = F.sha1(F.concat_ws("\u001e", *[F.coalesce(_col(f), F.lit("")) for f in id_fields]))
    out = out.withColumn("__content", content)
    nth = F.row_number().over(Window.partitionBy("__content").orderBy("origin", *map(_col, fields)))
    return out.withColumn("record_id", F.concat_ws("-", F.substring("__content", 1, 16), nth)).drop("__content")
