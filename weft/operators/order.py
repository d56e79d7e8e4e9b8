"""Sort, sample, page and top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.errors import OpError, need_columns, need_positive
from weft.runtime import checkpoint


def sort_rows(df: DataFrame, column: str, ascending: bool = True, ties: list[str] = ()) -> DataFrame:
    """Nulls last in either direction; rows of equal cells by ``ties``."""
    need_columns("sort_rows", "column", df, [column, *ties])
    c = F.col(f"`{column}`")
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *ties)


def sample_rows(df: DataFrame, n: int | None = None, frac: float | None = None, seed: int | None = None) -> DataFrame:
    """``n`` rows, else about the part ``frac``, by a hash of the whole row, so a rerun takes the same rows.

    Neither: all rows. Equal rows are counted first and draw by their number, each for itself.
    """
    if n is None and frac is None:
        return df
    if n is not None and n < 0:
        raise OpError("sample_rows", "n", f"{n} is under 0")
    if n is None and not 0 <= frac <= 1:
        raise OpError("sample_rows", "frac", f"{frac!r} is not from 0 to 1")
    names = [f"d{i}" for i in range(len(df.columns))]
    copies = df.toDF(*names).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.expr("sequence(1L, n)")))
    key = F.xxhash64(F.lit(0 if seed is None else seed), *[F.col(c).cast("string") for c in names], "copy")
    chosen = copies.orderBy(key).limit(n) if n is not None else copies.where(F.shiftrightunsigned(key, 11).cast("double") / float(1 << 53) < frac)
    return chosen.select(*names).toDF(*df.columns)


def numbered(df: DataFrame, order_by: list[str], number_col: str = "number") -> DataFrame:
    """``df`` with ``number_col``, from 1, in the given order (nulls first); equal rows in any order.

    Rows are range-partitioned and counted by partition, so no task sees more than its range.
    """
    need_columns("numbered", "order_by", df, order_by)
    keys = [F.col(f"`{c}`") for c in order_by]
    parts = checkpoint(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return parts.join(F.broadcast(starts), "__part").withColumn(number_col, rank + F.col("__start")).drop("__part", "__start")


def page(df: DataFrame, order_by: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given order."""
    need_columns("page", "order_by", df, order_by)
    return df.orderBy(*order_by).offset(offset).limit(limit)


def top_per_group(df: DataFrame, group_by: list[str], column: str, k: int, ties: list[str] = (), rank_col: str = "rank") -> DataFrame:
    """The ``k`` largest rows of each group with their rank from 1.

    Spark keeps ``k`` rows of a group in each task before the shuffle, so a large group is cheap.
    """
    need_columns("top_per_group", "columns", df, [*group_by, column, *ties])
    need_positive("top_per_group", "k", k)
    order = Window.partitionBy(*group_by).orderBy(F.desc_nulls_last(column), *ties)
    return df.withColumn(rank_col, F.row_number().over(order)).where(F.col(rank_col) <= k)
