"""Joins of many rows with a table of one row a key, whatever the number of rows that share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the table that are broadcast (some 20 to 60 bytes each).
BROADCAST_ROWS = 300_000
#: Rows of a key that meet in one task; keys with more are dealt out. At least a part of all rows, so that few keys have more.
HOT_ROWS, HOT_PART = 50_000, 100_000


def join_table(rows: DataFrame, table: DataFrame, key: str, sizes: DataFrame, table_rows: int, all_rows: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each value of ``key``; null keys match nothing.

    ``sizes`` is ``(key, n)`` with the number of rows of each key; ``table_rows`` and ``all_rows``
    bound the rows of the table and of ``rows``. Up to ``BROADCAST_ROWS`` the table is broadcast.
    Beyond, a shuffle join deals each key with over ``HOT_ROWS`` rows out to several tasks, each
    with a copy of the table's row; at most ``HOT_PART`` keys have so many, and they are broadcast.
    """
    if table_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key)
    most = max(HOT_ROWS, all_rows // HOT_PART)
    hot = F.broadcast(sizes.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("__parts")))
    dealt = rows.join(hot, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(F.spark_partition_id(), *rows.columns), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    copies = table.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copies, [key, "__part"]).drop("__part")
