"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number in (0, 1) from the hash of key and shard, and the shard with the
least ``-ln(number) / weight`` takes the record. A further shard takes records only into
itself, and a shard's part of all keys is its part of the weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.errors import OpError, need_columns
from weft.runtime import checkpoint

#: Rows that one task numbers, about.
CELL_ROWS = 100_000
#: Equal rows numbered from one row of the table of groups.
REPEAT_ROWS = 10_000


def _score(key, shard: int, weight: float):
    bits = F.conv(F.substr(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), F.lit(1), F.lit(13)), 16, 10).cast("double")
    return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))


def shard_of(key, weights: list[float]):
    """The shard (0 to ``len(weights) - 1``) of a key Column; a null key is as the empty text."""
    if not weights or any(w <= 0 for w in weights):
        raise OpError("shard", "weights", f"{weights!r} must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    best = F.array_min(F.array(*[_score(text, i, w) for i, w in enumerate(weights)]))
    return best["shard"]


def assign_shards(docs: DataFrame, id_col: str = "doc_id", weights: list[float] | None = None, shard_col: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row; a column of that name is replaced.

    Rows with equal keys share a shard. No shuffle: the key alone decides.
    """
    need_columns("shard", "id_col", docs, [id_col])
    return docs.withColumn(shard_col, shard_of(F.col(id_col), weights or [1.0] * 8))


def number_slots(rows: DataFrame, shard_col: str = "shard", id_col: str = "doc_id", slot_col: str = "slot") -> DataFrame:
    """``rows`` with a slot from 0 without gaps in each shard, ordered by hash of the key, then by all columns.

    Equal rows are counted first, so that a key with a large part of all rows is one group.
    Groups are numbered in cells of the hash order, and a running sum over the small table of
    cells puts the cells one behind the other; no task sees a whole shard. Give it slim rows:
    keys and figures, not texts.
    """
    need_columns("number_slots", "columns", rows, [shard_col, id_col])
    columns = rows.columns
    groups = checkpoint(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    total = groups.agg(F.sum("__n").alias("n"), F.max("__n").alias("most")).first()
    digits = next(d for d in range(2, 9) if 16**d * CELL_ROWS >= (total["n"] or 0) or d == 8)
    groups = groups.withColumn("__cell", F.substr(F.col("__h"), F.lit(1), F.lit(digits)))
    cells = groups.groupBy(shard_col, "__cell").agg(F.sum("__n").alias("__n"))
    before = Window.partitionBy(shard_col).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col(shard_col).alias("__shard"), F.col("__cell").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(shard_col, "__cell").orderBy("__h", *columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("__at", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    placed = placed.join(starts, (F.col(shard_col) == F.col("__shard")) & (F.col("__cell") == F.col("__of"))).withColumn("__at", F.col("__at") + F.col("__start"))
    if (total["most"] or 0) > REPEAT_ROWS:
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(REPEAT_ROWS).cast("long")))
        placed = placed.withColumn("__part", part).withColumn("__n", F.least(F.col("__n") - F.col("__part"), F.lit(REPEAT_ROWS))).withColumn("__at", F.col("__at") + F.col("__part"))
        placed = placed.repartition(F.col(shard_col), F.col("__at"))
    return placed.select(*[c for c in columns if c != slot_col], F.explode(F.sequence(F.col("__at"), F.col("__at") + F.col("__n") - 1)).alias(slot_col))
