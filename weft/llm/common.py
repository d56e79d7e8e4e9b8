"""Helpers of the training-data operators."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a Python worker handles at a time, whatever the Arrow batch holds.
CHUNK_BYTES = 4 << 20
#: Ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def texts_of(column: pa.Array):
    """The UTF-8 bytes of each row, None for null, without decoding to str."""
    return column.cast(pa.large_binary()).to_pylist() if not pa.types.is_large_binary(column.type) else column.to_pylist()


def slices(batch: pa.RecordBatch, text: int, most: int = CHUNK_BYTES):
    """Cut a batch so that each part holds about ``most`` bytes of text (one row at least)."""
    sizes = np.fromiter((0 if x is None else x for x in pc.binary_length(batch.column(text)).to_pylist()), np.int64, batch.num_rows)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def schema_with(df: DataFrame, *fields: StructField) -> StructType:
    """``df``'s schema with ``fields`` added; a field of the same name is replaced."""
    new = {f.name.lower() for f in fields}
    return StructType([f for f in df.schema.fields if f.name.lower() not in new] + list(fields))


def field(df: DataFrame, name: str, alias: str | None = None) -> StructField:
    return StructField(alias or name, df.schema[name].dataType)


def fold(key, parts: int):
    """crc32 of a key as text, modulo ``parts``, as a Column."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def crc(key: object) -> int:
    return zlib.crc32(str(key).encode())


def text_key(text):
    """MD5 of a text Column; a null text is as an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def named_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` with a struct as the id, in the order of ids, those without one last: ``(missing, id, key)``, key being ``text_key``."""
    return docs.select(F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key")).alias("id"), F.col(text_col).alias("text"))


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, most: int = BROADCAST_IDS) -> DataFrame:
    """One row of ``docs`` for each group: that with the smallest id, of equal or missing ids the first by text, of equal texts any.

    ``groups`` is ``(id, component_id)`` for each row, with ids as in ``named_texts`` and the smallest one of the
    group; it is read several times. Rows leave by id and text. Up to ``most`` pairs are broadcast.
    """
    names, plain = docs.columns, docs.toDF(*[f"d{i}" for i in range(len(docs.columns))])
    key, text = (F.col(f"d{names.index(c)}") for c in (id_col, text_col))
    first = F.col("id.id").eqNullSafe(F.col("component_id.id"))
    gone = groups.where(~first).select("id").distinct()
    if groups.groupBy("id.id").count().where("count > 1").isEmpty():
        few = gone.count() <= most
        gone = gone.select(F.col("id.id").alias("gone"))
        return plain.join(F.broadcast(gone) if few else gone, key.eqNullSafe(F.col("gone")), "left_anti").toDF(*names)
    pairs = groups.where(first).groupBy("id", "component_id").agg(F.count(F.lit(1)).alias("n"))
    many = pairs.groupBy("component_id").agg(F.sum("n").alias("rows")).where("rows > 1").select("component_id")
    shared = pairs.join(F.broadcast(many) if many.count() <= most else many, "component_id", "left_semi").select("id", "component_id")

    def of(table):
        table = table.withColumnRenamed("id", "of")
        return F.broadcast(table) if table.count() <= most else table

    same = key.eqNullSafe(F.col("of.id")) & (text_key(text) == F.col("of.key"))
    alone = plain.join(of(gone.unionByName(shared.select("id"))), same, "left_anti")
    chosen = plain.join(of(shared), same).groupBy("component_id").agg(F.min_by(F.struct(*plain.columns), F.struct(text)).alias("row"))
    return alone.unionByName(chosen.select("row.*")).toDF(*names)


def word_count(text):
    r"""How many ``[^\x20\x09-\x0D]+`` a text Column has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
