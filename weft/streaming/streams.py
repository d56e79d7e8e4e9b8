"""Structured Streaming forms: keyed dedupe, windowed counts, accumulation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.errors import need_columns, need_one_of, need_positive
from weft.functions.scalars import url_key
from weft.sources.sinks import Lineage


def with_item_key(df: DataFrame, id_col: str = "", url_col: str = "", content_cols: list[str] = ()) -> DataFrame:
    """``item_key``: the site's id, else one spelling of the address, else a hash of the content."""
    need_columns("item_key", "columns", df, [c for c in (id_col, url_col, *content_cols) if c])
    parts = []
    if id_col:
        parts.append(F.nullif(F.trim(F.col(id_col).cast("string")), F.lit("")))
    if url_col:
        parts.append(url_key(F.col(url_col)))
    if content_cols:
        parts.append(F.sha1(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content_cols])))
    return df.withColumn("item_key", F.coalesce(*parts))


def first_seen(stream: DataFrame, keys: list[str], time_col: str = "", late: str = "1 day") -> DataFrame:
    """Rows whose keys were not seen before. With a time column, keys are forgotten ``late`` after; without one the state grows with the keys."""
    need_columns("first_seen", "keys", stream, keys)
    if time_col:
        return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def windowed_counts(stream: DataFrame, time_col: str, kind: str = "tumbling", size: str = "1 day", slide: str = "", late: str = "1 hour", by: list[str] = ()) -> DataFrame:
    """``(start, end, *by, n)`` over tumbling, sliding or session windows; rows later than ``late`` do not count. Batch tables give the same counts."""
    need_columns("windowed_counts", "columns", stream, [time_col, *by])
    need_one_of("windowed_counts", "kind", kind, ("tumbling", "sliding", "session"))
    rows = stream.withWatermark(time_col, late) if stream.isStreaming else stream
    w = F.session_window(time_col, size) if kind == "session" else F.window(time_col, size, slide or None) if kind == "sliding" else F.window(time_col, size)
    return rows.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def accumulate(stream: DataFrame, lineage: Lineage, checkpoint: str, name: str = "accumulate"):
    """Add each micro-batch to a cumulative dataset until the source is drained; a batch that is run again adds nothing twice."""
    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: lineage.append(batch) and None).start()


def drain(stream: DataFrame, path: str, checkpoint: str, max_records_per_file: int = 0):
    """Write what a source has now as Parquet parts; a later call goes on where this one stopped."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True)
    return (writer.option("maxRecordsPerFile", max_records_per_file) if max_records_per_file else writer).start()


def newest(seen: DataFrame, key_col: str, scope: list[str] = ()) -> DataFrame:
    """``(*scope, newest)``: the greatest key that each scope has seen; without rows there is none."""
    need_columns("newest", "columns", seen, [key_col, *scope])
    return seen.groupBy(*scope).agg(F.max(key_col).alias("newest")).where("newest is not null")


def newer_than(df: DataFrame, marks: DataFrame, key_col: str, scope: list[str] = ()) -> DataFrame:
    """Rows whose key is above the newest one seen of their scope; all rows of scopes that were not seen. Null keys go where the scope was seen."""
    need_columns("newer_than", "columns", df, [key_col, *scope])
    names = [f"__scope{i}" for i in range(len(scope))]
    marks = marks.select(*[F.col(c).alias(n) for c, n in zip(scope, names, strict=True)], F.col("newest").alias("__newest"))
    test = F.lit(True)
    for c, n in zip(scope, names, strict=True):
        test = test & F.col(c).eqNullSafe(F.col(n))
    both = df.join(marks if scope else F.broadcast(marks), test, "left")  # without a scope one row
    return both.where(F.col("__newest").isNull() | (F.col(key_col) > F.col("__newest"))).select(*df.columns)


def busiest(stream: DataFrame, key_col: str, time_col: str, minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """``(key, peak)``: the most rows of a key within any ``minutes``, again each time that it grows; the greatest of a key is its peak.

    A key's state are its times within ``minutes`` of the watermark, and a timer takes the key away once no further row can
    come near them, so the state is bounded by what ``late`` lets in. Run it with the RocksDB state store. Rows without a key
    or a time do not count.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    need_columns("busiest", "columns", stream, [key_col, time_col])
    need_positive("busiest", "minutes", minutes)
    span = minutes * 60  # seconds, the ends of a span counted
    kind = dict(stream.dtypes)[key_col]
    rows = stream.select(F.col(key_col).alias("key"), F.col(time_col).alias("at")).where("key is not null and at is not null").withWatermark("at", late)

    class Peak(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("state", "times array<bigint>, peak bigint")

        def handleInputRows(self, key, rows, timerValues):
            times, peak = self.state.get() if self.state.exists() else ([], 0)
            times = sorted([*times, *(int(t.value // 1_000_000_000) for pdf in rows for t in pd.to_datetime(pdf["at"]))])
            first, most = 0, peak
            for i, t in enumerate(times):
                while times[first] < t - span:
                    first += 1
                most = max(most, i - first + 1)
            edge = timerValues.getCurrentWatermarkInMs() // 1000 - span
            self.state.update(([t for t in times if t >= edge], most))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max((times[-1] + span + 1) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
            if most > peak:
                yield pd.DataFrame({"key": [key[0]], "peak": [most]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.state.clear()
            yield from ()

        def close(self) -> None:
            pass

    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Peak(), outputStructType=f"key {kind}, peak bigint", outputMode="Update", timeMode="EventTime")
