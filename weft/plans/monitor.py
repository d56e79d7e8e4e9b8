"""What runs did, as rows: counts of workflow nodes taken while they run, and the batches and failures of streams."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from weft.errors import need_columns


def _done(found: Observation) -> bool:
    """Whether the counts are there; ``get`` would wait for a job that may never come."""
    return found._jo is not None and found._jo.future().isCompleted()


#: Seconds that ``Monitor.rows`` waits at most for counts of jobs that have ended.
WAIT_S = 60


class Monitor:
    """Counts rows as they pass through nodes, in the jobs that need them anyway; no pass is added.

    ``watch`` before a job, ``rows`` after it. A node counts for the first job that runs it whole.
    """

    def __init__(self):
        self.seen: dict[str, list] = {}

    def watch(self, node: str, df: DataFrame, nulls: list[str] = ()) -> DataFrame:
        """``df``, counted when a job runs it, with the nulls of the named columns."""
        need_columns("monitor", "nulls", df, nulls)
        found = Observation()
        self.seen[node] = [found, list(nulls)]
        missing = [F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(nulls)]
        return df.observe(found, F.count(F.lit(1)).alias("rows"), *missing)

    def _arrived(self, spark: SparkSession) -> None:
        """Spark hands counts over after their job, in the order of the jobs: those of all earlier ones are there when those of one more are."""
        last = Observation()
        spark.range(1).observe(last, F.count(F.lit(1)).alias("rows")).collect()
        end = time.monotonic() + WAIT_S
        while not _done(last) and time.monotonic() < end:
            time.sleep(0.01)

    def rows(self, spark: SparkSession) -> DataFrame:
        """``(node, state, rows, nulls)``: ``done`` with the count and the nulls by column, or ``waiting`` for nodes that no job has run."""
        if any(not _done(found) for found, _ in self.seen.values()):
            self._arrived(spark)
        out = []
        for node, (found, nulls) in self.seen.items():
            done = _done(found)
            got = found.get if done else {}
            out.append((node, "done" if done else "waiting", got.get("rows"), {c: got.get(f"n{i}") or 0 for i, c in enumerate(nulls)} if done else None))
        return spark.createDataFrame(out, "node string, state string, rows bigint, nulls map<string,bigint>")


class StreamMonitor(StreamingQueryListener):
    """Batches of streams and how they ended. Add it with ``spark.streams.addListener``; ``rows`` may be asked at any time."""

    def __init__(self, most: int = 100_000):
        self.most, self._events, self._names, self._lock = most, [], {}, threading.Lock()

    def _add(self, *event) -> None:
        with self._lock:
            self._events.append(event)
            del self._events[: -self.most]  # the newest ones stay

    def onQueryStarted(self, event):
        self._names[str(event.runId)] = event.name
        self._add(event.name, "started", None, None, None)

    def onQueryProgress(self, event):
        self._add(event.progress.name, "batch", event.progress.batchId, event.progress.numInputRows, None)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._add(self._names.get(str(event.runId)), "failed" if event.exception else "ended", None, None, event.exception)

    def rows(self, spark: SparkSession) -> DataFrame:
        """``(stream, event, batch, rows, reason)`` in the order of what happened."""
        with self._lock:
            return spark.createDataFrame(list(self._events), "stream string, event string, batch bigint, rows bigint, reason string")
