"""What larger tables bring: late counts, calm series, many rows of one order, long ranks."""

import time

from compare import both
from pyspark.sql import Observation
from pyspark.sql import functions as F

from weft.operators import columns as C
from weft.operators import graph as G
from weft.plans import analysis_queries as Q

SMALL = "/root/testdata/sf0.001"


class Late(Observation):
    """Counts that are seen only from a moment on, as when Spark is slow to hand them over."""

    since = 0.0

    @property
    def _jo(self):
        real, late = self.__dict__.get("real"), self
        if real is None:
            return None

        class Seen:
            def future(self):
                return self

            def isCompleted(self):
                return time.monotonic() > late.since and real.future().isCompleted()

            def __getattr__(self, name):
                return getattr(real, name)

        return Seen()

    @_jo.setter
    def _jo(self, value):
        self.__dict__["real"] = value


def test_counts_that_come_late_are_waited_for(spark, monkeypatch):
    from weft.plans import monitor as M

    monkeypatch.setattr(M, "Observation", Late)
    monitor = M.Monitor()
    monitor.watch("kept", monitor.watch("in", spark.range(10)).where("id > 6")).collect()
    monitor.watch("unread", spark.range(3))
    Late.since = time.monotonic() + 2
    got = {r["node"]: (r["state"], r["rows"]) for r in monitor.rows(spark).collect()}
    assert got == {"in": ("done", 10), "kept": ("done", 3), "unread": ("waiting", None)}


def test_alert_of_a_calm_series_matches_its_sql(spark, tmp_path):
    for name in "region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    spark.read.parquet(f"{SMALL}/events.parquet").withColumn("value", F.lit(5.0)).coalesce(1).write.parquet(str(tmp_path / "once"))
    (tmp_path / "events.parquet").symlink_to(next((tmp_path / "once").glob("part-*.parquet")))
    mine, theirs = both(spark, Q.QUERIES["alert"], Q.ORACLES["alert"], str(tmp_path))
    assert mine == theirs and not mine[1]


def test_filling_backwards_takes_one_pass(spark):
    n = 400_000
    df = spark.range(n, numPartitions=1).select("id", F.lit(1).alias("g"), F.when(F.col("id") == n - 3, F.lit(7)).alias("v"))
    started = time.monotonic()
    for group in (None, ["g"]):
        filled = C.fill_null(df, ["v"], method="bfill", order_by=["id"], group_by=group)
        assert filled.where("v = 7").agg(F.count(F.lit(1)), F.max("id")).first() == (n - 2, n - 3)
    assert time.monotonic() - started < 60


def test_g_index_of_many_entities(spark):
    rows = spark.range(50_000).select(F.col("id").alias("doc"), F.col("id").alias("entity"), F.lit(2000).alias("year"))
    assert G.select_nodes(rows, "g_index", 3, "year").count() == 0  # a document each: g is 1 / 3
    assert G.select_nodes(rows, "g_index", 1, "year").count() == 1


def test_links_of_all_connect_as_all_pairs_do(spark):
    import numpy as np

    from weft.operators.components import connected_components
    from weft.operators.links import bits_within, links_of_all

    rng = np.random.default_rng(3)
    prints = np.unique(rng.integers(0, 1 << 30, 40)[rng.integers(0, 40, 900)] ^ (1 << rng.integers(0, 60, 900)) ^ (1 << rng.integers(0, 60, 900)))
    up = {x: x for x in prints.tolist()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in up:
        for y in up:
            if x < y and (x ^ y).bit_count() <= 6:
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(x,) for x in up], "fp long")
    links = links_of_all(df, bits_within(6), len(up), block_rows=40)
    got = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    want = {x: root(x) for x in up}
    alone = {x for x in up if list(want.values()).count(want[x]) == 1}
    assert got == {x: r for x, r in want.items() if x not in alone}


def test_a_key_normalises_its_text_once(spark):
    from weft.operators import joins as J

    df = spark.createDataFrame([("@a Some  words", "x"), ("", "y"), (None, "z"), ("Some words", " ")], "t string, u string")
    assert str(J.match_key(df, ["t"], "text")).count("nfkc") == 1
    found = df.select(J.match_key(df, ["t"], "text").alias("k"), J.match_key(df, ["t", "u"]).alias("two")).collect()
    assert found[0]["k"] == found[3]["k"] and [r["k"] is None for r in found] == [False, True, True, False]
    assert [r["two"] for r in found] == ["@a Some  words\u001fx", None, None, None]
    out = J.anti_join(df, df.where("u = 'x'"), "t", mode="text")
    assert out.columns == ["t", "u"] and sorted(r["u"] for r in out.collect()) == ["y", "z"]


def test_paths_carried_in_blocks(spark, monkeypatch):
    from itertools import combinations

    names = [f"n{i}" for i in range(12)]
    edges = [(a, b, 1 + (7 * i) % 9) for i, (a, b) in enumerate(combinations(names, 2)) if i % 5]
    near = {(x, y): (1 / w) ** 2 for a, b, w in edges for x, y in ((a, b), (b, a))}
    two, three = {}, {}
    for before, after in ((near, two), (two, three)):
        for (x, m), c in before.items():
            for y in names:
                if (m, y) in near and x != y:
                    after[x, y] = min(after.get((x, y), 9e9), c + near[m, y])
    want = {(a, b) for a, b, w in edges if (1 / w) ** 2 <= min(two.get((a, b), 9e9), three.get((a, b), 9e9)) * (1 + 1e-9)}
    monkeypatch.setattr(G, "SOURCES", 4)
    monkeypatch.setattr(G, "TASK_LINKS", 20)
    got = G.pathfinder(spark.createDataFrame(edges, "a string, b string, weight long"), r=2, lmax=3).collect()
    assert {(r["a"], r["b"]) for r in got} == want


def test_fingerprints_hold_few_texts_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from weft.operators import dedupe as D

    words = [f"word{i}" for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([[f"{w}" for w in words[i % 50 :]] for i in range(4000)], pa.list_(pa.string()))], names=["id", "w"])
    tracemalloc.start()
    sizes = [x.num_rows for x in D._fingerprints([batch])]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 4000 and most < 30e6
    assert D._votes("word1").nbytes == 64
