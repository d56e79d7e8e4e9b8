"""What a task holds and how often a row is copied, whatever the number of rows."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_blocks import shuffled_records

from weft.functions import texts
from weft.operators import dense
from weft.operators.places import affiliation_countries


def test_normal_forms_hold_some_texts_at_a_time():
    wide = pa.array(["Ａé" * 5_000 + str(i) for i in range(3_000)] + [None])
    tracemalloc.start()
    got = texts.nfkc.func(wide)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3_001 and got[7].as_py() == "Aé" * 5_000 + "7" and got[3_000].as_py() is None and len(texts.nfkc.func(wide.slice(0, 0))) == 0
    assert peak < 12_000_000, peak


def test_vectors_are_copied_to_a_bounded_number_of_blocks(spark):
    rows = spark.range(2_000).withColumn("u", dense.unit(F.array(*[(F.xxhash64("id", F.lit(i)) % 1_009).cast("double") for i in range(4)]))).withColumn("n", F.lit(1).cast("long")).withColumn("flag", F.lit(True))
    got, records = shuffled_records(spark, lambda: dense.figures(rows, -1.0, "near", block_rows=16).groupBy("id").agg(F.sum("n").alias("n")).collect())
    assert len(got) == 2_000 and {r["n"] for r in got} == {1_999}
    assert records < 2_000 * 3 * dense.BLOCKS, records


@pytest.mark.parametrize("most", [10, 0])
def test_addresses_do_not_meet_by_spelling(spark, monkeypatch, most):
    from weft.operators import places, skew

    monkeypatch.setattr(places, "BROADCAST_ROWS", most)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", most)
    aliases = spark.createDataFrame([("utopia", "U"), ("new utopia", "N")], "alias string, country string")
    df = spark.range(500).select("id", F.when(F.col("id") % 2 == 0, "Lab, Utopia").otherwise("Lab, New Utopia; Dept, utopia.").alias("cell"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = affiliation_countries(df, "id", "cell", aliases)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r["countries"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(got[i] == (["U"] if i % 2 == 0 else ["N", "U"]) for i in range(500))
    assert ("BroadcastHashJoin" in plan) and ("__part" in plan) == (most == 0)
