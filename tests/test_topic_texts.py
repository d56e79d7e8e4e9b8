"""Topics over texts that are cut into words once for all models."""

import pytest
from pyspark.sql import functions as F
from test_text_models import texts, watched

from weft.operators import topics as TP


def test_topics_cut_texts_once_for_all_models(spark):
    df, seen = watched(spark, texts(60))
    got = TP.topic_coherence(df, "id", "text", [2, 3, 4], topn=3, rounds=2).collect()
    assert [r["k"] for r in got] == [2, 3, 4] and seen.value == 60
    df, seen = watched(spark, texts(60))
    assert len(TP.topic_map(df, "text", 3, rounds=2).collect()) == 3 and seen.value == 60


def test_coherence_of_a_model_is_that_of_its_keywords(spark):
    df = spark.createDataFrame([*texts(40), (3, "apple iron", "f"), (90, "", "m"), (91, None, "m")], "id long, text string, side string")
    got = {r["k"]: r["coherence"] for r in TP.topic_coherence(df, "id", "text", [2], topn=4, rounds=3).collect()}
    keywords = TP.topic_model(df, "text", 2, topn=4, rounds=3)
    assert got[2] == pytest.approx(TP.npmi(df, "id", "text", keywords.select("topic", "keyword")).agg(F.avg("coherence")).first()[0])
