"""Classifiers over texts that are cut into words once, and terms counted in blocks of texts."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weft.functions.texts import tokens, words
from weft.operators import blocks as B
from weft.operators import stats as ST


def texts(n, seed=1):
    draw = random.Random(seed)
    sides = ["apple pear plum fig grape".split(), "iron zinc lead gold tin".split()]
    return [(i, " ".join(draw.choices(sides[i % 2], k=draw.randint(3, 12))), "fm"[i % 2]) for i in range(n)]


def watched(spark, rows):
    """The rows with a text that is counted each time that it is made."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf(StringType())
    def made(text):
        seen.add(1)
        return text

    df = spark.createDataFrame(rows, "id long, raw string, side string").repartition(3).select("id", made("raw").alias("text"), "side")
    return df, seen


def test_classifier_cuts_texts_once(spark):
    rows = texts(60)
    df, seen = watched(spark, rows)
    model = ST.train_classifier(df, "text", "side", 20)
    assert seen.value <= 3 * 60  # nulls are looked for, words are cut
    got = ST.classify(spark.createDataFrame([*rows, (99, None, None)], "id long, text string, side string"), "text", model).collect()
    assert all(r["label"] == r["side"] for r in got)


@pytest.mark.parametrize(("size", "span", "least"), [(5, 1, 1), (40, 1, 3), (7, 2, 1), (30, 2, 2), (10_000, 2, 1)])
def test_frequent_terms_against_counts(spark, size, span, least):
    draw = random.Random(size)
    rows = [" ".join(draw.choices([f"w{int(draw.paretovariate(0.7)) % 50}" for _ in range(8)], k=draw.randint(0, 30))) for _ in range(80)] + ["only " * 50, "", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string").repartition(7)
    blocks = B.encoded(df, words(F.col("t")), 1)
    n, of = collections.Counter(), collections.Counter()
    for r in rows:
        w = (r or "").split()
        terms = w if span == 1 else [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        n.update(terms)
        of.update(set(terms))
    want = sorted((t for t in n if of[t] >= least), key=lambda t: (-n[t], t))[:size]
    assert blocks.count() > 3 and B.frequent_terms(blocks, size, span, least) == want


def test_term_vectors_against_counts(spark):
    rows = [(i, t) for i, t in enumerate(["a b a b c", "", None, "c", "b a", "x y z"])]
    blocks = B.encoded(spark.createDataFrame(rows, "i long, t string").repartition(2), words(F.col("t")), 1, ["i"])
    got = {r["i"]: r["tf"].toArray().tolist() for r in B.term_vectors(blocks, [["a", "c", "none"], ["b a", "a b", "q q"]], ["i"]).collect()}
    assert got == {0: [2, 1, 0, 1, 2, 0], 1: [0] * 6, 2: [0] * 6, 3: [0, 1, 0, 0, 0, 0], 4: [1, 0, 0, 1, 0, 0], 5: [0] * 6}


def test_words_with_and_without_han_characters(spark):
    df = spark.createDataFrame([("The Größe of x2, ٣٤ İstanbul ΣΑΣ\tno_w",), ("数据data处理 a",), ("中",), ("か漢字 x",), ("",), (None,)], "t string")
    got = [r["w"] for r in df.select(words(F.col("t")).alias("w")).collect()]
    assert got == [["the", "größe", "of", "x2", "٣٤", "i̇stanbul".split("̇")[0], "stanbul", "σας", "no", "w"], ["数据", "data", "处理", "a"], ["中"], ["か", "漢字", "x"], [], None]
    assert [r["w"] for r in df.select(tokens(F.col("t")).alias("w")).collect()][0] == ["größe", "x2", "stanbul", "σας"]
