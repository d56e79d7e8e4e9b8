"""Texts as blocks of numbered words: figures as by plain counting, and what is shuffled."""

import collections
import itertools
import math

import pytest

from weft.operators import blocks as B
from weft.operators import text as T

WORDS = [f"zq{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
#: Texts of all lengths: none, one word, fewer than a window, many; pairs differ in nearly all places.
TEXTS = [None, "", "alone", "zqaa zqab", "zqab zqab zqab"] + [" ".join(WORDS[(k * k * 7 + i * (k % 11 + 1) + i * i) % 300] for i in range(k % 90)) for k in range(150)]


def shuffled_records(spark, run):
    """Rows that ``run`` wrote into shuffles."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    none = lambda: jvm.java.util.ArrayList()

    def total():
        stages = store.stageList(none(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before, out = total(), run()
    return out, sum(n for k, n in total().items() if k not in before)


def near(words, span):
    return [(a, b) for i, a in enumerate(words) for b in words[i + 1 : i + span] if a != b]


@pytest.mark.parametrize("slice_words", [120, 1 << 20])
def test_text_rank_writes_no_table_of_pairs(spark, monkeypatch, slice_words):
    monkeypatch.setattr(B, "SLICE_WORDS", slice_words)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").coalesce(1)
    weights = collections.Counter()
    for t in TEXTS:
        for a, b in near((t or "").split(), 5):
            weights[a, b] += 1
            weights[b, a] += 1
    out = collections.Counter()
    for (a, _), n in weights.items():
        out[a] += n
    rank = dict.fromkeys(out, 1 / len(out))
    for _ in range(2):
        new = dict.fromkeys(out, 0.15 / len(out))
        for (a, b), n in weights.items():
            new[b] += 0.85 * rank[a] * n / out[a]
        rank = new
    got, records = shuffled_records(spark, lambda: T.text_rank(df, "text", top_k=1000, rounds=2).collect())
    assert {r["word"]: r["score"] for r in got} == pytest.approx(rank)
    assert records < len({tuple(sorted(p)) for p in weights}), records


@pytest.mark.parametrize("window", [0, 4])
def test_cooccurrence_shuffles_no_row_a_word_of_a_text(spark, window):
    texts = TEXTS * 8
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    split = [[w for w in (t or "").split()] for t in texts]
    n, has = sum(bool(t) for t in split), collections.Counter(w for t in split for w in set(t))
    weight = collections.Counter()
    for t in split:
        raw = {w: k * (math.log((1 + n) / (1 + has[w])) + 1) for w, k in collections.Counter(t).items()}
        for w, x in raw.items():
            weight[w] += x / math.sqrt(sum(y * y for y in raw.values()))
    top = sorted(weight, key=lambda w: (-round(weight[w], 9), w))[:30]
    wanted = collections.Counter()
    for t in split:
        for unit in [t[i : i + window] for i in range(max(len(t) - window + 1, 1))] if window else [t]:
            wanted.update(itertools.combinations(sorted(set(unit) & set(top)), 2))
    got, records = shuffled_records(spark, lambda: T.cooccurrence(df, "id", "text", window=window).collect())
    assert {(r["a"], r["b"]): r["count"] for r in got} == {k: c for k, c in wanted.items() if c >= 2}
    assert records < sum(has.values()), records


def test_rows_of_one_id_are_one_text(spark):
    df = spark.createDataFrame([(1, "red blue"), (1, "red green"), (2, "blue grey")], "id int, text string")
    joined = spark.createDataFrame([(1, "red blue red green"), (2, "blue grey")], "id int, text string")
    a, b = ({r["word"]: r["weight"] for r in T.keywords(x, "id", "text").collect()} for x in (df, joined))
    assert a == pytest.approx(b)
