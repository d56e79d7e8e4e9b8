"""Words of Han text: planted corpora cut again, best paths against all paths, counts against plain loops."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from weft.errors import OpError
from weft.functions.texts import tokens
from weft.operators import segment, text

HAN = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]


def planted(seed, n_words=250, n_texts=4000):
    rng = random.Random(seed)
    vocabulary = list({"".join(rng.choice(HAN) for _ in range(rng.choice([1, 2, 2, 2, 3, 4]))) for _ in range(n_words)})
    weights = [1 / (i + 5) for i in range(len(vocabulary))]
    texts = [rng.choices(vocabulary, weights, k=rng.randint(4, 25)) for _ in range(n_texts)]
    return vocabulary, texts


def spans(cut):
    ends = list(itertools.accumulate(map(len, cut)))
    return set(zip([0, *ends], ends, strict=False))


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_words_are_found(spark, seed):
    _, texts = planted(seed)
    df = spark.createDataFrame([(i, "".join(t)) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["words"] for r in segment.cut_words(df, "text").collect()}
    assert all("".join(got[i]) == "".join(t) for i, t in enumerate(texts))
    right = sum(len(spans(got[i]) & spans(t)) for i, t in enumerate(texts))
    f1 = 2 * right / (sum(len(t) for t in texts) + sum(map(len, got.values())))
    assert f1 > 0.9, f1
    top = text.word_counts(df, "text", 20, lexicon="learned").collect()
    true = collections.Counter(w for t in texts for w in t if len(w) >= 2)
    assert len({r["word"] for r in top} & {w for w, _ in true.most_common(25)}) >= 18
    assert {r["word"] for r in text.keywords(df, "id", "text", 10, lexicon="learned").collect()} <= set(true)


def test_lexicon_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(segment, "PIECE", 5)
    rng = random.Random(6)
    rows = ["".join(rng.choice("天地玄黄宇") for _ in range(rng.randint(0, 30))) + rng.choice(["", " abc ", "1"]) + "".join(rng.choice("天地玄") for _ in range(rng.randint(1, 12))) for _ in range(150)] + [None, "", "none here", "𠀀𠀁天" * 9]
    df = spark.createDataFrame([(r,) for r in rows], "text string").repartition(3)
    got = {r["word"]: (r["n"], r["cohesion"], r["freedom"]) for r in segment.learn_lexicon(df, "text", longest=3, min_count=4, min_cohesion=0.1, min_freedom=0.5).collect()}
    import regex

    n, near = collections.Counter(), collections.defaultdict(collections.Counter)
    for run in (x for r in rows for x in regex.findall(r"\p{Han}+", r or "")):
        for k in (1, 2, 3):
            for i in range(len(run) - k + 1):
                w = run[i : i + k]
                n[w] += 1
                near[w, 0][run[i - 1] if i else None] += 1
                near[w, 1][run[i + k] if i + k < len(run) else None] += 1
    total = sum(c for w, c in n.items() if len(w) == 1)

    def entropy(counts):
        size = sum(counts.values())
        each = [c for x, c in counts.items() if x is not None] + [1] * counts[None]
        return -sum(c / size * math.log(c / size) for c in each)

    wanted = {w: (c, None, None) for w, c in n.items() if len(w) == 1}
    for w, c in n.items():
        if len(w) > 1 and c >= 4:
            cohesion = min(math.log(c * total / (n[w[:k]] * n[w[k:]])) for k in range(1, len(w)))
            freedom = min(entropy(near[w, 0]), entropy(near[w, 1]))
            if cohesion >= 0.1 and freedom >= 0.5:
                wanted[w] = (c, cohesion, freedom)
    assert set(got) == set(wanted) and sum(len(w) > 1 for w in wanted) > 5
    for w, (c, a, b) in wanted.items():
        assert got[w][0] == c and (a is None or got[w][1:] == pytest.approx((a, b)))


def test_path_is_the_best_of_all():
    rng = random.Random(7)
    for _ in range(300):
        pool = {"".join(rng.choice("天地玄") for _ in range(rng.randint(1, 4))): rng.randint(1, 9) * 1000 for _ in range(9)}
        lexicon = segment.Lexicon(pool, 20_000, max(map(len, pool)))
        run = "".join(rng.choice("天地玄黄") for _ in range(rng.randint(1, 9)))
        ways = []
        for cuts in itertools.product([False, True], repeat=len(run) - 1):
            at = [0, *(i for i, c in enumerate(cuts, 1) if c), len(run)]
            parts = [run[a:b] for a, b in itertools.pairwise(at)]
            if all(len(p) == 1 or p in pool for p in parts):
                ways.append((sum(pool.get(p, 20_000) for p in parts), [-len(p) for p in reversed(parts)], parts))
        assert lexicon.cut(run) == min(ways)[2]


def test_segment_edges(spark):
    own = segment.Lexicon.of(spark.createDataFrame([("北京", 50), ("大学", 60), ("北京大学", 90), ("ABC词", 5), (None, 3), ("", 4), ("坏", 0)], "word string, n int"))
    df = spark.createDataFrame([("在北京大学见 Hello 北京x12",), (None,), ("",), ("no Han",), ("天" * 100_000,)], "text string").withColumn("words", F.lit(1))
    got = [r["words"] for r in segment.cut_words(df, "text", lexicon=own).collect()]
    assert got[:4] == [["在", "北京大学", "见", "hello", "北京", "x12"], None, [], ["no", "han"]] and got[4] == ["天"] * 100_000
    kept = df.select(tokens(F.col("text"), lexicon=own).alias("t")).first()["t"]
    assert kept == ["北京大学", "hello", "北京", "x12"]
    assert segment.learn_lexicon(df.where("text is null"), "text").count() == 0
    assert [r["words"] for r in segment.cut_words(df.where("text = 'no Han'"), "text").collect()] == [["no", "han"]]
    with pytest.raises(OpError):
        segment.learn_lexicon(df, "nothing")


def test_keywords_with_a_given_table(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma alpha")], "id int, text string")
    idf = spark.createDataFrame([("alpha", 2.0), ("beta", 4.0), ("delta", 3.0)], "word string, idf double")
    got = {(r["id"], r["word"]): r["weight"] for r in text.tf_idf(df, "id", "text", idf=idf).collect()}
    one, two = math.hypot(2, 8), math.hypot(3, 2)
    assert got == pytest.approx({(1, "alpha"): 2 / one, (1, "beta"): 8 / one, (2, "gamma"): 3 / two, (2, "alpha"): 2 / two})
