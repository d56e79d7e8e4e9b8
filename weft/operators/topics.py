"""Topic models and the tables drawn from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.errors import OpError, need_columns, need_positive
from weft.functions.scalars import divergence
from weft.functions.special import classical_mds
from weft.functions.texts import STOP_WORDS, tokens
from weft.operators import lda
from weft.runtime import checkpoint


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def counted_texts(df: DataFrame, column: str, vocabulary: int = 2000, min_df: int = 2, lexicon=(), keep: list[str] = ()) -> tuple[list[str], DataFrame]:
    """The words that stand most often in the texts, and ``keep`` and ``features`` (how often each stands there) of the texts with a word; ``lexicon`` says what words Han text has.

    Texts are cut into words once; words are counted in blocks of texts.
    """
    from weft.operators import blocks as B

    need_columns("topics", "column", df, [column, *keep])
    rows = df.select(tokens(F.coalesce(_col(column).cast("string"), F.lit("")), STOP_WORDS, lexicon=lexicon).alias("__words"), *map(_col, keep))
    rows = rows.withColumn("__some", F.size("__words") > 0)
    texts = B.encoded(rows, F.col("__words"), 1, ["__some", *keep])
    known = B.frequent_terms(texts, vocabulary, least_texts=min_df)
    if not known:
        raise OpError("topics", "column", f"no word stands in {min_df} texts")
    return known, checkpoint(B.term_vectors(texts, [known], ["__some", *keep], "features").where("__some").drop("__some"))


def fit_lda(df: DataFrame, column: str, k: int, vocabulary: int = 2000, min_df: int = 2, rounds: int = 10, seed: int = 42, lexicon=()):
    """``(words, model, rows with counts)`` of an LDA, each round over all texts; ``lexicon`` says what words Han text has."""
    need_positive("topics", "k", k)
    words, rows = counted_texts(df, column, vocabulary, min_df, lexicon)
    return words, lda.fit(rows, len(words), k, rounds, seed), rows


def topic_model(df: DataFrame, column: str, k: int = 5, topn: int = 10, **options) -> DataFrame:
    """``(topic, rank, keyword, weight)`` of an LDA."""
    words, model, _ = fit_lda(df, column, k, **options)
    found = [(t + 1, r, words[i], p) for t, best, parts in model.best(topn) for r, (i, p) in enumerate(zip(best, parts, strict=True), 1)]  # topn a topic
    return df.sparkSession.createDataFrame(found, "topic int, rank int, keyword string, weight double")


def topic_by_stage(df: DataFrame, column: str, stage_col: str, topics: int = 3, topn: int = 8, **options) -> DataFrame:
    """``(stage, topic, rank, keyword, weight)``: a model for each stage; the stages are few and named by one job."""
    need_columns("topic_by_stage", "columns", df, [column, stage_col])
    stages = [r[0] for r in df.select(_col(stage_col)).where(_col(stage_col).isNotNull()).distinct().orderBy(stage_col).limit(101).collect()]
    if not 1 <= len(stages) <= 100:
        raise OpError("topic_by_stage", "stage_col", f"{len(stages)} stages; 1 to 100 are needed")
    out = None
    for s in stages:
        part = topic_model(df.where(_col(stage_col) == F.lit(s)), column, topics, topn, **options).select(F.lit(s).alias("stage"), "topic", "rank", "keyword", "weight")
        out = part if out is None else out.unionByName(part)
    return out


def topic_map(df: DataFrame, column: str, k: int = 5, **options) -> DataFrame:
    """``(topic, x, y, prevalence)``: topics in the plane by the divergence of their words, and their part of all texts in percent."""
    _, model, rows = fit_lda(df, column, k, **options)
    p = model.parts()  # k rows of the vocabulary
    m = (p[:, None] + p[None]) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.maximum(a, 1e-300) / m), 0).sum(axis=2)
    xy = classical_mds(np.sqrt(np.maximum((part(np.broadcast_to(p[:, None], m.shape)) + part(np.broadcast_to(p[None], m.shape))) / 2, 0)))
    share = model.shares(rows).select("t", (F.col("p") * 100).alias("prevalence"))
    points = df.sparkSession.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "t int, x double, y double")
    return points.join(share, "t").select((F.col("t") + 1).alias("topic"), "x", "y", F.round("prevalence", 2).alias("prevalence"))


def topic_salience(weights: DataFrame, lam: float = 0.6, topn: int = 10) -> DataFrame:
    """``(topic, rank, keyword, relevance)`` from ``(topic, keyword, weight)``: ``lam log2 p(w|t) + (1 - lam) log2(p(w|t) / p(w))``."""
    need_columns("topic_salience", "weights", weights, ["topic", "keyword", "weight"])
    if not 0 <= lam <= 1:
        raise OpError("topic_salience", "lam", f"{lam!r} is not from 0 to 1")
    by_topic = weights.groupBy("topic").agg(F.sum("weight").alias("t"))
    by_word = weights.groupBy("keyword").agg(F.sum("weight").alias("w"))
    total = weights.agg(F.sum("weight").alias("n"))
    x = weights.where("weight > 0").join(by_topic, "topic").join(by_word, "keyword").crossJoin(F.broadcast(total))  # total is one row
    p = F.col("weight") / F.col("t")
    x = x.withColumn("relevance", lam * F.log2(p) + (1 - lam) * F.log2(p / (F.col("w") / F.col("n"))))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("relevance"), "keyword"))).where(F.col("rank") <= topn).select("topic", "rank", "keyword", "relevance")


def npmi(df: DataFrame, id_col: str, column: str, keywords: DataFrame) -> DataFrame:
    """``(topic, coherence)``: the mean normalised mutual information of a topic's keyword pairs over texts; -1 for pairs that never meet."""
    need_columns("npmi", "keywords", keywords, ["topic", "keyword"])
    wanted = keywords.select(F.col("keyword").alias("w")).distinct()
    rows = df.select(_col(id_col).alias("id"), F.explode(F.array_distinct(tokens(_col(column)))).alias("w"))
    n = df.where(F.size(tokens(F.coalesce(_col(column), F.lit("")))) > 0).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return _mutual(checkpoint(rows.join(wanted, "w", "left_semi")), n, keywords)


def _mutual(rows: DataFrame, n: DataFrame, keywords: DataFrame) -> DataFrame:
    """``npmi`` from ``(id, w)``, the different keywords of each text, and ``n``, one row with the number of texts."""
    single = rows.groupBy("w").agg(F.count(F.lit(1)).cast("double").alias("f"))
    pairs = keywords.select("topic", F.col("keyword").alias("a")).join(keywords.select("topic", F.col("keyword").alias("b")), "topic").where("a < b")
    docs = rows.groupBy("id").agg(F.array_sort(F.collect_set("w")).alias("u")).where("size(u) > 1")
    both = docs.select(F.explode(F.flatten(F.transform("u", lambda a: F.transform(F.filter("u", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).cast("double").alias("c"))
    x = pairs.join(both, ["a", "b"], "left").join(single.select(F.col("w").alias("a"), F.col("f").alias("fa")), "a", "left").join(single.select(F.col("w").alias("b"), F.col("f").alias("fb")), "b", "left").crossJoin(F.broadcast(n))  # n is one row
    pxy = F.col("c") / F.col("n")
    value = F.when(F.col("c").isNull(), -1.0).when(pxy == 1, 1.0).otherwise(F.log(pxy / (F.col("fa") / F.col("n") * F.col("fb") / F.col("n"))) / -F.log(pxy))
    return x.groupBy("topic").agg(F.avg(value).alias("coherence"))


def topic_coherence(df: DataFrame, id_col: str, column: str, ks: list[int], topn: int = 6, vocabulary: int = 2000, min_df: int = 2, lexicon=(), **options) -> DataFrame:
    """``(k, perplexity, coherence)`` for each number of topics; texts are cut into words and counted once for all of them, and each model's rounds go over all texts."""
    from pyspark.ml.functions import vector_to_array

    need_columns("topic_coherence", "id_col", df, [id_col])
    words, rows = counted_texts(df, column, vocabulary, min_df, lexicon, [id_col])
    n = rows.agg(F.count(F.lit(1)).cast("double").alias("n"))
    out = None
    for k in ks:
        need_positive("topics", "k", k)
        model = lda.fit(rows, len(words), k, **options)
        best = [(t, i) for t, found, _ in model.best(topn) for i in found]
        top = df.sparkSession.createDataFrame([(t, words[i]) for t, i in best], "topic int, keyword string")
        if lexicon:
            found = npmi(df, id_col, column, top)  # which knows words without a lexicon only
        else:
            chosen = sorted({i for _, i in best})  # topn a topic
            counts = vector_to_array("features")
            has = F.filter(F.array(*[F.when(counts[i] > 0, F.lit(words[i])) for i in chosen]), lambda w: w.isNotNull())
            found = _mutual(checkpoint(rows.select(_col(id_col).alias("id"), F.explode(has).alias("w"))), n, top)
        one = found.agg(F.avg("coherence").alias("coherence")).select(F.lit(k).alias("k"), F.lit(float(np.exp(model.log_perplexity(rows)))).alias("perplexity"), "coherence")
        out = one if out is None else out.unionByName(one)
    return out


def topic_flow(weights: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(stage, topic, next_topic, similarity)`` from ``(stage, topic, keyword, weight)`` with numbered stages: one less the divergence of the words of topics of neighbouring stages."""
    need_columns("topic_flow", "weights", weights, ["stage", "topic", "keyword", "weight"])
    maps = weights.groupBy("stage", "topic").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("keyword", F.col("weight").cast("double"))))).alias("m"))
    nxt = maps.select((F.col("stage") - 1).alias("stage"), F.col("topic").alias("next_topic"), F.col("m").alias("n"))
    return maps.join(nxt, "stage").withColumn("similarity", 1 - divergence(F.col("m"), F.col("n"))).where(F.col("similarity") >= threshold).select("stage", "topic", "next_topic", "similarity")


def topic_timeline(words: DataFrame, threshold: float = 0.2) -> DataFrame:
    """``(stage, topic, family, similarity, is_secondary)`` from ``(stage, topic, keyword)``: topics of following stages join the family
    of the most alike topic before by Jaccard similarity; a second topic of a stage in one family is secondary. A row a topic meets in one group."""
    need_columns("topic_timeline", "words", words, ["stage", "topic", "keyword"])
    sets = words.groupBy("stage", "topic").agg(F.array_sort(F.collect_set("keyword")).alias("w"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, last, families = [], [], 0
        for _, part in pdf.sort_values(["stage", "topic"]).groupby("stage", sort=True):
            now = [(t, set(w)) for t, w in zip(part["topic"], part["w"], strict=True)]
            ranked = sorted(((len(w & v) / max(1, len(w | v)), i, f) for i, (_, w) in enumerate(now) for _, v, f in last), key=lambda x: (-x[0], x[1], x[2]))
            chosen: dict[int, tuple[int, float, bool]] = {}
            taken: set[int] = set()
            for s, i, f in ranked:
                if s >= threshold and i not in chosen:
                    chosen[i] = (f, s, f in taken)
                    taken.add(f)
            last_now = []
            for i, (t, w) in enumerate(now):
                if i not in chosen:
                    families += 1
                    chosen[i] = (families, 0.0, False)
                last_now.append((t, w, chosen[i][0]))
                rows.append((part["stage"].iloc[0], t, *chosen[i]))
            last = last_now
        return pd.DataFrame(rows, columns=["stage", "topic", "family", "similarity", "is_secondary"])

    kinds = dict(words.dtypes)
    return sets.groupBy().applyInPandas(link, f"stage {kinds['stage']}, topic {kinds['topic']}, family int, similarity double, is_secondary boolean")


def topic_labels(weights: DataFrame, topn: int = 3) -> DataFrame:
    """``(topic, label)``: the heaviest words, joined by a middle dot."""
    need_columns("topic_labels", "weights", weights, ["topic", "keyword", "weight"])
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "keyword"))), 1, topn)
    return weights.groupBy("topic").agg(F.array_join(top["keyword"], "·").alias("label"))


def vector_topics(df: DataFrame, id_col: str, vector_col: str, column: str, k: int = 5, topn: int = 10, stop: tuple[str, ...] = STOP_WORDS, lexicon=(), seed: int = 42) -> DataFrame:
    """``(topic, rank, keyword, weight, documents)``: spherical k-means of a vector column, and the words that stand out in each cluster.

    A word weighs its part of the words of the cluster times ``ln(1 + a / f)``, with ``f`` its count in all clusters and ``a``
    the mean number of words of a cluster. Topics are numbered from 1 in the order of their smallest ids, which are distinct;
    rows without a direction are in none, and a topic without words has no rows.
    """
    from weft.operators.text import _words

    need_columns("vector_topics", "columns", df, [id_col, vector_col, column])
    need_positive("vector_topics", "k", k)
    need_positive("vector_topics", "topn", topn)
    named = vector_clusters(df, id_col, vector_col, k, seed).select(F.col(id_col).alias("id"), (F.col("cluster") + 1).alias("topic"))
    named = checkpoint(named)
    sizes = named.groupBy("topic").agg(F.count(F.lit(1)).alias("documents"))
    words = df.select(_col(id_col).alias("id"), F.explode(_words(df, column, stop, lexicon)).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    cells = checkpoint(words.join(named, "id").groupBy("topic", "word").agg(F.sum("n").alias("n")))
    by_topic = cells.groupBy("topic").agg(F.sum("n").alias("m"))
    mean = cells.agg((F.sum("n") / F.count_distinct("topic")).alias("a"))
    by_word = cells.groupBy("word").agg(F.sum("n").alias("f"))  # at most k rows of cells a word
    both = cells.join(by_word, "word").join(F.broadcast(by_topic), "topic").crossJoin(F.broadcast(mean))  # k rows, and one
    weighed = both.withColumn("weight", F.col("n") / F.col("m") * F.log(1 + F.col("a") / F.col("f")))
    ranked = weighed.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 12)), "word"))).where(F.col("rank") <= topn)
    return ranked.join(F.broadcast(sizes), "topic").select("topic", "rank", F.col("word").alias("keyword"), "weight", "documents")


def vector_clusters(df: DataFrame, id_col: str, vector_col: str, k: int, seed: int = 42) -> DataFrame:
    """``(id, cluster)`` by k-means of the directions of a vector column; rows without a direction are left out."""
    from weft.operators.dense import unit
    from weft.operators.spectral import clustered

    need_columns("vector_clusters", "columns", df, [id_col, vector_col])
    points = df.select(_col(id_col), unit(_col(vector_col)).alias("u")).where("u is not null and not exists(u, x -> isnan(x))")
    return clustered(points, id_col, "u", k, seed)
