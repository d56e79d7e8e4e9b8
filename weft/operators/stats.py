"""Correlation, significance, anomalies, clusters, a text classifier and automated-account scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from weft.errors import OpError, need_columns, need_one_of
from weft.functions.scalars import number
from weft.functions.special import chi2_tail, f_tail, normal_two_sided, t_two_sided
from weft.functions.texts import tokens
from weft.operators.order import numbered
from weft.runtime import checkpoint


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def average_ranks(df: DataFrame, value: str, group_by: list[str] = ()) -> DataFrame:
    """``df`` with ``rank`` of a value, equal values sharing their mean rank. Values are counted first, so ties cost one row;
    ranks come from sums over ranges of values, so no task ranks the whole column."""
    keys = list(group_by)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    parts = counts.repartitionByRange(_col(value)).withColumn("__part", F.spark_partition_id())
    parts = checkpoint(parts)
    sums = parts.groupBy(*keys, "__part").agg(F.sum("__n").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    within = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.withColumn("__b", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(offsets, [*keys, "__part"])
    ranked = ranked.select(*keys, value, (F.col("__o") + F.col("__b") + (F.col("__n") + 1) / 2).alias("rank"), F.col("__n").alias("ties"))
    return df.join(ranked, [*keys, value])


def _kendall(pairs: DataFrame) -> float | None:
    """Tau-b of ``(x, y)`` by counts of distinct pairs, in rows that grow with their number times its logarithm.

    Values of x are numbered. Two numbers share their first bits up to one in which they
    differ, so under each such prefix those with a 0 there are compared with those with a 1 by
    running sums over y, which are range-partitioned: no pairs are listed.
    """
    cells = checkpoint(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    n = cells.agg(F.sum("n")).first()[0] or 0
    tie = lambda c: cells.groupBy(c).agg(F.sum("n").alias("k")).agg(F.coalesce(F.sum(F.col("k").cast("double") * (F.col("k") - 1) / 2), F.lit(0.0))).first()[0]
    tx, ty, total = tie("x"), tie("y"), n * (n - 1) / 2
    if total <= tx or total <= ty:
        return None
    places = checkpoint(numbered(cells.select("x").distinct(), ["x"]))
    levels = max(1, (places.count()).bit_length())
    wide = cells.join(places, "x").select("y", "n", "number", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    side = F.getbit("number", F.col("level"))
    under = wide.groupBy("level", F.expr("shiftright(number, level + 1)").alias("prefix"), "y").agg(F.sum(F.when(side == 0, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(side == 1, F.col("n")).otherwise(0)).alias("high"))
    keys = ["level", "prefix"]
    parts = checkpoint(under.repartitionByRange(*keys, "y").withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy(*keys, "part").agg(F.sum("low").alias("s"))
    before = Window.partitionBy(*keys).orderBy("part")  # a row a partition
    offsets = sums.select(*keys, "part", (F.sum("s").over(before) - F.col("s")).alias("start"), F.sum("s").over(Window.partitionBy(*keys)).alias("all"))
    within = Window.partitionBy("part", *keys).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.withColumn("run", F.coalesce(F.sum("low").over(within), F.lit(0))).join(offsets, [*keys, "part"])
    below = F.col("start") + F.col("run")
    s = ranked.agg(F.sum(F.col("high").cast("double") * (2 * below + F.col("low") - F.col("all")))).first()[0] or 0.0
    return s / math.sqrt((total - tx) * (total - ty))


def correlation(df: DataFrame, columns: list[str] | None = None, method: str = "pearson", min_abs: float = 0.0) -> DataFrame:
    """``(col1, col2, method, correlation, abs_correlation)`` of numeric columns, strongest first; pairs with a constant column are left out."""
    op = "correlation"
    need_one_of(op, "method", method, ("pearson", "spearman", "kendall"))
    columns = columns or numeric_columns(df)
    need_columns(op, "columns", df, columns)
    if len(columns) < 2:
        raise OpError(op, "columns", "two numeric columns are needed")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = df.select(*[number(_col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    if method == "pearson":
        both = lambda a, b: (F.when(F.col(at[b]).isNotNull(), F.col(at[a])), F.when(F.col(at[a]).isNotNull(), F.col(at[b])))
        steady = lambda c: F.coalesce(F.var_pop(c), F.lit(0.0)) > 0
        one = rows.agg(*[F.when(steady(both(a, b)[0]) & steady(both(a, b)[1]), F.corr(*both(a, b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
        items = F.array(*[F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
        out = one.select(F.explode(items).alias("x")).select("x.*")
    else:
        out = None
        for a, b in pairs:
            xy = rows.select(F.col(at[a]).alias("x"), F.col(at[b]).alias("y")).where("x is not null and y is not null")
            if method == "spearman":
                r = average_ranks(xy, "x").select(F.col("rank").alias("rx"), "y")
                r = average_ranks(r, "y").agg(F.when((F.var_pop("rx") > 0) & (F.var_pop("rank") > 0), F.corr("rx", "rank")).alias("r"))
            else:
                r = df.sparkSession.createDataFrame([(_kendall(xy),)], "r double")
            r = r.select(F.lit(a).alias("col1"), F.lit(b).alias("col2"), "r")
            out = r if out is None else out.unionByName(r)
    r = F.col("r")
    return out.where(r.isNotNull() & ~F.isnan(r) & (F.abs(r) >= min_abs)).select("col1", "col2", F.lit(method).alias("method"), r.alias("correlation"), F.abs(r).alias("abs_correlation")).orderBy(F.desc("abs_correlation"), "col1", "col2")


TESTS = ("ttest", "anova", "mannwhitney", "kruskal")
#: Groups that a test may have (each gives one row of sums).
GROUPS = 10_000


def significance(df: DataFrame, group_col: str, value_col: str, test: str = "ttest", alpha: float = 0.05) -> DataFrame:
    """``test, groups, n, statistic, df, p_value, significant, means``: Welch's t, F, Mann-Whitney's U (normal with ties and continuity) or Kruskal's H.

    Sums by group come from Spark; the tail of the distribution is worked out for the one row of them.
    """
    op = "significance"
    need_columns(op, "columns", df, [group_col, value_col])
    need_one_of(op, "test", test, TESTS)
    rows = df.select(_col(group_col).cast("string").alias("g"), number(_col(value_col)).alias("v")).where("g is not null and v is not null")
    ties = 0.0
    if test in ("mannwhitney", "kruskal"):
        ranked = checkpoint(average_ranks(rows, "v"))
        ties = ranked.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.coalesce(F.sum(F.pow("t", 3) - F.col("t")), F.lit(0.0))).first()[0]
        rows = ranked
        sums = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s2"), F.sum("rank").alias("r"))
    else:
        sums = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s2"))
    found = sums.orderBy("g").limit(GROUPS + 1).collect()
    if len(found) > GROUPS or len(found) < 2 or (test in ("ttest", "mannwhitney") and len(found) != 2):
        raise OpError(op, "group_col", f"{len(found)} groups; {test} takes {'two' if test in ('ttest', 'mannwhitney') else f'2 to {GROUPS}'}")
    n, m = np.array([x["n"] for x in found], float), np.array([x["m"] for x in found])
    s2 = np.array([x["s2"] or 0.0 for x in found])
    total, free = n.sum(), math.nan
    if test == "ttest":
        se = s2 / n
        stat = (m[0] - m[1]) / math.sqrt(se.sum()) if se.sum() > 0 else math.nan
        free = se.sum() ** 2 / (se**2 / (n - 1)).sum() if se.sum() > 0 else math.nan
        p = t_two_sided(stat, free) if se.sum() > 0 else math.nan
    elif test == "anova":
        between, within = (n * (m - (n * m).sum() / total) ** 2).sum(), ((n - 1) * s2).sum()
        free = len(n) - 1
        stat = between / free / (within / (total - len(n))) if within > 0 else math.inf
        p = f_tail(stat, free, total - len(n))
    else:
        r = np.array([x["r"] for x in found])
        if test == "mannwhitney":
            stat = r[0] - n[0] * (n[0] + 1) / 2
            spread = math.sqrt(n[0] * n[1] / 12 * (total + 1 - ties / (total * (total - 1))))
            away = max(0.0, abs(stat - n[0] * n[1] / 2) - 0.5)
            p = normal_two_sided(away / spread) if spread > 0 else 1.0
        else:
            free = len(n) - 1
            fix = 1 - ties / (total**3 - total)
            stat = (12 / (total * (total + 1)) * (r**2 / n).sum() - 3 * (total + 1)) / fix if fix > 0 else math.nan
            p = chi2_tail(stat, free) if fix > 0 else 1.0
    means = ";".join(f"{x['g']}={x['m']:.4f}" for x in found)
    row = (test, len(found), int(total), float(stat), None if math.isnan(free) else float(free), float(p), bool(p < alpha), means)
    return df.sparkSession.createDataFrame([row], "test string, groups int, n bigint, statistic double, df double, p_value double, significant boolean, means string")


#: Rows that an isolation forest is grown from, trees, and rows a tree sees (the method's own sample size).
FOREST_ROWS, TREES, TREE_ROWS = 20_000, 100, 256
#: Copies of a row that one task numbers at a time.
COPIES = 10_000


def anomaly(df: DataFrame, columns: list[str] | None = None, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """``df`` with ``anomaly_score`` (higher: isolated sooner) and ``is_anomaly`` (the highest part ``contamination``).

    The forest is grown on the driver from a bounded hash sample of the rows, in which copies weigh as often as they occur; every row is scored in its own task. Missing numbers become the median.
    """
    op = "anomaly"
    columns = columns or numeric_columns(df)
    need_columns(op, "columns", df, columns)
    if not columns or not 0 < contamination < 0.5:
        raise OpError(op, "columns" if not columns else "contamination", "give numeric columns, and a part above 0 and under 0.5")
    medians = df.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(number(_col(c)), 0.5, 10_000).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    if medians["n"] < 5:
        raise OpError(op, "df", f"{medians['n']} rows; 5 are needed")
    cells = [F.coalesce(number(_col(c)), F.lit(float(medians[f"m{i}"] or 0.0))) for i, c in enumerate(columns)]
    points, named = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)]), [f"c{i}" for i in range(len(cells))]
    counted = points.groupBy(*named).agg(F.count(F.lit(1)).alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("long")))).repartition(F.xxhash64("part", *named))
    first = F.col("part") * COPIES
    copies = parts.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("n")) - 1)))
    likely = min(1.0, 1.2 * FOREST_ROWS / medians["n"])  # of the hashes, so that few rows are ordered
    drawn = copies.select(*named, F.xxhash64(F.lit(seed), "copy", *named).alias("o")).where(F.col("o").cast("double") <= (2 * likely - 1) * 2.0**63)
    x = np.array([list(r) for r in drawn.orderBy("o", *named).limit(FOREST_ROWS).drop("o").collect()])
    rng, per = np.random.default_rng(seed), min(TREE_ROWS, len(x))
    usual = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(rows, depth):
        """Rows of ``(column, cut, left, right)``; a leaf has column -1 and its path length as the cut."""
        nodes = []

        def add(part, level):
            me = len(nodes)
            nodes.append(None)
            low, high = part.min(axis=0), part.max(axis=0)
            free = np.flatnonzero(high > low)
            if level >= depth or len(part) < 2 or not len(free):
                nodes[me] = (-1, level + usual(len(part)), 0, 0)
                return me
            c = int(rng.choice(free))
            cut = float(rng.uniform(low[c], high[c]))
            left = add(part[part[:, c] < cut], level + 1)
            nodes[me] = (c, cut, left, add(part[part[:, c] >= cut], level + 1))
            return me

        add(rows, 0)
        return np.array(nodes)

    trees = [grow(x[rng.choice(len(x), per, replace=False)], math.ceil(math.log2(max(per, 2)))) for _ in range(TREES)]
    wide = np.zeros((TREES, max(map(len, trees)), 4))
    for i, t in enumerate(trees):
        wide[i, : len(t)] = t
    held, scale = df.sparkSession.sparkContext.broadcast(wide), usual(per) or 1.0

    @F.pandas_udf("double")
    def score(*parts: pd.Series) -> pd.Series:
        """All trees at once: the rows walk down until each is at a leaf."""
        values, out, forest = np.column_stack([p.to_numpy(float) for p in parts]), [], held.value
        column, cut, left, right = (forest[:, :, i] for i in range(4))
        column, left, right = column.astype(np.int32), left.astype(np.int32), right.astype(np.int32)
        tree = np.arange(len(forest))[:, None]
        for i in range(0, len(values), 1024):
            rows = values[i : i + 1024]
            at = np.zeros((len(forest), len(rows)), np.int32)
            row = np.arange(len(rows))[None]
            while True:
                c = column[tree, at]
                if (c < 0).all():
                    break
                down = np.where(rows[row, np.maximum(c, 0)] < cut[tree, at], left[tree, at], right[tree, at])
                at = np.where(c >= 0, down, at)
            out.append(cut[tree, at].sum(axis=0))
        return pd.Series(2 ** (-np.concatenate([np.zeros(0), *out]) / len(forest) / scale))

    scored = checkpoint(df.withColumn("anomaly_score", score(*cells)))
    cut = scored.agg(F.percentile_approx("anomaly_score", 1 - contamination, 10_000)).first()[0]
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > cut)


def text_features(df: DataFrame, column: str, vocabulary: int = 3000, ngrams: int = 1, lexicon=()):
    """``(fitted pipeline, df with a unit TF-IDF vector in features)``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer

    words = tokens(F.coalesce(_col(column).cast("string"), F.lit("")), lexicon=lexicon)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    grams = F.concat(words, F.array_compact(pairs)) if ngrams > 1 else words
    prepared = df.withColumn("__words", grams)
    model = Pipeline(stages=[CountVectorizer(inputCol="__words", outputCol="__tf", vocabSize=vocabulary), IDF(inputCol="__tf", outputCol="__idf"), Normalizer(inputCol="__idf", outputCol="features")]).fit(prepared)
    return model, model.transform(prepared)


def cluster_texts(df: DataFrame, column: str, k: int = 5, vocabulary: int = 3000, seed: int = 42, most: int = 0, lexicon=()) -> DataFrame:
    """``df`` with ``cluster`` (k-means of TF-IDF vectors) and the clustering's ``silhouette``.

    With ``most`` the number of clusters is the one from ``k`` to ``most`` with the largest silhouette, the smaller of equals.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    need_columns("cluster_texts", "column", df, [column])
    if k < 2 or most and most < k:
        raise OpError("cluster_texts", "k", f"{k} is under 2, or over most")
    _, rows = text_features(df, column, vocabulary, lexicon=lexicon)
    rows = checkpoint(rows)
    tried = []
    for n in range(k, (most or k) + 1):
        out = KMeans(k=n, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows)
        tried.append((-ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(out), n, out))
    value, _, out = min(tried, key=lambda x: x[:2])
    return out.select(*map(_col, df.columns), "cluster", F.lit(-value).alias("silhouette"))


def dbscan(df: DataFrame, id_col: str, vector_col: str, eps: float = 0.3, min_samples: int = 5) -> DataFrame:
    """``(id, cluster, is_noise)`` by cosine distance: rows with ``min_samples`` rows within ``eps`` (itself counted) are cores,
    linked cores are a cluster (named by its smallest core), others join the cluster of their smallest core neighbour.

    Exact. Rows of one direction are compared once and counted as often as they are there; what a cell gives are counts,
    forests and least neighbours, never pairs. Ids are distinct; rows without a direction are noise.
    """
    from weft.operators import dense
    from weft.operators.order import numbered
    from weft.operators.skew import join_table
    from weft.operators.sparse import density_clusters

    need_columns("dbscan", "columns", df, [id_col, vector_col])
    dense.need_threshold("dbscan", 1 - eps)
    members, classes = dense.directions(df, id_col, vector_col)
    rows = checkpoint(numbered(classes, ["id"]).select(F.col("number").cast("long").alias("id"), F.col("id").alias("first"), "key", "n", "u"))
    near = dense.figures(rows.withColumn("flag", F.lit(True)), 1 - eps, "near").groupBy("id").agg(F.sum("n").alias("n"))

    def flagged(cores):
        return rows.join(cores.withColumn("flag", F.lit(True)), "id", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))

    def links(cores):
        return dense.figures(flagged(cores), 1 - eps, "forest").select(F.col("id").alias("a"), F.col("n").alias("b"))

    def border(cores):
        found = dense.figures(flagged(cores), 1 - eps, "least").groupBy("id").agg(F.min("n").alias("other"))
        return found.join(cores, "id", "left_anti")

    found = checkpoint(density_clusters(rows.select("id", "n"), checkpoint(near), links, border, min_samples))
    names = rows.select(F.col("id").alias("cluster"), F.col("first").alias("name"))
    by_key = checkpoint(rows.select("id", "key", "n").join(found, "id").join(names, "cluster").select("key", "n", F.col("name").alias("cluster")))
    named = join_table(members, by_key.select("key", "cluster"), "key", by_key, by_key.count(), members.count()).select("id", "cluster")
    return df.select(_col(id_col).alias("id")).join(named, "id", "left").select("id", "cluster", F.col("cluster").isNull().alias("is_noise"))


#: Words of two letters or digits or more of a classifier's texts.
_CLASSIFIER_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9\\p{L}\\p{N}]{2,}+', 0)"


def train_classifier(df: DataFrame, column: str, label_col: str, vocabulary: int = 20_000):
    """A fitted pipeline: words and pairs of words, TF-IDF, logistic regression with each class of equal weight. Save it with ``.save(path)``."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizerModel, IndexToString, NGram, SQLTransformer, StringIndexerModel, VectorAssembler

    from weft.operators import blocks as B

    need_columns("train_classifier", "columns", df, [column, label_col])
    rows = df.where(_col(label_col).isNotNull() & _col(column).isNotNull()).select(_col(column).cast("string").alias("text"), _col(label_col).cast("string").alias("label_text"))
    # texts are cut into words once; what follows counts in blocks of them, and the model holds what that gave as stages
    texts = B.encoded(rows, F.expr(_CLASSIFIER_WORDS), 1, ["label_text"])
    counts = checkpoint(texts.select(F.explode("label_text").alias("label_text")).groupBy("label_text").agg(F.count(F.lit(1)).alias("n")))
    labels = [r[0] for r in counts.orderBy(F.desc("n"), "label_text").limit(1001).collect()]
    if not 2 <= len(labels) <= 1000:
        raise OpError("train_classifier", "label_col", f"{len(labels)} labels; 2 to 1000 are needed")
    terms = [B.frequent_terms(texts, vocabulary, span) for span in (1, 2)]
    if not all(terms):
        raise OpError("train_classifier", "column", "no text has two words")
    total = counts.agg(F.sum("n").alias("total"))
    weighed = B.term_vectors(texts, terms, ["label_text"]).join(F.broadcast(counts), "label_text").crossJoin(F.broadcast(total)).withColumn("weight", F.col("total") / (F.col("n") * len(labels)))  # at most 1000 labels
    index = StringIndexerModel.from_labels(labels, inputCol="label_text", outputCol="label", handleInvalid="keep")
    counted = index.transform(weighed)
    scaled = IDF(inputCol="tf", outputCol="features").fit(counted)
    learned = LogisticRegression(weightCol="weight", maxIter=30, regParam=0.01).fit(scaled.transform(counted))
    vectors = [CountVectorizerModel.from_vocabulary(terms[i], inputCol=c, outputCol=f"tf{i + 1}") for i, c in enumerate(("words", "pairs"))]
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {_CLASSIFIER_WORDS} AS words FROM __THIS__"), NGram(n=2, inputCol="words", outputCol="pairs"), *vectors, VectorAssembler(inputCols=["tf1", "tf2"], outputCol="tf"), scaled, learned, IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)])


def classify(df: DataFrame, column: str, model, new_col: str = "label") -> DataFrame:
    """``df`` with the predicted label; a null text has none."""
    need_columns("classify", "column", df, [column])
    rows = df.withColumn("__row", F.struct(*map(_col, df.columns))).select("__row", F.coalesce(_col(column).cast("string"), F.lit("")).alias("text"))
    out = model.transform(rows)
    return out.select("__row.*", F.when(F.col("__row")[column].isNotNull(), F.col("predicted")).alias(new_col)).select(*[c for c in df.columns if c != new_col], new_col)


BURST_POSTS, LIKELY_AT, SUSPECT_AT = 5, 0.67, 0.34


def bot_scores(df: DataFrame, id_col: str, author_col: str, text_col: str, time_col: str) -> DataFrame:
    """``(author, posts, dup_ratio, peak, bot_score, bot_level)``: 0.6 of the posts that another author nearly repeats (3 bits),
    and 0.4 of how far the busiest ten minutes are above the median author's."""
    from weft.operators.dedupe import band_keys, with_simhash
    from weft.operators.links import bits_within, extremes_by_key
    from weft.operators.skew import join_table
    from weft.operators.timeseries import peak_counts

    need_columns("bot_scores", "columns", df, [id_col, author_col, text_col, time_col])
    rows = df.where(_col(author_col).isNotNull() & (_col(author_col).cast("string") != ""))
    of = rows.select(F.struct(_col(id_col).alias("id"), _col(author_col).alias("author")).alias("id"), _col(text_col).alias("text"))
    prints = checkpoint(with_simhash(of, "id", "text").select("id.author", "fp", F.xxhash64("id.author").alias("code")))
    by_print = checkpoint(prints.groupBy("fp").agg(F.min("code").alias("low"), F.max("code").alias("high"), F.count(F.lit(1)).alias("n")))
    counts = by_print.agg(F.count(F.lit(1)).alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    around = extremes_by_key(band_keys(by_print.select("fp", "low", "high"), 3), bits_within(3))
    seen = by_print.select("fp", "low", "high").unionByName(around).groupBy("fp").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    dup = join_table(prints, seen, "fp", by_print, counts["prints"], counts["rows"]).groupBy("author").agg(F.sum(((F.col("low") != F.col("code")) | (F.col("high") != F.col("code"))).cast("long")).alias("dup"))
    posts = rows.groupBy(_col(author_col).alias("author")).agg(F.count(F.lit(1)).alias("posts"))
    peaks = peak_counts(rows, author_col, time_col).select(F.col("key").alias("author"), F.when(F.col("posts") >= BURST_POSTS, F.col("peak")).alias("peak"))
    usual = peaks.agg(F.coalesce(F.percentile("peak", 0.5), F.lit(0.0)).alias("usual"))
    out = posts.join(dup, "author", "left").join(peaks, "author", "left").crossJoin(F.broadcast(usual))  # usual is one row
    ratio = F.coalesce("dup", F.lit(0)) / F.col("posts")
    burst = F.when((F.col("usual") > 0) & (F.col("peak") > F.col("usual")), F.least(F.lit(1.0), (F.col("peak") - F.col("usual")) / (2 * F.col("usual")))).otherwise(0.0)
    score = F.round(ratio * 0.6 + burst * 0.4, 4)
    return out.select("author", "posts", F.round(ratio, 4).alias("dup_ratio"), F.coalesce("peak", F.lit(0)).alias("peak"), score.alias("bot_score"), F.when(score >= LIKELY_AT, "likely").when(score >= SUSPECT_AT, "suspect").otherwise("none").alias("bot_level"))
