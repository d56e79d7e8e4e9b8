"""Exact cosine joins of sparse vectors by prefix filtering, and density clusters of texts on them.

Words are ranked by rarity. The prefix of a vector of length 1 is its rarest words, so many that what is left is shorter than
the threshold. Two vectors at the threshold or over it share a word of both prefixes: without one, all that they share is in
the rest of the one whose prefix ends first. So vectors meet under the words of their prefixes only. All that they share up
to that end is known there, and of what follows the product of the lengths of both rests is a bound, which few pairs pass
that are not at the threshold; only their vectors are fetched. The lists of words that many prefixes share are cut into
blocks, each pair of blocks a key of its own, so no list meets in one task. Where the lists would give too many meetings
(low thresholds), all vectors are compared in blocks instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.errors import OpError, need_columns, need_positive
from weft.functions.texts import STOP_WORDS
from weft.operators.components import connected_components
from weft.operators.order import numbered
from weft.operators.skew import BROADCAST_ROWS, join_table
from weft.runtime import checkpoint

#: Vectors of a list that meet in one task.
LIST_ROWS = 2048
#: Meetings a vector under words of prefixes up to which lists are joined; with more all vectors are compared in blocks.
LIST_MEETINGS = 64
#: Vectors of a block: an eighth of all (so that tasks are enough), but between these; and how many of either side are
#: multiplied at a time, their common words as a dense matrix where more than one in ``DENSE`` has them.
BLOCK_ROWS, TILE_ROWS, DENSE = (2048, 16_384), 2048, 32
#: Room for rounding in bounds; the cosine itself decides.
ROUNDING = 1e-9


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def cosine_pairs(vectors: DataFrame, threshold: float, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(a, b, similarity)`` with a < b of all pairs of ``vectors`` (id, v) at ``threshold`` or over, over 0.

    ``v`` is an array of ``(rank, w)`` by rank, the rarest first, with positive figures whose squares add up to 1; ids are
    distinct. Exact: nothing is sampled and no list is capped.
    """
    if not 0 < threshold <= 1:
        raise OpError("cosine_pairs", "threshold", f"{threshold!r} is not over 0 and up to 1")
    rows = vectors.select("id", "v").where("size(v) > 0")
    kinds = dict(rows.dtypes)["id"]
    ranks = lambda v: F.transform(v, lambda x: x["rank"])
    figures = lambda v: F.transform(v, lambda x: x["w"])

    def prefixes(batches):
        for pdf in batches:
            found = []
            for i, r, w in zip(range(len(pdf)), pdf["r"], pdf["w"], strict=True):
                left = np.sqrt(np.cumsum((w * w)[::-1])[::-1])  # the length from each word on
                k = int(np.count_nonzero(left >= threshold - ROUNDING))
                after = np.append(left[1:], 0.0)[:k]
                found.append((np.full(k, i), r[:k], w[:k], after, np.full(k, r[k - 1]), np.full(k, after[-1])))
            if found:
                at, *columns = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[at], **dict(zip(("rank", "w", "after", "end", "rest"), columns, strict=True))})

    prefix = checkpoint(rows.select("id", ranks("v").alias("r"), figures("v").alias("w")).mapInPandas(prefixes, f"id {kinds}, rank bigint, w double, after double, end bigint, rest double"))
    sizes = checkpoint(prefix.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / list_rows).cast("int")))
    known = rows.count()
    met = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    if met / 2 > LIST_MEETINGS * known:
        return _in_blocks(rows, threshold, known)
    sizes = sizes.select("rank", "blocks")
    few = sizes.count() <= BROADCAST_ROWS
    listed = prefix.join(F.broadcast(sizes) if few else sizes, "rank").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda name, mine, other: dealt.select("rank", F.col("mine").alias(mine), F.col("other").alias(other), *[F.col(c).alias(f"{name}_{c}") for c in ("id", "w", "after", "end", "rest")])
    met = side("a", "i", "j").join(side("b", "j", "i"), ["rank", "i", "j"]).where("a_id < b_id")
    first = F.col("a_end") <= F.col("b_end")
    shared = met.groupBy(F.col("a_id").alias("a"), F.col("b_id").alias("b")).agg(F.sum(F.col("a_w") * F.col("b_w")).alias("shared"), F.max(F.when(first, F.col("a_rest")).otherwise(F.col("b_rest"))).alias("rest"), F.max_by(F.when(first, F.col("b_after")).otherwise(F.col("a_after")), "rank").alias("after"))
    pairs = checkpoint(shared.where(F.col("shared") + F.col("rest") * F.col("after") >= threshold - ROUNDING).select("a", "b"))
    held = pairs.count()
    out = pairs
    for end in ("a", "b"):  # a vector that is near very many is copied, not gathered
        sizes = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
        out = join_table(out, rows.select(F.col("id").alias(end), F.col("v").alias(f"v{end}")), end, sizes, max(known, BROADCAST_ROWS + 1), held)
    slim = out.select("a", "b", ranks("va").alias("ra"), figures("va").alias("wa"), ranks("vb").alias("rb"), figures("vb").alias("wb"))

    def cosines(batches):
        for pdf in batches:
            got = np.empty(len(pdf))
            for i, (ra, wa, rb, wb) in enumerate(zip(pdf["ra"], pdf["wa"], pdf["rb"], pdf["wb"], strict=True)):
                _, x, y = np.intersect1d(ra, rb, assume_unique=True, return_indices=True)
                got[i] = np.dot(wa[x], wb[y])
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": got})

    return slim.mapInPandas(cosines, f"a {kinds}, b {kinds}, similarity double").where(F.col("similarity") >= threshold)


def _in_blocks(rows: DataFrame, threshold: float, known: int) -> DataFrame:
    """``(a, b, similarity)`` as of ``cosine_pairs``, each two of some blocks of vectors compared whole in one task.

    What is shuffled are the vectors, once for each block, and no meetings.
    """
    kinds = dict(rows.dtypes)["id"]
    blocks = -(-known // min(max(known // 8, BLOCK_ROWS[0]), BLOCK_ROWS[1]))
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    slim = rows.select("id", F.transform("v", lambda x: x["rank"]).alias("r"), F.transform("v", lambda x: x["w"]).alias("w"), mine.alias("mine"))
    dealt = slim.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "r", "w")

    def compare(cell: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        alone = cell[0] == cell[1]  # two rows of one block meet here only
        left, right = pdf[pdf["mine"] == cell[0]], pdf[pdf["mine"] == cell[1]]
        tiles = lambda x: [_tile(x[i : i + TILE_ROWS]) for i in range(0, len(x), TILE_ROWS)]
        one = tiles(left)
        two = one if alone else tiles(right)
        found = [pd.DataFrame({"a": pdf["id"][:0], "b": pdf["id"][:0], "similarity": np.zeros(0)})]
        for i, x in enumerate(one):
            for j, y in enumerate(two):
                if alone and j < i:
                    continue
                near = _products(x, y)
                p, q = np.nonzero(near >= threshold)
                if alone and i == j:
                    p, q = p[p < q], q[p < q]
                found.append(pd.DataFrame({"a": x[0][p], "b": y[0][q], "similarity": near[p, q]}))
        out = pd.concat(found)
        turned = (out["a"] > out["b"]).to_numpy()
        return pd.DataFrame({"a": out["b"].where(turned, out["a"]), "b": out["a"].where(turned, out["b"]), "similarity": out["similarity"]})

    return dealt.groupBy("i", "j").applyInPandas(compare, f"a {kinds}, b {kinds}, similarity double")


def _tile(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Ids, and by word: the words, where each begins, the rows and the figures."""
    sizes = [len(r) for r in rows["r"]]
    word, at, w = np.concatenate(list(rows["r"])), np.repeat(np.arange(len(rows)), sizes), np.concatenate(list(rows["w"]))
    order = np.argsort(word, kind="stable")
    words, first = np.unique(word[order], return_index=True)
    return rows["id"].to_numpy(), words, np.append(first, len(word)), at[order], w[order]


def _products(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> np.ndarray:
    """The cosines of all rows of two tiles: rare words by their lists, the others as a product of matrices."""
    (ids, words, first, at, w), (others, words_y, first_y, at_y, w_y) = x, y
    _, i, j = np.intersect1d(words, words_y, assume_unique=True, return_indices=True)
    n, m = first[i + 1] - first[i], first_y[j + 1] - first_y[j]
    dense = n * m * DENSE * DENSE > len(ids) * len(others)
    columns = np.count_nonzero(dense)
    a, b = np.zeros((len(ids), columns)), np.zeros((columns, len(others)))
    for k, (p, q) in enumerate(zip(i[dense], j[dense], strict=True)):
        a[at[first[p] : first[p + 1]], k] = w[first[p] : first[p + 1]]
        b[k, at_y[first_y[q] : first_y[q + 1]]] = w_y[first_y[q] : first_y[q + 1]]
    out = a @ b
    for p, q in zip(i[~dense], j[~dense], strict=True):
        s, t = slice(first[p], first[p + 1]), slice(first_y[q], first_y[q + 1])
        out[at[s][:, None], at_y[t]] += w[s][:, None] * w_y[t]
    return out


def text_vectors(df: DataFrame, id_col: str, column: str, vocabulary: int | None = None, stop: tuple[str, ...] = STOP_WORDS, lexicon=()) -> tuple[DataFrame, DataFrame]:
    """``(id, key)`` of each text with words, and ``(key, id, n, v)`` of each distinct TF-IDF vector: its least id, how many texts have it, the vector for ``cosine_pairs``.

    Texts with the same words equally often are one vector. Weights are as in ``tf_idf``; with ``vocabulary`` only so many
    words count, the most frequent ones (ties by word). Ids are distinct.
    """
    from weft.operators.text import _words

    need_columns("text_vectors", "columns", df, [id_col, column])
    words = df.select(_col(id_col).alias("id"), F.explode(_words(df, column, stop, lexicon)).alias("word"))
    if vocabulary is not None:
        need_positive("text_vectors", "vocabulary", vocabulary)
        words = checkpoint(words)
        top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(vocabulary).select("word")
        words = words.join(top if vocabulary > BROADCAST_ROWS else F.broadcast(top), "word", "left_semi")
    counted = words.groupBy("id", "word").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    held = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("word", "tf"))).alias("x"))  # the words of a text
    held = checkpoint(held.withColumn("key", F.struct(F.xxhash64("x").alias("p"), F.xxhash64(F.lit(1), "x").alias("q"))))
    classes = checkpoint(held.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("x").alias("x")))
    entries = classes.select("id", "n", F.inline("x"))
    by_word = numbered(entries.groupBy("word").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("n")), ["df", "word"], "rank")
    by_word = checkpoint(by_word)
    size = by_word.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    total = held.count()
    table = by_word.select("word", "rank", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = join_table(entries.select("id", "word", "tf"), table, "word", by_word, size["words"], size["rows"])
    raw = weighed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), (F.col("tf") * F.col("idf")).alias("w")))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    unit = raw.withColumn("norm", norm).select("id", F.expr("transform(v, x -> struct(x.rank as rank, x.w / norm as w))").alias("v"))
    return held.select("id", "key"), checkpoint(classes.select("key", "id", "n").join(unit, "id").select("key", "id", "n", "v"))


def density_clusters(rows: DataFrame, near: DataFrame, links, border, min_samples: int) -> DataFrame:
    """``(id, cluster)`` of the rows in clusters, for ``rows`` (id, n) and ``near`` (id, n): how many rows each stands for, and how many others are near it.

    Rows with ``min_samples`` near rows, those it stands for counted, are cores. ``links(cores)`` gives ``(a, b)`` that
    connect near cores, ``border(cores)`` gives ``(id, other)``, the smallest near core of each near row that is none.
    """
    both = rows.join(near.withColumnRenamed("n", "m"), "id", "left")
    cores = checkpoint(both.where(F.col("n") + F.coalesce("m", F.lit(0)) >= min_samples).select("id"))
    parts = connected_components(links(cores), "a", "b").select(F.col("node").alias("id"), "component")
    named = checkpoint(cores.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("cluster")))
    edge = border(cores).join(named.select(F.col("id").alias("other"), "cluster"), "other").select("id", "cluster")
    return named.unionByName(edge)


def dbscan_texts(df: DataFrame, id_col: str, column: str, eps: float = 0.3, min_samples: int = 5, vocabulary: int | None = 3000, lexicon=()) -> DataFrame:
    """``(id, cluster, is_noise)`` of texts by the cosine distance of their TF-IDF vectors, all near pairs found exactly.

    Clusters are as in ``dbscan``. Equal vectors are compared once and counted as often as they are there. Texts without
    words (of the vocabulary) are noise, nulls too; ids are distinct.
    """
    if not 0 <= eps < 1:
        raise OpError("dbscan_texts", "eps", f"{eps!r} is not from 0 to under 1")
    need_positive("dbscan_texts", "min_samples", min_samples)
    members, classes = text_vectors(df, id_col, column, vocabulary, lexicon=lexicon)
    pairs = checkpoint(cosine_pairs(classes, 1 - eps).select("a", "b"))
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    slim = classes.select("id", "n")
    sizes = ends.groupBy("other").agg(F.count(F.lit(1)).alias("n"))
    near = join_table(ends, slim.withColumnRenamed("id", "other"), "other", sizes, slim.count(), ends.count()).groupBy("id").agg(F.sum("n").alias("n"))

    def links(cores):
        return pairs.join(cores.select(F.col("id").alias("a")), "a", "left_semi").join(cores.select(F.col("id").alias("b")), "b", "left_semi")

    def border(cores):
        return ends.join(cores.select(F.col("id").alias("other")), "other", "left_semi").join(cores, "id", "left_anti").groupBy("id").agg(F.min("other").alias("other"))

    found = checkpoint(density_clusters(slim, near, links, border, min_samples))
    by_key = classes.select("key", "n", "id").join(found, "id").select("key", "n", "cluster")
    held = members.count()
    named = join_table(members, by_key.select("key", "cluster"), "key", by_key, by_key.count(), held).select("id", "cluster")
    return df.select(_col(id_col).alias("id")).join(named, "id", "left").select("id", "cluster", F.col("cluster").isNull().alias("is_noise"))
