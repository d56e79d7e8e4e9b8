"""Exact, normalised, near and semantic duplicates."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weft.errors import OpError, need_columns, need_one_of
from weft.functions.texts import normalized, normalized_key, words
from weft.operators import dense
from weft.operators.components import connected_components
from weft.operators.links import bits_within, links_by_key, links_of_all
from weft.operators.skew import join_table
from weft.runtime import checkpoint, spread


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def drop_duplicates(df: DataFrame, columns: list[str] | None = None, keep: str | bool = "first", order_by: str | None = None, mode: str = "exact") -> DataFrame:
    """One row (``first`` or ``last`` by ``order_by``), or none (``False``), of rows equal in the columns.

    Mode ``normalized`` compares the texts without what reposts add; rows of which nothing is
    left are all kept.
    """
    op = "drop_duplicates"
    columns = columns or df.columns
    need_columns(op, "columns", df, columns)
    need_one_of(op, "keep", keep, ("first", "last", False))
    need_one_of(op, "mode", mode, ("exact", "normalized"))
    if keep is not False and not order_by:
        raise OpError(op, "order_by", f"{keep} needs an order")
    names = [f"d{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    key = [F.col(names[df.columns.index(c)]) for c in columns]
    if mode == "normalized":
        rows = spread(rows).withColumn("key", normalized_key(F.concat_ws("\u001e", *[c.cast("string") for c in key])))
        rows = rows.withColumn("key", F.struct("key", F.when(F.col("key") == "", F.monotonically_increasing_id()).alias("row")))  # what is blank is a group of its own
    else:
        rows = rows.withColumn("key", F.struct(*key))
    if keep is False and mode == "normalized":
        first = F.min_by(F.struct(*names), F.struct(F.lit(0)))
        out = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first.alias("row")).where("n = 1").select("row.*")
    elif keep is False:
        many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = rows.join(many, rows["key"].eqNullSafe(many["key"]), "left_anti").drop("key")
    else:
        chosen = F.min_by if keep == "first" else F.max_by
        out = rows.groupBy("key").agg(chosen(F.struct(*names), F.struct(F.lit(0), names[df.columns.index(order_by)])).alias("row")).select("row.*")
    return out.toDF(*df.columns)


#: Hashes of words that a worker keeps.
_HASHES: dict[str, np.ndarray] = {}
_HASHES_KEPT = 1 << 17
#: Texts whose words a worker has as Python values at a time.
TEXTS = 128


def _votes(word: str) -> np.ndarray:
    """For each bit of a word's hash, the lowest first, 1 or -1."""
    if word not in _HASHES:
        if len(_HASHES) >= _HASHES_KEPT:
            _HASHES.clear()
        bits = np.unpackbits(np.frombuffer(hashlib.sha1(word.encode()).digest()[7::-1], np.uint8), bitorder="little")
        _HASHES[word] = bits.astype(np.int8) * 2 - 1
    return _HASHES[word]


def _fingerprints(batches):
    for whole in batches:
        for start in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(start, TEXTS)
            prints, texts = [], batch.column(1).to_pylist()
            with_words = [i for i, text in enumerate(texts) if text]
            for i in with_words:
                counts = Counter(texts[i])
                tally = np.array(list(counts.values()), np.int64) @ np.stack([_votes(w) for w in counts])
                prints.append(int(np.packbits(tally > 0, bitorder="little").view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(with_words, pa.int64())), pa.array(prints, pa.int64())], names=["id", "fp"])


def with_simhash(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, fp)``: a 64-bit vote of the normalised text's words by frequency, each hashed by SHA-1; texts without words are left out."""
    rows = spread(df.select(_col(id_col).alias("id"), _col(text_col).alias("text"))).select("id", words(normalized(F.col("text"))).alias("w"))
    return rows.mapInArrow(_fingerprints, StructType([StructField("id", rows.schema["id"].dataType), StructField("fp", LongType())]))


def band_keys(prints: DataFrame, max_distance: int) -> DataFrame:
    """``prints`` (fp, ...) under the keys of the bands: two fingerprints at most ``max_distance`` bits apart share one.

    64 bits are cut into ``max_distance + k`` bands; two such fingerprints share ``k`` of them,
    so every choice of ``k`` bands is a key. ``k`` (1 to 3) follows the number of fingerprints
    so that lists stay short; each finds the same pairs. Give it distinct fingerprints.
    """
    if max_distance not in range(16):
        raise OpError("near_pairs", "max_distance", f"{max_distance!r} is not from 0 to 15")
    n = prints.count()
    k = next((k for k in (1, 2, 3) if 8 * 2 ** (64 * k / (max_distance + k)) >= n), 3)
    bands = max_distance + k
    cuts = [round(64 * i / bands) for i in range(bands + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    chosen = [sum(x) for x in combinations(masks, k)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(chosen)])
    return prints.withColumn("key", F.explode(keys))


#: From so many bits on the lists of the bands hold about half of all pairs of real texts (measured at 8), and comparing all is cheaper.
ALL_FROM = 6


def near_groups(df: DataFrame, id_col: str, text_col: str, max_distance: int = 8) -> DataFrame:
    """``(id, group)``: the smallest id reachable over texts at most ``max_distance`` bits apart; texts without words are left out."""
    need_columns("near_groups", "columns", df, [id_col, text_col])
    prints = checkpoint(with_simhash(df, id_col, text_col))
    firsts = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    counts = firsts.agg(F.count(F.lit(1)).alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if max_distance in range(ALL_FROM, 16):
        links = links_of_all(firsts.select("fp"), bits_within(max_distance), counts["prints"])
    else:
        links = links_by_key(band_keys(firsts.select("fp"), max_distance), bits_within(max_distance))
    linked = connected_components(links, "a", "b")
    roots = firsts.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = roots.groupBy("root").agg(F.min("least").alias("group"), F.count(F.lit(1)).alias("n"))
    named = join_table(roots.select("fp", "root"), names.select("root", "group"), "root", names, counts["prints"], counts["prints"])
    return join_table(prints, named.select("fp", "group"), "fp", firsts, counts["prints"], counts["rows"]).select("id", "group")


def dedupe_similar(df: DataFrame, column: str, id_col: str, max_distance: int = 8) -> DataFrame:
    """The first row (smallest id) of each group of near texts, and all rows without words."""
    groups = near_groups(df, id_col, column, max_distance)
    gone = groups.where("id <> group").select(F.col("id").alias("__gone"))
    return df.join(gone, _col(id_col) == F.col("__gone"), "left_anti")


def similar_semi(df: DataFrame, other: DataFrame, column: str, other_column: str, id_col: str, other_id: str, max_distance: int = 8, keep: str = "exclude") -> DataFrame:
    """Rows whose text is not (``exclude``) or is (``keep``) connected to a text of the other table by near texts of either."""
    need_one_of("similar_semi", "keep", keep, ("exclude", "keep"))
    both = df.select(F.struct(F.lit(0).alias("side"), _col(id_col).cast("string").alias("id")).alias("id"), _col(column).alias("text")).unionByName(other.select(F.struct(F.lit(1).alias("side"), _col(other_id).cast("string").alias("id")).alias("id"), _col(other_column).alias("text")))
    groups = checkpoint(near_groups(both, "id", "text", max_distance))
    hit = groups.where("id.side = 1").select("group").distinct()
    mine = groups.where("id.side = 0").join(hit, "group", "left_semi").select(F.col("id.id").alias("__hit"))
    return df.join(mine, _col(id_col).cast("string") == F.col("__hit"), "left_semi" if keep == "keep" else "left_anti")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if either has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar_to(df: DataFrame, id_col: str, vector_col: str, query: list[float], top_k: int = 10) -> DataFrame:
    """``(rank, id, similarity)`` of the ``top_k`` rows nearest to a query vector by cosine."""
    need_columns("similar_to", "columns", df, [id_col, vector_col])
    q = F.array(*[F.lit(float(x)) for x in query])
    out = df.select(_col(id_col).alias("id"), cosine(_col(vector_col), q).alias("similarity")).where("similarity is not null").orderBy(F.desc("similarity"), "id").limit(top_k)
    return out.select(F.row_number().over(Window.orderBy(F.desc("similarity"), "id")).alias("rank"), "id", "similarity")  # top_k rows


def semantic_pairs(df: DataFrame, id_col: str, vector_col: str, threshold: float = 0.92) -> DataFrame:
    """``(a, b, similarity)`` with a < b of all pairs at or over ``threshold`` by cosine, found exactly.

    Each pair of rows gives a row, so give it distinct vectors. Rows without a vector, or with one of length 0, are in none;
    ids are distinct.
    """
    need_columns("semantic_pairs", "columns", df, [id_col, vector_col])
    dense.need_threshold("semantic_pairs", threshold)
    rows = df.select(_col(id_col).alias("id"), dense.unit(_col(vector_col)).alias("u")).where("u is not null and not exists(u, x -> isnan(x))")
    return dense.pairs(rows, threshold)


def semantic_dedupe(df: DataFrame, id_col: str, vector_col: str, threshold: float = 0.92) -> DataFrame:
    """Greedy in order of id: a row goes if a row that stays before it is at ``threshold`` or over; rows without a vector, or with one of length 0, stay.

    Of vectors of one direction only the first can stay, so only it is compared. The rest is decided in rounds: a row
    without an undecided earlier near row stays, and what is near it goes. A round takes figures by row, never pairs.
    """
    from weft.operators.order import numbered

    need_columns("semantic_dedupe", "columns", df, [id_col, vector_col])
    dense.need_threshold("semantic_dedupe", threshold)
    held, classes = dense.directions(df, id_col, vector_col)
    first = classes.select(F.col("id").alias("x"))
    gone = held.select(F.col("id").alias("x")).join(first, "x", "left_anti")
    rows = checkpoint(numbered(classes.select("id", "u"), ["id"]).select(F.col("number").cast("long").alias("id"), F.col("id").alias("x"), "u", F.lit(1).cast("long").alias("n")))
    left = rows
    while not left.isEmpty():
        least = checkpoint(dense.figures(left.withColumn("flag", F.lit(True)), threshold, "least").groupBy("id").agg(F.min("n").alias("least")))
        if least.isEmpty():
            break
        stays = left.join(least.where("least < id"), "id", "left_anti").select("id")
        flagged = left.join(stays.withColumn("flag", F.lit(True)), "id", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
        goes = checkpoint(dense.figures(checkpoint(flagged), threshold, "least").select("id").distinct().join(stays, "id", "left_anti"))
        gone = gone.unionByName(left.join(goes, "id", "left_semi").select("x"))
        left = checkpoint(left.join(goes, "id", "left_anti").join(stays, "id", "left_anti"))
    return df.join(gone.distinct(), _col(id_col) == F.col("x"), "left_anti")
