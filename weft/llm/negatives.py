"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster, a candidate at the angle t from its centre, with the largest angle r of a
member, has a product with a member of at most ``|anchor| |candidate| cos(max(0, t - r))``. The candidates are sorted by this
bound once for a cluster; every member walks that one list and stops where the bound of all that follows is below what it
still needs, so its result is certified and exact. Members first walk for their positives, then for negatives in the windows
that the positives' scores give.

The work is a grid of cells: a part of the anchors (whole clusters, large ones cut) by a block of the candidates, both of
bounded size, so a task holds one part and one block whatever the tables hold. Each cell sorts its block once for each of
its clusters; the best of all blocks are merged. The vectors of a block are sent once for each part of the anchors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from weft.errors import need_columns
from weft.runtime import checkpoint

#: Numbers of a cell: components of its candidates, and of its anchors.
BLOCK_NUMBERS, PART_NUMBERS = 1 << 22, 1 << 18
#: Anchors that the centres are fitted on, at most; all anchors are then assigned.
SAMPLE = 4096
CLUSTERS = 64
#: Largest size of a whole component; products of 32,768 of them still fit a long.
LARGEST = 1 << 24
#: Candidates of the first step of a walk; each further step takes as many as all before.
STEP = 512


def quantized(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", flip_every: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """``(id, label, q)``: rows that take part, with whole components ``floor(scale * x)``; where ``id`` is divisible by ``flip_every`` the next label.

    No part take rows with a null id, label or vector, with a null or non-finite component, and with one whose size times
    ``scale`` is beyond 2 to the 24 (their products leave a long). Of rows with one id the one with the smallest label, then
    the smallest components does. An empty vector is as zeros; of vectors of several lengths shorter ones are as if they
    ended in zeros.
    """
    need_columns("hard_negatives", "id_col/vector_col/label_col", df, [id_col, vector_col, label_col])
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(F.lit(float(scale)) * v) <= float(LARGEST)))
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & good)
    label = F.col(label_col).cast("long")
    if flip_every:
        label = F.when(F.col(id_col) % flip_every == 0, (label + 1) % labels).otherwise(label)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.transform(x, lambda v: F.floor(v * float(scale)).cast("int")).alias("q"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("row")).select("id", "row.*")


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows of ``width`` numbers, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _centres(anchors: DataFrame, width: int, clusters: int, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """Unit centres of at most ``clusters`` clusters by spherical k-means over the ``SAMPLE`` anchors with the smallest hashes."""
    drawn = anchors.select("id", "q").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    x = np.zeros((len(drawn), width))
    for i, r in enumerate(drawn):
        x[i, : len(r["q"])] = r["q"]
    x = _unit(x)
    k = max(1, min(clusters, math.isqrt(len(x))))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)] if len(x) else np.zeros((1, width))
    for _ in range(rounds if len(x) else 0):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def _assigned(anchors: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """``anchors`` with the ``cluster`` of the nearest centre."""

    def run(batches):
        for batch in batches:
            q = batch.column(batch.schema.get_field_index("q"))
            nearest = (_unit(_matrix(q, width)) @ centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=[*batch.schema.names, "cluster"])

    return anchors.mapInArrow(run, StructType([*anchors.schema.fields, StructField("cluster", IntegerType())]))


def _parted(anchors: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``anchors`` with a ``part``: clusters one behind the other, cut into parts of about ``most`` anchors; and the number of parts."""
    sizes = {r["cluster"]: r["n"] for r in anchors.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cluster
    start, place = 0, F.lit(0).cast("long")
    for cluster in sorted(sizes):
        place = F.when(F.col("cluster") == cluster, F.lit(start) + F.pmod(F.xxhash64("id"), F.lit(sizes[cluster]))).otherwise(place)
        start += sizes[cluster]
    return anchors.withColumn("part", F.floor(place / most).cast("int")), max(1, -(-start // most))


class _Block:
    """Candidates of a cell; the list of a cluster is their order by its bound."""

    def __init__(self, table: pa.Table, width: int):
        self.id, self.label = table["id"].to_numpy(), table["label"].to_numpy()
        self.x = _matrix(table["q"].combine_chunks(), width)
        self.size = np.linalg.norm(self.x, axis=1)
        self.unit = _unit(self.x)

    def listed(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the candidates for the members of a cluster, and the bound (for an anchor of length 1) at each place of it."""
        centre = _unit(_unit(members).sum(axis=0, keepdims=True))[0]
        reach = float(np.arccos(np.clip(_unit(members) @ centre, -1, 1)).max())
        angle = np.arccos(np.clip(self.unit @ centre, -1, 1))
        bound = self.size * (np.cos(np.maximum(0, angle - reach)) + 1e-7) + 1e-6  # with room for rounding
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class _Best:
    """For each row the ``k`` entries with the highest scores, ties by smaller id."""

    def __init__(self, rows: int, k: int):
        self.k, self.rows = k, rows
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(rows, np.iinfo(np.int64).min)  # the k-th score of the rows that have k

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Offer ``scores`` (a line for each of ``rows``, a column for each id) where ``fits``."""
        low = np.iinfo(np.int64).min
        floor = self.least[rows]
        if scores.shape[1] > self.k:
            open_ = np.where(fits, scores, low)
            floor = np.maximum(floor, np.partition(open_, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(fits & (scores >= floor[:, None]))
        if not len(i):
            return
        row, score, id_ = np.concatenate([self.row, rows[i]]), np.concatenate([self.score, scores[i, j]]), np.concatenate([self.id, ids[j]])
        order = np.lexsort((id_, -score, row))
        row, score, id_ = row[order], score[order], id_[order]
        first = np.searchsorted(row, row, "left")
        place = np.arange(len(row)) - first
        keep = place < self.k
        self.row, self.score, self.id = row[keep], score[keep], id_[keep]
        full = place[keep] == self.k - 1
        self.least[self.row[full]] = self.score[full]


def _walk(block: _Block, members: np.ndarray, needs, offer) -> None:
    """Walk the list of one cluster. ``needs()`` is the score from which an entry can still count, for each member; ``offer(active, scores, places)`` takes a step's products."""
    order, bound = block.listed(members)
    length, at = np.linalg.norm(members, axis=1), 0
    while at < len(order):
        active = np.nonzero(length * bound[at] + 1e-6 >= needs())[0]
        if not len(active):
            return
        end = min(len(order), at + max(STEP, at))
        end = min(end, at + max(STEP, (1 << 22) // len(active)))  # so many products are held
        places = order[at:end]
        offer(active, _products(members[active], block.x[places]), places)
        at = end


def _positives(anchors: pa.Table, block: _Block, width: int, k: int):
    """Arrays (anchor, id, score): for each anchor its best ``k`` others of the same label in the block."""
    ids, labels, x, cluster = anchors["id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["q"].combine_chunks(), width), anchors["cluster"].to_numpy()
    for c in np.unique(cluster):
        mine = np.nonzero(cluster == c)[0]
        best = _Best(len(mine), k)

        def offer(active, scores, places, mine=mine, best=best):
            same = (labels[mine[active]][:, None] == block.label[places][None]) & (ids[mine[active]][:, None] != block.id[places][None])
            best.take(active, scores, block.id[places], same)

        _walk(block, x[mine], lambda best=best: best.least.astype(float), offer)
        yield ids[mine[best.row]], best.id, best.score


def _negatives(anchors: pa.Table, block: _Block, width: int, k: int, percent: int):
    """Arrays (anchor, positive, positive score, id, score): for each positive of an anchor the best ``k`` of another label within its window."""
    ids, labels, x, cluster = anchors["id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["q"].combine_chunks(), width), anchors["cluster"].to_numpy()
    held = anchors["positives"].combine_chunks()
    sizes, items = np.diff(held.offsets.to_numpy()), held.flatten()
    owner, scores_of, ids_of = np.repeat(np.arange(len(ids)), sizes), items.field("score").to_numpy(), items.field("id").to_numpy()
    for c in np.unique(cluster):
        mine = np.nonzero(cluster == c)[0]
        back = np.full(len(ids), -1)
        back[mine] = np.arange(len(mine))
        slot = np.nonzero(back[owner] >= 0)[0]
        member, top, name = back[owner[slot]], scores_of[slot], ids_of[slot]
        low = -(-percent * top // 100)  # the least whole score with percent * top <= 100 * score
        best = _Best(len(slot), k)

        def needs(best=best, member=member, low=low, top=top, n=len(mine)):
            still = np.full(n, np.inf)  # members without an open window need nothing
            np.minimum.at(still, member[low <= top], np.maximum(low, best.least)[low <= top].astype(float))
            return still

        def offer(active, scores, places, mine=mine, best=best, member=member, low=low, top=top):
            line = np.full(len(mine), -1)
            line[active] = np.arange(len(active))
            other = labels[mine[active]][:, None] != block.label[places][None]
            rank = np.arange(len(member)) - np.searchsorted(member, member, "left")  # each member's windows one after the other, to hold few products at a time
            for j in range(int(rank.max(initial=-1)) + 1):
                w = np.nonzero((rank == j) & (line[member] >= 0))[0]
                s = scores[line[member[w]]]
                best.take(w, s, block.id[places], other[line[member[w]]] & (s >= low[w][:, None]) & (s <= top[w][:, None]))

        _walk(block, x[mine], needs, offer)
        yield ids[mine[member[best.row]]], name[best.row], top[best.row], best.id, best.score


def _grid(anchors: DataFrame, parts: int, rows: DataFrame, blocks: int, work, names: list[str]) -> DataFrame:
    """``work`` on each part of the anchors with each block of the rows."""
    left = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = pa.schema([(n, pa.int64()) for n in names])

    def cell(some: pa.Table, table: pa.Table) -> pa.Table:
        found = list(work(some, table)) if len(some) and len(table) else []
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * len(names)
        return pa.table([pa.array(np.asarray(x, np.int64)) for x in columns], schema=schema)

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(cell, ", ".join(f"{n} bigint" for n in names))


def _first(rows: DataFrame, by: list[str], score: str, id_col: str, k: int) -> DataFrame:
    """The first ``k`` of each group by score, then by id, numbered in ``rank``; each block has sent ``k`` at most."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_col)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, clusters: int = CLUSTERS, block_numbers: int = BLOCK_NUMBERS, part_numbers: int = PART_NUMBERS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for ``rows`` (id, label, q) of ``quantized``.

    Scores are inner products. An anchor's positives are its first rows of the same label, itself left out; for each of them
    the first rows of another label come that score at most as much as the positive and at least ``percent`` of it. Higher
    scores come first, ties by smaller id. A positive without a row in its window, as any with a score below 0, gives none.

    ``is_anchor`` is a condition over ``rows``. All rows are candidates; centres are fitted on a sample of the anchors, which
    decides how far a walk goes and never what it finds.
    """
    need_columns("hard_negatives", "rows", rows, ["id", "label", "q"])
    rows = checkpoint(rows.select("id", "label", "q"))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("width")).first()
    width = max(1, shape["width"])
    anchors = rows.where(is_anchor)
    anchors, parts = _parted(checkpoint(_assigned(anchors, _centres(anchors, width, clusters), width)), max(1, part_numbers // width))
    blocks = max(1, -(-shape["n"] * width // block_numbers))
    near = _grid(anchors, parts, rows, blocks, lambda a, b: _positives(a, _Block(b, width), width, positives), ["anchor", "id", "score"])
    chosen = _first(near, ["anchor"], "score", "id", positives).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))  # at most so many each
    members = checkpoint(anchors.join(chosen, anchors["id"] == chosen["anchor"]).drop("anchor"))
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    hard = _grid(members, parts, rows, blocks, lambda a, b: _negatives(a, _Block(b, width), width, negatives, percent), names)
    found = _first(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = r"""
WITH raw AS (
  SELECT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.id AS anchor_id, a.label AS al, c.id, c.label, list_sum([a.q[i] * c.q[i] FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score
  FROM raw a, raw c WHERE a.id % 100 = 0 AND a.id <> c.id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE label = al QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.al AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
