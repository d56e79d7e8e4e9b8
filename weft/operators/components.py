"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.errors import need_columns
from weft.operators.skew import join_table
from weft.runtime import checkpoint


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with an edge to another; component is the smallest node.

    Each round replaces the edges by two star contractions (every node is linked to the
    smallest node it sees). All state is an edge table, grouped with map-side minima; the
    minima are broadcast or dealt out to the edges (``join_table``), so the edges of a hub
    never meet in one place. Rounds grow with the logarithm of the longest path. Null ends and
    self-loops are ignored; repeated edges count once; an empty edge table gives an empty result.
    """
    need_columns("connected_components", "src/dst", edges, [src, dst])
    a, b = F.col(src), F.col(dst)
    links = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links, seen = checkpoint(links), None
    for _ in range(max_rounds):
        now = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == seen or not now["n"]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        seen_by = join_table(both, least.select("u", F.least("u", "m").alias("m")), "u", least, 2 * now["n"], 2 * now["n"])
        large = seen_by.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_table(large, least.select("u", "m"), "u", least, 2 * now["n"], 2 * now["n"]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"connected_components: no fixpoint after {max_rounds} rounds")


#: Links that a task contracts at a time.
CONTRACTED = 2_000_000


def contracted(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b)`` that connect the same nodes as ``links`` between numbers, at most one for each node of a task."""

    def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        u, v, label = at[: len(u)], at[len(u) :], np.arange(len(names))
        while len(u):
            x, y = label[u], label[v]
            apart = x != y
            u, v, x, y = u[apart], v[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label[label], label):
                label = label[label]
        other = np.nonzero(label != np.arange(len(names)))[0]
        return names[other], names[label[other]]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= CONTRACTED:
                held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
        if held:
            u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["a", "b"])

    return links.select(F.col(a).cast("long"), F.col(b).cast("long")).mapInArrow(run, "a bigint, b bigint")
