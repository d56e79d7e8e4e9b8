"""Near fingerprints that meet under keys: compared list by list in tasks, never as a join of all pairs.

Rows ``(key, fp, ...)`` with one key are a list. Long lists are cut into blocks before they are dealt
out, and each pair of blocks is a list of its own, so no task holds a whole long list.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.skew import BROADCAST_ROWS
from weft.runtime import checkpoint

#: Longest list that one task compares whole.
LIST_ROWS = 2048
#: Rows of one of the two blocks that a task compares where all fingerprints are, and the blocks there are at least.
BLOCK_ROWS, BLOCKS = 32_768, 16


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(node, smallest node of its component)`` for the given edges."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def bits_within(most: int) -> Callable[[np.ndarray], np.ndarray]:
    """Whether differences of fingerprints have at most so many bits."""
    return lambda differ: np.bitwise_count(differ.view(np.uint64)) <= most


def _near(keys: np.ndarray, prints: np.ndarray, near):
    """Places ``(i, j)`` of near fingerprints with one key, for one distance between the places after the other."""
    at, step = np.arange(len(keys)), 1
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            return
        found = at[near(prints[at] ^ prints[at + step])]
        yield found, found + step
        step += 1


def list_links(keys: np.ndarray, prints: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run of equal keys."""
    found_a, found_b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i, j in _near(keys, prints, near):
        found_a.append(prints[i])
        found_b.append(prints[j])
        held += len(i)
        if held > 1 << 20:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], 0
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def _by_list(work, names: list[str]):
    """``work`` on the columns of whole lists of a sorted partition."""
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        held = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in work(*[c[:last] for c in held])], schema=schema)
            held = [c[last:] for c in held]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in work(*held)], schema=schema)

    return run


def _dealt(listed: DataFrame, list_rows: int) -> DataFrame:
    """``listed`` sorted by key within partitions, the keys of long lists replaced by those of pairs of blocks."""
    blocks = F.ceil(F.col("n") / list_rows).cast("int").alias("blocks")
    long = checkpoint(listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > list_rows).select("key", blocks))
    few = long.count()
    if few:
        both = listed.join(F.broadcast(long) if few <= BROADCAST_ROWS else long, "key", "left")
        both = both.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
        key = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
        listed = both.withColumn("key", key).select(*listed.columns)
    return listed.repartition("key").sortWithinPartitions("key")


def links_by_key(listed: DataFrame, near, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(a, b)``: links that connect the fingerprints of ``listed`` (key, fp) as all near pairs within lists do; a spanning forest of each list."""
    return _dealt(listed.select("key", "fp"), list_rows).mapInArrow(_by_list(lambda keys, prints: list_links(keys, prints, near), ["a", "b"]), "a bigint, b bigint")


def extremes_by_key(listed: DataFrame, near, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(fp, low, high)``: for ``listed`` (key, fp, low, high) the least and the greatest values among the near fingerprints of each list."""

    def work(keys, prints, low, high):
        least, most, seen = low.copy(), high.copy(), np.zeros(len(keys), bool)
        for i, j in _near(keys, prints, near):
            np.minimum.at(least, i, low[j])
            np.minimum.at(least, j, low[i])
            np.maximum.at(most, i, high[j])
            np.maximum.at(most, j, high[i])
            seen[i] = seen[j] = True
        return prints[seen], least[seen], most[seen]

    return _dealt(listed.select("key", "fp", "low", "high"), list_rows).mapInArrow(_by_list(work, ["fp", "low", "high"]), "fp bigint, low bigint, high bigint")


def _between(near):
    """A spanning forest of the links between the two sides, or within the one, of each run of equal keys."""

    def links(keys, side, prints):
        found_a, found_b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for sides, part in zip(np.split(side, cuts), np.split(prints, cuts), strict=True):
            one = not len(sides) or sides[0] == sides[-1]
            low = part if one else part[sides == sides[0]]
            high = part if one else part[sides != sides[0]]
            for i, x in enumerate(low):
                others = high[i + 1 :] if one else high
                hit = others[near(others ^ x)]
                if len(hit):
                    found_a.append(np.full(len(hit), x))
                    found_b.append(hit)
                    held += len(hit)
                if held > 1 << 20:
                    a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
                    found_a, found_b, held = [a], [b], 0
        return forest(np.concatenate(found_a), np.concatenate(found_b))

    return links


def links_of_all(prints: DataFrame, near, rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(a, b)``: links that connect the distinct fingerprints ``fp``, ``rows`` in number, as all near pairs do, by comparing all of them.

    They are dealt into blocks, and a task compares two blocks: each pair of fingerprints once, with no more rows in a
    task and as many copies of a row as there are blocks.
    """
    blocks = max(BLOCKS, -(-rows // block_rows))
    mine, other = F.col("mine"), F.col("other")
    dealt = prints.select("fp", F.pmod(F.xxhash64("fp"), F.lit(blocks)).alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    listed = dealt.select((F.least(mine, other) * blocks + F.greatest(mine, other)).cast("long").alias("key"), mine.cast("long").alias("side"), "fp")
    tasks = min(blocks * (blocks + 1) // 2, 2000)  # so many pairs of blocks; sized by work, not by bytes
    return listed.repartition(tasks, "key").sortWithinPartitions("key", "side").mapInArrow(_by_list(_between(near), ["a", "b"]), "a bigint, b bigint")
