"""SimHash near-duplicates through an inverted index of fingerprint bytes.

A fingerprint has 64 bits in 8 bytes. Two that differ in at most ``r`` bits share at least
``8 - r`` bytes at their positions, so within any ``r + k`` positions they share ``k``. The
index therefore lists each distinct fingerprint under every choice of ``k`` of the first
``r + k`` positions with the bytes there; rows that meet in a list have their shared
positional bytes tallied, those that reach ``8 - r`` are kept, and the differing bits decide.
``k`` follows the number of distinct fingerprints, so that lists stay short at any size;
every ``k`` finds the same links. Lists over ``LIST_ROWS`` are cut into blocks before they are
dealt out, and each pair of blocks is a list of its own. A task emits a spanning forest of the
links it finds, never all pairs.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weft.errors import OpError, need_columns
from weft.llm.common import field, keep_first, named_texts, texts_of
from weft.operators.components import connected_components
from weft.operators.skew import BROADCAST_ROWS, join_table
from weft.runtime import checkpoint

SEED = 42
#: Longest list that one task compares whole.
LIST_ROWS = 2048
#: Shingles whose bits are unpacked at a time.
SPAN = 1 << 16


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words of a text, A-Z in lower case, repeats included."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        parts = [line]
    else:
        ends = list(accumulate(len(w) + 1 for w in found))
        parts = [line[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    tally = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SPAN):
        part = np.ascontiguousarray(hashes[i : i + SPAN])
        tally += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(tally * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = 3) -> DataFrame:
    """``(id, fp)``: a fingerprint of each whole text as a signed long; one row for each input row.

    A null text, like one without words, has fingerprint 0. Other columns are ignored.
    """
    need_columns("simhash", "id_col/text_col", docs, [id_col, text_col])

    def run(batches):
        for batch in batches:
            values = [fingerprint(shingle_hashes(t, shingle_words)) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["id", "fp"])

    schema = StructType([field(docs, id_col, "id"), StructField("fp", LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def key_bytes(distinct: int, max_bits: int) -> int:
    """Positions in a key: enough for random fingerprints to meet about once in ten lists or less."""
    return next((k for k in range(1, 8 - max_bits) if k >= 3 and 256**k >= 10 * distinct), 8 - max_bits)


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


def list_links(keys: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run of equal keys."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, step, held = np.arange(len(keys)), 1, 0
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        differ = prints[at] ^ prints[at + step]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = at[shared >= 8 - max_bits]
        near = near[np.bitwise_count((prints[near] ^ prints[near + step]).view(np.uint64)) <= max_bits]
        found_a.append(prints[near])
        found_b.append(prints[near + step])
        held += len(near)
        if held > 1 << 20:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], 0
        step += 1
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def list_pairs(keys: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the bound, the smaller fingerprint second, that connect each run of equal keys as its links do: no pair of rows that are connected already."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    group, at, step = np.arange(len(keys)), np.arange(len(keys)), 1
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            return np.concatenate(found_a), np.concatenate(found_b)
        near = at[group[at] != group[at + step]]
        differ = prints[near] ^ prints[near + step]
        near = near[(differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - max_bits]
        near = near[np.bitwise_count((prints[near] ^ prints[near + step]).view(np.uint64)) <= max_bits]
        if len(near):
            found_a.append(np.maximum(prints[near], prints[near + step]))
            found_b.append(np.minimum(prints[near], prints[near + step]))
            nodes, roots = forest(group[near], group[near + step])
            new = np.arange(len(keys))
            new[nodes] = roots
            group = new[group]
        step += 1


def _compare(max_bits: int, compare=list_links):
    """Compare the rows of each key of a sorted partition."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(keys, prints):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in compare(keys, prints, max_bits)], schema=schema)

    def run(batches):
        keys = prints = np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy()])
            last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            yield links(keys[:last], prints[:last])
            keys, prints = keys[last:], prints[last:]
        yield links(keys, prints)

    return run


def fingerprint_links(prints: DataFrame, max_bits: int = 3, list_rows: int = LIST_ROWS, pairs: bool = False) -> DataFrame:
    """``(a, b)``: links that connect all fingerprints ``fp`` differing in at most ``max_bits`` bits.

    Not every pair is listed, but two fingerprints are connected by the listed links exactly
    if they are connected by pairs within the bound. With ``pairs`` each link is such a pair.
    """
    if max_bits not in range(6):
        raise OpError("simhash", "max_bits", f"{max_bits!r} is not a whole number from 0 to 5")
    spark, n = prints.sparkSession, prints.count()
    if not n or not max_bits:
        return spark.createDataFrame([], "a bigint, b bigint")
    k = key_bytes(n, max_bits)
    masks = [sum(255 << 8 * p for p in chosen) for chosen in combinations(range(max_bits + k), k)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    listed = prints.select(F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("key"), "fp")
    blocks = F.ceil(F.col("n") / list_rows).cast("int").alias("blocks")
    long = checkpoint(listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > list_rows).select("key", blocks))
    few = long.count()
    if few:
        both = listed.join(F.broadcast(long) if few <= BROADCAST_ROWS else long, "key", "left")
        both = both.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
        listed = both.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("key"), "fp")
    return listed.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(max_bits, list_pairs if pairs else list_links), "a bigint, b bigint")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """``(id, fp, component_id)`` for each input row; component_id is the smallest id reachable over links.

    Texts are grouped by fingerprint first, so copies cost one list entry whatever their
    number. Null texts and texts without words have fingerprint 0 and link like any other;
    rows with a null id belong to their group but name it only if no other member has an id.
    Repeated rows give repeated rows; an empty table gives none.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, shingle_words))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    counts = distinct.agg(F.count(F.lit(1)).alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    linked = connected_components(fingerprint_links(distinct.select("fp"), max_bits), "a", "b").withColumnRenamed("node", "fp")
    members = checkpoint(linked.join(distinct.select("fp", "least_id"), "fp"))
    named = members.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    found = join_table(members.select("fp", "component"), named.drop("n"), "component", named, counts["prints"], counts["prints"]).select("fp", "component_id")
    roots = distinct.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return join_table(prints, roots, "fp", distinct, counts["prints"], counts["rows"]).select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each group: the row of ``docs`` with its smallest id, all columns kept.

    Of rows of a group with equal ids the first by text stays. Rows without an id stay only if
    nothing else in their group has one; then one of them does.
    """
    need_columns("simhash", "id_col/text_col", docs, [id_col, text_col])
    groups = near_duplicate_groups(named_texts(docs, id_col, text_col), "id", "text", shingle_words, max_bits)
    return keep_first(docs, checkpoint(groups.select("id", "component_id")), id_col, text_col)


def hex_fingerprint(fp):
    """16 lowercase hex digits of a signed fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
