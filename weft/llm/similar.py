"""Near-duplicates at a wanted similarity of word shingles: the byte-position index over minwise bytes.

A 64-bit SimHash with a radius of 3 bits links few of the pairs at a Jaccard similarity of 0.8
(about one in ten of those measured), so where a similarity is asked for, the positional bytes
are minwise ones: byte ``i`` of a signature is the low byte of the least value of the ``i``-th
hash over the shingles, and two texts share a byte with the probability of their similarity.
The SimHash fingerprints come first all the same: texts with one
fingerprint, and pairs that the index of fingerprint bytes, the tally and the bits give at
``FINGERPRINT_BITS``, are candidates, and the shingle sets verify them. The minwise bytes find
the pairs that are left. For these the rest is as for fingerprints: groups of bytes are the keys of an inverted index, texts that
meet under a key have their shared bytes tallied, pairs that reach the least count are kept, and
the shingle sets themselves decide. Equal sets are one entry.

Each text is first compared with one other text (of those that come first under its keys, the
first with a likely tally), which settles most keys: those whose texts are all connected then. In
the others the texts of different groups are compared under the first key that a pair shares, by
the tally alone, and those with a likely partner once more with their sets. Keys of many or long texts are cut into blocks. Only verified
pairs are links, and a task emits a spanning forest of them.

A pair at the bound meets in at least one of ``BANDS`` keys of ``BAND_BYTES`` bytes with
probability ``1 - (1 - s ** BAND_BYTES) ** BANDS`` (0.9996 at 0.8).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from weft.errors import OpError, need_columns
from weft.llm.common import BROADCAST_IDS, field, keep_first, named_texts, slices, texts_of
from weft.llm.simhash import fingerprint, fingerprint_links, shingle_hashes
from weft.operators.components import connected_components
from weft.operators.skew import join_table
from weft.runtime import checkpoint

BAND_BYTES, BANDS = 5, 20
POSITIONS = BAND_BYTES * BANDS
#: Words of a shingle of the fingerprints, and bits that two may differ in.
FINGERPRINT_WORDS, FINGERPRINT_BITS = 3, 3
#: Deviations of the tally below its mean that still count.
SLACK = 4.5
#: Texts, and hashes of their sets, of one block of a key; a task compares two blocks at a time.
BLOCK, BLOCK_HASHES = 512, 4 << 20
_RNG = np.random.default_rng(20)
_FACTORS = (_RNG.integers(1, 1 << 32, POSITIONS, dtype=np.uint64) | 1).astype(np.uint32)
_SHIFTS = _RNG.integers(0, 1 << 32, POSITIONS, dtype=np.uint64).astype(np.uint32)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, words))


def signature(hashes: np.ndarray) -> bytes:
    """The minwise bytes of a set; zeros for an empty one."""
    if not len(hashes):
        return bytes(POSITIONS)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        part = low[i : i + 2048]
        values = _FACTORS[:, None] * part[None, :] + _SHIFTS[:, None]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        values ^= values >> np.uint32(12)
        least = np.minimum(least, values.min(axis=1))
    return least.astype(np.uint8).tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """``(id, same, signature, hashes, fp)`` of each row; ``same`` is a digest of the shingle set, ``hashes`` its size, ``fp`` the SimHash fingerprint."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                same, signed, sizes, prints = [], [], [], []
                for text in texts_of(part.column(1)):
                    hashes = shingle_set(text, shingle_words)
                    same.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                    signed.append(signature(hashes))
                    sizes.append(len(hashes))
                    prints.append(fingerprint(shingle_hashes(text, FINGERPRINT_WORDS)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(same, pa.binary()), pa.array(signed, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64())], names=["id", "same", "signature", "hashes", "fp"])

    schema = StructType([field(docs, id_col, "id"), StructField("same", BinaryType()), StructField("signature", BinaryType()), StructField("hashes", LongType()), StructField("fp", LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def least_tally(similarity: float) -> float:
    """Shared positions that a pair at ``similarity`` has at least, ``SLACK`` deviations below the mean."""
    return POSITIONS * similarity - SLACK * (POSITIONS * similarity * (1 - similarity)) ** 0.5


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes have at least this Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = np.count_nonzero(np.isin(x, y, assume_unique=True, kind="sort"))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _cells(batches, columns: int):
    """The rows of each cell of a sorted partition, as lists by column."""
    cell, held = None, [[] for _ in range(columns)]
    for batch in batches:
        cells = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
        values = [batch.column(i).to_pylist() for i in range(columns)]
        cuts = [0, *(np.nonzero(cells[1:] != cells[:-1])[0] + 1).tolist(), len(cells)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if cells[a] != cell and held[0]:
                yield held
                held = [[] for _ in range(columns)]
            cell = cells[a]
            for have, column in zip(held, values, strict=True):
                have += column[a:b]
    if held[0]:
        yield held


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], schema=_PAIRS)


def _tallied(similarity: float):
    """Rows ``(node, hub, hashes)`` of ``(node, hub, signature, mark, hashes)`` whose signatures share enough bytes."""
    least = least_tally(similarity)

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, POSITIONS) for i in (2, 3))
            kept = batch.filter(pa.array((a == b).sum(axis=1) >= least))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(4)], names=["node", "hub", "hashes"])

    return run


def _with_hub(similarity: float):
    """``(a, b)``: the rows of a cell ``(cell, node, hub, set)``, its hub first, that are alike with the hub."""
    def run(batches):
        cell = have = None
        for batch in batches:
            found = []
            for c, node, of, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                hashes = np.frombuffer(packed, np.uint64)
                if c != cell:
                    cell, have = c, hashes
                elif alike(have, hashes, similarity):
                    found.append((node, of))
            yield _pairs(found)

    return run


def _candidates(i: int, matrix: np.ndarray, bands: np.ndarray, side: np.ndarray, band: int, least: float) -> np.ndarray:
    """Rows after ``i`` that may be alike with it and share no key before this one; of another block, where a cell has two."""
    later = np.nonzero((matrix[i + 1 :] == matrix[i]).sum(axis=1) >= least)[0] + i + 1
    if len(later) and side[0] != side[-1]:
        later = later[side[later] != side[i]]
    return later[(bands[later] == bands[i]).argmax(axis=1) == band] if len(later) else later


def _matrix(signed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.frombuffer(b"".join(signed), np.uint8).reshape(len(signed), POSITIONS)
    wide = np.zeros((len(signed), BANDS, 8), np.uint8)
    wide[:, :, :BAND_BYTES] = matrix.reshape(len(signed), BANDS, BAND_BYTES)
    return matrix, wide.view(np.uint64)[:, :, 0]


def _likely(similarity: float):
    """``(cell, node)``: the rows of a cell ``(cell, mine, node, group, band, signature)`` that may be alike with one of another group."""
    least = least_tally(similarity)

    def run(batches):
        for cell, side, nodes, groups, band, signed in _cells(batches, 6):
            (matrix, bands), groups, side = _matrix(signed), np.array(groups), np.array(side)
            wanted = np.zeros(len(nodes), bool)
            for i in range(len(nodes) - 1):
                later = _candidates(i, matrix, bands, side, band[0], least)
                later = later[groups[later] != groups[i]]
                wanted[later] = True
                wanted[i] |= bool(len(later))
            keep = np.nonzero(wanted)[0].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], kind) for c, kind in ((cell, pa.int64()), (side, pa.int32()), (nodes, pa.int64()), (groups, pa.int64()), (band, pa.int32()))], names=["cell", "mine", "node", "group", "band"])

    return run


def _verify(similarity: float):
    """``(a, b)``: a spanning forest of the pairs of a cell ``(cell, mine, node, group, band, signature, set)`` that are alike; rows of one group are connected already."""
    least = least_tally(similarity)

    def run(batches):
        for _, side, nodes, groups, band, signed, packed in _cells(batches, 7):
            (matrix, bands), side = _matrix(signed), np.array(side)
            hashes = [np.frombuffer(x, np.uint64) for x in packed]
            first: dict = {}
            up = [first.setdefault(g, i) for i, g in enumerate(groups)]

            def root(i):
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            found = []
            for i in range(len(nodes) - 1):
                for j in _candidates(i, matrix, bands, side, band[0], least).tolist():
                    a, b = root(i), root(j)
                    if a != b and alike(hashes[i], hashes[j], similarity):
                        up[max(a, b)] = min(a, b)
                        found.append((nodes[i], nodes[j]))
            yield _pairs(found)

    return run


def _with_sets(rows: DataFrame, shingle_words: int) -> DataFrame:
    """``text`` replaced by the bytes of its shingle set."""

    names, at = rows.columns, rows.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                columns = list(part.columns)
                columns[at] = pa.array([shingle_set(t, shingle_words).tobytes() for t in texts_of(part.column(at))], pa.binary())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [StructField("text", BinaryType()) if f.name == "text" else f for f in rows.schema.fields]
    return rows.mapInArrow(run, StructType(fields))


def _blocks(rows: str, hashes: str):
    """Into how many blocks so many rows and hashes of their sets are cut."""
    return F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(hashes) / BLOCK_HASHES)).cast("int")


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """``(node, hub)``: nodes whose fingerprints are equal, or a pair of the index of fingerprint bytes; enough of them to connect all such."""
    prints = checkpoint(distinct.groupBy("fp").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")))
    size = prints.agg(F.count(F.lit(1)).alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes")).first()
    equal = join_table(distinct.select("fp", "node"), prints.select("fp", "hub"), "fp", prints, size["prints"], size["nodes"]).where("node <> hub").select("node", "hub")
    first = lambda end, name: prints.select(F.col("fp").alias(end), F.col("hub").alias(name))
    near = fingerprint_links(prints.select("fp"), FINGERPRINT_BITS, pairs=True).distinct()
    near = near.join(first("a", "node"), "a").join(first("b", "hub"), "b").select("node", "hub")
    return checkpoint(equal.unionByName(near))


def _links(distinct: DataFrame, named: DataFrame, shingle_words: int, similarity: float, repeated: bool) -> DataFrame:
    """``(a, b)``: verified links that connect the nodes of ``distinct`` as all pairs at ``similarity`` do; ``repeated``: some rows of ``named`` are equal."""
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("signature", b * BAND_BYTES + 1, BAND_BYTES)) for b in range(BANDS)])
    listed = distinct.select(F.posexplode(keys).alias("band", "key"), "node", "hashes")
    meet = checkpoint(listed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n"), F.sum("hashes").alias("all")).where("n > 1"))
    counts = meet.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    members = checkpoint(join_table(listed, meet.select("key", "hub", _blocks("n", "all").alias("blocks")), "key", meet, counts["keys"], counts["rows"]))
    printed = fingerprint_pairs(distinct)
    met = members.select("node").unionByName(printed.select(F.explode(F.array("node", "hub")).alias("node"))).distinct()
    nodes = checkpoint(distinct.join(met, "node", "left_semi").select("node", "least", "signature", "hashes"))
    few = nodes.count() <= BROADCAST_IDS  # some 60 bytes each
    of = nodes.select("node", F.col("least.id").alias("least_id"), F.col("least.key").alias("least_key"))
    rows = named.join(F.broadcast(of) if few else of, F.col("id.id").eqNullSafe(F.col("least_id")) & (F.col("id.key") == F.col("least_key"))).select("node", "text")
    rows = rows.dropDuplicates(["node"]) if repeated else rows
    sets = checkpoint(_with_sets(rows, shingle_words))
    # each text with those that its fingerprint meets, and with the first likely one of the hubs of its keys
    edges = members.where("node <> hub").select("node", "hub").distinct()
    of_hub = edges.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    both = join_table(edges.join(nodes.select("node", "signature", "hashes"), "node"), nodes.select(F.col("node").alias("hub"), F.col("signature").alias("mark")), "hub", of_hub, counts["rows"], counts["rows"])
    chosen = both.select("node", "hub", "signature", "mark", "hashes").mapInArrow(_tallied(similarity), "node bigint, hub bigint, hashes bigint")
    chosen = chosen.groupBy("node").agg(F.min("hub").alias("hub"), F.first("hashes").alias("hashes"))
    chosen = checkpoint(chosen.unionByName(printed.join(nodes.select("node", "hashes"), "node").select("node", "hub", "hashes")).distinct())
    sizes = chosen.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("hashes").alias("all"))
    stars = sizes.select("hub", _blocks("n", "all").alias("blocks"))
    linked = counts["rows"] + printed.count()
    dealt = join_table(chosen, stars, "hub", sizes, linked, linked).select("node", "hub", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    hubs = stars.select(F.col("hub").alias("node"), "hub", F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"))
    cells = dealt.unionByName(hubs).join(sets, "node").select(F.xxhash64("hub", "block").alias("cell"), "node", "hub", "text")
    cells = cells.repartition("cell").sortWithinPartitions("cell", F.col("node") != F.col("hub"))
    links = checkpoint(cells.mapInArrow(_with_hub(similarity), "a bigint, b bigint"))
    # texts of different groups under keys that are not connected yet
    groups = connected_components(links, "a", "b")
    grouped = checkpoint(members.join(groups, "node", "left").select("key", "band", "node", "blocks", F.coalesce("component", "node").alias("group")))
    spread = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n")
    spread = checkpoint(spread)
    mine = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    dealt = join_table(grouped, spread.select("key"), "key", spread, counts["keys"], counts["rows"]).withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "mine", "node", "group", "band")
    cells = dealt.join(nodes.select("node", "signature"), "node").select("cell", "mine", "node", "group", "band", "signature")
    order = ("cell", "mine", "node")
    wanted = checkpoint(cells.repartition("cell").sortWithinPartitions(*order).mapInArrow(_likely(similarity), "cell bigint, mine int, node bigint, `group` bigint, band int"))
    cells = wanted.join(nodes.select("node", "signature"), "node").join(sets, "node").select("cell", "mine", "node", "group", "band", "signature", "text")
    more = cells.repartition("cell").sortWithinPartitions(*order).mapInArrow(_verify(similarity), "a bigint, b bigint")
    return links.unionByName(more)


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float) -> DataFrame:
    """``(id, component_id)`` for each row, ids as in ``named_texts``; component_id is the smallest of the group.

    The nodes are the distinct shingle sets, numbered, each with the smallest id that has it.
    """
    need_columns("similar", "id_col/text_col", docs, [id_col, text_col])
    if not 0 < similarity <= 1:
        raise OpError("similar", "similarity", f"{similarity!r} is not above 0 and up to 1")
    named = named_texts(docs, id_col, text_col)
    signed = checkpoint(signatures(named, "id", "text", shingle_words))
    firsts = signed.groupBy("same").agg(F.min("id").alias("least"), F.first("signature").alias("signature"), F.first("hashes").alias("hashes"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    distinct = checkpoint(firsts.withColumn("node", F.monotonically_increasing_id()))
    counts = distinct.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    repeated = not signed.groupBy("id").count().where("count > 1").isEmpty()
    linked = checkpoint(connected_components(_links(distinct, named, shingle_words, similarity, repeated), "a", "b").join(distinct.select("node", "least"), "node"))
    firsts = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    nodes = linked.count()
    linked = join_table(linked.select("node", "component"), firsts.drop("n"), "component", firsts, nodes, nodes).select("node", "component_id")
    roots = distinct.join(linked, "node", "left").select("same", F.coalesce("component_id", "least").alias("component_id"))
    return join_table(signed.select("id", "same"), roots, "same", distinct.select("same", "n"), counts["sets"], counts["rows"]).select("id", "component_id")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(id, component_id)`` for each row: the smallest id that is reachable over pairs at ``similarity`` or above.

    Texts with equal shingle sets are alike; null texts and texts without words have the empty
    set. A text of fewer words is one shingle. Repeated rows repeat, and an id on unlike texts is
    in several groups; component_id is null where no member has an id. An empty table gives none.
    """
    return _groups(docs, id_col, text_col, shingle_words, similarity).select("id.id", F.col("component_id.id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group: the row of ``docs`` with its smallest id, columns as they were.

    Of rows of a group with equal ids the first by text stays. Rows without an id stay only if
    nothing else in their group has one; then one of them does. Rows of other groups do not
    count, whatever their ids.
    """
    return keep_first(docs, checkpoint(_groups(docs, id_col, text_col, shingle_words, similarity)), id_col, text_col)
