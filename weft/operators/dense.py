"""Exact near pairs of dense vectors by pivots, compared cell by cell.

Vectors are taken as directions of length 1, and a cosine is a distance between them. Each has its home with the nearest of
some pivots. By the triangle inequality a vector can be near one of another home only if it is not much further from that
pivot than from its own, so it is copied to those homes alone, and to earlier ones only, so that each pair meets in one
place. Homes with many vectors are given pivots of their own, and what still is large is cut into blocks; a cell is a pair
of blocks. Cells give what is asked for: pairs, or a few figures a row, so that very many near vectors cost no row a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from weft.errors import OpError
from weft.runtime import checkpoint

#: Vectors of a block of a home with few; a cell holds two.
BLOCK_ROWS = 4096
#: Blocks that a home is cut into before its blocks grow, and rows of a block at most (some 40 MB at 64 components). A row is
#: copied once a block, so what is shuffled grows with the rows up to that size, and with their square beyond.
BLOCKS, MOST_ROWS = 12, 65_536
#: Pivots of one level, at most.
PIVOTS = 512
#: Room for rounding when cells are chosen; a cosine is at the threshold if its double is.
ROUNDING = 1e-9
#: Vectors whose directions agree to so many decimals count as of one direction.
DECIMALS = 12


def need_threshold(op: str, threshold: float) -> None:
    if not -1 <= threshold <= 1:
        raise OpError(op, "threshold", f"{threshold!r} is not from -1 to 1")


def unit(v: Column) -> Column:
    """A vector at length 1; null without a length, or with a null component."""
    numbers = F.transform(v, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(numbers, lambda x: x / size))


def directions(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """``(id, key)`` of each row with a direction, and ``(key, id, n, u)`` of each direction: its smallest id, how many rows have it, the unit vector of that row."""
    u = unit(F.col(f"`{vector_col}`"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), u.alias("u")).where("u is not null and not exists(u, x -> isnan(x))")
    digits = F.transform("u", lambda x: F.round(x, DECIMALS) + 0.0)
    held = checkpoint(rows.withColumn("key", F.struct(F.xxhash64(digits).alias("p"), F.xxhash64(F.lit(1), digits).alias("q"))))
    return held.select("id", "key"), checkpoint(held.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.min_by("u", "id").alias("u")))


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _homes(rows: DataFrame, pivots: np.ndarray, reach: float, level: str) -> DataFrame:
    """``rows`` (home, stay, id, u, ...) with each row once in its new home, and once (``stay`` false) in each earlier one that it can be near."""
    width, names = pivots.shape[1], rows.columns
    between = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)

    def run(batches):
        for batch in batches:
            u = _matrix(batch.column(names.index("u")), width)
            far = np.sqrt(np.maximum(0, 2 - 2 * u @ pivots.T))
            home = far.argmin(axis=1)
            own = far[np.arange(len(u)), home]
            # how far the plane half way between two pivots is, which a near vector of the other home lies beyond
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (far**2 - own[:, None] ** 2) / (2 * between[home])
            near = np.nan_to_num(plane, nan=0.0, posinf=np.inf) <= reach + ROUNDING
            earlier = near & (np.arange(len(pivots))[None] < home[:, None])
            stay = batch.column(names.index("stay")).to_numpy(zero_copy_only=False)
            # a copy in an upper level is compared with those at home only, wherever they are
            earlier[~stay] = near[~stay]
            at, to = np.nonzero(earlier)
            own_rows = np.nonzero(stay)[0]
            at, to = np.concatenate([own_rows, at]), np.concatenate([home[own_rows], to])
            part = batch.take(pa.array(at))
            homes = [f"{a}{level}{b}" for a, b in zip(part.column(names.index("home")).to_pylist(), to, strict=True)]
            columns = list(part.columns)
            columns[names.index("home")] = pa.array(homes, pa.string())
            columns[names.index("stay")] = pa.array(np.concatenate([np.ones(len(own_rows), bool), np.zeros(len(at) - len(own_rows), bool)]))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, rows.schema)


def placed(rows: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, levels: int = 3) -> DataFrame:
    """``rows`` (id, u, ...) by ``home``; ``stay`` is whether it is a row's own. Each pair at the threshold meets once: both at home, or one of them."""
    width = rows.select(F.size("u").alias("n")).agg(F.max("n")).first()[0] or 1
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    out = checkpoint(rows.select(F.lit("").alias("home"), F.lit(True).alias("stay"), *rows.columns))
    if reach >= 2 - 1e-6 or threshold <= -1:
        return out
    for level in range(levels):
        sizes = out.where("stay").groupBy("home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * block_rows)
        large = {r["home"]: r["n"] for r in sizes.limit(PIVOTS).collect()}  # homes are few: pivots to the power of the level
        if not large:
            break
        done = [out.where(~F.col("home").isin(list(large)))]
        for home, n in large.items():
            mine = out.where(F.col("home") == home)
            k = int(min(PIVOTS, max(2, n // block_rows)))
            chosen = mine.where("stay").orderBy(F.xxhash64("id", F.lit(level))).limit(k).select("u").collect()
            pivots = np.unique(np.array([r["u"] for r in chosen]).reshape(len(chosen), width), axis=0)
            done.append(_homes(mine, pivots, reach, "/") if len(pivots) > 1 else mine)
        grown = done[0]
        for part in done[1:]:
            grown = grown.unionByName(part)
        copied = checkpoint(grown)
        if copied.count() > 4 * out.count():  # pivots do not tell these vectors apart; blocks are cheaper
            break
        out = copied
    return out


def by_cells(rows: DataFrame, threshold: float, work, schema: StructType, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``work(left, right, same)`` on the two blocks of each cell, as Arrow tables of ``rows``' columns; gives a table of ``schema``.

    Each pair of rows at the threshold is in one cell; with ``same`` both blocks are one, and each pair is there twice.
    """
    names = rows.columns
    homes = placed(rows, threshold, block_rows)
    sizes = homes.groupBy("home").agg(F.sum(F.col("stay").cast("int")).alias("own"), F.sum((~F.col("stay")).cast("int")).alias("more"))
    parts = lambda n: F.greatest(F.least(F.ceil(F.col(n) / block_rows), F.lit(BLOCKS)), F.ceil(F.col(n) / max(block_rows, MOST_ROWS))).cast("int")
    blocks = sizes.select("home", F.greatest(parts("own"), F.lit(1)).alias("b"), parts("more").alias("m"))
    both = homes.join(F.broadcast(blocks), "home")  # homes are few
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("stay"), F.col("b")).otherwise(F.col("m"))).cast("int")
    both = both.withColumn("block", block)
    inner = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    outer = F.when(F.col("m") > 0, F.transform(F.sequence(F.lit(1), F.col("m")), lambda j: F.struct(F.col("block").alias("i"), (-j).alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    copies = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda i: F.struct(i.alias("i"), (-F.col("block") - 1).alias("j")))
    dealt = both.withColumn("cell", F.explode(F.when(F.col("stay"), F.concat(inner, outer)).otherwise(copies))).select("home", "cell.i", "cell.j", "block", "stay", *names)

    def run(key, table):
        _, i, j = (k.as_py() for k in key)
        own, of = table["stay"].to_numpy(), table["block"].to_numpy()
        pick = lambda mask: table.select(names).filter(pa.array(mask))
        left, right = (own & (of == i), own & (of == j)) if j >= 0 else (own, ~own)
        return work(pick(left), pick(right), j == i)

    return dealt.groupBy("home", "i", "j").applyInArrow(run, schema)


def _near(left: pa.Table, right: pa.Table, threshold: float):
    """``(rows of the left, rows of the right, cosines)`` at the threshold, some rows of the left at a time."""
    if not len(left) or not len(right):
        return
    width = len(left["u"][0])
    a, b = _matrix(left["u"], width), _matrix(right["u"], width)
    step = max(1, (1 << 22) // len(b))
    for at in range(0, len(a), step):
        cosine = a[at : at + step] @ b.T
        i, j = np.nonzero(cosine >= threshold)
        yield i + at, j, cosine[i, j]


def pairs(rows: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(a, b, similarity)`` with a < b of all ``rows`` (id, u) at the threshold or over it; ids are distinct, u of length 1."""
    kind = rows.schema["id"].dataType

    def work(left, right, same):
        ids, others = left["id"].to_numpy(zero_copy_only=False), right["id"].to_numpy(zero_copy_only=False)
        found = [(ids[i], others[j], s) for i, j, s in _near(left, right, threshold)]
        a, b, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (ids[:0], others[:0], np.zeros(0))
        keep = a < b if same else np.ones(len(a), bool)
        a, b, s = a[keep], b[keep], s[keep]
        low = np.where(a < b, a, b) if len(a) else a
        high = np.where(a < b, b, a) if len(a) else b
        return pa.table({"a": pa.array(low, left["id"].type), "b": pa.array(high, left["id"].type), "similarity": pa.array(s, pa.float64())})

    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("similarity", DoubleType())])
    return by_cells(rows.select("id", "u"), threshold, work, schema, block_rows)


def figures(rows: DataFrame, threshold: float, how: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each of ``rows`` (id, u, n, flag) and cell with near ones: never one a pair. Ids are whole numbers.

    ``near``: ``(id, n)``, the sum of ``n`` of its near rows. ``least``: ``(id, n)``, the least id of near rows with the
    flag. ``forest``: ``(id, n)``, links that connect near rows with the flag as all near pairs do.
    """
    from weft.operators.links import forest

    def work(left, right, same):
        sides = [(left, right)] if same else [(left, right), (right, left)]
        out = []
        for mine, other in sides[:1] if how == "forest" else sides:
            ids, theirs = mine["id"].to_numpy(), other["id"].to_numpy()
            counts, flags = other["n"].to_numpy(), other["flag"].to_numpy(zero_copy_only=False)
            total, least = np.zeros(len(ids), np.int64), np.full(len(ids), np.iinfo(np.int64).max)
            a = b = np.zeros(0, np.int64)
            own = mine["flag"].to_numpy(zero_copy_only=False)
            for i, j, _ in _near(mine, other, threshold):
                apart = ids[i] != theirs[j]
                i, j = i[apart], j[apart]
                if how == "near":
                    np.add.at(total, i, counts[j])
                elif how == "least":
                    np.minimum.at(least, i[flags[j]], theirs[j[flags[j]]])
                else:
                    both = own[i] & flags[j]
                    a, b = forest(np.concatenate([a, ids[i[both]]]), np.concatenate([b, theirs[j[both]]]))
            if how == "near":
                out.append((ids[total > 0], total[total > 0]))
            elif how == "least":
                seen = least < np.iinfo(np.int64).max
                out.append((ids[seen], least[seen]))
            else:
                out.append((a, b))
        x, y = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"id": pa.array(x, pa.int64()), "n": pa.array(y, pa.int64())})

    return by_cells(rows.select("id", "u", "n", "flag"), threshold, work, StructType([StructField("id", LongType()), StructField("n", LongType())]), block_rows)
