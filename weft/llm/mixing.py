"""Mixing sources to target weights by repetition rates.

Sizes are summed by source, sources share the total by weight, and a source's rate is its
target over its size. Each document is taken ``floor(rate)`` times and once more if its hash
falls below the fraction. A hash gives ``SEEDS`` such draws; for each source the draw whose
taken words come nearest to the target decides, so a few long documents move a source little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.errors import OpError, need_columns
from weft.llm.common import word_count
from weft.runtime import checkpoint, fresh_name

#: Draws of 32 bits that one SHA-256 gives.
SEEDS = 8
#: A table of sources of at most so many rows is broadcast (some 100 bytes a row).
BROADCAST_SOURCES = 100_000


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_rate: int = 3) -> DataFrame:
    """``totals`` (source, source_size) with ``target``: its share of all sizes by weight.

    Sources by code point, null last, weigh ``weights`` in turn. No target is above
    ``max_rate`` times the source's size; what is above is shared again by weight among the
    others until none is above. In order of size by weight, a source is held at its limit if
    the share of what those before it leave is no less. One row a source goes through these
    windows, never documents.
    """
    if not weights or any(not isinstance(w, int) or w <= 0 for w in weights):
        raise OpError("mix", "weights", f"{weights!r} must be positive whole numbers")
    if not isinstance(max_rate, int) or max_rate < 1:
        raise OpError("mix", "max_rate", f"{max_rate!r} must be a whole number of 1 or more")
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))).cast("int") + 1).cast("decimal(10,0)")
    t = totals.withColumn("weight", weight).withColumn("most", (F.col("source_size") * max_rate).cast("decimal(20,0)"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(every).cast("decimal(20,0)"))
    left = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("decimal(22,0)")
    t = t.withColumn("held", F.col("most") * F.sum("weight").over(after).cast("decimal(16,0)") <= F.col("weight") * left)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("held"), F.col("most"))).over(every), F.lit(0))
    share = F.sum(F.when(~F.col("held"), F.col("weight"))).over(every)
    t = t.withColumn("left", left).withColumn("open", share)
    target = F.when(F.col("held"), F.col("most").cast("double")).otherwise(F.col("weight").cast("double") * F.col("left").cast("double") / F.col("open").cast("double"))
    return t.select("source", "source_size", target.alias("target"))


def _draw(seed):
    """A number from 0 to under 1 of the key's hash; seed 0 to SEEDS - 1."""
    return F.conv(F.substr(F.col("__hash"), seed * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))


def _copies(rate, seed):
    return (F.floor(rate) + (_draw(seed) < rate - F.floor(rate)).cast("int")).cast("long")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_rate: int = 3) -> DataFrame:
    """``(id, source, size, source_size, target, copies)``, one row for each input row.

    Size: the words of the whole text (null: 0). Null is a source of its own. Rows with equal
    ids draw alike. A source without words has rate 0. An empty table gives an empty result.
    """
    need_columns("mix", "columns", docs, [id_col, text_col, source_col])
    sizes = checkpoint(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    sizes = sizes.withColumn("__hash", F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")), 256))
    return _taken(sizes, *_rates(sizes, weights, max_rate)).select("id", "source", "size", "source_size", "target", "copies")


def _rates(sizes: DataFrame, weights, max_rate) -> tuple[DataFrame, bool]:
    """Sources with target, rate and the draw to use; whether there are few enough to broadcast."""
    targets = checkpoint(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_rate))
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    few = targets.count() <= BROADCAST_SOURCES
    drawn = _with_source(sizes.select("source", "size", "__hash"), targets, few)
    taken = drawn.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(F.col("size") * _copies(F.col("rate"), F.lit(k))).alias(f"t{k}") for k in range(SEEDS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]))["seed"]
    seeds = taken.select(F.col("source").alias("s"), best.alias("seed"))
    return checkpoint(targets.join(seeds, F.col("source").eqNullSafe(F.col("s"))).drop("s")), few


def _with_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    s = sources.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(s) if few else s, rows["source"].eqNullSafe(s["__source"])).drop("__source")


def _taken(sizes: DataFrame, rates: DataFrame, few: bool) -> DataFrame:
    return _with_source(sizes, rates, few).withColumn("copies", _copies(F.col("rate"), F.col("seed")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_rate: int = 3) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, columns as they were.

    Rates come from slim sizes; the texts themselves are read once more and never shuffled
    while the table of sources can be broadcast.
    """
    need_columns("mix", "columns", docs, [id_col, text_col, source_col])
    sizes = checkpoint(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    hashed = lambda key: F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    rates, few = _rates(sizes.withColumn("__hash", hashed(F.col("id"))), weights, max_rate)
    row = fresh_name(docs, "row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(source_col).alias("source"), hashed(F.col(id_col)).alias("__hash"))
    out = _taken(packed, rates, few).select(row, F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("__copy"))
    return out.select(*[F.col(row)[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         sha256(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w, 3 * source_size::HUGEINT AS most,
         (sum(source_size) OVER ())::HUGEINT AS total
  FROM totals),
ordered AS (
  SELECT *, total - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
held AS (SELECT *, most * open <= w * left_over AS at_limit FROM ordered),
targets AS (
  SELECT source, source_size,
         CASE WHEN at_limit THEN most::DOUBLE
              ELSE w::DOUBLE * (total - coalesce(sum(most) FILTER (at_limit) OVER (), 0))::DOUBLE / (sum(w) FILTER (NOT at_limit) OVER ())::DOUBLE END AS target
  FROM held),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets),
drawn AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, k.k AS seed,
         d.size * (floor(r.rate)::BIGINT + (('0x' || substr(d.h, (k.k * 8 + 1)::INT, 8))::BIGINT / 4294967296.0::DOUBLE < r.rate - floor(r.rate))::INT) AS taken
  FROM docs d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, range(8) k(k)),
nearest AS (
  SELECT source, arg_min(seed, (off, seed)) AS seed
  FROM (SELECT source, seed, abs(sum(taken)::DOUBLE - any_value(target)) AS off FROM drawn GROUP BY source, seed) GROUP BY source)
SELECT d.doc_id, d.size, d.source_size, d.target, d.taken::BIGINT AS taken
FROM drawn d JOIN nearest n ON d.source IS NOT DISTINCT FROM n.source AND d.seed = n.seed
"""
