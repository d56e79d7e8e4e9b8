r"""Filter interaction audit: what each of five filters removes in each of the 120 orders of applying them.

A text fails a set of the filters, its mask. Documents are counted by part and mask in one pass; all orders then follow from
these counts. Orders are numbered lexicographically (by Lehmer rank, 0 to 119), so the orders that begin with the same letters
are an interval of ranks. A mask is removed at step s in exactly the orders whose first s letters are s - 1 filters that it
passes and then one that it fails: some intervals. Its count is added where an interval starts and taken off where it ends,
and a prefix sum over the ranks gives the totals of all orders. The same holds for filters that come too late (redundant).

Filters: A under 200 words, B under half of the words distinct, C over 2 % capitals ``[A-Z]``, D any of ``#$%&*|``, E equal to
a text of a smaller id. Words are ``[^\x20\x09-\x0D]+``, case-sensitive. A null text is an empty one.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.errors import need_columns
from weft.llm.common import text_key
from weft.operators.skew import HOT_ROWS, join_table
from weft.runtime import checkpoint

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: The counts of a part and mask that are spread over the orders.
WEIGHTS = ("n", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: whether a whole text fails A to D."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    few = (n < 200).cast("int")
    same = (100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long")).cast("int")
    upper = (100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long")).cast("int")
    signs = text.rlike(r"[#$%&*|]").cast("int")
    return few + 2 * same + 4 * upper + 8 * signs


def _hot(rows: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of the keys with many rows."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS)


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and set of failed filters (bit 0 for A), and how many of them are labelled good and toxic.

    A null part is the empty text. An id counts as good or toxic if any of its labels says 1. Rows without an id, and rows
    with the smallest id of their text, do not fail E; repeated rows count as often as they are there.

    Texts stay where they are read; only id, part, mask and a digest go on, in a table that is written once. What fails E is
    found by joining that table with the digests that several ids share, hot digests and ids dealt out to several tasks.
    """
    need_columns("filter_audit", "id_col/text_col/part_col", docs, [id_col, text_col, part_col])
    need_columns("filter_audit", "quality_col/toxic_col", labels, [id_col, quality_col, toxic_col])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"), text_key(text).alias("key"))
    slim = checkpoint(slim)
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(quality_col) == 1).cast("long")).alias("good"), F.max((F.col(toxic_col) == 1).cast("long")).alias("toxic"))
    marks = checkpoint(marks.where("id is not null and (good = 1 or toxic = 1)").select("id", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    shared = checkpoint(slim.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most"))
    rows, marked, several = slim.count(), marks.count(), shared.count()
    late = join_table(slim.select("id", "part", "mask", "key"), shared.select("key", "least"), "key", shared, several, rows).where("id > least").select("id", "part", "mask")
    # each document as it is without E, then those that fail E once less there and once more with E
    every = slim.select("id", "part", "mask", F.lit(1).cast("long").alias("n")).unionByName(late.withColumn("moved", F.explode(F.array(F.lit(-1), F.lit(1)))).select("id", "part", F.when(F.col("moved") == 1, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"), F.col("moved").cast("long").alias("n")))
    every = checkpoint(every.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).where("n <> 0"))
    counted = every.groupBy("part", "mask").agg(F.sum("n").alias("n"))
    known = join_table(every, marks, "id", _hot(every, "id"), marked, rows)
    labelled = known.groupBy("part", "mask").agg(F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    both = counted.join(labelled, ["part", "mask"], "left")
    return both.select("part", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def intervals(mask: int) -> list[tuple[int, str, int, int]]:
    """``(step, kind, start, end)``: the ranks in which the filter of a step removes a mask (``removed``), or fails it too late (``redundant``)."""
    found: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for step in range(1, len(LETTERS) + 1):
        size = reduce(lambda x, y: x * y, range(1, len(LETTERS) - step + 1), 1)
        for i, prefix in enumerate(permutations(range(len(LETTERS)), step)):  # the i-th prefix has the ranks from i * size on
            fails = [mask >> letter & 1 for letter in prefix]
            if fails[-1]:
                found.setdefault((step, "redundant" if any(fails[:-1]) else "removed"), []).append((i * size, (i + 1) * size))
    return [(step, kind, a, b) for (step, kind), spans in sorted(found.items()) for a, b in _merged(spans)]


def _ends(spark: SparkSession) -> DataFrame:
    """``(mask, step, kind, rank, sign)``: the ends of the intervals of all masks, some thousand rows from the rule above."""
    rows = [(m, step, kind, at, sign) for m in range(1, 1 << len(LETTERS)) for step, kind, a, b in intervals(m) for at, sign in ((a, 1), (b, -1)) if at < len(ORDERS)]
    return spark.createDataFrame(rows, "mask int, step int, kind string, rank int, sign int")


def _grid(spark: SparkSession) -> DataFrame:
    """``(rank, step, filter_order, letter)``, 600 rows."""
    return spark.createDataFrame([(r, s + 1, order, order[s]) for r, order in enumerate(ORDERS) for s in range(len(LETTERS))], "rank int, step int, filter_order string, letter string")


def audit(counts: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` from ``mask_counts``.

    600 rows a part, zeros included. Each part's windows have 120 rows (the ranks of a step) or 5 (the steps of an order).
    """
    spark = counts.sparkSession
    counts = checkpoint(counts)
    names = [f"{kind}_{w}" for kind in ("removed", "redundant") for w in WEIGHTS]
    # both tables below are of fixed size, whatever the input
    spread = counts.join(F.broadcast(_ends(spark)), "mask").groupBy("part", "step", "rank")
    steps = spread.agg(*[F.sum(F.when(F.col("kind") == name.partition("_")[0], F.col("sign") * F.col(name.partition("_")[2]))).alias(name) for name in names])
    parts = counts.groupBy("part").agg(F.sum("n").alias("all"), *[F.coalesce(F.sum(F.when(F.col("mask") == 1 << i, F.col("n"))), F.lit(0)).alias(f"only_{x}") for i, x in enumerate(LETTERS)])
    cells = parts.crossJoin(F.broadcast(_grid(spark))).join(steps, ["part", "step", "rank"], "left")
    ranks = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumns({n: F.coalesce(F.sum(n).over(ranks), F.lit(0)) for n in names if n in ("removed_n", "redundant_n", "removed_good", "removed_toxic")})
    order = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unique = reduce(lambda rest, x: F.when(F.col("letter") == x, F.col(f"only_{x}")).otherwise(rest), LETTERS, F.lit(0))
    cells = cells.withColumn("kept", F.col("all") - F.sum("removed_n").over(order)).withColumn("unique_fails", unique)
    value = cells.groupBy("part", "letter").agg(F.sum("removed_n").alias("shapley"))
    out = cells.join(value, ["part", "letter"])
    return out.select("part", "filter_order", "step", "kept", F.col("removed_n").alias("removed"), F.col("redundant_n").alias("redundant"), "unique_fails", F.col("removed_good").alias("good_lost"), F.col("removed_toxic").alias("toxic_lost"), "shapley")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
fails AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words JOIN least USING (t) LEFT JOIN marks USING (doc_id)),
masks AS (
  SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS m, a::INT + b::INT + c::INT + d::INT + e::INT AS n_failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE w.l <> v.l AND x.l NOT IN (v.l, w.l) AND y.l NOT IN (v.l, w.l, x.l) AND z.l NOT IN (v.l, w.l, x.l, y.l)),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS f, string_split(substr(filter_order, 1, s - 1), '') AS before FROM orders, range(1, 6) r(s)),
judged AS (
  SELECT part, filter_order, step, f, n, good, toxic, n_failed, m[f] AS now, len([x FOR x IN before IF coalesce(m[x], false)]) > 0 AS gone FROM masks, steps),
summed AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (NOT now AND NOT gone) AS kept, sum(n) FILTER (now AND NOT gone) AS removed, sum(n) FILTER (now AND gone) AS redundant,
    sum(n) FILTER (now AND n_failed = 1) AS unique_fails, sum(good) FILTER (now AND NOT gone) AS good_lost, sum(toxic) FILTER (now AND NOT gone) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM summed
"""
