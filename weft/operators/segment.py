r"""Words of Han text: a lexicon learned from the corpus, and the most probable way to cut a run with it.

A run of Han characters has no blanks. A sequence of characters is taken for a word if it holds together (it comes much more
often than its parts would by chance) and stands free (many different characters come before it and behind it). Both are
plain aggregates over all sequences of the corpus, by joins of their counts. A run is then a graph with an edge for each
word of the lexicon in it and for each single character, and its words are the path of least cost, the cost of a word being
minus the logarithm of its share.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from weft.errors import OpError, need_columns, need_positive
from weft.operators.skew import join_table
from weft.runtime import checkpoint

#: Characters of a run that are explored at a time while learning.
PIECE = 2048
#: Words of a lexicon that workers hold (some 100 bytes each).
MOST_WORDS = 1_000_000
#: Costs are whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
#: What marks a Han run among the tokens handed to Python.
_MARK = "\u0001"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _sequences(df: DataFrame, column: str, longest: int) -> DataFrame:
    """``(word, before, behind, n)``: every sequence of up to ``longest`` characters of a run with its neighbours, empty at the ends of the run."""
    runs = df.select(F.explode(F.regexp_extract_all(F.lower(_col(column)), F.lit(r"\p{IsHan}++"), F.lit(0))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    at = F.explode(F.sequence(F.lit(0), F.length("run") - 1, F.lit(PIECE)))
    pieces = runs.select("n", F.length("run").alias("size"), at.alias("at"), "run")
    # one character before the piece, and as many behind as the longest sequence and its neighbour need
    pieces = pieces.select("n", "size", "at", F.split(F.concat(F.when(F.col("at") == 0, _MARK).otherwise(""), F.expr(f"substr(run, greatest(at, 1), {PIECE} + {longest} + if(at = 0, 0, 1))")), "").alias("c"))
    starts = pieces.select("n", "c", F.explode(F.expr(f"sequence(2, least({PIECE}, size - at) + 1)")).alias("i"), F.col("size") + 1 - F.col("at"))
    starts = starts.toDF("n", "c", "i", "last")
    slim = starts.select("n", F.expr(f"slice(c, i - 1, least({longest}, last - i + 1) + 2)").alias("w"), F.expr(f"least({longest}, last - i + 1)").alias("most"))
    each = slim.select("n", "w", F.explode(F.expr("sequence(1, most)")).alias("k"))
    clean = lambda c: F.when(c == _MARK, "").otherwise(c)
    return each.select(F.array_join(F.expr("slice(w, 2, k)"), "").alias("word"), clean(F.col("w")[0]).alias("before"), F.coalesce(F.expr("get(w, k + 1)"), F.lit("")).alias("behind"), "n")


def learn_lexicon(df: DataFrame, column: str, longest: int = 4, min_count: int = 5, min_cohesion: float = 3.0, min_freedom: float = 1.0) -> DataFrame:
    """``(word, n, cohesion, freedom)`` of the words of the Han text in a column; single characters have neither figure.

    n: how often the sequence comes. cohesion: the least, over the ways to cut a sequence in two, of the logarithm of how
    many times more often it comes than its parts would by chance. freedom: the lesser of the entropies of the characters
    before and behind it; the end of a run counts as a new character each time. Words have up to ``longest`` characters and
    reach all three bounds. Equal runs are counted once and weighed; nulls and text without Han characters give nothing.
    """
    need_columns("learn_lexicon", "column", df, [column])
    need_positive("learn_lexicon", "longest", longest)
    need_positive("learn_lexicon", "min_count", min_count)
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("x")), F.struct(F.lit(1).alias("side"), F.col("behind").alias("x"))))
    met = _sequences(df, column, longest).select("word", "n", sides.alias("s")).groupBy("word", "s.side", "s.x").agg(F.sum("n").alias("n"))
    spread = F.sum(F.when(F.col("x") == "", 0.0).otherwise(F.col("n") * F.log("n")))
    by_side = met.groupBy("word", "side").agg(F.sum("n").alias("n"), spread.alias("spread"))
    counts = by_side.groupBy("word").agg(F.max("n").alias("n"), F.min(F.log("n") - F.col("spread") / F.col("n")).alias("freedom"))
    counts = checkpoint(counts.where((F.col("n") >= min_count) | (F.length("word") == 1)).withColumn("size", F.length("word")))
    total = counts.where("size = 1").agg(F.sum("n")).first()[0] or 0
    parts = counts.select(F.col("word").alias("part"), F.col("n").alias("m"))
    rows = counts.where("size > 1").select("word", "n", F.explode(F.expr("sequence(1, size - 1)")).alias("k"), "size")
    cuts = checkpoint(rows.select("word", "n", F.expr("substr(word, 1, k)").alias("left"), F.expr("substr(word, k + 1)").alias("right")))
    held, known = cuts.count(), parts.count()
    for side in ("left", "right"):  # a common character is a part of very many sequences
        sizes = cuts.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        cuts = join_table(cuts, parts.select(F.col("part").alias(side), F.col("m").alias(f"n_{side}")), side, sizes, known, held)
    bound = F.log(F.col("n").cast("double") * float(total) / (F.col("n_left").cast("double") * F.col("n_right")))
    cohesion = cuts.groupBy("word").agg(F.min(bound).alias("cohesion"))
    words = counts.where("size > 1").join(cohesion, "word").where((F.col("cohesion") >= min_cohesion) & (F.col("freedom") >= min_freedom))
    single = counts.where("size = 1").select("word", "n", F.lit(None).cast("double").alias("cohesion"), F.lit(None).cast("double").alias("freedom"))
    return words.select("word", "n", "cohesion", "freedom").unionByName(single)


@dataclass(frozen=True, eq=False)
class Lexicon:
    """Costs of words in millionths, and that of a character that is no word of it."""

    costs: dict[str, int]
    unknown: int
    longest: int

    @staticmethod
    def of(words: DataFrame, word_col: str = "word", count_col: str = "n") -> Lexicon:
        """From a table of words and counts, learned or one's own; up to ``MOST_WORDS`` of them, for every worker holds them.

        A word counts as its largest count; words in upper case are lowered; blank words and counts that are not positive do not count.
        """
        need_columns("lexicon", "word_col/count_col", words, [word_col, count_col])
        rows = words.select(F.lower(_col(word_col)).alias("w"), _col(count_col).cast("long").alias("n")).where("w <> '' and n > 0").groupBy("w").agg(F.max("n").alias("n"))
        found = rows.limit(MOST_WORDS + 1).collect()
        if len(found) > MOST_WORDS:
            raise OpError("lexicon", "words", f"over {MOST_WORDS} words; raise min_count of learn_lexicon")
        costs, unknown = _costs({r["w"]: r["n"] for r in found})
        return Lexicon(costs, unknown, max(map(len, costs), default=1))

    def __reduce__(self):
        return Lexicon, (self.costs, self.unknown, self.longest)

    def cut(self, run: str) -> list[str]:
        """The words of a run: the path of least cost, of equal ones that with the longer last word, and so on from the end."""
        n, costs, get = len(run), [0], self.costs.get
        steps = [0] * (n + 1)
        for end in range(1, n + 1):
            best, step = costs[end - 1] + get(run[end - 1], self.unknown), 1
            for size in range(2, min(self.longest, end) + 1):
                cost = get(run[end - size : end])
                if cost is not None and costs[end - size] + cost <= best:
                    best, step = costs[end - size] + cost, size
            costs.append(best)
            steps[end] = step
        words = []
        while n:
            words.append(run[n - steps[n] : n])
            n -= steps[n]
        return words[::-1]

    def words(self, c: Column) -> Column:
        """Words of a text Column in lower case: runs of letters and digits, and the words of Han runs; null stays null."""
        mixed = F.regexp_extract_all(F.regexp_replace(F.lower(c), r"(\p{IsHan}++)", f"{_MARK}$1"), F.lit(rf"{_MARK}\p{{IsHan}}++|[\p{{L}}\p{{N}}&&[^\p{{IsHan}}]]++"), F.lit(0))
        lexicon = self

        @F.arrow_udf(ArrayType(StringType()))
        def cut_all(tokens: pa.Array) -> pa.Array:
            cut = lru_cache(1 << 14)(lexicon.cut)
            return pa.array([None if row is None else [w for t in row for w in (cut(t[1:]) if t[:1] == _MARK else (t,))] for row in tokens.to_pylist()], pa.list_(pa.string()))

        return F.coalesce(cut_all(F.when(c.rlike(r"\p{IsHan}"), mixed)), mixed)


def _costs(counts: dict[str, int]) -> tuple[dict[str, int], int]:
    from math import log

    total = sum(counts.values())
    return {w: round(UNIT * log(total / n)) for w, n in counts.items()}, round(UNIT * log(2 * total)) if total else 0


def learned(df: DataFrame, column: str, **bounds) -> Lexicon:
    """The lexicon that the Han text of a column gives by itself; ``bounds`` as in ``learn_lexicon``."""
    return Lexicon.of(learn_lexicon(df, column, **bounds))


def cut_words(df: DataFrame, column: str, new_col: str = "words", lexicon: Lexicon | None = None, **bounds) -> DataFrame:
    """``df`` with the words of a column as a list; without a lexicon by the one learned from it."""
    need_columns("cut_words", "column", df, [column])
    lexicon = lexicon or learned(df, column, **bounds)
    return df.withColumn(new_col, lexicon.words(_col(column).cast("string")))
