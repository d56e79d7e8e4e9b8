"""Texts as blocks of numbered words: a row for each block, with its distinct words and the places where they stand.

A block holds some thousands of texts. Figures of words (how many texts have them, what they weigh, how they rank) meet a
block by its list of distinct words, so a shuffle carries a row for each word of a block and never one for each place, and
what follows is arithmetic on arrays in the tasks. Texts of a block are kept apart by ``gap`` places without a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.runtime import checkpoint, spread

#: Places of a block (a text is never cut, so one long text can be more).
BLOCK_PLACES = 2_000_000
#: Words whose figures a task holds at a time in ``text_rank`` (8 bytes each).
SLICE_WORDS = 4_000_000


def encoded(df: DataFrame, words: Column, gap: int, keep: list[str] = (), even: bool = True) -> DataFrame:
    """``(block, words, places)``: the distinct words of a block of texts, and the number of the word at each place, -1 between texts, as 32-bit numbers.

    Of the columns ``keep`` the values of a block go along as lists, one value a text. Without ``even`` texts stay in the tasks that read them.
    """

    def run(batches):
        from pyspark import TaskContext

        part, found = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lists = batch.column(0)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            a = 0
            while a < len(lists):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_PLACES, "right")) - 1)
                coded = lists.slice(a, b - a).flatten().dictionary_encode()
                sizes = np.diff(ends[a : b + 1])
                places = np.full(int(sizes.sum()) + gap * (len(sizes) + 1), -1, np.int32)
                at = np.arange(int(sizes.sum())) + gap * (np.repeat(np.arange(len(sizes)), sizes) + 1)
                places[at] = coded.indices.to_numpy(zero_copy_only=False)
                if len(coded) or keep:
                    held = [pa.ListArray.from_arrays([0, b - a], batch.column(1 + i).slice(a, b - a)) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([pa.array([part + found]), pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.array([places.tobytes()], pa.binary()), *held], names=["block", "words", "places", *keep])
                    found += 1
                a = b

    kept = "".join(f", `{c}` array<{df.schema[c].dataType.simpleString()}>" for c in keep)
    texts = (spread(df) if even else df).select(words.alias("w"), *[F.col(f"`{c}`") for c in keep])
    return checkpoint(texts.mapInArrow(run, f"block bigint, words array<string>, places binary{kept}"))


def valued(blocks: DataFrame, table: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """``columns`` of the blocks and ``values``: for the words of a block their ``value`` in ``table``, which has one row for each word."""
    rows = blocks.select("block", F.posexplode("words").alias("at", "word")).join(table.select("word", value), "word")
    lists = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v")))).alias("x"))
    return checkpoint(blocks.select("block", *columns).join(lists.select("block", F.col("x.v").alias("values")), "block").select("values", *columns))


def by_word(blocks: DataFrame, work, kind: str = "bigint") -> DataFrame:
    """``(word, n)``: the sums over all blocks of what ``work(places, number of words)`` gives for each word of one."""

    def run(batches):
        for batch in batches:
            for words, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n = work(np.frombuffer(places, np.int32), len(words.values))
                yield pa.RecordBatch.from_arrays([words.values, pa.array(n)], names=["word", "n"])

    return blocks.select("words", "places").mapInArrow(run, f"word string, n {kind}").groupBy("word").agg(F.sum("n").alias("n"))


def in_texts(places: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, word, tf)`` of each word of each text, by text."""
    keys, tf = np.unique((np.cumsum(places < 0) * words + places)[places >= 0], return_counts=True)
    return keys // words, keys % words, tf


def _terms(places: np.ndarray, words: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, code)`` of each term: a word, or with ``span`` 2 two neighbours, the first one's number times ``words`` and the second's."""
    text = np.cumsum(places < 0) - 1
    if span == 1:
        return text[places >= 0], places[places >= 0].astype(np.int64)
    at = np.nonzero((places[:-1] >= 0) & (places[1:] >= 0))[0]
    return text[at], places[at].astype(np.int64) * words + places[at + 1]


def frequent_terms(blocks: DataFrame, size: int, span: int = 1, least_texts: int = 1) -> list[str]:
    """The ``size`` terms that stand most often in the texts, of equal ones the first by code points, if ``least_texts`` texts have them.

    Terms are words, or with ``span`` 2 pairs of neighbours with a blank between. The ``size`` most frequent terms of each block
    bound the count of the last term wanted from below; a term of that count has its share of it in some block, so only the
    terms that have are counted over all blocks. The result is exact; blocks are made with a ``gap`` of 1 or more.
    """
    from weft.operators.skew import BROADCAST_ROWS

    def counted(most: int | None, least: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                for words, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    names = words.values
                    text, code = _terms(np.frombuffer(places, np.int32), len(names), span)
                    codes, at, n = np.unique(code, return_inverse=True, return_counts=True)
                    pairs = np.unique(at * (int(text[-1]) + 1) + text) // (int(text[-1]) + 1) if least_texts > 1 and len(text) else at
                    texts = np.bincount(pairs, minlength=len(codes)) if len(codes) else n
                    chosen = np.nonzero(n >= least)[0]
                    if most is not None and len(chosen) > most:
                        chosen = chosen[np.argpartition(-n[chosen], most - 1)[:most]]
                    codes = codes[chosen]
                    term = names.take(pa.array(codes)) if span == 1 else pc.binary_join_element_wise(names.take(pa.array(codes // max(1, len(names)))), names.take(pa.array(codes % max(1, len(names)))), " ")
                    yield pa.RecordBatch.from_arrays([term, pa.array(n[chosen], pa.int64()), pa.array(texts[chosen], pa.int64())], names=["term", "n", "texts"])

        return blocks.select("words", "places").mapInArrow(run, "term string, n bigint, texts bigint")

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).where(F.col("texts") >= least_texts)

    parts = blocks.count()
    first = summed(counted(size, 1)).orderBy(F.desc("n")).limit(size).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("found")).first()
    least = -(-first["n"] // parts) if first["found"] == size else 1
    rows = counted(None, 1)
    if least > 1:
        terms = checkpoint(counted(None, least).select("term").distinct())
        rows = rows.join(F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms, "term", "left_semi")
    return [r["term"] for r in summed(rows).orderBy(F.desc("n"), "term").limit(size).collect()]


def term_vectors(blocks: DataFrame, terms: list[list[str]], keep: list[str], column: str = "tf") -> DataFrame:
    """``keep`` and ``column``, a row a text: how often it has each term; ``terms[0]`` are words and ``terms[1]``, if given, pairs of neighbours."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    starts, total = np.cumsum([0, *map(len, terms)]), sum(map(len, terms))

    def run(batches):
        known = pa.array(terms[0], pa.string())
        ends = [pa.array(x, pa.string()) for x in zip(*[t.split(" ") for t in terms[1]], strict=True)] if len(terms) > 1 and terms[1] else None
        for batch in batches:
            for row in range(batch.num_rows):
                names, held = batch.column(0)[row].values, [batch.column(2 + i)[row].values for i in range(len(keep))]
                places, texts = np.frombuffer(batch.column(1)[row].as_py(), np.int32), len(held[0])
                number = pc.index_in(names, known).fill_null(-1).to_numpy(zero_copy_only=False)
                text, code = _terms(places, len(names), 1)
                at = number[code].astype(np.int64)
                found = [(text[at >= 0], at[at >= 0])]
                if ends:
                    one, two = (pc.index_in(e, names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for e in ends)
                    wanted = np.nonzero((one >= 0) & (two >= 0))[0]
                    codes = one[wanted] * len(names) + two[wanted]
                    order = np.argsort(codes)
                    codes, wanted = codes[order], wanted[order]
                    text, code = _terms(places, len(names), 2)
                    at = np.searchsorted(codes, code)
                    hit = np.nonzero(at < len(codes))[0]
                    hit = hit[codes[at[hit]] == code[hit]]
                    found.append((text[hit], starts[1] + wanted[at[hit]]))
                keys, n = np.unique(np.concatenate([t * total + i for t, i in found]), return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(texts + 1) * total), pa.int32())
                fields = [pa.array(np.zeros(texts, np.int8)), pa.array(np.full(texts, total, np.int32)), pa.ListArray.from_arrays(offsets, pa.array((keys % total).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.float64)))]
                yield pa.RecordBatch.from_arrays([*held, pa.StructArray.from_arrays(fields, names=["type", "size", "indices", "values"])], names=[*keep, column])

    kept = [StructField(c, blocks.schema[c].dataType.elementType) for c in keep]
    return checkpoint(blocks.select("words", "places", *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, StructType([*kept, StructField(column, VectorUDT())])))


def text_counts(blocks: DataFrame) -> DataFrame:
    """``(word, n)``: how many texts have a word."""
    return by_word(blocks, lambda places, words: np.bincount(in_texts(places, words)[1], minlength=words).astype(np.int64))


def texts_with_words(blocks: DataFrame) -> int:
    """How many texts have a word."""

    def run(batches):
        for batch in batches:
            # a text starts where a word stands behind none
            n = [int(np.count_nonzero((x[1:] >= 0) & (x[:-1] < 0))) for x in (np.frombuffer(p, np.int32) for p in batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    return blocks.select("places").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def weight_sums(blocks: DataFrame, idf: DataFrame) -> DataFrame:
    """``(word, weight)``: the sums of tf times ``idf`` (word, idf), each text scaled to length 1."""
    of = valued(blocks, idf, "idf", ["words", "places"])

    def run(batches):
        for batch in batches:
            for words, values, places in zip(batch.column(1), batch.column(0), batch.column(2).to_pylist(), strict=True):
                idfs = values.values.to_numpy(zero_copy_only=False)
                text, word, tf = in_texts(np.frombuffer(places, np.int32), len(idfs))
                raw = tf * idfs[word]
                _, of_text = np.unique(text, return_inverse=True)
                norm = np.sqrt(np.bincount(of_text, raw * raw))
                # a figure of 0 for all words of a text leaves it without weights
                weight = np.divide(raw, norm[of_text], out=np.zeros_like(raw), where=norm[of_text] > 0)
                yield pa.RecordBatch.from_arrays([words.values, pa.array(np.bincount(word, weight, len(idfs)))], names=["word", "weight"])

    return of.mapInArrow(run, "word string, weight double").groupBy("word").agg(F.sum("weight").alias("weight"))


def met(places: np.ndarray, most: int, window: int) -> np.ndarray:
    """How often each two of ``most`` words meet in a text, or with ``window`` in so many neighbouring places of one."""
    out = np.zeros((most, most), np.int64)
    if window:
        inside = places >= 0
        first = inside & ~np.concatenate([[False], inside[:-1]])
        behind = np.concatenate([inside[window - 1 :], np.zeros(min(window - 1, len(inside)), bool)])
        # a text shorter than a window is one
        starts = np.nonzero(inside & (behind | first))[0]
    else:
        starts, at = np.unique(np.cumsum(places == -1)[places >= 0], return_inverse=True)
        chosen = places[places >= 0]
    for a in range(0, len(starts), 1 << 20):
        n = min(1 << 20, len(starts) - a)
        here = np.zeros((n, most), np.float32)
        if window:
            for k in range(window):
                w = places[starts[a : a + n] + k]
                rows = np.nonzero((w >= 0) & (w < most))[0]
                here[rows, w[rows]] = 1
        else:
            rows = (at >= a) & (at < a + n) & (chosen < most)
            here[at[rows] - a, chosen[rows]] = 1
        here = here[here.sum(axis=1) > 1]
        out += (here.T @ here).astype(np.int64)
    return out


def meetings(blocks: DataFrame, chosen: list[str], window: int) -> DataFrame:
    """``(a, b, count)`` with a < b of ``chosen`` words: texts, or windows of so many words, with both."""
    names = sorted(chosen)  # by code points, as Spark compares

    def run(batches):
        for batch in batches:
            for words, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                number = np.asarray(pc.index_in(words.values, pa.array(names, pa.string())).fill_null(len(names)).to_numpy(zero_copy_only=False))
                n = met(np.append(number, -1)[np.frombuffer(places, np.int32)], len(names), window)
                a, b = np.nonzero(np.triu(n, 1))
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in a], pa.string()), pa.array([names[i] for i in b], pa.string()), pa.array(n[a, b])], names=["a", "b", "count"])

    return blocks.select("words", "places").mapInArrow(run, "a string, b string, count bigint").groupBy("a", "b").agg(F.sum("count").alias("count"))


def from_neighbours(places: np.ndarray, values: np.ndarray, span: int) -> np.ndarray:
    """For each word the sum of the ``values`` of the other words within ``span`` places of where it stands."""
    value = np.append(values, 0.0)[places]
    got = np.zeros(len(places))
    for k in range(1, span):
        other = places[:-k] != places[k:]
        got[:-k] += value[k:] * other
        got[k:] += value[:-k] * other
    return np.bincount(places + 1, got, len(values) + 1)[1:]


def neighbour_ranks(blocks: DataFrame, span: int, rounds: int, damping: float) -> DataFrame:
    """``(word, pagerank)`` over the network of words within ``span`` places of each other, weighed by how often they are, after so many rounds.

    The network is never written: a round goes over the blocks, and each word takes from those beside it. What the words pass on
    reaches the tasks ``SLICE_WORDS`` words at a time, the most frequent first, so that no task and not the driver holds all.
    """
    spark = blocks.sparkSession
    from weft.operators.order import numbered

    out = by_word(blocks, lambda places, words: from_neighbours(places, np.ones(words), span), "double").select("word", F.col("n").alias("out"), (-F.col("n")).alias("minus"))
    words = checkpoint(numbered(checkpoint(out), ["minus", "word"]).select("word", "out", (F.col("number") - 1).cast("long").alias("id")))
    coded = valued(blocks, words, "id", ["places"])
    most, n = words.count(), words.where("out > 0").count()
    linked = words.where("out > 0").select("id", "out")
    ranks = linked.withColumn("pagerank", F.lit(1.0 / max(n, 1)))

    def pass_on(first: int, ranks: DataFrame) -> DataFrame:
        here = ranks.where((F.col("id") >= first) & (F.col("id") < first + SLICE_WORDS)).select("id", (F.col("pagerank") / F.col("out")).alias("q")).toArrow()
        values = np.zeros(min(SLICE_WORDS, most - first))
        values[here["id"].to_numpy() - first] = here["q"].to_numpy()
        shared = spark.sparkContext.broadcast(values)

        def run(batches):
            table = shared.value
            for batch in batches:
                for ids, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    at = ids.values.to_numpy(zero_copy_only=False) - first
                    inside = (at >= 0) & (at < len(table))
                    own = np.where(inside, table[np.where(inside, at, 0)], 0.0)
                    got = from_neighbours(np.frombuffer(places, np.int32), own, span) if own.any() else np.zeros(len(own))
                    sent = np.nonzero(got)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(at[sent] + first, pa.int64()), pa.array(got[sent])], names=["id", "s"])

        return checkpoint(coded.mapInArrow(run, "id bigint, s double").groupBy("id").agg(F.sum("s").alias("s")))

    for _ in range(rounds):
        sent = None
        for first in range(0, most, SLICE_WORDS):
            one = pass_on(first, ranks)
            sent = one if sent is None else sent.unionByName(one)
        if sent is None:
            break
        total = sent.groupBy("id").agg(F.sum("s").alias("s"))
        ranks = checkpoint(linked.join(total, "id", "left").select("id", "out", (F.lit((1 - damping) / max(n, 1)) + F.lit(damping) * F.coalesce("s", F.lit(0.0))).alias("pagerank")))
    return words.select("id", "word").join(ranks, "id").select("word", "pagerank")
