r"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of 13 consecutive words of the benchmark items; a shorter item is
one window of its own length. Patterns of one length ``m`` share a shift table over blocks of
two words: a block that ends no pattern lets the search skip up to ``m - 1`` words. Where the
shift is 0, the bucket of the last words selects the patterns to compare, word by word. Words
are numbers; a pattern is its place among the numbered words of all items.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from weft.errors import need_columns
from weft.llm.common import schema_with, slices, text_key, texts_of
from weft.operators.skew import BROADCAST_ROWS
from weft.runtime import checkpoint

WINDOW = 13
#: Words of a pattern's end whose hash names its bucket.
SUFFIX = 4
#: Benchmark text that is searched for at a time, bytes: what is broadcast, and a worker's index is some 30 times as large.
PATTERN_BYTES = 4 << 20
#: A-Z in lower case; bytes that are not of words (below 0x80, neither digit nor letter) to spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return (text or b"").translate(_WORDS).split()


class WuManber:
    """The patterns of one length: shifts of blocks and buckets of suffixes over the items' numbered words."""

    def __init__(self, length: int, base: int, words: array):
        self.length, self.base, self.words = length, base, words
        self.block, self.suffix = min(2, length), min(SUFFIX, length)
        self.skip = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, int | list[int]] = {}

    def add(self, start: int, end: int) -> None:
        """The patterns of an item, whose words are those from ``start`` to ``end``."""
        words, m = self.words, self.length
        for at in range(start + self.block - 1, end):
            block = words[at - 1] * self.base + words[at] if self.block == 2 else words[at]
            self.shift[block] = min(self.shift.get(block, self.skip), max(0, m - 1 - (at - start)))
        for first in range(start, end - m + 1):
            bucket = hash(tuple(words[first + m - self.suffix : first + m]))
            have = self.buckets.setdefault(bucket, first)
            if isinstance(have, list):
                have.append(first)
            elif have != first:
                self.buckets[bucket] = [have, first]

    def search(self, words: array, hit: bytearray, starts: list[int]) -> None:
        """Mark in ``hit`` the words inside occurrences, and add the places of the patterns that occur."""
        m, skip, shift, suffix, base, one = self.length, self.skip, self.shift.get, self.suffix, self.base, self.block == 1
        at, n = m - 1, len(words)
        while at < n:
            move = shift(words[at] if one else words[at - 1] * base + words[at], skip)
            if move:
                at += move
                continue
            bucket = self.buckets.get(hash(tuple(words[at - suffix + 1 : at + 1])), ())
            for first in bucket if isinstance(bucket, (list, tuple)) else (bucket,):
                if words[at - m + 1 : at + 1] == self.words[first : first + m]:
                    hit[at - m + 1 : at + 1] = b"\x01" * m
                    starts.append(first)
            at += 1


class Index:
    """All windows of some items' texts."""

    def __init__(self, texts: list[bytes | None]):
        cut = [words_of(t) for t in texts]
        self.numbers: dict[bytes, int] = {}
        words = array("i", [self.numbers.setdefault(w, len(self.numbers)) for item in cut for w in item])
        self.starts, self.unknown = [0], len(self.numbers)
        by_length: dict[int, WuManber] = {}
        for item in cut:
            start = self.starts[-1]
            self.starts.append(start + len(item))
            if item:
                m = min(WINDOW, len(item))
                by_length.setdefault(m, WuManber(m, self.unknown + 1, words)).add(start, start + len(item))
        self.finders = [by_length[m] for m in sorted(by_length)]

    def search(self, words: list[bytes]) -> tuple[bytearray, set[int]]:
        """Which words are inside occurrences, and the numbers of the items that occur."""
        get, unknown = self.numbers.get, self.unknown
        hit, found = bytearray(len(words)), []
        numbered = array("i", [get(w, unknown) for w in words])
        for finder in self.finders:
            finder.search(numbered, hit, found)
        return hit, {bisect_right(self.starts, first) - 1 for first in found}


_STATE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _spans(hit: bytearray) -> list[int]:
    """Starts and ends of the marked runs, one after the other."""
    out, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out += [at, end]
        at = hit.find(1, end)
    return out


#: The index of the benchmark part that this worker has searched for last, with the part's key.
_HELD: dict[str, tuple[Index, list]] = {}


def _index(patterns) -> tuple[Index, list]:
    """The index of a broadcast part and the ids of its items, made once a worker."""
    key, ids, texts = patterns.value
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Index(texts), ids
    return _HELD[key]


def _sorted_items(names: set) -> list:
    return sorted(x for x in names if x is not None) + [None] * (None in names)


def _search(patterns, text_at: int, keep: list[int]):
    """The columns ``keep`` and a state for each row: what of the broadcast items its whole text holds."""

    def run(batches):
        index, ids = _index(patterns)
        for batch in batches:
            for part in slices(batch, text_at):
                states = []
                for text in texts_of(part.column(text_at)):
                    hit, items = index.search(words_of(text))
                    states.append({"n_words": len(hit), "n_hit": hit.count(1), "spans": _spans(hit), "items": _sorted_items({ids[i] for i in items})})
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(states, _STATE)], names=[*(part.schema.names[i] for i in keep), "state"])

    return run


def _merge(batches):
    """``(key, n_words, [spans], [items])`` of several parts as one state."""
    for batch in batches:
        states = []
        for words, spans, items in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            hit = bytearray(words)
            for part in spans:
                for a, b in zip(part[::2], part[1::2], strict=True):
                    hit[a:b] = b"\x01" * (b - a)
            states.append({"n_words": words, "n_hit": hit.count(1), "spans": _spans(hit), "items": _sorted_items({x for part in items for x in part})})
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states, _STATE)], names=["key", "found"])


_RESULT = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("spans", ArrayType(LongType())), StructField("items", ArrayType(StringType()))])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", result_col: str = "contamination", pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """``docs`` with a struct column ``result_col``: n_words, n_hit, spans, items.

    spans: starts and ends, in words, of the runs inside occurrences; items: the ids, as
    text, of the items that occur, sorted, and a null at the end if items without an id do.
    The benchmark is searched for in parts of about ``pattern_bytes`` (by hash of the item),
    each broadcast; with more than one part each gives a slim table of the texts that it hits,
    by a digest of the text, and the texts themselves are not stored. A column named
    ``result_col`` is replaced. Null texts have no words. Items without words match nothing.
    Repeated rows are judged one by one; without items nothing is hit.
    """
    need_columns("decontaminate", "text_col", docs, [text_col])
    need_columns("decontaminate", "item_col/item_text_col", benchmark, [item_col, item_text_col])
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    parts = -(-total // pattern_bytes) or 1
    context, out = docs.sparkSession.sparkContext, docs.drop(result_col)
    names = out.columns
    out = out.toDF(*[f"c{i}" for i in range(len(names))])
    at = next(i for i, c in enumerate(names) if c.lower() == text_col.lower())

    def held(k: int):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()
        return context.broadcast((uuid.uuid4().hex, [r["id"] for r in rows], [r["text"].encode() for r in rows]))

    if parts == 1:
        return out.mapInArrow(_search(held(0), at, list(range(len(names)))), schema_with(out, StructField("state", _RESULT))).toDF(*names, result_col)
    keyed, hits = out.select(text_key(F.col(f"c{at}")).alias("key"), F.col(f"c{at}").alias("text")), None
    for k in range(parts):
        found = keyed.mapInArrow(_search(held(k), 1, [0]), StructType([StructField("key", BinaryType()), StructField("state", _RESULT)])).where("state.n_hit > 0")
        found = checkpoint(found.groupBy("key").agg(F.first("state").alias("state")))
        hits = found if hits is None else hits.unionByName(found)
    merged = hits.groupBy("key").agg(F.max("state.n_words").alias("n_words"), F.collect_list("state.spans").alias("spans"), F.collect_list("state.items").alias("items"))
    merged = checkpoint(merged)
    few = merged.count()
    table = merged.mapInArrow(_merge, StructType([StructField("key", BinaryType()), StructField("found", _RESULT)]))
    rows = out.withColumn("key", text_key(F.col(f"c{at}")))
    n_words = F.coalesce(F.regexp_count(F.col(f"c{at}"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    clean = F.struct(n_words.alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    joined = rows.join(F.broadcast(table) if few <= BROADCAST_ROWS else table, "key", "left")
    return joined.select(*out.columns, F.coalesce("found", clean)).toDF(*names, result_col)


def contaminated(result, least_part: int = 20):
    """Whether at least one word in ``least_part`` is hit."""
    return (result["n_hit"] > 0) & (result["n_hit"] * least_part >= result["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows that are not contaminated, with the columns of ``docs``."""
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    text = f"d{next(i for i, c in enumerate(names) if c.lower() == text_col.lower())}"
    found = find_contamination(plain, benchmark, text, result_col="found", **options)
    return found.where(~contaminated(F.col("found"))).drop("found").toDF(*names)


def items_digest(items):
    """SHA-256 of the comma-joined item ids."""
    return F.sha2(F.array_join(items, ","), 256)


ORACLE = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT *, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
doc_windows AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, lengths WHERE len(w) >= m)),
found AS (SELECT d.doc_id, d.i, d.m, x.item_id FROM doc_windows d JOIN windows x ON d.m = x.m AND d.win = x.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
