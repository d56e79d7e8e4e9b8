"""Token counts by section from one encoding of the whole document.

A document is encoded once. Its tokens' byte spans are joined to the sections' spans by
search in the sorted section starts. A token that lies in several sections counts whole for
one of them: by rule ``largest`` (the default) for the section that holds most of its bytes,
the earlier of equals; by rule ``first`` for the section of its first byte. So sections add
up to the document.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from weft.errors import need_columns, need_one_of
from weft.llm.common import field, slices, texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: What splits text before the merges of the public rank files (a fixed value of theirs).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("largest", "first")
#: A run of white space (as the pattern has it) that the pattern's engine is not given; it backtracks and would run out of stack.
_LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


@lru_cache(2)
def encoder(vocabulary: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and the bytes of each token."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_ids(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """The tokens of a text with runs of any length.

    In the pattern a run of white space is one piece, less its last character where text follows; so long ones are cut out and encoded as the piece that they are.
    """
    ids, at = [], 0
    for m in _LONG_RUN.finditer(text):
        end = m.end() - (m.end() < len(text))
        ids += encoding.encode_ordinary(text[at : m.start()])
        ids += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str = "largest") -> np.ndarray:
    """Tokens of each section. ends: where the tokens end; bounds: where the sections start, then where the last ends."""
    n = len(bounds) - 1
    if not len(ends) or not n:
        return np.zeros(n, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    if rule == "largest":
        for i in np.nonzero(last > first)[0]:
            cut = np.clip(bounds[first[i] : last[i] + 2], starts[i], ends[i])
            first[i] += int(np.diff(cut).argmax())
    return np.bincount(first, minlength=n)[:n]


def sections(text: bytes, separator: re.Pattern) -> np.ndarray:
    """Byte bounds of the sections; a separator belongs to the section before it."""
    cuts = [m.end() for m in separator.finditer(text)]
    return np.array(sorted({0, *cuts, len(text)}), np.int64)


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = r"\n+", vocabulary: str = VOCABULARY, rule: str = "largest") -> DataFrame:
    """``(id, section, start, end, n_tokens, doc_tokens)``, a row for each section of each whole text.

    start and end are in characters, end exclusive. ``separator`` is a regular expression over
    bytes. A null or empty text has one empty section without tokens. Repeated rows repeat. Bytes that are
    no UTF-8 are read as replacement characters, in the sections as in the tokens.
    """
    need_columns("tokens", "id_col/text_col", docs, [id_col, text_col])
    need_one_of("tokens", "rule", rule, RULES)
    kinds = [("section", IntegerType(), pa.int32()), ("start", LongType(), pa.int64()), ("end", LongType(), pa.int64()), ("n_tokens", LongType(), pa.int64()), ("doc_tokens", LongType(), pa.int64())]
    schema = StructType([field(docs, id_col, "id"), *(StructField(n, t) for n, t, _ in kinds)])

    def run(batches):
        encoding, sizes = encoder(vocabulary)
        cut = re.compile(separator.encode())
        for batch in batches:
            for part in slices(batch, 1):
                row, out = [], [[] for _ in kinds]
                for k, raw in enumerate(texts_of(part.column(1))):
                    whole = (raw or b"").decode("utf-8", "replace")
                    text = whole.encode()
                    ends = np.cumsum(sizes[token_ids(encoding, whole)]) if text else np.zeros(0, np.int64)
                    bounds = sections(text, cut) if text else np.array([0, 0])
                    at = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])[bounds]
                    row.append(np.full(len(bounds) - 1, k))
                    values = (np.arange(len(bounds) - 1), at[:-1], at[1:], attribute(ends, bounds, rule), np.full(len(bounds) - 1, len(ends)))
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                ids = part.column(0).take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c), t) for c, (_, _, t) in zip(out, kinds, strict=True))], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def document_tokens(counts: DataFrame) -> DataFrame:
    """``(id, n_tokens, sections)`` from the rows of ``section_tokens``."""
    return counts.groupBy("id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("sections"))
