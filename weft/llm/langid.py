"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of ``WINDOW`` bytes, the
largest response of each filter goes to a softmax over the languages. The network is trained
in numpy on windows of labelled texts. For inference embedding and filters fold into two
tables over pairs of bytes, so a window costs two gathers and a maximum for each position;
every whole text is cut into windows and their probabilities are averaged by length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from weft.errors import need_columns
from weft.llm.common import fold, schema_with, slices, texts_of
from weft.operators.skew import BROADCAST_ROWS

WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 8, 8
#: Labelled documents by language that training reads, about, and windows from each; windows of all languages together, about
#: (61 MB of bytes; fewer documents are read of each language where there are many, one at least).
DOCUMENTS, WINDOWS, ALL_WINDOWS = 1000, 6, 240_000
EPOCHS, BATCH, RATE = 4, 128, 0.005
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
#: Windows that go through the network at a time.
AT_ONCE = 512


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last filled up with 0, and the bytes of text in each."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(text) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), sizes


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"e": normal(256, EMBEDDING, scale=0.5), "v": normal(len(WIDTHS) * FILTERS, len(languages), scale=0.3), "c": np.zeros(len(languages), np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = normal(w * EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        peaks, where = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            patches = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
            act = patches @ self.p[f"w{w}"]
            at = act.argmax(axis=1)
            peaks.append(np.take_along_axis(act, at[:, None], axis=1)[:, 0] + self.p[f"b{w}"])
            where.append(at)
        h = np.maximum(np.concatenate(peaks, axis=1), 0)
        return e, where, h, h @ self.p["v"] + self.p["c"]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        e, where, h, logits = self._forward(x)
        z = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d *= (weight / weight.sum())[:, None]
        g = {"v": h.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = (d @ self.p["v"].T) * (h > 0)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            dk, at = dh[:, k * FILTERS : (k + 1) * FILTERS], where[k]
            g[f"b{w}"] = dk.sum(axis=0)
            gw, weights = np.zeros_like(self.p[f"w{w}"]), self.p[f"w{w}"]
            for j in range(w):
                part = slice(j * EMBEDDING, (j + 1) * EMBEDDING)
                gw[part] = np.einsum("bfe,bf->ef", e[rows, at + j], dk)
                np.add.at(g["e"], x[rows, at + j], dk[:, :, None] * weights[part].T[None])
            g[f"w{w}"] = gw
        return g

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
        """Adam on the cross-entropy, each language with equal weight."""
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(self.languages))))[y]
        for _ in range(max(EPOCHS, -(-300 * BATCH // max(1, len(y))))):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                at, step = order[i : i + BATCH], step + 1
                for k, g in self.gradients(x[at], y[at], weight[at]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> Tables:
        return Tables(self)


class Tables:
    """The network for inference: responses of byte pairs at the first and second place of a filter."""

    def __init__(self, net: Network):
        one = {(w, j): net.p["e"] @ net.p[f"w{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for w in WIDTHS for j in range(w)}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        self.first = np.concatenate([pair(one[w, 0], one[w, 1]) for w in WIDTHS], axis=1)
        self.second = np.concatenate([pair(one[3, 2], np.zeros((256, FILTERS), np.float32)), pair(one[4, 2], one[4, 3])], axis=1)
        self.bias = np.concatenate([net.p[f"b{w}"] for w in WIDTHS])
        self.v, self.c, self.languages = net.p["v"], net.p["c"], net.languages

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """For each window (row of bytes) the log-probability of each language."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), AT_ONCE):
            part = x[i : i + AT_ONCE].astype(np.uint16)
            codes = part[:, :-1] * np.uint16(256) + part[:, 1:]
            act = self.first[codes[:, :-2]]
            act[:, :, FILTERS:] += self.second[codes[:, 2:]]
            tail = (self.first[codes[:, -2:], :FILTERS]).max(axis=1)  # width 2 also fits at the last places
            peak = act.max(axis=1)
            peak[:, :FILTERS] = np.maximum(peak[:, :FILTERS], tail)
            at = part[:, -3] * np.uint16(256) + part[:, -2]  # and width 3 once more
            last = self.first[at, FILTERS : 2 * FILTERS] + self.second[part[:, -1] * np.uint16(256), :FILTERS]
            peak[:, FILTERS : 2 * FILTERS] = np.maximum(peak[:, FILTERS : 2 * FILTERS], last)
            logits = np.maximum(peak + self.bias, 0) @ self.v + self.c
            logits -= logits.max(axis=1, keepdims=True)
            out[i : i + AT_ONCE] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t.decode("utf-8", "replace")))]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not known or not self.languages:
            return names, scores
        cut = [windows(texts[i]) for i in known]
        each = np.exp(self.log_probabilities(np.concatenate([x for x, _ in cut])).astype(np.float64))
        sizes = np.concatenate([n for _, n in cut]).astype(np.float64)
        starts = np.cumsum([0, *(len(n) for _, n in cut[:-1])])
        p = np.add.reduceat(each * sizes[:, None], starts)
        p /= p.sum(axis=1, keepdims=True)
        for i, row in zip(known, np.round(p, 6), strict=True):  # rounded, so that a text scores alike whatever it is scored with
            names[i], scores[i] = self.languages[int(row.argmax())], float(row.max())
        return names, scores


def _training_windows(batches):
    """``(lang, x)``: up to ``WINDOWS`` windows of each text, one after the other."""
    for batch in batches:
        for part in slices(batch, 1):
            found = []
            for text in texts_of(part.column(1)):
                x, _ = windows(text)
                found.append(x[sorted({int(i) for i in np.linspace(0, len(x) - 1, WINDOWS)})].tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["lang", "x"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Tables:
    """Train on rows with text and language outside the held-out fold (crc32 of the id, as text, modulo 5 is 0).

    About ``DOCUMENTS`` of each language are read, those with the smallest hashes of the id, or
    as many as make ``ALL_WINDOWS`` of all languages together, and ``WINDOWS`` windows spread
    over each text. Every language that a training row has is learned; the driver holds the
    windows and a row a language.
    """
    need_columns("language", "columns", docs, [id_col, text_col, lang_col])
    seen = docs.where(fold(id_col, FOLDS) != HELD_OUT).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("id", F.lit(3))).alias("least")).collect()
    if not counts:
        return Network([]).tables()
    most = max(1, min(DOCUMENTS, ALL_WINDOWS // (WINDOWS * len(counts))))
    parts = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["n"]), r["least"]) for r in counts], "of string, part double, least bigint")
    number = F.xxhash64("id", F.lit(3))
    draw = F.shiftrightunsigned(number, 11).cast("double") / float(1 << 53)
    picked = seen.join(F.broadcast(parts) if len(counts) <= BROADCAST_ROWS else parts, F.col("lang") == F.col("of")).where((draw < F.col("part")) | (number == F.col("least"))).select("lang", "text")
    rows = picked.mapInArrow(_training_windows, StructType([StructField("lang", StringType()), StructField("x", BinaryType())]))
    found = sorted((r["lang"], bytes(r["x"])) for r in rows.collect())
    names = sorted({a for a, _ in found})
    number_of = {a: i for i, a in enumerate(names)}
    x = np.frombuffer(b"".join(b for _, b in found), np.uint8).reshape(-1, WINDOW)
    return Network(names).train(x, np.repeat([number_of[a] for a, _ in found], [len(b) // WINDOW for _, b in found])).tables()


def identify(docs: DataFrame, model: Tables, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the language of each whole text and its probability; columns of these names are replaced.

    A null text or one without a letter is ``und`` with score 0. Equal texts get equal values.
    """
    need_columns("language", "text_col", docs, [text_col])
    docs = docs.drop(lang_col, score_col)
    at = docs.columns.index(text_col)
    names = [*(f"c{i}" for i in range(len(docs.columns))), "lang", "score"]
    held = docs.sparkSession.sparkContext.broadcast(model)  # some 10 MB, whatever the data

    def run(batches):
        tables = held.value
        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                langs, scores = tables.predict(texts_of(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    plain = docs.toDF(*names[:-2])
    schema = schema_with(plain, StructField("lang", StringType()), StructField("score", DoubleType()))
    return plain.mapInArrow(run, schema).toDF(*docs.columns, lang_col, score_col)
