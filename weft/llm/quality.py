"""Quality classifier from positive and unlabelled texts.

A linear score over byte frequencies and word and line figures is trained to minimise the
non-negative unbiased risk: trusted positives give ``prior * R_p(+)``, and the risk of the
negatives is what unlabelled text has beyond ``prior * R_p(-)``, never less than 0. The prior
is the part of label 1 among labelled training rows. Trained scores become probabilities by a
logistic fit to samples of both labels, weighted so that label 1 has the prior. Training takes
bounded samples by hash of the id (``POSITIVES``, ``UNLABELLED``, ``CALIBRATION``); scoring reads
every whole text in its own task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from weft.errors import need_columns
from weft.llm.common import fold, schema_with, slices, texts_of

POSITIVES, UNLABELLED, CALIBRATION = 6000, 8000, 3000
STEPS, BATCH, RATE, DECAY = 600, 1024, 0.02, 1e-4
FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7
_SYMBOL = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
WIDTH = 256 + 9


def features(text: bytes | None) -> np.ndarray:
    """Square roots of the byte frequencies, then figures of length, words and lines; zeros without text."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    out[:256] = np.sqrt(counts / len(data))
    words, lines = text.split(), text.split(b"\n")
    symbol = _SYMBOL[data]
    out[256:] = (
        np.log1p(len(data)) / 10,
        len(data) / max(1, len(words)) / 10,
        len(set(words)) / max(1, len(words)),
        len(set(lines)) / len(lines),
        np.log1p(len(data) / len(lines)) / 10,
        np.count_nonzero(symbol[1:] & symbol[:-1]) / len(data) * 5,
        np.count_nonzero(symbol) / max(1, len(words)),
        np.count_nonzero(_UPPER[data]) / max(1, len(words)),
        counts[48:58].sum() / len(data) * 5,
    )
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """Means, scales and weights; without positives every text scores the prior."""

    def __init__(self, mean, scale, weights, bias, slope, shift):
        self.mean, self.scale, self.weights, self.bias, self.slope, self.shift = mean, scale, weights, bias, slope, shift

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Rounded, so that a text scores alike whatever it is scored with."""
        return np.round(_sigmoid(self.slope * self.margins(x).astype(np.float64) + self.shift), 6)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, labelled: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Minimise the non-negative unbiased risk with the sigmoid loss, by Adam."""
    level = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.0, level)
    pool = np.concatenate([positive, unlabelled])
    mean, scale = pool.mean(axis=0), pool.std(axis=0) + 0.02
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in (positive, unlabelled))
    rng, w, b = np.random.default_rng(seed), np.zeros(WIDTH), 0.0
    m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for step in range(1, STEPS + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        lp, lu = _sigmoid(xp @ w + b), _sigmoid(xu @ w + b)
        # loss of a margin z: sigmoid(-z) as positive, sigmoid(z) as negative; both slopes are s(1 - s)
        gp, gu = lp * (1 - lp), lu * (1 - lu)
        negatives = lu.mean() - prior * lp.mean()
        if negatives >= 0:
            cp, cu = -2 * prior * gp, gu
        else:  # step back from a negative estimate
            cp, cu = prior * gp, -gu
        grad = np.append(cp @ xp / BATCH + cu @ xu / BATCH + DECAY * w, cp.mean() + cu.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    model = Model(mean, scale, w, b, 1.0, 0.0)
    if len(set(labels)) == 2:
        weights = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
        model.slope, model.shift = _logistic(model.margins(labelled), labels, weights)
    return model


def _logistic(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit with slightly softened labels, by Newton steps."""
    z, t, w = z.astype(np.float64), np.where(y == 1, 1 - 1e-3, 1e-3), weights / weights.sum()
    a, c = 1.0, 0.0
    for _ in range(50):
        s = _sigmoid(a * z + c)
        r, h = w * (s - t), w * (s * (1 - s) + 1e-6)
        g = np.array([(r * z).sum() + 1e-3 * a, r.sum()])
        k = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum()]])
        d = np.linalg.solve(k, g)
        a, c = a - np.clip(d[0], -1, 1), c - np.clip(d[1], -1, 1)
    return (a, c) if a > 0 else (1.0, 0.0)


def _with_features(docs: DataFrame) -> DataFrame:
    """``(id, kind, x)``: features of ``text`` as float32 bytes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                rows = [features(t).tobytes() for t in texts_of(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["id", "kind", "x"])

    return docs.select("id", "kind", "text").mapInArrow(run, StructType([docs.schema["id"], docs.schema["kind"], StructField("x", BinaryType())]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Train on rows outside the held-out fold (crc32 of the id, as text, modulo 4 is 2).

    A row with several labels counts as its largest; null labels and null ids do not count.
    Samples are those with the smallest hashes, ``POSITIVES`` labelled 1, ``UNLABELLED`` of all
    documents, ``CALIBRATION`` labelled 0 and as many labelled 1 for the logistic fit. An id on
    several texts gives one of them, the same in each run.
    """
    need_columns("quality", "id_col/text_col", docs, [id_col, text_col])
    need_columns("quality", "label_col", labels, [id_col, label_col])
    known = labels.where(fold(id_col, FOLDS) != HELD_OUT).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).where("y is not null")
    ids = docs.where(fold(id_col, FOLDS) != HELD_OUT).select(F.col(id_col).alias("id")).distinct()
    share = known.agg(F.avg((F.col("y") == 1).cast("double")).alias("p")).first()["p"]
    order = F.xxhash64(F.col("id").cast("string"), F.lit(9))
    kinds = [(known.where("y = 1"), "p", POSITIVES), (known.where("y = 0"), "n", CALIBRATION), (ids, "u", UNLABELLED)]
    chosen = None
    for rows, kind, most in kinds:
        part = rows.select("id").orderBy(order, "id").limit(most).withColumn("kind", F.lit(kind))
        chosen = part if chosen is None else chosen.unionByName(part)
    few = F.broadcast(chosen)  # at most POSITIVES + CALIBRATION + UNLABELLED ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few, "id")
    found = _with_features(rows).groupBy("id", "kind").agg(F.min("x").alias("x")).orderBy("kind", order, "id").collect()
    x = {k: np.frombuffer(b"".join(r["x"] for r in found if r["kind"] == k), np.float32).reshape(-1, WIDTH) for k in "pnu"}
    positives = x["p"][:CALIBRATION]
    labelled = np.concatenate([x["n"], positives])
    return train(x["p"], x["u"], 0.5 if share is None else float(share), labelled, np.repeat([0, 1], [len(x["n"]), len(positives)]))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, from 0 to 1, of each whole text; a column of that name is replaced.

    A null text scores as an empty one. Equal texts score alike.
    """
    need_columns("quality", "text_col", docs, [text_col])
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)
    names = [*(f"c{i}" for i in range(len(docs.columns))), "score"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                x = np.stack([features(t) for t in texts_of(part.column(at))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(x))], names=names)

    plain = docs.toDF(*names[:-1])
    return plain.mapInArrow(run, schema_with(plain, StructField("score", DoubleType()))).toDF(*docs.columns, score_col)


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows whose score is at least ``accept``, with the columns of ``docs``.

    A model without positives to learn from rejects nothing: all rows stay.
    """
    if not np.any(model.weights):
        return docs
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    return score(plain, model, f"d{names.index(text_col)}").where(F.col("score") >= accept).drop("score").toDF(*names)
