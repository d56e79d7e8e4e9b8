"""Latent Dirichlet allocation by batch variational Bayes: each round reads every text, none is drawn.

Tasks fit the topics of their texts to the word weights of the round and give the sums of what each topic takes of each
word; only these sums, topics by words, reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.special import digamma, log_gamma

#: Texts that are fitted at a time, rounds that a text takes at most, and the mean change of its weights at which it is done.
TEXTS, STEPS, SETTLED = 512, 100, 1e-3


@dataclass
class Topics:
    """A model: ``weights`` of topics (rows) over words, and the priors of topics in a text and of words in a topic."""

    weights: np.ndarray
    alpha: float
    eta: float

    def parts(self) -> np.ndarray:
        """The part of each word in each topic."""
        return self.weights / self.weights.sum(axis=1, keepdims=True)

    def best(self, topn: int) -> list[tuple[int, list[int], list[float]]]:
        """``(topic, words, parts)`` of the heaviest words of each topic, of equal ones the first."""
        order = np.argsort(-self.parts(), axis=1, kind="stable")[:, :topn]
        return [(t, [int(i) for i in o], [float(x) for x in p[o]]) for t, (p, o) in enumerate(zip(self.parts(), order, strict=True))]

    def shares(self, rows: DataFrame) -> DataFrame:
        """``(t, p)``: the mean part of each topic in the texts."""
        k = len(self.weights)

        def one(words, n, ends, gamma, _):
            return (gamma / gamma.sum(axis=1, keepdims=True)).sum(axis=0), len(gamma)

        sums = _summed(rows, self, one, k + 1).select("i", "x")
        total = sums.where(F.col("i") == k).select(F.col("x").alias("n"))  # one row
        return sums.where(F.col("i") < k).crossJoin(F.broadcast(total)).select(F.col("i").cast("int").alias("t"), (F.col("x") / F.col("n")).alias("p"))

    def log_perplexity(self, rows: DataFrame) -> float:
        """The variational bound of the texts on minus the mean log likelihood of a word."""
        (k, v), alpha, eta = self.weights.shape, self.alpha, self.eta
        log_words = _log_mean(self.weights)

        def one(words, n, ends, gamma, text):
            log_topics = _log_mean(gamma)
            both = log_topics[text] + log_words.T[words]
            most = both.max(axis=1)
            bound = (n * (most + np.log(np.exp(both - most[:, None]).sum(axis=1)))).sum()
            bound += ((alpha - gamma) * log_topics + log_gamma(gamma)).sum() - log_gamma(gamma.sum(axis=1)).sum()
            return np.array([bound + len(gamma) * (math.lgamma(k * alpha) - k * math.lgamma(alpha))]), n.sum()

        bound, count = _collected(rows, self, one, 2)
        w = self.weights
        bound += ((eta - w) * log_words + log_gamma(w)).sum() - w.size * math.lgamma(eta) + k * math.lgamma(eta * v) - log_gamma(w.sum(axis=1)).sum()
        return float(-bound / max(count, 1.0))


def fit(rows: DataFrame, words: int, k: int, rounds: int = 10, seed: int = 42) -> Topics:
    """The model of ``k`` topics after so many rounds over all ``rows`` (features, a vector of counts of so many words); a text's and a topic's prior are one over ``k``."""
    model = Topics(np.random.default_rng(seed).gamma(100.0, 0.01, (k, words)), 1 / k, 1 / k)
    for _ in range(rounds):
        by_word = np.exp(_log_mean(model.weights))

        def one(at, n, ends, gamma, text, by_word=by_word):
            topics = np.exp(_log_mean(gamma))[text]
            taken = topics * by_word.T[at]
            taken *= (n / (taken.sum(axis=1) + 1e-100))[:, None]
            return np.concatenate([np.bincount(at, taken[:, t], words) for t in range(k)]), len(gamma)

        model = Topics(model.eta + _collected(rows, model, one, k * words + 1)[:-1].reshape(k, words), model.alpha, model.eta)
    return model


def _log_mean(weights: np.ndarray) -> np.ndarray:
    """The expected logarithms under a Dirichlet distribution of each row."""
    return digamma(weights) - digamma(weights.sum(axis=1, keepdims=True))


def _fitted(at: np.ndarray, n: np.ndarray, ends: np.ndarray, by_word: np.ndarray, alpha: float) -> np.ndarray:
    """The topic weights of texts, from the words ``at`` which they have ``n`` times; each goes on until it settles."""
    k, sizes = len(by_word), np.diff(ends)
    out, left = np.ones((len(sizes), k)), np.arange(len(sizes))
    held, count = by_word.T[at], n
    first, text = ends[:-1], np.repeat(left, sizes)
    gamma, moving = out.copy(), np.ones(len(sizes), bool)
    for _ in range(STEPS):
        topics = np.exp(_log_mean(gamma))
        part = count / ((topics[text] * held).sum(axis=1) + 1e-100)
        new = alpha + topics * np.add.reduceat(held * part[:, None], first, axis=0)
        still = moving & (np.abs(new - gamma).mean(axis=1) >= SETTLED)
        gamma[moving], moving = new[moving], still  # whatever the other texts of the block do
        out[left] = gamma
        if not moving.any():
            break
        if np.count_nonzero(moving) * 4 < 3 * len(left):  # go on with what has not settled
            keep = moving[text]
            held, count, sizes = held[keep], count[keep], sizes[moving]
            left, gamma, moving = left[moving], gamma[moving], moving[moving]
            first, text = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(left)), sizes)
    return out


def _summed(rows: DataFrame, model: Topics, figures, size: int) -> DataFrame:
    """``(i, x)``: the sums over blocks of texts of what ``figures`` makes of them, numbers in an array and a last one."""
    by_word, alpha = np.exp(_log_mean(model.weights)), model.alpha

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                words, n = batch.column(0).slice(start, TEXTS), batch.column(1).slice(start, TEXTS)
                ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
                at, n = words.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy()
                gamma = _fitted(at, n, ends, by_word, alpha)
                found, last = figures(at, n, ends, gamma, np.repeat(np.arange(len(gamma)), np.diff(ends)))
                total[:-1] += found
                total[-1] += last
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "x"])

    raw = F.unwrap_udt("features")
    texts = rows.select(raw["indices"].alias("at"), raw["values"].alias("n")).where("size(at) > 0")
    return texts.mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x"))


def _collected(rows: DataFrame, model: Topics, figures, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in _summed(rows, model, figures, size).collect():  # as many as topics times words
        out[r["i"]] = r["x"]
    return out
