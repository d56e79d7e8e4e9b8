"""Topic models learn from all texts in each round."""

import math

import numpy as np
import pytest
from test_text_models import texts

from weft.functions.special import digamma, log_gamma
from weft.operators import lda
from weft.operators import topics as TP


def test_gamma_functions():
    x = np.array([0.01, 0.25, 1.0, 2.5, 5.9, 40.0, 1e6])
    assert log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-12, rel=1e-12)
    assert digamma(x) == pytest.approx([(math.lgamma(v * (1 + 1e-6)) - math.lgamma(v * (1 - 1e-6))) / (2e-6 * v) for v in x], rel=1e-4, abs=1e-4)


def plain(counts, k, rounds, seed=42):
    """Batch variational Bayes text by text, and the bound on the log perplexity."""
    log_mean = lambda w: digamma(w) - digamma(w.sum(axis=-1, keepdims=True))
    w, alpha, eta = np.random.default_rng(seed).gamma(100.0, 0.01, (k, counts.shape[1])), 1 / k, 1 / k

    def fitted(c, b):
        g = np.ones(k)
        for _ in range(100):
            t = np.exp(log_mean(g))
            new = alpha + t * (b @ (c / (t @ b + 1e-100)))
            done, g = np.abs(new - g).mean() < 1e-3, new
            if done:
                break
        return g

    for _ in range(rounds):
        b = np.exp(log_mean(w))
        new = np.full_like(w, eta)
        for c in counts:
            t = np.exp(log_mean(fitted(c, b)))
            new += t[:, None] * b * (c / (t @ b + 1e-100))
        w = new
    bound, parts = 0.0, []
    for c in counts:
        g = fitted(c, np.exp(log_mean(w)))
        parts.append(g / g.sum())
        bound += (c * np.log(np.exp(log_mean(g)) @ np.exp(log_mean(w)))).sum() + ((alpha - g) * log_mean(g) + log_gamma(g) - math.lgamma(alpha)).sum() + math.lgamma(k * alpha) - math.lgamma(g.sum())
    bound += ((eta - w) * log_mean(w) + log_gamma(w) - math.lgamma(eta)).sum() + k * math.lgamma(eta * w.shape[1]) - log_gamma(w.sum(axis=1)).sum()
    return w, -bound / counts.sum(), np.mean(parts, axis=0)


@pytest.mark.parametrize("parts", [1, 5])
def test_rounds_take_every_text(spark, monkeypatch, parts):
    rows = [*texts(70), (70, "apple iron", "f"), (71, "", "m"), (72, "apple", "m")]
    df = spark.createDataFrame(rows, "id long, text string, side string").repartition(parts)
    words, model, counted = TP.fit_lda(df, "text", 3, rounds=4)
    counts = np.array([[t.split().count(w) for w in words] for _, t, _ in rows if t])
    want, bound, share = plain(counts.astype(float), 3, 4)
    assert model.weights == pytest.approx(want, rel=1e-6) and model.log_perplexity(counted) == pytest.approx(bound, rel=1e-6)
    assert [r["p"] for r in model.shares(counted).orderBy("t").collect()] == pytest.approx(share, rel=1e-6)
    assert model.weights.sum() == pytest.approx(counts.sum() + model.eta * model.weights.size)  # each word of each text is in some topic


def test_texts_that_settle_at_different_steps_in_blocks():
    draw = np.random.default_rng(1)
    counts = draw.integers(0, 4, (40, 12)) * (draw.random((40, 12)) < 0.4)
    counts[:, 0] += 1
    text, at = np.nonzero(counts)
    by_word = draw.random((3, 12))
    got = lda._fitted(at, counts[text, at].astype(float), np.searchsorted(text, np.arange(41)), by_word, 1 / 3)
    for i, c in enumerate(counts):
        one = np.nonzero(c)[0]
        assert got[i] == pytest.approx(lda._fitted(one, c[one].astype(float), np.array([0, len(one)]), by_word, 1 / 3)[0], rel=1e-9)
