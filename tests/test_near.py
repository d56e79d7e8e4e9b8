"""Exact near pairs of sparse and dense vectors and the clusters on them, against all pairs."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.errors import OpError
from weft.operators import dedupe, dense, skew, sparse, stats


def vectors(spark, rows):
    return spark.createDataFrame([(i, [(int(r), float(w)) for r, w in v]) for i, v in rows], "id long, v array<struct<rank:bigint,w:double>>")


def random_vectors(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:  # near an earlier one
            base = dict(rng.choice(out)[1])
            for _ in range(rng.randint(0, 3)):
                base[rng.randint(1, 60)] = rng.random() + 0.1
        else:
            base = {min(60, int(rng.expovariate(0.05)) + 1): rng.random() + 0.05 for _ in range(rng.randint(1, 12))}
        size = math.sqrt(sum(w * w for w in base.values()))
        out.append((i, sorted((61 - r if i < 0 else r, w / size) for r, w in base.items())))
    return out


@pytest.mark.parametrize(("threshold", "list_rows"), [(0.3, 2048), (0.7, 7), (0.95, 3), (1.0, 2048)])
def test_cosine_pairs_against_all_pairs(spark, monkeypatch, threshold, list_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rows = random_vectors(int(threshold * 100), 250)
    got = {(r["a"], r["b"]): r["similarity"] for r in sparse.cosine_pairs(vectors(spark, rows).repartition(3), threshold, list_rows).collect()}
    full = {i: dict(v) for i, v in rows}
    wanted = {}
    for a in full:
        for b in full:
            if a < b:
                s = sum(w * full[b].get(r, 0) for r, w in full[a].items())
                if s >= threshold - 1e-12:
                    wanted[a, b] = s
    sure = {k for k, s in wanted.items() if s >= threshold + 1e-12}
    assert sure <= set(got) <= set(wanted) and (threshold == 1.0 or len(sure) > 50)
    assert all(s == pytest.approx(wanted[k]) for k, s in got.items())


@pytest.mark.parametrize(("threshold", "tile"), [(0.3, 2048), (0.6, 7), (0.9, 40)])
def test_cosine_pairs_in_blocks(spark, monkeypatch, threshold, tile):
    """with many meetings vectors are compared in blocks, with the same pairs, and no meeting is shuffled."""
    monkeypatch.setattr(sparse, "BLOCK_ROWS", (60, 60))
    monkeypatch.setattr(sparse, "TILE_ROWS", tile)
    df = vectors(spark, [*random_vectors(3, 250), (900, [])]).repartition(3)
    found = []
    for meetings in (0, 10**9):
        monkeypatch.setattr(sparse, "LIST_MEETINGS", meetings)
        found.append(sparse.cosine_pairs(df, threshold))
    plan = found[0]._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Join" not in plan
    blocks, lists = ({(r["a"], r["b"]): r["similarity"] for r in x.collect()} for x in found)
    near = lambda got: {k for k, s in got.items() if s >= threshold + 1e-12}
    assert near(blocks) == near(lists) and len(near(blocks)) > 50 and blocks == pytest.approx({k: lists.get(k, threshold) for k in blocks}) and all(a < b for a, b in blocks)


def test_sparse_edges(spark):
    empty = vectors(spark, [])
    assert sparse.cosine_pairs(empty, 0.5).count() == 0
    assert sparse.cosine_pairs(vectors(spark, [(1, []), (2, [(3, 1.0)]), (3, [(3, 1.0)])]), 0.5).collect()[0][:] == (2, 3, 1.0)
    with pytest.raises(OpError):
        sparse.cosine_pairs(empty, 0)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "red blue"), (4, "blue red"), (5, "red blue green pink")], "id long, text string").withColumn("n", F.lit(1))
    assert {tuple(r) for r in sparse.dbscan_texts(df, "id", "text", 0.1, 2).collect()} == {(1, None, True), (2, None, True), (3, 3, False), (4, 3, False), (5, None, True)}
    assert sparse.dbscan_texts(df.where("id < 2"), "id", "text").collect()[0][:] == (1, None, True)
    many = spark.createDataFrame([(i, "same few plain words" if i % 2 else f"own{i} word{i}") for i in range(6000)], "id long, text string")
    got = collections.Counter((r["cluster"], r["is_noise"]) for r in sparse.dbscan_texts(many, "id", "text", 0.3, 3, None).collect())
    assert got == {(1, False): 3000, (None, True): 3000}


def test_dbscan_texts_against_all_pairs(spark):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(40)]
    topics = [rng.sample(pool, 8) for _ in range(5)]
    texts = [(i, " ".join(rng.choice(topics[i % 5] if rng.random() < 0.85 else pool) for _ in range(rng.randint(3, 14)))) for i in range(160)]
    texts += [(i + 500, t) for i, t in texts[:30]]
    words = {i: collections.Counter(w for w in t.split() if len(w) > 1) for i, t in texts}
    df_ = collections.Counter(w for c in words.values() for w in c)
    top = {w for w, _ in sorted(collections.Counter(w for c in words.values() for w in c.elements()).items(), key=lambda x: (-x[1], x[0]))[:30]}
    for vocabulary, eps, least in ((None, 0.4, 4), (30, 0.25, 4)):
        vec = {i: {w: n * (math.log((1 + len(words)) / (1 + df_[w])) + 1) for w, n in c.items() if vocabulary is None or w in top} for i, c in words.items()}
        size = {i: math.sqrt(sum(x * x for x in v.values())) or 1 for i, v in vec.items()}
        near = {a: {b for b in vec if b != a and sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) / size[a] / size[b] >= 1 - eps} for a in vec if vec[a]}
        cores = {a for a in near if len(near[a]) + 1 >= least}
        name = {}
        for c in sorted(cores):
            todo = [c] if c not in name else []
            while todo:
                x = todo.pop()
                if x not in name:
                    name[x] = c
                    todo += near[x] & cores
        wanted = {a: name.get(a, name.get(min(near.get(a, set()) & cores, default=None))) for a in vec}
        got = {r["id"]: r["cluster"] for r in sparse.dbscan_texts(spark.createDataFrame(texts, "id long, text string"), "id", "text", eps, least, vocabulary).collect()}
        assert got == wanted, vocabulary
        assert len(set(name.values())) > 1


# dense


def clustered(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    x = centres[rng.integers(0, 6, n)] + spread * rng.standard_normal((n, width))
    x[rng.random(n) < 0.1] = x[0]
    x[rng.random(n) < 0.1] *= 3
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, "id long, v array<double>").withColumn("id", F.col("id").cast(kind)).repartition(3)


@pytest.mark.parametrize(("spread", "threshold", "block"), [(0.3, 0.9, 16), (0.3, 0.9, 4096), (1.0, 0.5, 40), (0.05, 0.999, 30), (1.0, -0.2, 64)])
def test_dense_pairs_against_all_pairs(spark, spread, threshold, block):
    rows = clustered(3, 300, 5, spread)
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    units = frame(spark, rows).select("id", dense.unit(F.col("v")).alias("u"))
    got = [(r["a"], r["b"]) for r in dense.pairs(units, threshold, block).collect()]
    sure, wanted = ({(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= threshold + e} for e in (1e-12, -1e-12))
    assert len(got) == len(set(got)) and sure <= set(got) <= wanted and len(sure) > 100


def test_pivots_spare_comparisons(spark):
    rows = frame(spark, clustered(4, 2000, 8, 0.05)).select("id", dense.unit(F.col("v")).alias("u"))
    homes = dense.placed(rows, 0.99, 100)
    own = homes.where("stay").groupBy("home").count().collect()
    assert sum(r["count"] for r in own) == 2000 and len(own) > 5 and homes.count() < 4 * 2000


@pytest.mark.parametrize("kind", ["long", "string"])
def test_semantic_dedupe_against_a_plain_loop(spark, kind, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 50)
    rows = [*clustered(5, 250, 6, 0.4), (900, None), (901, [0.0] * 6), (902, [float("nan")] * 6)]
    order = sorted(range(250), key=str if kind == "string" else int)
    u = np.array([v for _, v in rows[:250]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    kept = []
    for i in order:
        if all(u[i] @ u[j] < 0.9 for j in kept):
            kept.append(i)
    got = {str(r["id"]) for r in dedupe.semantic_dedupe(frame(spark, rows, kind), "id", "v", 0.9).collect()}
    assert got == {str(i) for i in [*kept, 900, 901, 902]}
    empty = frame(spark, rows, kind).where("id < 0")
    assert dedupe.semantic_dedupe(empty, "id", "v").count() == dedupe.semantic_pairs(empty, "id", "v").count() == 0
    with pytest.raises(OpError):
        dedupe.semantic_pairs(empty, "id", "v", 2)


def test_very_many_vectors_of_one_direction(spark):
    v = F.array(*[F.lit(float(x)) * (1 + F.col("id")) for x in (0.3, -0.2, 0.7, 0.1)])
    df = spark.range(100_000).select("id", v.alias("v"))
    assert [r["id"] for r in dedupe.semantic_dedupe(df, "id", "v", 0.95).collect()] == [0]
    got = stats.dbscan(df, "id", "v", 0.01, 5).groupBy("cluster", "is_noise").count().collect()
    assert [tuple(r) for r in got] == [(0, False, 100_000)]


def test_dbscan_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 40)
    rows = [*clustered(6, 260, 4, 0.5), (900, None)]
    u = np.array([v for _, v in rows[:260]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.97
    cores = [i for i in range(260) if near[i].sum() >= 8]
    name = {}
    for c in cores:
        todo = [c] if c not in name else []
        while todo:
            x = todo.pop()
            if x not in name:
                name[x] = c
                todo += [y for y in cores if near[x, y]]
    wanted = {i: name.get(i, name.get(next((c for c in cores if near[i, c]), None))) for i in range(260)} | {900: None}
    got = {r["id"]: r["cluster"] for r in stats.dbscan(frame(spark, rows), "id", "v", 0.03, 8).collect()}
    assert got == wanted and len(set(name.values())) > 1 and None in wanted.values()
