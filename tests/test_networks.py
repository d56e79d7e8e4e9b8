"""Networks and clusters: detours of each kind by brute force, planted communities and topics, silhouettes from all pairs."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.errors import OpError
from weft.operators import graph, skew, spectral, stats, topics


def network(seed, n, p):
    rng = random.Random(seed)
    return [(f"n{a:02d}", f"n{b:02d}", rng.choice([0.1, 0.2, 0.25, 0.5, 0.8, 1.0])) for a, b in itertools.combinations(range(n), 2) if rng.random() < p]


def detours(edges, r, lmax, length):
    """Every simple path by depth-first search."""
    long = {(a, b): 1 / w if length == "inverse" else max(0, 1 - w) for a, b, w in edges}
    near = {}
    for (a, b), c in long.items():
        near.setdefault(a, []).append((b, c))
        near.setdefault(b, []).append((a, c))
    kept = set()
    for (a, b), own in long.items():
        best = math.inf
        stack = [(a, 0.0, {a})]
        while stack:
            at, far, seen = stack.pop()
            for to, c in near[at]:
                if to in seen:
                    continue
                total = max(far, c) if r == math.inf else (far**r + c**r) ** (1 / r)
                if total > own * (1 + 1e-12) or len(seen) > (lmax or math.inf):
                    continue
                if to == b:
                    if len(seen) > 1:
                        best = min(best, total)
                else:
                    stack.append((to, total, seen | {to}))
        if own <= best * (1 + 1e-9):
            kept.add((a, b))
    return kept


@pytest.mark.parametrize(("r", "lmax", "length"), [(1, 0, "inverse"), (2, 0, "inverse"), (1, 2, "complement"), (2, 3, "inverse"), (math.inf, 2, "inverse"), (math.inf, 3, "complement")])
def test_pathfinder_against_all_paths(spark, r, lmax, length):
    edges = network(int(r if r < 9 else 9) * 10 + lmax, 13, 0.5)
    df = spark.createDataFrame(edges, "a string, b string, weight double").withColumn("row", F.lit(1))
    got = {(x["a"], x["b"]) for x in graph.pathfinder(df, "weight", r, lmax=lmax, length=length).collect()}
    assert got == detours(edges, r, lmax, length) and 0 < len(got) < len(edges)


def test_pathfinder_parts_and_groups(spark):
    edges = network(5, 12, 0.6)
    both = [(g, *e) for g in ("x", "y", None) for e in edges[: None if g else 9]]
    df = spark.createDataFrame(both, "g string, a string, b string, weight double")
    for dmax in (1.0, 0.4, 0.001):
        got = graph.pathfinder(df, "weight", 1, "g", dmax=dmax).collect()
        for g in ("x", "y", None):
            mine = edges[: None if g else 9]
            kept = sorted(((-w, a, b) for a, b, w in mine if (a, b) in detours(mine, 1, 0, "inverse")))
            assert {(e["a"], e["b"]) for e in got if e["g"] == g} == {(a, b) for _, a, b in kept[: max(1, math.ceil(len(kept) * dmax))]}
    assert graph.pathfinder(df.where("false"), "weight", 2).count() == 0
    for bad in ({"r": 3}, {"lmax": 1}, {"dmax": 0}, {"length": "other"}):
        with pytest.raises(OpError):
            graph.pathfinder(df, "weight", **bad)


def test_spectral_on_a_large_network(spark, monkeypatch):
    """Planted communities of over 2,000 nodes, with a hub in each."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(skew, "HOT_ROWS", 300)
    rng = random.Random(3)
    edges = set()
    for i in range(2400):
        g = i % 4
        edges |= {tuple(sorted((i, (rng.randrange(600) * 4 + g)))) for _ in range(4)} | {tuple(sorted((i, g)))}
        if rng.random() < 0.1:
            edges.add(tuple(sorted((i, rng.randrange(2400)))))
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges if a != b], "a long, b long, weight double")
    got = {r["node"]: r["cluster"] for r in graph.spectral_clusters(df, 4).collect()}
    assert set(got) == {x for e in edges for x in e if e[0] != e[1]}
    assert sum(got[i] == i % 4 for i in got) > 0.98 * len(got)  # clusters are numbered by their smallest nodes


def test_spectral_values_against_a_dense_solver(spark):
    edges = network(8, 14, 0.4)
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    w = np.zeros((len(names), len(names)))
    for a, b, x in edges:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = x
    s = 1 / np.sqrt(w.sum(axis=1))
    exact = np.linalg.eigvalsh(np.eye(len(names)) - w * s[:, None] * s)
    _, values, columns = spectral.leading_vectors(df, 3, rounds=60)
    assert values == pytest.approx(exact[:3], abs=1e-3) and len(columns) == 3
    empty = df.where("false")
    assert graph.spectral_clusters(empty).count() == 0 and graph.spectral_clusters(df.limit(1), 0).count() == 2
    with pytest.raises(OpError):
        graph.spectral_clusters(df, -1)


@pytest.mark.parametrize("metric", ["euclidean_squared", "cosine"])
def test_silhouettes_against_all_pairs(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 3)) + rng.integers(0, 3, 90)[:, None]
    c = [int(v) for v in rng.integers(0, 4, 90)]
    c[7] = 9  # alone
    rows = [(i, [float(v) for v in x[i]], c[i]) for i in range(90)]
    df = spark.createDataFrame([*rows, (200, None, 1), (201, [1.0, 2.0, 3.0], None)], "id int, v array<double>, c int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = 1 - u @ u.T if metric == "cosine" else ((x[:, None] - x[None]) ** 2).sum(axis=2)
    got = {r["id"]: r["silhouette"] for r in spectral.silhouettes(df, "id", "v", "c", metric).collect()}
    assert set(got) == set(range(90))
    for i in range(90):
        mean = {k: np.mean([far[i, j] for j in range(90) if c[j] == k and j != i] or [np.nan]) for k in set(c)}
        a, b = mean.pop(c[i]), min(mean.values())
        assert got[i] == pytest.approx(0 if c.count(c[i]) < 2 else (b - a) / max(a, b), abs=1e-9)
    assert all(r["silhouette"] == 0 for r in spectral.silhouettes(df.withColumn("c", F.lit(1)), "id", "v", "c", metric).collect())
    assert spectral.silhouettes(df.where("false"), "id", "v", "c", metric).count() == 0


def test_topics_of_planted_vectors(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        g = i % 3
        v = 0.2 * rng.standard_normal(6)
        v[g] += 1
        rows.append((i, [float(a) for a in v * rng.uniform(0.5, 4)], " ".join(rng.choice([f"topic{g}a", f"topic{g}b", "shared", "common"], 12))))
    df = spark.createDataFrame([*rows, (500, None, "lost words"), (501, [0.0] * 6, None)], "id long, v array<double>, text string")
    assert all(r["cluster"] == r["id"] % 3 for r in topics.vector_clusters(df, "id", "v", 3).collect())
    got = topics.vector_topics(df, "id", "v", "text", 3, 2).collect()
    assert {(r["topic"], r["keyword"]) for r in got} == {(g + 1, f"topic{g}{x}") for g in range(3) for x in "ab"} and {r["documents"] for r in got} == {40}


def test_number_of_text_clusters(spark):
    rng = random.Random(1)
    pools = [[f"w{g}{i}" for i in range(6)] for g in range(3)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(pools[i % 3]) for _ in range(15))) for i in range(90)], "id int, text string")
    got = stats.cluster_texts(df, "text", 2, most=5).collect()
    assert len({r["cluster"] for r in got}) == 3 and len({(r["id"] % 3, r["cluster"]) for r in got}) == 3


def test_betweenness_by_part_and_by_rounds(spark, monkeypatch):
    """parts are worked on in tasks of their own; parts with more links than a task takes give the same in rounds."""
    edges = [(f"{g}{a}", f"{g}{b}", w) for g, n in (("p", 7), ("q", 12)) for a, b, w in network(n, n, 0.4)]
    df = spark.createDataFrame([*edges, ("z1", "z2", 1.0), ("z2", "z2", 1.0)], "a string, b string, weight double")
    some = df.select("a").distinct().where("a > 'pn02'")
    found = []
    for links, sources, places in ((2_000_000, 2, 1), (30, 256, 1_000_000)):
        monkeypatch.setattr(graph, "PART_LINKS", links)
        monkeypatch.setattr(graph, "PART_SOURCES", sources)
        monkeypatch.setattr(graph, "PLACES", places)
        found.append([{r["node"]: r["betweenness"] for r in graph.betweenness(df, sources=s).collect()} for s in (None, some)])
    assert sum(found[0][0].values()) > 0 and found[0] == [pytest.approx(w) for w in found[1]]


def test_coupling_counts_in_as_many_tasks_as_meetings_need(spark, monkeypatch):
    """what one task counts is bounded whatever the number of shuffle partitions."""
    monkeypatch.setattr(graph, "TASK_MEETINGS", 100)
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.randrange(30)) for _ in range(600)] + [(None, 1), (1, None)]
    got = graph.coupling_edges(spark.createDataFrame(rows, "doc long, ref long"), "doc", "ref")
    of = {}
    for doc, ref in set(rows):
        if doc is not None and ref is not None:
            of.setdefault(ref, []).append(doc)
    want = {}
    for docs in of.values():
        for a, b in itertools.combinations(sorted(docs), 2):
            want[a, b] = want.get((a, b), 0) + 1
    assert {(r["a"], r["b"]): r["count"] for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == sum(want.values()) // 100 + 1 > 20


def test_edges_are_made_once(spark):
    """F19 to F21, F24, F25: what makes the edges runs once, however often an operator reads them."""
    edges = network(2, 12, 0.5)
    df, seen = spark.createDataFrame(edges, "a string, b string, weight double").repartition(2), spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    made = df.mapInPandas(counted, df.schema)
    for run in (lambda e: graph.max_links(e, 3), lambda e: graph.eigenvector(e, rounds=3), graph.largest_component, graph.spanning_forest, lambda e: graph.page_rank(e, rounds=2), lambda e: spectral.leading_vectors(e, 2, rounds=3)[0]):
        seen.value = 0
        assert run(made).collect() and seen.value == len(edges)


@pytest.mark.parametrize(("kind", "few"), [("long", False), ("string", True)])
def test_coupling_counts_references_of_many_documents(spark, monkeypatch, kind, few):
    """A reference of over 200 documents counts like any other, also where lists are cut into blocks."""
    rng = random.Random(5)
    rows = [(d, "all") for d in range(260)] + [(rng.randrange(260), f"r{rng.randrange(40)}") for _ in range(900)]
    rows += rows[:50]
    if few:
        monkeypatch.setattr(graph, "LIST_DOCS", 16)
    if kind == "string":
        rows = [(f"d{d}", r) for d, r in rows]
    got = graph.coupling_edges(spark.createDataFrame(rows, f"doc {kind}, ref string").repartition(3), "doc", "ref").collect()
    of = {}
    for doc, ref in set(rows):
        of.setdefault(ref, []).append(doc)
    want = {}
    for docs in of.values():
        for pair in itertools.combinations(sorted(docs), 2):
            want[pair] = want.get(pair, 0) + 1
    assert len(got) == len(want) and {(r["a"], r["b"]): r["count"] for r in got} == want
    for name, n in (("HELD_DOCS", 300), ("COUNTED_MEETINGS", 5000), ("HELD_PAIRS", 20_000)):
        monkeypatch.setattr(graph, name, n)
    lists = pa.table({"x": [sorted(docs) for docs in of.values()], "y": pa.nulls(len(of), pa.list_(pa.string() if kind == "string" else pa.int64()))})
    added = {}
    for batch in graph._met_counts(lists.to_batches(7)):
        for a, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            added[a, b] = added.get((a, b), 0) + n
    assert added == want


@pytest.mark.parametrize("held", [1000, 15])
def test_forest_of_blocks_of_edges(spark, monkeypatch, held):
    """Rounds go over the forests of blocks only, and the forest is that of all edges, the last by ends of equal weights."""
    monkeypatch.setattr(graph, "FOREST_EDGES", held)
    rng = random.Random(held)
    edges = [(f"s{a}", f"s{b}", rng.choice([1.0, 2.0, 3.0, math.nan])) for a, b in itertools.combinations(range(20), 2) if a % 2 == b % 2]
    root, want = {}, set()

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, w in sorted(edges, key=lambda e: (math.inf if math.isnan(e[2]) else e[2], e[0], e[1]), reverse=True):
        if top(a) != top(b):
            root[top(a)] = top(b)
            want.add((a, b))
    table = pa.table({c: [e[i] for e in edges] for i, c in enumerate("abw")})
    blocks = {tuple(x.values())[:2] for batch in graph._forest_edges(table.to_batches(7)) for x in batch.to_pylist()}
    assert want <= blocks and (held < len(edges) or blocks == want) and len(blocks) < len(edges)
    df = spark.createDataFrame([*edges, ("s1", "s1", 9.0), (None, "s1", 9.0)], "a string, b string, weight double").repartition(3)
    assert {(x["a"], x["b"]) for x in graph.spanning_forest(df).collect()} == want


@pytest.mark.parametrize("few", [False, True])
def test_eigenvector_links_are_dealt_out_once(spark, monkeypatch, few):
    """Links lie by the node that they lead to; values as from the whole matrix, broadcast or dealt out."""
    plans, real = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().toString()) or real(df))
    if few:
        monkeypatch.setattr(graph, "BROADCAST_VALUES", 0)
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    edges = network(4, 12, 0.5)
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    matrix, v = np.eye(len(names)), np.ones(len(names))
    for a, b, w in edges:
        matrix[names.index(a), names.index(b)] = matrix[names.index(b), names.index(a)] = w
    for _ in range(5):
        v = matrix @ v / np.linalg.norm(matrix @ v)
    got = {x["node"]: x["eigenvector"] for x in graph.eigenvector(spark.createDataFrame(edges, "a string, b string, weight double"), rounds=5).collect()}
    assert got == pytest.approx(dict(zip(names, v, strict=True))) and "hashpartitioning(y" in plans[0]


@pytest.mark.parametrize("few", [False, True])
def test_leading_vectors_links_are_dealt_out_once(spark, monkeypatch, few):
    """Links lie by the node that they lead to; two parts give two eigenvalues of 0, broadcast or dealt out."""
    plans, real = [], spectral.checkpoint
    monkeypatch.setattr(spectral, "checkpoint", lambda df: plans.append((df.columns, df._jdf.queryExecution().toString())) or real(df))
    if few:
        monkeypatch.setattr(spectral, "BROADCAST_NUMBERS", 0)
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    edges = [(f"{p}{i}", f"{p}{j}", 1.0) for p in "xy" for i in range(4) for j in range(i + 1, 4)]
    _, values, _ = spectral.leading_vectors(spark.createDataFrame(edges, "a string, b string, weight double"), 3, rounds=6)
    assert values[:2] == pytest.approx([0, 0], abs=1e-6) and values[2] > 0.5
    assert any(c == ["x", "y", "w"] and "hashpartitioning(y#" in plan.partition("Physical Plan")[2] and "RepartitionByExpression [y" in plan for c, plan in plans)
