"""Pathfinder by the longest edge: the edges of all minimum spanning trees, in rounds that halve the nodes."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import components
from weft.operators import graph as G
from weft.operators import skew


def stays(edges):
    """Edges whose ends no heavier ones connect, by union of the heavier ones."""
    kept, over = set(), {}

    def root(x):
        while over.setdefault(x, x) != x:
            x = over[x]
        return x

    for w in sorted({w for *_, w in edges}, reverse=True):
        here = [(g, a, b) for g, a, b, v in edges if v == w and a != b]
        kept |= {(g, a, b) for g, a, b in here if root((g, a)) != root((g, b))}
        for g, a, b in here:
            over[root((g, a))] = root((g, b))
    return kept


@pytest.mark.parametrize(("nodes", "part", "weights", "few"), [(14, 0.5, 4, False), (9, 0.4, 50, True)])
def test_bottleneck_edges_against_unions(spark, monkeypatch, nodes, part, weights, few):
    if few:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 5)
    draw = random.Random(nodes)
    edges = [(g, f"n{i}", f"n{j}", float(draw.randint(1, weights))) for g in ("x", None) for i in range(nodes) for j in range(i, nodes) if draw.random() < part]
    edges += [("x", "n9", "n1", 2.0), ("x", "n1", "n9", 2.0)]
    df = spark.createDataFrame(edges, "g string, a string, b string, weight double").repartition(5)
    got = {(r["g"], r["a"], r["b"]) for r in G.pathfinder(df, "weight", group_col="g").collect()}
    assert got == stays(edges)


def test_rounds_grow_with_nodes_not_with_weights(spark, monkeypatch):
    """A star of as many weights as edges is settled in one round, not in one for each halving of the weights."""
    calls, real = [], G.connected_components
    monkeypatch.setattr(G, "connected_components", lambda *a, **k: calls.append(1) or real(*a, **k))
    star = spark.range(1, 300).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"), F.col("id").cast("double").alias("weight"))
    assert G.pathfinder(star, "weight").count() == 299 and len(calls) == 1


@pytest.mark.parametrize(("r", "lmax"), [(1, 2), (2, 3), (2, 0), (float("inf"), 2)])
def test_detours_within_parts_are_those_of_rounds(spark, monkeypatch, r, lmax):
    """Parts that a task takes whole or source by source, parts joined round by round, and both at once give the same edges."""
    draw = random.Random(7)
    edges = [(f"{p}{i}", f"{p}{j}", float(draw.randint(1, 9))) for p, n in (("x", 9), ("y", 5), ("z", 2)) for i in range(n) for j in range(i + 1, n) if n < 3 or draw.random() < 0.7]
    edges += [("x0", "x0", 3.0), (None, "x1", 3.0), ("x1", "x0", 2.0), ("y1", "y0", 9.0)]
    df = spark.createDataFrame(edges, "a string, b string, weight double").repartition(4)
    found = []
    for sources, nodes, few in ((256, 2048, 0), (1, 2048, 0), (2, 7, 5), (2, 0, 0)):
        monkeypatch.setattr(G, "SOURCES", sources)
        monkeypatch.setattr(G, "WITHIN_NODES", nodes)
        if few:
            monkeypatch.setattr(skew, "BROADCAST_ROWS", few)
        found.append(sorted((str(x["a"]), x["b"], x["weight"]) for x in G.pathfinder(df, "weight", r, lmax=lmax).collect()))
    assert found[0] == found[1] == found[2] == found[3] and 5 < len(found[0]) < len(edges)


def test_contracted_links_connect_the_same_nodes(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(4)
    few = components.contracted(df, "u", "v")
    want = {(x["node"], x["component"]) for x in components.connected_components(df, "u", "v").collect()}
    assert {(x["node"], x["component"]) for x in components.connected_components(few, "a", "b").collect()} == want
    assert components.contracted(df.coalesce(1), "u", "v").count() == len(want) - len({c for _, c in want})
