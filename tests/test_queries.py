"""Every registered query: against its SQL, or against a plain computation of the same."""

import collections
import itertools
import math
import re

import numpy as np
import pytest
from compare import both
from pyspark.sql import functions as F

from weft.functions.texts import tokens
from weft.operators import graph as G
from weft.operators import topics as TP
from weft.plans import analysis_queries as Q
from weft.plans import catalog

SMALL = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def rows(spark, name):
    return [r.asDict() for r in catalog.QUERIES[name](spark, SMALL).collect()]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, name):
    mine, theirs = both(spark, catalog.QUERIES[name], catalog.ORACLES[name], SMALL)
    assert mine == theirs


def network(spark, k=None):
    edges = Q.supplier_edges(spark, SMALL)
    return [(r["a"], r["b"], r["count"]) for r in (edges if k is None else G.max_links(edges, k, "count")).collect()]


def paths(edges):
    """Betweenness by the shortest paths from every node, an edge being as long as one over its weight."""
    near = collections.defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[b][a] = 1 / w
    total = dict.fromkeys(near, 0.0)
    for s in near:
        far, left, order = {s: 0.0}, set(near), []
        while left and (x := min((far.get(v, math.inf), v) for v in left))[0] < math.inf:
            left.remove(x[1])
            order.append(x[1])
            for y, length in near[x[1]].items():
                far[y] = min(far.get(y, math.inf), x[0] + length)
        ways, share = collections.Counter({s: 1}), collections.Counter()
        before = {y: [x for x in near[y] if x in far and abs(far[x] + near[x][y] - far[y]) <= 1e-9 * far[y]] for y in order if y != s}
        for y in order[1:]:
            ways[y] = sum(ways[x] for x in before[y])
        for y in reversed(order[1:]):
            for x in before[y]:
                share[x] += ways[x] / ways[y] * (1 + share[y])
            total[y] += share[y]
    n = len(near)
    return {k: v / max(1, (n - 1) * (n - 2)) for k, v in total.items()}


def best_states(r, d, gamma, ratio):
    """The cheapest sequence of two states by trying all of few periods, else by dynamic programming over costs."""
    base = sum(r) / sum(d)
    rate = [min(max(p, 1e-12), 1 - 1e-9) for p in (base, base * ratio)]
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    cost = [[-(choose(n, k) + k * math.log(p) + (n - k) * math.log(1 - p)) for p in rate] for k, n in zip(r, d, strict=True)]
    enter = gamma * math.log(max(2, len(r)))
    table = [(cost[0][0], [0]), (cost[0][1] + enter, [1])]
    for c in cost[1:]:
        table = [min(((v + (enter if s and not p[-1] else 0.0) + c[s], [*p, s]) for v, p in table), key=lambda x: x[0]) for s in (0, 1)]
    return min(table, key=lambda x: x[0])[1], cost


def test_samples(spark):
    source = {"sample_rows": "orders", "sample_fraction": "lineitem"}
    for name in source:
        df = catalog.QUERIES[name](spark, SMALL)
        first, again = sorted(map(str, df.collect())), sorted(map(str, catalog.QUERIES[name](spark, SMALL).collect()))
        assert first == again and 0 < len(first) < table(spark, source[name]).count()
        assert df.exceptAll(table(spark, source[name]).select(*df.columns)).isEmpty()


def test_anomaly(spark):
    got = rows(spark, "anomaly")
    scores = [r["anomaly_score"] for r in got]
    assert len(got) == 6000 and 0 < min(scores) and max(scores) < 1
    flagged = [r["anomaly_score"] for r in got if r["is_anomaly"]]
    assert 0.04 < len(flagged) / len(got) <= 0.055 and min(flagged) > max(r["anomaly_score"] for r in got if not r["is_anomaly"])


def test_betweenness_and_sigma(spark):
    want = paths(network(spark, 5))
    got = {r["node"]: r["betweenness"] for r in rows(spark, "betweenness")}
    assert got == pytest.approx(want)
    suppliers = table(spark, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("s"), F.year("l_shipdate").alias("y"))
    heaviest = {r["node"]: r["w"] for r in G.bursts(suppliers, "s", "y", gamma=0.2, ratio=1.2).groupBy("node").agg(F.max("weight").alias("w")).collect()}
    assert {r["node"]: r["sigma"] for r in rows(spark, "sigma")} == pytest.approx({k: (v + 1) ** heaviest.get(k, 0.0) for k, v in want.items()})


def test_bursts(spark):
    counts = collections.Counter()
    for r in table(spark, "events").select("user_id", F.datediff("ts", F.lit("2024-01-01")).alias("day")).collect():
        counts[r["user_id"], r["day"]] += 1
    days = range(min(d for _, d in counts), max(d for _, d in counts) + 1)
    every = [sum(n for (u, d), n in counts.items() if d == day and u is not None) for day in days]
    want = set()
    for user in {u for u, _ in counts if u is not None}:
        path, cost = best_states([counts[user, d] for d in days], every, 0.3, 1.5)
        for state, part in itertools.groupby(range(len(path)), key=path.__getitem__):
            part = list(part)
            if state:
                want.add((user, days[part[0]], days[part[-1]], round(sum(cost[i][0] - cost[i][1] for i in part), 6)))
    assert {(r["node"], r["start"], r["end"], round(r["weight"], 6)) for r in rows(spark, "bursts")} == want


def test_pathfinder(spark):
    edges = network(spark)
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    far = {(x, y): math.inf for x in names for y in names}
    for a, b, w in edges:
        far[a, b] = far[b, a] = 1 / w
    for k in names:
        for x in names:
            for y in names:
                far[x, y] = min(far[x, y], max(far[x, k], far[k, y]))
    assert {(r["a"], r["b"]) for r in rows(spark, "pathfinder")} == {(a, b) for a, b, w in edges if 1 / w <= far[a, b] * (1 + 1e-12)}


def test_spectral_clusters(spark):
    got = {r["node"]: r["cluster"] for r in rows(spark, "spectral_clusters")}
    edges = network(spark, 8)
    assert set(got) == {x for a, b, _ in edges for x in (a, b)} and set(got.values()) == set(range(4))

    def cut(of):  # normalised cut: what leaves each cluster over what its nodes have
        leaves, has = collections.Counter(), collections.Counter()
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                has[of[x]] += w
                leaves[of[x]] += w * (of[x] != of[y])
        return sum(leaves[c] / has[c] for c in has)

    rng = np.random.default_rng(0)
    others = [dict(zip(got, rng.permutation(list(got.values())), strict=True)) for _ in range(200)]
    assert cut(got) <= np.quantile([cut(o) for o in others], 0.5)


def test_text_rank(spark):
    weights = collections.Counter()
    for r in table(spark, "documents").select(tokens(F.col("text")).alias("w")).collect():
        w = r["w"] or []
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 5)):
                if w[i] != w[j]:
                    weights[min(w[i], w[j]), max(w[i], w[j])] += 1
    names = sorted({x for pair in weights for x in pair})
    at, m = {x: i for i, x in enumerate(names)}, np.zeros((len(names), len(names)))
    for (a, b), n in weights.items():
        m[at[a], at[b]] = m[at[b], at[a]] = n
    m /= m.sum(axis=1, keepdims=True)
    p = np.full(len(names), 1 / len(names))
    for _ in range(10):
        p = 0.15 / len(names) + 0.85 * (p @ m)
    best = sorted(range(len(names)), key=lambda i: (-p[i], names[i]))[:10]
    got = rows(spark, "text_rank")
    assert [r["score"] for r in got] == pytest.approx([p[i] for i in best]) and {r["word"] for r in got[:5]} == {names[i] for i in best[:5]}


def test_stages_cover_the_days(spark):
    got = sorted(rows(spark, "suggest_stages"), key=lambda r: r["stage"])
    by_day = collections.Counter(str(r["d"]) for r in table(spark, "events").select(F.to_date("ts").alias("d")).collect())
    for r in got:
        inside = {d: n for d, n in by_day.items() if r["start"] <= d <= r["end"]}
        assert r["rows"] == sum(inside.values()) and r["days"] >= 3 and r["peak_count"] == max(inside.values()) == by_day[r["peak_day"]]
    assert sum(r["rows"] for r in got) == sum(by_day.values())
    ends = [(np.datetime64(a["end"]) + 1, np.datetime64(b["start"])) for a, b in itertools.pairwise(got)]
    assert all(a == b for a, b in ends)


def test_topic_timeline(spark):
    sets = collections.defaultdict(set)
    for r in Q.stage_words(spark, SMALL).collect():
        sets[r["stage"], r["topic"]].add(r["keyword"])
    got = {(r["stage"], r["topic"]): (r["family"], r["similarity"], r["is_secondary"]) for r in rows(spark, "topic_timeline")}
    assert set(got) == set(sets)
    for (stage, topic), (family, similarity, _) in got.items():
        before = {t: w for (s, t), w in sets.items() if s == stage - 1}
        alike = {t: len(w & sets[stage, topic]) / len(w | sets[stage, topic]) for t, w in before.items()}
        if alike and max(alike.values()) >= 0.2:
            assert similarity == pytest.approx(max(alike.values())) and family in {got[stage - 1, t][0] for t, v in alike.items() if v == max(alike.values())}
        else:
            assert similarity == 0.0
    for stage in {s for s, _ in got}:
        families = [f for (s, _), (f, _, second) in got.items() if s == stage and not second]
        assert len(families) == len(set(families))


def test_topics(spark):
    for name, per in (("topic_model", 10), ("topic_by_stage", 8)):
        groups = collections.defaultdict(list)
        for r in rows(spark, name):
            groups[r.get("stage"), r["topic"]].append((r["rank"], r["weight"], r["keyword"]))
        assert len(groups) == (4 if name == "topic_model" else 2 * len({s for s, _ in groups}))
        for words in groups.values():
            words.sort()
            weights = [w for _, w, _ in words]
            assert [k for k, _, _ in words] == list(range(1, per + 1)) and weights == sorted(weights, reverse=True) and sum(weights) <= 1 + 1e-9
    points = rows(spark, "topic_map")
    assert len(points) == 4 and sum(r["prevalence"] for r in points) == pytest.approx(100, abs=1)  # texts without known words have no topic
    assert [sum(r[c] for r in points) for c in "xy"] == pytest.approx([0, 0], abs=1e-6)
    found = rows(spark, "topic_coherence")
    assert sorted(r["k"] for r in found) == [2, 4] and all(r["perplexity"] > 1 and -1 <= r["coherence"] <= 1 for r in found)


def test_coherence_against_brute_force(spark):
    docs = [set(r["w"] or []) for r in table(spark, "documents").select(tokens(F.col("text")).alias("w")).collect()]
    common = [w for w, _ in sorted(collections.Counter(w for d in docs for w in d).items(), key=lambda x: (-x[1], x[0]))[:6]]
    n = sum(bool(d) for d in docs)
    values = []
    for a, b in itertools.combinations(common, 2):
        c, fa, fb = sum(a in d and b in d for d in docs) / n, sum(a in d for d in docs) / n, sum(b in d for d in docs) / n
        values.append(-1.0 if not c else 1.0 if c == 1 else math.log(c / fa / fb) / -math.log(c))
    keywords = spark.createDataFrame([(1, w) for w in common], "topic int, keyword string")
    assert TP.npmi(table(spark, "documents"), "doc_id", "text", keywords).first()["coherence"] == pytest.approx(np.mean(values))


def test_learned_labels_and_clusters(spark):
    known = {r["doc_id"]: r["lang"] for r in table(spark, "documents").collect()}
    got = {r["doc_id"]: r["label"] for r in rows(spark, "text_classifier")}
    assert set(got) == set(known) and sum(got[k] == v for k, v in known.items() if v) / sum(v is not None for v in known.values()) > 0.9
    clusters = rows(spark, "cluster_texts")
    assert {r["doc_id"] for r in clusters} == set(known) and {r["cluster"] for r in clusters} <= set(range(4)) and all(-1 <= r["silhouette"] <= 1 for r in clusters)
    top = collections.Counter((r["cluster"], known[r["doc_id"]]) for r in clusters)
    by = collections.Counter(r["cluster"] for r in clusters)
    assert sum(max(n for (c, _), n in top.items() if c == k) for k in by) / len(clusters) > 0.5  # clusters follow the languages


TESTED = {"sample_rows", "sample_fraction", "anomaly", "betweenness", "sigma", "bursts", "pathfinder", "spectral_clusters", "text_rank", "suggest_stages", "topic_timeline", "topic_model", "topic_by_stage", "topic_map", "topic_coherence", "text_classifier", "cluster_texts"}


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLES) | TESTED
