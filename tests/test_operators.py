"""Literal frames: semantics that the tables do not show, and named refusals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.errors import OpError
from weft.functions import scalars as S
from weft.functions import special
from weft.functions.texts import normalized, washed, words
from weft.operators import aggregates as A
from weft.operators import columns as C
from weft.operators import dedupe as D
from weft.operators import entities as EN
from weft.operators import graph as G
from weft.operators import joins as J
from weft.operators import links as L
from weft.operators import stats as ST
from weft.operators import text as T
from weft.operators import timeseries as TS
from weft.operators import topics as TP
from weft.operators import skew
from weft.operators.components import connected_components


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()), key=repr)


def test_filters_tell_their_comparisons_apart(spark):
    df = spark.createDataFrame([(1, "a.b"), (2, "a(b"), (3, ""), (4, None)], "n int, t string")
    assert values(C.filter_rows(df, "t", "contains", r"a\."), "n") == [1]
    assert values(C.filter_rows(df, "t", "not_contains", "a"), "n") == [3, 4]
    assert values(C.filter_rows(df, "t", "ne", "a.b"), "n") == [2, 3, 4]
    assert values(C.filter_rows(df, "t", "is_null"), "n") == [3, 4]
    assert values(C.filter_rows(df, "n", "eq", "2.0"), "n") == [2]
    assert values(C.filter_rows(df, "n", "not_in", "1, 2.0"), "n") == [3, 4]
    for bad in (("t", "contains", "("), ("n", "gt", "x"), ("q", "eq", 1), ("n", "like", 1)):
        with pytest.raises(OpError):
            C.filter_rows(df, *bad)


def test_fill_drop_and_convert(spark):
    df = spark.createDataFrame([(1, "", None), (2, "x", 1.5), (3, None, 2.0)], "n int, t string, v double")
    assert values(C.fill_null(df, ["t"], "z"), "n", "t") == [(1, "z"), (2, "x"), (3, "z")]
    assert values(C.fill_null(df, ["t"], method="ffill", order_by=["n"]), "n", "t") == [(1, None), (2, "x"), (3, "x")]
    assert C.fill_null(df, ["t"]) is df
    assert values(C.drop_null(df, ["t", "v"], "all"), "n") == [2, 3]
    assert values(C.convert_type(df.where("n <> 2"), "v", "int"), "n", "v") == [(1, None), (3, 2)]
    with pytest.raises(Exception, match="not a whole number"):
        C.convert_type(df, "v", "int").collect()
    words = spark.createDataFrame([("No",), ("false",), ("yes",), (None,), ("否",)], "w string")
    assert [r[0] for r in C.convert_type(words, "w", "bool").collect()] == [False, False, True, False, False]


def test_column_calc_follows_float_arithmetic(spark):
    df = spark.createDataFrame([(7.0, 0.0), (-7.0, 2.0)], "`a b` double, c double")
    got = [r["x"] for r in C.column_calc(df, "x", "`a b` / c").collect()]
    assert math.isinf(got[0]) and got[1] == -3.5
    assert [r["x"] for r in C.column_calc(df.where("c > 0"), "x", "`a b` // c + `a b` % c").collect()] == [-4 + 1]
    for bad in ("__import__('os')", "c + ", "c ** 99", "nope + 1"):
        with pytest.raises(OpError):
            C.column_calc(df, "x", bad)


def test_moments_in_several_spellings(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024年1月5日 08:09",), ("2024/1/5 8:9:10",), ("x",), (None,)], "d string")
    got = [r[0] for r in df.select(F.date_format(S.moment(F.col("d"), df.schema["d"].dataType), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-01-05 00:00:00", "2024-01-05 08:09:00", "2024-01-05 08:09:10", None, None]


def test_scalars(spark):
    df = spark.createDataFrame([("1.2万", "https://WWW.Example.com:443/a/?utm_source=x&b=2&a=1#t")], "n string, u string")
    r = df.select(S.counted(F.col("n")).alias("n"), S.url_key(F.col("u")).alias("u"), S.parts_of(F.lit("a； b,c、")).alias("p"), S.divergence(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("b"), F.lit(1.0))).alias("d")).first()
    assert tuple(r) == (12000, "example.com/a?a=1&b=2", ["a", "b", "c"], 1.0)


def test_normalised_reposts_are_one_text(spark):
    texts = ["so good! https://t.cn/x", "@someone so good!", "so good! [smile]", "so  good!//@a:quoted//@b: more", "回复@a://@b:so good!", "//@a:first//@b:so good!", "https://t.cn/y", "@a", "[微笑][微笑]", "ＡＢＣ，哈哈哈哈", "[免费]#美食#", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", normalized(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(6)] == ["so good!"] * 6
    assert [got[i] for i in range(6, 12)] == ["", "", "", "ABC,哈哈", "[免费]美食", None]
    assert values(D.drop_duplicates(df, ["t"], "first", "i", "normalized"), "i") == [0, 10, 11, 6, 7, 8, 9]
    assert values(D.drop_duplicates(df, ["t"], "last", "i", "normalized"), "i") == [10, 11, 5, 6, 7, 8, 9]
    assert values(D.drop_duplicates(df, ["t"], False, None, "normalized"), "i") == [10, 11, 6, 7, 8, 9]


def test_washed_texts(spark):
    want = {
        "我也觉得//@张三:说得对//@李四:太离谱了": "我也觉得",
        "//@张三:说得对": None,
        "看这个 https://t.cn/A6xyz O网页链接 真的绝了 展开c": "看这个 真的绝了",
        "正文内容收起d": "正文内容",
        "正文内容 展开 更多": "正文内容 更多",
        "请展开说说你的想法": "请展开说说你的想法",
        "[泪][泪][泪]": None,
        "。。。！！！": None,
        "哈哈哈哈哈哈哈哈": "哈哈",
        "好\u200b的\u200b吧": "好的吧",
        "@小明 你觉得呢 #三亚旅游# 太美了": "你觉得呢 三亚旅游 太美了",
        "加微信: abcd1234 领取": "加 领取",
        "回复@小红: 好": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: r["w"] for r in df.select("t", washed(F.col("t")).alias("w")).collect()} == want


def test_aggression_families(spark):
    texts = ["今天路很堵", "分配不均", "你算什么东西，废物", "3号楼", "listen to a@b.example now", "", None]
    got = [tuple(r) for r in T.aggression(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").select("aggression", "aggression_score", "aggression_hits").collect()]
    assert got == [("none", 0.0, ""), ("none", 0.0, ""), ("severe", 0.6, "abuse:废物；attack:你算什么"), ("severe", 0.6, "privacy:3号楼"), ("severe", 0.6, "privacy:a@b.example"), ("none", 0.0, ""), ("none", 0.0, "")]


def test_words_of_mixed_writing(spark):
    row = spark.range(1).select(words(F.lit("我Love北京 2024年x")).alias("a"), words(F.lit("研究生命起源"), ("研究生", "生命", "起源", "研究")).alias("b"), words(F.lit("字 A")).alias("c")).first()
    assert row["a"] == ["我", "love", "北京", "2024", "年", "x"] and row["b"] == ["研究生", "命", "起源"] and row["c"] == ["字", "a"]


def test_join_null_keys_and_names(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, v string")
    got = J.join_tables(a, b, "outer", "k", "k")
    assert got.columns == ["k", "v_x", "v_y"]
    assert values(got, "k", "v_x", "v_y") == sorted([(1, "x", "p"), (None, "y", "q"), (3, None, "r")], key=repr)
    assert values(J.anti_join(a, b, "k"), "v") == ["y"]  # blank keys match nothing
    with pytest.raises(OpError):
        J.join_tables(a, b, "asof", "k", "k")


def test_reply_graph(spark):
    rows = [("ann", "p", "1", None), ("bob", "p", "2", "1"), ("bob", "p", "3", "1"), ("ann", "p", "4", "1"), ("cid", "p", "5", "9")]
    df = spark.createDataFrame(rows, "author string, article string, floor string, parent string")
    assert [tuple(r) for r in J.reply_graph(df, "author", "article", "floor", "parent").collect()] == [("bob", "ann", 2)]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in list(up)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_table_joins_deal_out_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 0), (3, 1), (None, 2), (1, 0)], "k long, v long")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k long, t string")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plain = sorted(map(tuple, skew.join_table(rows, table, "k", sizes, 3, 504).collect()))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    dealt = skew.join_table(rows, table, "k", sizes, 3, 504)
    assert sorted(map(tuple, dealt.collect())) == plain and len(plain) == 502 and dealt.columns == ["k", "v", "t"]
    assert got_components(spark, [(1, i) for i in range(2, 300)] + [(300, 301), (302, 301)]) == {**dict.fromkeys(range(1, 300), 1), 300: 300, 301: 300, 302: 300}


def got_components(spark, edges):
    return dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())


@pytest.mark.parametrize(("most", "list_rows"), [(3, 2048), (8, 2048), (8, 3)])
def test_near_fingerprints_against_brute_force(spark, most, list_rows):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 20)
    prints = sorted({int(b) for b in base} | {int(b) ^ sum(1 << int(i) for i in set(bits)) for b in base for bits in rng.integers(0, 62, (6, most)).tolist()})
    near = [(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= most]
    df = spark.createDataFrame([(p, p, p) for p in prints], "fp long, low long, high long")
    keyed = D.band_keys(df, most)
    got = [tuple(r) for r in L.links_by_key(keyed, L.bits_within(most), list_rows).collect()]
    assert set(got) and dict(zip(*map(list, L.forest(*map(np.array, zip(*got, strict=True)))), strict=True)) == dict(zip(*map(list, L.forest(*map(np.array, zip(*near, strict=True)))), strict=True))
    ends = L.extremes_by_key(keyed, L.bits_within(most), list_rows).groupBy("fp").agg(F.min("low"), F.max("high")).collect()
    around = {p: [q for pair in near for q in pair if p in pair] for p in prints}
    assert {tuple(r) for r in ends} == {(p, min(q), max(q)) for p, q in around.items() if q}


def test_semantic_dedupe_is_greedy(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    x = np.concatenate([base, base + rng.standard_normal((12, 16)) * 0.2, base[:3]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, [0.0] * 16), (91, None)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    stays = []
    for i in range(len(u)):
        if not any(u[i] @ u[j] >= 0.92 for j in stays):
            stays.append(i)
    got = D.semantic_dedupe(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    assert values(got, "id") == sorted([*stays, 90, 91], key=repr)


def test_special_functions():
    assert abs(special.t_two_sided(2.0, 10) - 0.07338803477074) < 1e-10
    assert abs(special.f_tail(3.0, 2, 20) - 1.3**-10) < 1e-12
    assert abs(special.chi2_tail(5.991464547107979, 2) - 0.05) < 1e-10
    assert abs(special.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
    d = np.array([[0, 3, 4], [3, 0, 5], [4, 5, 0]], float)
    p = special.classical_mds(d)
    assert np.allclose([[np.linalg.norm(a - b) for b in p] for a in p], d)


def test_significance_refuses_and_answers(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 6.0), ("b", 8.0)], "g string, v double")
    r = ST.significance(df, "g", "v").first()
    v, t = r["df"], abs(r["statistic"])
    x = np.linspace(-t, t, 200_001)
    density = math.gamma((v + 1) / 2) / math.sqrt(v * math.pi) / math.gamma(v / 2) * (1 + x * x / v) ** (-(v + 1) / 2)
    assert abs(t - 3.0983866769659336) < 1e-9 and abs(r["p_value"] - (1 - np.trapezoid(density, x))) < 1e-8
    with pytest.raises(OpError):
        ST.significance(df.where("g = 'a'"), "g", "v")


def test_anomaly_samples_copies_as_often_as_they_occur(spark, monkeypatch):
    monkeypatch.setattr(ST, "FOREST_ROWS", 300)
    monkeypatch.setattr(ST, "COPIES", 64)
    df = spark.range(3000).select("id", *[F.when(F.col("id") % 3 == 0, v).otherwise(F.pmod(F.xxhash64("id", F.lit(v)), F.lit(1000)) / 10).alias(c) for c, v in (("a", 400.0), ("b", 500.0))])
    for seed in (1, 2, 3):
        found = ST.anomaly(df, ["a", "b"], 0.05, seed)
        scores = {r["common"]: r["s"] for r in found.groupBy((F.col("a") == 400).alias("common")).agg(F.avg("anomaly_score").alias("s")).collect()}
        assert scores[True] < 0.6 and found.where("is_anomaly and a = 400").count() == 0 and found.where("is_anomaly").count() > 0, scores


def test_anomaly_finds_the_outlier(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.standard_normal((200, 2)))] + [(999, 30.0, -30.0)]
    df = ST.anomaly(spark.createDataFrame(rows, "i int, a double, b double"), ["a", "b"], 0.02)
    assert df.orderBy(F.desc("anomaly_score")).first()["i"] == 999


def test_forecasts(spark):
    flat = spark.createDataFrame([(f"2024-01-{i:02d}", float(i)) for i in range(1, 11)], "d string, v double")
    last = TS.forecast(flat, "d", "v", "holt", 2, alpha=1.0, beta=1.0).orderBy("period").collect()[-1]
    assert (last["period"], last["predicted"], last["horizon"]) == ("2024-01-12", 12.0, 2)
    season = spark.createDataFrame([(f"2024-01-{i:02d}", float(i % 3)) for i in range(1, 13)], "d string, v double")
    hw = TS.forecast(season, "d", "v", "holt_winters", 3, season_len=3).where("horizon > 0").orderBy("horizon").collect()
    assert [round(r["predicted"], 2) for r in hw] == [1.0, 2.0, 0.0]
    with pytest.raises(Exception, match="two rows of one period"):
        TS.forecast(flat.unionByName(flat), "d", "v").collect()
    with pytest.raises(OpError):
        TS.forecast(flat, "d", "v", "prophet")


def test_stages_part_at_the_valley():
    n = np.array([1, 1, 9, 9, 2, 1, 1, 2, 8, 9, 1, 1])
    assert TS.stage_starts(n, 2, 6, 2.0) == [(0, None), (6, 5)]
    assert TS.stage_starts(n, 7, 6, 2.0) == [(0, None)]


def test_alert_without_signal_has_one_row(spark):
    df = spark.createDataFrame([(f"2024-01-0{i}", 0.1) for i in range(1, 6)], "p string, i double")
    assert [r["signal"] for r in TS.alert(df, "p", "i").collect()] == ["none"]


def test_entities_by_plain_patterns(spark):
    """The families written as the patterns that they stand for."""
    import random
    import re

    han = r"[\u4e00-\u9fa5]"
    plain = [
        ("PERSON", re.compile(f"(?:{han}{{2,4}}|[{EN.SURNAMES}])(?:{'|'.join(EN.HONORIFICS)})"), 0),
        ("ORG", re.compile(f"{han}{{2,}}(?:{'|'.join(EN.ORG_ENDS)})"), 0),
        ("LOC", re.compile(f"(?:{'|'.join(EN.LOC_CUES)})({han}{{2,}}(?:{'|'.join(EN.LOC_ENDS)}))"), 1),
        ("DATE", re.compile(r"\d{4}年\d{1,2}月\d{1,2}日|\d{4}年\d{1,2}月|\d{1,2}月\d{1,2}日"), 0),
    ]
    rng = random.Random(2)
    parts = [*EN.HONORIFICS, *EN.ORG_ENDS, *EN.LOC_CUES, *EN.LOC_ENDS, *"王李的了天地", " ", "x", "2024年5月", "12月3日", "，"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(400)] + [None, "", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("text", F.lit(1)).repartition(3)
    want = {(i, m[g], k, m.start(g), m.end(g)) for i, t in enumerate(texts) for k, p, g in plain for m in p.finditer(t or "")}
    assert {tuple(r) for r in EN.entities(df, "i", "t").collect()} == want and len({w[2] for w in want}) == 4
    assert {tuple(r) for r in EN.entities(df, "i", "t", ["LOC"]).collect()} == {w for w in want if w[2] == "LOC"}
    long = spark.createDataFrame([(1, "在" + "天" * 300_000 + "湖" + "地" * 300_000)], "i int, t string")
    assert [r[2:] for r in EN.entities(long, "i", "t").collect()] == [("LOC", 1, 300_002)]
    with pytest.raises(OpError):
        EN.entities(df, "i", "t", ["ANIMAL"])


def test_gazetteer_by_plain_search(spark):
    import random

    rng = random.Random(3)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.choice("XY") for _ in range(9)}
    texts = ["".join(rng.choice("abcd ") for _ in range(40)) for _ in range(60)]
    want = set()
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            hit = max((w for w in terms if t.startswith(w, at)), key=len, default=None)
            if hit:
                want.add((i, hit, terms[hit], at, at + len(hit)))
            at += len(hit) if hit else 1
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    gazetteer = spark.createDataFrame([*terms.items(), ("", "X"), (None, "X"), ("q", None)], "term string, label string")
    assert {tuple(r) for r in EN.entities(df, "i", "t", gazetteer=gazetteer).collect()} == want and len(want) > 100


def network(spark):
    edges = [("a", "b", 5.0), ("b", "c", 4.0), ("a", "c", 1.0), ("c", "d", 3.0), ("x", "y", 2.0)]
    return spark.createDataFrame(edges, "a string, b string, weight double")


def test_networks(spark):
    e = network(spark)
    assert values(G.spanning_forest(e), "a", "b") == [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")]
    assert values(G.pathfinder(e), "a", "b") == [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")]
    assert values(G.largest_component(e).select("a", "b"), "a", "b") == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")]
    assert abs(G.page_rank(e, rounds=30).agg(F.sum("pagerank")).first()[0] - 1) < 1e-6
    between = dict(tuple(r) for r in G.betweenness(e.where("a <> 'x'")).collect())
    assert between == {"a": 0.0, "b": pytest.approx(2 * 2 / 6), "c": pytest.approx(2 * 2 / 6), "d": 0.0}  # from a to c by b
    top = G.eigenvector(e.where("a <> 'x'")).orderBy(F.desc("eigenvector")).first()["node"]
    assert top == "b"
    assert dict(tuple(r) for r in G.spectral_clusters(e, 2).collect())["x"] != dict(tuple(r) for r in G.spectral_clusters(e, 2).collect())["a"]


def test_bursts(spark):
    rows = [("n", t) for t in range(10) for _ in range(12 if t in (4, 5) else 1)] + [("m", t) for t in range(10) for _ in range(30)]
    got = [tuple(r)[:3] for r in G.bursts(spark.createDataFrame(rows, "n string, t int"), "n", "t").collect()]
    assert got == [("n", 4, 5)]


def test_topic_timeline_links_families(spark):
    rows = [(1, 1, w) for w in "abc"] + [(2, 1, w) for w in "xyz"] + [(2, 2, w) for w in "abd"]
    got = {(r["stage"], r["topic"]): r["family"] for r in TP.topic_timeline(spark.createDataFrame(rows, "stage int, topic int, keyword string")).collect()}
    assert got[1, 1] == got[2, 2] != got[2, 1]


def test_kappa_of_full_agreement(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a")], "x string, y string")
    assert A.kappa(df, "x", "y").first()["kappa"] == 1.0


def test_kendall_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(float(x), float(x + y)) for x, y in rng.integers(0, 12, (150, 2))] + [(1.0, None)]
    pairs = [r for r in rows if r[1] is not None]
    sign = lambda v: (v > 0) - (v < 0)
    s = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for i, a in enumerate(pairs) for b in pairs[:i])
    tx, ty = (sum(a[k] != b[k] for i, a in enumerate(pairs) for b in pairs[:i]) for k in (0, 1))
    got = ST.correlation(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], "kendall").first()["correlation"]
    assert got == pytest.approx(s / math.sqrt(tx * ty))


def test_message_dates_by_the_mail_parser(spark):
    import random
    from datetime import datetime, timedelta, timezone
    from email.utils import parsedate_to_datetime

    rng = random.Random(5)
    texts = ["Thu, 01 May 2025 10:20:30 +0800", "1 May 25 9:05 EST", "Fri, 31 Dec 1999 23:59:59 -0330", "30 Jun 2024 00:00:00 Z", "mon, 7 jan 2019 07:08:09 gmt"]
    for _ in range(100):
        at = datetime(rng.randint(1971, 2040), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59), tzinfo=timezone(timedelta(minutes=rng.choice([0, 330, -480, 525, 60]))))
        texts.append(at.strftime("%a, %d %b %Y %H:%M:%S %z"))
    want = [parsedate_to_datetime(t).astimezone(timezone.utc).replace(tzinfo=None) for t in texts]
    odd = [None, "", "yesterday", "Thu, 31 Feb 2025 10:00:00 GMT", "1 Foo 2020 10:00", "1 May 2020 25:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *odd])], "i int, t string")
    got = [r[0] for r in df.select("i", S.message_date(F.col("t")).alias("m")).orderBy("i").select("m").collect()]
    assert got == [*want, *[None] * len(odd)]


def test_sample_against_its_hash(spark):
    import xxhash
    from weft.operators import order as O

    rows = [(1, "a"), (1, "a"), (1, "a"), (2, None), (3, "ü"), *((i, f"v{i % 7}") for i in range(10, 200))]
    df = spark.createDataFrame(rows, "k long, v string").repartition(3)

    def key(row, copy, seed=5):
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little", signed=True), 42)
        for x in row:
            h = h if x is None else xxhash.xxh64_intdigest(str(x).encode(), h)
        return xxhash.xxh64_intdigest(copy.to_bytes(8, "little"), h)

    seen, keyed = {}, []
    for r in rows:
        seen[r] = seen.get(r, 0) + 1
        keyed.append((key(r, seen[r]), r))
    signed = sorted(((h - (1 << 64) if h >> 63 else h), r) for h, r in keyed)
    text = lambda found: sorted(map(repr, found))
    for n in (0, 1, 40, 1000):
        assert text(tuple(r) for r in O.sample_rows(df, n, seed=5).collect()) == text(r for _, r in signed[:n])
    for frac in (0.0, 0.3, 1.0):
        assert text(tuple(r) for r in O.sample_rows(df, frac=frac, seed=5).collect()) == text(r for h, r in keyed if (h >> 11) / (1 << 53) < frac)


def test_planted_outliers_rank_first(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 3))
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(10_000 + i, *(float(s) * 9 for s in sign)) for i, sign in enumerate([(1, 1, 1), (-1, 1, -1), (1, -1, 1), (-1, -1, -1)])]
    rows += [(20_000 + i, 0.0, 0.0, 0.0) for i in range(300)]  # copies of the middle
    got = ST.anomaly(spark.createDataFrame(rows, "i long, a double, b double, c double"), ["a", "b", "c"], 0.05).collect()
    top = sorted(got, key=lambda r: -r["anomaly_score"])
    assert {r["i"] for r in top[:8]} >= {10_000, 10_001, 10_002, 10_003} and all(r["is_anomaly"] for r in top[:8])
    copies = {r["anomaly_score"] for r in got if r["i"] >= 20_000}
    assert len(copies) == 1 and not any(r["is_anomaly"] for r in got if r["i"] >= 20_000)
    far = np.argsort(-np.linalg.norm(x, axis=1))
    score = {r["i"]: r["anomaly_score"] for r in got}
    assert np.mean([score[i] for i in far[:100]]) > np.mean([score[i] for i in far[-100:]]) + 0.1
