"""Queries of two-table steps, order and duplicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import dedupe as D
from weft.operators import joins as J
from weft.operators import order as O
from weft.runtime import load

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


for _how in ("inner", "left", "right", "outer"):
    QUERIES[f"join_{_how}"] = lambda spark, d, how=_how: J.join_tables(load(spark, d, "customer").select("c_name", F.nullif("c_custkey", F.lit(1)).alias("k")), load(spark, d, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(1)).alias("k")), how, "k", "k")
    ORACLES[f"join_{_how}"] = f"WITH a AS (SELECT c_name, nullif(c_custkey, 1) AS k FROM customer), b AS (SELECT o_orderkey, nullif(o_custkey, 1) AS k FROM orders) SELECT c_name, coalesce(a.k, b.k) AS k, o_orderkey FROM a {'FULL OUTER' if _how == 'outer' else _how.upper()} JOIN b ON a.k IS NOT DISTINCT FROM b.k"


@query("join_cross", "SELECT r_regionkey, r_name, n_nationkey, n_name, n_regionkey FROM region CROSS JOIN nation")
def _(spark, d):
    return J.join_tables(load(spark, d, "region"), load(spark, d, "nation"), "cross")


@query("join_suffixes", "SELECT a.n_nationkey AS n_nationkey_x, a.n_name AS n_name_x, a.n_regionkey AS n_regionkey_x, b.n_nationkey AS n_nationkey_y, b.n_name AS n_name_y, b.n_regionkey AS n_regionkey_y FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey")
def _(spark, d):
    return J.join_tables(load(spark, d, "nation"), load(spark, d, "nation"), "inner", "n_nationkey", "n_regionkey")


@query("anti_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    return J.anti_join(load(spark, d, "orders"), load(spark, d, "supplier"), "o_custkey", "s_suppkey").select("o_orderkey", "o_custkey")


@query("semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    return J.anti_join(load(spark, d, "orders"), load(spark, d, "supplier"), "o_custkey", "s_suppkey", keep="keep").select("o_orderkey", "o_custkey")


@query("anti_join_composite", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey)")
def _(spark, d):
    li = load(spark, d, "lineitem")
    return J.anti_join(li, li.where("l_returnflag = 'R'"), "l_partkey, l_suppkey").select("l_orderkey", "l_linenumber")


@query("anti_join_trim", "SELECT c_custkey FROM customer WHERE c_custkey * 3 NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    orders = load(spark, d, "orders").select(F.concat(F.lit("  c"), F.col("o_custkey").cast("string"), F.lit("\u3000")).alias("k"))
    customers = load(spark, d, "customer").withColumn("k", F.concat(F.lit("C"), (F.col("c_custkey") * 3).cast("string")))
    return J.anti_join(customers, orders, "k", "k", mode="trim", ignore_case=True).select("c_custkey")


@query("semi_join_url", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def _(spark, d):
    docs = load(spark, d, "documents").withColumn("u", F.concat(F.lit("http://www.s.example:80/a/"), F.col("doc_id").cast("string")))
    other = load(spark, d, "benchmark").select(F.concat(F.lit("HTTPS://S.example/a/"), F.col("item_id").cast("string"), F.lit("/?utm_source=x#top")).alias("u"))
    return J.anti_join(docs, other, "u", "u", mode="url", keep="keep").select("doc_id")


@query("reply_graph", "WITH c AS (SELECT conv_id, turn, role || (conv_id % 7)::VARCHAR AS author FROM conversations), t AS (SELECT conv_id, arg_min(author, turn) AS target FROM c WHERE turn = (SELECT min(turn) FROM conversations) GROUP BY 1) SELECT author AS source, target, count(*) AS weight FROM c JOIN t USING (conv_id) WHERE turn > (SELECT min(turn) FROM conversations) AND author <> target GROUP BY 1, 2")
def _(spark, d):
    c = load(spark, d, "conversations")
    first = c.agg(F.min("turn")).first()[0]
    rows = c.select("conv_id", "turn", F.concat("role", F.col("conv_id") % 7).alias("author"), F.col("turn").alias("floor"), F.when(F.col("turn") > first, F.lit(first)).alias("parent"))
    return J.reply_graph(rows, "author", "conv_id", "floor", "parent", "turn")


@query("verify", "WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 20 END AS promised FROM customer), n AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) SELECT c_custkey, promised AS expected, coalesce(k, 0) AS collected, promised - coalesce(k, 0) AS gap, CASE WHEN coalesce(k, 0) = 0 AND coalesce(promised, 1) > 0 THEN 'missing' WHEN promised IS NULL THEN 'unverifiable' WHEN promised - coalesce(k, 0) > 1 THEN 'incomplete' WHEN promised - coalesce(k, 0) < -1 THEN 'excess' ELSE 'complete' END AS status FROM l LEFT JOIN n ON c_custkey = o_custkey")
def _(spark, d):
    listed = load(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 20).alias("promised"))
    return J.verify(listed, load(spark, d, "orders"), "c_custkey", "o_custkey", "promised", tolerance=1).select("c_custkey", "expected", "collected", "gap", "status")


@query("diff_rows", "WITH a AS (SELECT l_suppkey, l_returnflag FROM lineitem), b AS (SELECT l_partkey % 10 AS l_suppkey, l_returnflag FROM lineitem) SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)")
def _(spark, d):
    li = load(spark, d, "lineitem")
    return J.diff(li.select("l_suppkey", "l_returnflag"), li.select((F.col("l_partkey") % 10).alias("l_suppkey"), "l_returnflag"))


@query("diff_keyed", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus, o_orderpriority, CASE o_orderstatus WHEN 'P' THEN 'added' WHEN 'F' THEN 'removed' ELSE 'changed' END AS change, CASE WHEN o_orderstatus = 'O' THEN 'o_totalprice' ELSE '' END AS columns FROM orders WHERE o_orderstatus IN ('P', 'F') OR o_orderpriority = '1-URGENT'")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    urgent = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")
    after = o.where("o_orderstatus <> 'F'").withColumn("o_totalprice", F.when(urgent, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return J.diff(o.where("o_orderstatus <> 'P'"), after, ["o_orderkey"])


@query("compare_snapshots", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS before FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, sum(c_acctbal) AS after FROM customer GROUP BY 1) SELECT k, round(before, 4) AS before, round(after, 4) AS after, round(coalesce(after, 0) - coalesce(before, 0), 4) AS delta, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'gone' WHEN after > before THEN 'up' WHEN after < before THEN 'down' ELSE 'same' END AS change FROM a FULL JOIN b USING (k)")
def _(spark, d):
    before = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    after = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return J.compare_snapshots(before, after, ["k"], "v").withColumns({c: F.round(c, 4) for c in ("before", "after", "delta")})


@query("lookup", "SELECT c_custkey, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.concat(F.lit(" "), F.upper("n_name")).alias("n"))
    aliases = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return J.lookup(c, "n", aliases, "n_name", "r_name", "region").select("c_custkey", "region")


@query("merge_tables", "SELECT n_nationkey AS k, n_name AS name, 'nation' AS source_name FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def _(spark, d):
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    return J.merge_tables([n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), r.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))], ["nation", "region"])


@query("fuse", "WITH f AS (SELECT nullif(trim(c_name), '') AS title, c_mktsegment AS kind, 'customers' AS origin FROM customer UNION ALL SELECT nullif(trim(s_name), ''), NULL, 'suppliers' FROM supplier UNION ALL SELECT nullif(trim(p_brand), ''), p_type, 'parts' FROM part) SELECT title, kind, origin, substr(sha1(coalesce(title, '')), 1, 16) || '-' || row_number() OVER (PARTITION BY title ORDER BY origin, title, kind) AS record_id FROM f")
def _(spark, d):
    return J.fuse([load(spark, d, t) for t in ("customer", "supplier", "part")], {"title": ["c_name", "s_name", "p_brand"], "kind": ["c_mktsegment", "p_type"]}, ["customers", "suppliers", "parts"], ["title"])


@query("sort_rows", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def _(spark, d):
    return O.sort_rows(load(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", False, ["c_custkey"])


@query("sample_rows")
def _(spark, d):
    return O.sample_rows(load(spark, d, "orders"), n=100, seed=3)


@query("sample_fraction")
def _(spark, d):
    return O.sample_rows(load(spark, d, "lineitem"), frac=0.1, seed=3)


@query("page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return O.page(o.withColumn("neg", -F.col("o_totalprice")), ["neg", "o_orderkey"], 100, 50).drop("neg")


@query("top_per_group", "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def _(spark, d):
    return O.top_per_group(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 3, ["o_orderkey"])


for _keep, _sql in (("first", "rn = 1"), ("last", "back = 1"), (False, "n = 1")):
    QUERIES[f"drop_duplicates_{str(_keep).lower()}"] = lambda spark, d, keep=_keep: D.drop_duplicates(load(spark, d, "documents").select("doc_id", "text", "lang"), ["text"], keep, "doc_id").select("doc_id", "lang")
    ORACLES[f"drop_duplicates_{str(_keep).lower()}"] = f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS back, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE {_sql}"


@query("similar_to", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank, vec_id AS id, s AS similarity FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]) AS s FROM embeddings, q) ORDER BY s DESC, vec_id LIMIT 10")
def _(spark, d):
    e = load(spark, d, "embeddings")
    return D.similar_to(e, "vec_id", "embedding", e.where("vec_id = 0").first()["embedding"])


@query("semantic_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.45")
def _(spark, d):
    return D.semantic_pairs(load(spark, d, "embeddings"), "vec_id", "embedding", 0.45)
