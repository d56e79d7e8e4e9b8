"""Queries of column steps and grouped figures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import aggregates as A
from weft.operators import columns as C
from weft.runtime import load

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("select_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    return C.select_columns(load(spark, d, "orders"), ["o_orderkey", "o_totalprice"])


@query("rename_columns", "SELECT c_custkey AS customer, c_name AS c_mktsegment, c_nationkey, c_acctbal, c_mktsegment AS c_name FROM customer")
def _(spark, d):
    return C.rename_columns(load(spark, d, "customer"), {"c_custkey": "customer", "c_name": "c_mktsegment", "c_mktsegment": "c_name"})


@query("strip_whitespace", r"SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM (SELECT doc_id, '  ' || text || chr(10) AS x FROM documents)")
def _(spark, d):
    return C.strip_whitespace(load(spark, d, "documents").select("doc_id", F.concat(F.lit("  "), "text", F.lit("\n")).alias("x")))


@query("convert_type", "SELECT event_id, value::VARCHAR IS NOT NULL AS value, try_cast(regexp_extract(props, '(-?[0-9.]+)', 1) AS DOUBLE) AS number, event_type NOT IN ('', 'false', 'no') AS flag, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment FROM events")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "value", F.regexp_extract("props", r"(-?[0-9.]+)", 1).alias("number"), F.col("event_type").alias("flag"), F.date_format("ts", "yyyy/M/d HH:mm:ss").alias("moment"))
    e = C.convert_type(C.convert_type(C.convert_type(e, "number", "float"), "flag", "bool"), "moment", "datetime")
    return C.convert_type(e, "value", "str").select("event_id", F.col("value").isNotNull().alias("value"), "number", "flag", F.date_format("moment", "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("fill_null_value", "SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, ''), 'none') AS s FROM orders")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("s"))
    return C.fill_null(o, ["s"], "none")


@query("fill_null_ffill", "SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return C.fill_null(e, ["v"], method="ffill", order_by=["event_id"], group_by=["user_id"])


@query("fill_null_bfill", "SELECT event_id, user_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return C.fill_null(e, ["v"], method="bfill", order_by=["event_id"], group_by=["user_id"])


@query("drop_null", "SELECT * FROM (SELECT event_id, nullif(CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END, '') AS t FROM events) WHERE t IS NOT NULL")
def _(spark, d):
    return C.drop_null(load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("t")), ["t"])


_FILTERS = {
    "eq": ("o_orderstatus", "F", "o_orderstatus = 'F'"),
    "ne": ("o_orderstatus", "F", "o_orderstatus <> 'F'"),
    "gt": ("o_totalprice", 200000, "o_totalprice > 200000"),
    "gte": ("o_custkey", "50", "o_custkey >= 50"),
    "lt": ("o_totalprice", 50000, "o_totalprice < 50000"),
    "lte": ("o_custkey", 20, "o_custkey <= 20"),
    "contains": ("o_orderpriority", "^[12]-", "regexp_matches(o_orderpriority, '^[12]-')"),
    "not_contains": ("o_orderpriority", "LOW|HIGH", "NOT regexp_matches(o_orderpriority, 'LOW|HIGH')"),
    "in": ("o_orderstatus", "F, P", "o_orderstatus IN ('F', 'P')"),
    "not_in": ("o_custkey", [1, 2, 3.0, 4], "o_custkey NOT IN (1, 2, 3, 4)"),
    "is_null": ("o_orderstatus", None, "o_orderstatus IS NULL OR o_orderstatus = ''"),
    "not_null": ("o_orderstatus", None, "NOT (o_orderstatus IS NULL OR o_orderstatus = '')"),
}
for _op, (_column, _value, _sql) in _FILTERS.items():
    QUERIES[f"filter_{_op}"] = lambda spark, d, c=_column, op=_op, v=_value: C.filter_rows(load(spark, d, "orders"), c, op, v).select("o_orderkey", c)
    ORACLES[f"filter_{_op}"] = f"SELECT o_orderkey, {_column} FROM orders WHERE {_sql}"


@query("filter_exclude", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 100000, false)")
def _(spark, d):
    return C.filter_rows(load(spark, d, "orders"), "o_totalprice", "gt", 100000, keep="exclude").select("o_orderkey")


@query("column_calc", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / l_quantity + l_linenumber ** 2 - floor(l_quantity / 7) + (l_quantity - 7 * floor(l_quantity / 7)) AS x FROM lineitem")
def _(spark, d):
    x = C.column_calc(load(spark, d, "lineitem"), "x", "`l_extendedprice` * (1 - l_discount) / l_quantity + l_linenumber ** 2 - l_quantity // 7 + l_quantity % 7")
    return x.select("l_orderkey", "l_linenumber", "x")


@query("bin_column_edges", "SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'middle' WHEN p_size > 30 AND p_size <= 50 THEN 'large' END AS size_bin FROM part")
def _(spark, d):
    return C.bin_column(load(spark, d, "part"), "p_size", [0, 10, 30, 50], ["small", "middle", "large"], "size_bin").select("p_partkey", "size_bin")


@query("bin_column_equal", "SELECT p_partkey, 'b' || (least(greatest(ceil((p_retailprice - lo) / ((hi - lo) / 5)), 1), 5)::INT)::VARCHAR AS price_bin FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def _(spark, d):
    return C.bin_column(load(spark, d, "part"), "p_retailprice", 5, ["b1", "b2", "b3", "b4", "b5"], "price_bin").select("p_partkey", "price_bin")


@query("extract_time", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, month(ts)::INT AS month, year(ts)::INT AS year FROM events")
def _(spark, d):
    e = load(spark, d, "events")
    for part in ("date", "hour", "weekday", "month", "year"):
        e = C.extract_time(e, "ts", part, part)
    return e.select("event_id", "date", "hour", "weekday", "month", "year")


@query("bin_time", "SELECT event_id, CASE WHEN ts::DATE >= '2024-01-01' AND ts::DATE < '2024-01-10' THEN 'start' WHEN ts::DATE >= '2024-01-10' AND ts::DATE < '2024-01-20' THEN 'peak' END AS stage, CASE WHEN ts::DATE >= '2024-01-01' AND ts::DATE < '2024-01-10' THEN 1 WHEN ts::DATE >= '2024-01-10' AND ts::DATE < '2024-01-20' THEN 2 END AS stage_order FROM events")
def _(spark, d):
    return C.bin_time(load(spark, d, "events"), "ts", ["2024-01-01", "2024-01-10", "2024-01-20"], ["start", "peak"], "stage", "stage_order").select("event_id", "stage", "stage_order")


@query("time_filter", "SELECT event_id FROM events WHERE ts::DATE BETWEEN '2024-01-05' AND '2024-01-07'")
def _(spark, d):
    return C.time_filter(load(spark, d, "events"), "ts", "2024-01-05", "2024-01-07").select("event_id")


@query("neutralise_formulas", "SELECT doc_id, CASE WHEN regexp_matches(x, '^[=+\\-@\\t\\r]') THEN chr(39) || x ELSE x END AS x FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '=' ELSE '' END || source AS x FROM documents)")
def _(spark, d):
    return C.neutralise_formulas(load(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "=").otherwise(""), "source").alias("x")))


@query("localise", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS lang FROM documents")
def _(spark, d):
    return C.localise(load(spark, d, "documents"), "lang", {"en": "English", "de": "German"}).select("doc_id", "lang")


@query("explode_links", r"SELECT page_id, unnest(regexp_extract_all(url, '(https?://[^\s,;，；、|]+)', 1)) AS link FROM pages")
def _(spark, d):
    return C.explode_links(load(spark, d, "pages"), "url").select("page_id", "link")


@query("groupby_agg", "SELECT o_orderpriority, sum(o_totalprice) AS o_totalprice, avg(o_totalprice) AS o_totalprice_mean, median(o_totalprice) AS o_totalprice_median, stddev_samp(o_totalprice) AS o_totalprice_std, count(DISTINCT o_custkey) AS o_custkey_nunique FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def _(spark, d):
    return A.groupby_agg(load(spark, d, "orders"), "o_orderpriority", "o_totalprice", "sum", agg_metrics=[("o_totalprice", "mean"), ("o_totalprice", "median"), ("o_totalprice", "std"), ("o_custkey", "nunique")])


@query("groupby_first_last", "SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_max(event_type, event_id) AS event_type_last FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    return A.groupby_agg(load(spark, d, "events"), "user_id", "event_type", "first", agg_metrics=[("event_type", "last")], row_order="event_id")


@query("query_scalars", "SELECT count(*) AS count, sum(l_quantity) AS sum, avg(l_quantity) AS mean, median(l_extendedprice) AS median FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    li, where = load(spark, d, "lineitem"), ("l_returnflag", "eq", "R")
    one = A.query(li, "count", where=where)
    for op, c in (("sum", "l_quantity"), ("mean", "l_quantity"), ("median", "l_extendedprice")):
        one = one.crossJoin(A.query(li, op, c, where=where))  # one row each
    return one


@query("query_value_counts", "SELECT coalesce(event_type, '(missing)') AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY count DESC, value LIMIT 200")
def _(spark, d):
    return A.query(load(spark, d, "events"), "value_counts", "event_type")


@query("query_groupby", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, sum(l_tax) AS l_tax_sum FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return A.query(load(spark, d, "lineitem"), "groupby", by=["l_returnflag", "l_linestatus"], agg="sum", columns=["l_quantity", "l_tax"])


@query("query_filter", "SELECT count(*) AS n FROM (SELECT doc_id FROM documents WHERE contains(text, 'token') LIMIT 200)")
def _(spark, d):
    return A.query(load(spark, d, "documents"), "filter", where=("text", "contains", "token"), columns=["doc_id"]).agg(F.count(F.lit(1)).alias("n"))


@query("compare_platform", "SELECT coalesce(c_mktsegment, '') AS platform, count(*) AS n, avg(c_acctbal) AS c_acctbal_mean FROM customer GROUP BY 1")
def _(spark, d):
    return A.compare_platform(load(spark, d, "customer"), "c_mktsegment", "c_acctbal")


_EVOLUTION = """WITH p AS (SELECT strftime(ts, '%Y-%m-%d') AS period, CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' WHEN 'view' THEN 'neutral' ELSE event_type END AS label, (value - floor(value)) AS score FROM events),
g AS (SELECT period, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'neutral') AS neutral, count(*) FILTER (label = 'negative') AS negative, count(*) AS total, count(score) AS score_n, round(avg(abs(score - 0.5)) * 2, 4) AS intensity FROM p GROUP BY 1)
SELECT period, positive, neutral, negative, total - positive - neutral - negative AS other, total, round(positive * 100.0::DOUBLE / total, 2) AS positive_pct, round(neutral * 100.0::DOUBLE / total, 2) AS neutral_pct, round(negative * 100.0::DOUBLE / total, 2) AS negative_pct, round((positive - negative)::DOUBLE / total, 4) AS sentiment_index, round(total * 100.0::DOUBLE / sum(total) OVER (), 2) AS volume_pct, score_n, intensity FROM g"""


def labelled_events(spark, d):
    t = F.col("event_type")
    label = F.when(t == "purchase", "positive").when(t == "error", "negative").when(t == "view", "neutral").otherwise(t)
    return load(spark, d, "events").select("event_id", "user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("period"), label.alias("label"), (F.col("value") - F.floor("value")).alias("score"))


@query("sentiment_evolution", _EVOLUTION)
def _(spark, d):
    return A.sentiment_evolution(labelled_events(spark, d), "period", "label", "score")


@query("label_counts", "SELECT lang AS label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def _(spark, d):
    return A.label_counts(load(spark, d, "documents"), "lang", share=True)


@query("kappa", "WITH c AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS o FROM c), e AS (SELECT sum(x.k * y.k)::DOUBLE AS s FROM (SELECT a, count(*) AS k FROM c GROUP BY 1) x JOIN (SELECT b, count(*) AS k FROM c GROUP BY 1) y ON x.a = y.b) SELECT n, o AS observed, s / (n * n) AS expected, CASE WHEN o = 1 THEN 1 ELSE (o - s / (n * n)) / (1 - s / (n * n)) END AS kappa FROM n, e")
def _(spark, d):
    return A.kappa(load(spark, d, "labels"), "quality", "toxic")


@query("chart_aggregate", "SELECT event_type AS x, sum(value) AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def _(spark, d):
    return A.chart_aggregate(load(spark, d, "events"), "event_type", "value", "sum", "event_id")


@query("pivot", "SELECT o_orderpriority AS y, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def _(spark, d):
    return A.pivot(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("histogram", "WITH r AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders), k AS (SELECT least(greatest(ceil((o_totalprice - lo) / w), 1), 10)::INT AS bin, count(*) AS n FROM orders, r GROUP BY 1) SELECT b.bin::INT AS bin, lo + (b.bin - 1) * w AS low, lo + b.bin * w AS high, coalesce(n, 0) AS n FROM range(1, 11) b(bin) CROSS JOIN r LEFT JOIN k ON k.bin = b.bin")
def _(spark, d):
    return A.histogram(load(spark, d, "orders"), "o_totalprice")


@query("box_stats", "WITH q AS (SELECT p_brand AS g, count(*) AS n, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS median, quantile_cont(p_retailprice, 0.75) AS q3 FROM part GROUP BY 1) SELECT g AS \"group\", n, (SELECT min(p_retailprice) FROM part WHERE p_brand = g AND p_retailprice >= q1 - 1.5 * (q3 - q1)) AS low, q1, median, q3, (SELECT max(p_retailprice) FROM part WHERE p_brand = g AND p_retailprice <= q3 + 1.5 * (q3 - q1)) AS high FROM q")
def _(spark, d):
    return A.box_stats(load(spark, d, "part"), "p_brand", "p_retailprice")


@query("stacked_shares", "SELECT x, a, b, round(a * 100 / (a + b), 2) AS a_share, round(b * 100 / (a + b), 2) AS b_share FROM (SELECT l_returnflag AS x, sum(l_discount) AS a, sum(l_tax) AS b FROM lineitem GROUP BY 1)")
def _(spark, d):
    li = load(spark, d, "lineitem").select("l_returnflag", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return A.stacked_shares(li, "l_returnflag", ["a", "b"])


@query("model_agreement", "WITH m AS (SELECT doc_id AS id, 'quality' AS m, quality::VARCHAR AS l FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM labels) SELECT x.m AS a, y.m AS b, count(*) AS shared, round(avg((x.l = y.l)::INT) * 100, 2) AS agreement FROM m x JOIN m y ON x.id = y.id WHERE x.l IS NOT NULL AND y.l IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    rows = load(spark, d, "labels").select("doc_id", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("model", "label"))
    return A.model_agreement(rows, "doc_id", "model", "label")


@query("h_index", "WITH r AS (SELECT l_suppkey AS node, l_quantity AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS rn FROM lineitem) SELECT node, count(*) AS documents, sum(c) AS citations, max(CASE WHEN c >= rn THEN rn ELSE 0 END) AS h FROM r GROUP BY 1")
def _(spark, d):
    return A.h_index(load(spark, d, "lineitem"), "l_suppkey", "l_quantity")


@query("profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM customer" for c, t in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))))
def _(spark, d):
    return A.profile(load(spark, d, "customer"))


@query("duplicate_rows", "SELECT sum(n)::BIGINT AS rows, (sum(n) - count(*))::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey)")
def _(spark, d):
    return A.duplicate_rows(load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey"))


def flagship(spark, d):
    """Order value by priority, with further measures."""
    return QUERIES["groupby_agg"](spark, d)


@query("fill_null_ffill_all", "SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT event_id, CASE WHEN event_id % 7 > 4 THEN value END AS v FROM events)")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 > 4, F.col("value")).alias("v"))
    return C.fill_null(e, ["v"], method="ffill", order_by=["event_id"])


@query("fill_null_bfill_all", "SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM (SELECT event_id, CASE WHEN event_id % 7 > 4 THEN value END AS v FROM events)")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 > 4, F.col("value")).alias("v"))
    return C.fill_null(e, ["v"], method="bfill", order_by=["event_id"])
