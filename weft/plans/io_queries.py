"""Queries of readers, writers, cumulative datasets, workflows and streams: what is written is read back and compared by SQL.

Folders are new ones in the shared folder of the session.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.scalars import value_at
from weft.functions.texts import accent_key
from weft.operators import charts as CH
from weft.operators import graph as G
from weft.operators.places import affiliation_countries
from weft.plans import flow
from weft.plans import monitor as MO
from weft.runtime import load, shared_folder
from weft.sources import records as R
from weft.sources import sinks as K
from weft.sources import tables as TB
from weft.streaming import streams as ST

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# bibliographic exports, written from the documents and read back

_FIELDS = """SELECT doc_id, 'Paper ' || doc_id || ' of ' || coalesce(source, 'nobody') AS title, 'Lee, A' || (doc_id % 7) AS first, 'Kim, B' || (doc_id % 5) AS second, (1950 + doc_id % 70)::VARCHAR AS year,
  'Journal of ' || coalesce(lang, 'none') AS journal, 'key ' || (doc_id % 11) AS k1, 'word ' || (doc_id % 13) AS k2, '10.1000/x' || doc_id AS doi FROM documents"""
_RECORDS = f"""SELECT substr(sha1(concat_ws(chr(30), title, first || ';' || second, year, journal)), 1, 16) AS record_id, title, first || ';' || second AS authors, journal, year::INT AS year, {{keywords}} AS keywords, {{doi}} AS doi, '{{name}}' AS format FROM ({_FIELDS})"""
_KEYS = "k1 || ';' || k2"
#: For each format the lines of a record (SQL over the fields), the SQL of keywords and DOI where the format has them, lines before the first record.
_LAYOUTS = {
    "ris": ("'TY  - JOUR', 'TI  - ' || title, 'AU  - ' || first, 'AU  - ' || second, 'PY  - ' || year, 'JO  - ' || journal, 'KW  - ' || k1, 'KW  - ' || k2, 'DO  - ' || doi, 'ER  - '", _KEYS, "doi", ""),
    "wos": ("'PT J', 'AU ' || first, '   ' || second, 'TI ' || title, 'SO ' || journal, 'PY ' || year, 'DE ' || k1 || ';' || k2, 'DI ' || doi, 'ER', ''", _KEYS, "doi", "FN Test\nVR 1.0"),
    "pubmed": ("'PMID- ' || doc_id, 'TI  - ' || title, 'FAU - ' || first, 'FAU - ' || second, 'DP  - ' || year || ' Mar', 'JT  - ' || journal, 'OT  - ' || k1, 'OT  - ' || k2, 'AID - ' || doi || ' [doi]', ''", _KEYS, "doi", ""),
    "refworks": ("'RT Journal Article', 'T1 ' || title, 'A1 ' || first, 'A1 ' || second, 'JF ' || journal, 'YR ' || year, 'K1 ' || k1, 'K1 ' || k2, 'DO ' || doi, ''", _KEYS, "doi", ""),
    "endnote": ("'%0 Journal Article', '%T ' || title, '%A ' || first, '%A ' || second, '%D ' || year, '%J ' || journal, '%K ' || k1, '%K ' || k2, '%R ' || doi, ''", _KEYS, "doi", ""),
    "cssci": ("'【来源篇名】' || title, '【来源作者】' || first, '【来源作者】' || second, '【期刊】' || journal, '【年代卷期】' || year || ',5(2):1-9', '【关键词】' || k1, '【关键词】' || k2, ''", _KEYS, "''", ""),
    "noteexpress": ("'{Reference Type}: Journal Article', '{Title}: ' || title, '{Author}: ' || first, '{Author}: ' || second, '{Year}: ' || year, '{Journal}: ' || journal, '{Keywords}: ' || k1, '{Keywords}: ' || k2, '{DOI}: ' || doi, ''", _KEYS, "doi", ""),
    "bibtex": ("'@article{a' || doc_id || ',', '  title = {' || title || '},', '  author = {' || first || ' and ' || second || '},', '  year = ' || year || ',', '  journal = \"' || journal || '\",', '  keywords = {' || k1 || ', ' || k2 || '},', '  doi = {' || doi || '}', '}'", _KEYS, "doi", ""),
    "scopus": ("'\"' || first || '; ' || second || '\",\"' || title || '\",' || year || ',\"' || journal || '\",' || doi || ',\"' || k1 || '; ' || k2 || '\"'", _KEYS, "doi", "Authors,Title,Year,Source title,DOI,Author Keywords"),
    "dimensions": ("'1,p,\"' || title || '\",\"' || first || '; ' || second || '\",' || year || ',\"' || journal || '\",' || doi", "NULL::VARCHAR", "doi", "Rank,Publication ID,Title,Authors,PubYear,Source title,DOI"),
    "lens": ("doc_id || ',\"' || title || '\",\"' || first || '; ' || second || '\",' || year || ',\"' || journal || '\",' || doi || ',\"' || k1 || '; ' || k2 || '\"'", _KEYS, "doi", "Lens ID,Title,Author/s,Publication Year,Source Title,DOI,Keywords"),
    "pubmed_csv": ("doc_id || ',\"' || title || '\",\"' || first || '; ' || second || '\",\"' || journal || '\",' || year || ',' || doi", "NULL::VARCHAR", "doi", "PMID,Title,Authors,Journal/Book,Publication Year,DOI"),
    "wos_table": ("'J' || chr(9) || first || '; ' || second || chr(9) || title || chr(9) || journal || chr(9) || year || chr(9) || k1 || '; ' || k2 || chr(9) || doi", _KEYS, "doi", "PT\tAU\tTI\tSO\tPY\tDE\tDI"),
}


def written_records(spark, d, name: str) -> str:
    """The documents as an export of this format: a folder of text files, each with what stands before the first record."""
    load(spark, d, "documents").createOrReplaceTempView("weft_documents")
    lines, _, _, head = _LAYOUTS[name]
    fields = spark.sql(_FIELDS.replace("::VARCHAR", "::STRING").replace("FROM documents", "FROM weft_documents"))
    text = fields.select(F.concat_ws("\n", F.expr(f"array({lines})")).alias("value"))
    def behind_head(batches):  # each task writes a file
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    out = folder(spark, name)
    (text.mapInArrow(behind_head, "value string") if head else text).write.text(out)
    return out


for _name, (_lines, _keywords, _doi, _head) in _LAYOUTS.items():
    QUERIES[f"read_{_name}"] = lambda spark, d, name=_name: R.open_upload(spark, written_records(spark, d, name)).select("record_id", "title", "authors", "journal", "year", "keywords", "doi", "format")
    ORACLES[f"read_{_name}"] = _RECORDS.replace("{keywords}", _keywords).replace("{doi}", _doi).replace("{name}", _name)


@query("record_references", f"SELECT substr(sha1(concat_ws(chr(30), title, 'Lee, A', year, journal)), 1, 16) AS record_id, p::INT AS position, CASE p WHEN 0 THEN 'Roe C, ' || year || ', NATURE, V1' ELSE 'Poe D, 2002, CELL, V2' END AS reference, CASE p WHEN 0 THEN 'Roe C' ELSE 'Poe D' END AS author, CASE p WHEN 0 THEN year::INT ELSE 2002 END AS year, NULL::VARCHAR AS title, CASE p WHEN 0 THEN 'NATURE' ELSE 'CELL' END AS journal, NULL::VARCHAR AS doi FROM ({_FIELDS}), range(2) r(p)")
def _(spark, d):
    load(spark, d, "documents").createOrReplaceTempView("weft_documents")
    fields = spark.sql(_FIELDS.replace("::VARCHAR", "::STRING").replace("FROM documents", "FROM weft_documents"))
    out = folder(spark, "references")
    fields.select(F.expr("concat_ws('\n', 'PT J', 'AU Lee, A', 'TI ' || title, 'SO ' || journal, 'PY ' || year, 'CR Roe C, ' || year || ', NATURE, V1', '   Poe D, 2002, CELL, V2', 'ER', '')").alias("value")).write.text(out)
    return R.references(R.read_records(spark, out, "wos"))


# tables written and read back

_ROWS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=1+' ELSE '' END || text AS text, lang, n_chars FROM documents"


def rows_of(spark, d) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.concat(F.when(F.col("doc_id") % 4 == 0, "=1+").otherwise(""), "text").alias("text"), "lang", "n_chars")


def _there_and_back(fmt: str):
    def run(spark, d):
        out = K.export(rows_of(spark, d), folder(spark, fmt), fmt)
        back = TB.read_table(spark, out, "jsonl" if fmt == "json" else fmt, "auto" if fmt == "csv" else "UTF-8")
        return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text"), "lang", F.col("n_chars").cast("long").alias("n_chars"))

    return run


for _fmt in ("csv", "json", "parquet"):
    QUERIES[f"export_{_fmt}"] = _there_and_back(_fmt)
    _cell = "CASE WHEN regexp_matches(text, '^[=+@\\t\\r-]') THEN '''' || text ELSE text END" if _fmt == "csv" else "text"
    ORACLES[f"export_{_fmt}"] = f"SELECT doc_id, sha256({_cell}) AS text, lang, n_chars FROM ({_ROWS})"


@query("export_txt", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(coalesce(c_mktsegment, ''), chr(10))) AS line FROM customer) GROUP BY 1")
def _(spark, d):
    out = K.export(load(spark, d, "customer"), folder(spark, "txt"), "txt", "c_mktsegment")
    return TB.read_table(spark, out, "txt").groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("read_gb18030", "SELECT c_custkey, '客户' || c_name AS name FROM customer")
def _(spark, d):
    out = folder(spark, "gb18030")
    lines = load(spark, d, "customer").select(F.concat_ws(",", "c_custkey", F.concat(F.lit("客户"), "c_name")).alias("value"))

    def encoded(batches):  # each task writes a file
        yield pa.RecordBatch.from_arrays([pa.array([b"c_custkey,name"], pa.binary())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.encode("gb18030") for x in batch.column(0).to_pylist()], pa.binary())], names=["value"])

    lines.mapInArrow(encoded, "value binary").select(F.col("value").cast("string")).write.text(out)
    return TB.read_table(spark, out, "csv", "auto").select(F.col("c_custkey").cast("long").alias("c_custkey"), "name")


_NETWORK = "WITH e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey::VARCHAR AS s FROM lineitem), w AS (SELECT x.s AS a, y.s AS b, count(*) AS weight FROM e x JOIN e y ON x.o = y.o AND x.s < y.s GROUP BY 1, 2), nodes AS (SELECT s, row_number() OVER (ORDER BY s) AS i FROM (SELECT DISTINCT s FROM e))"


def network(spark, d):
    rows = G.entity_rows(load(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("s")), "l_orderkey", "s", split=False)
    return rows.select(F.col("entity").alias("node")).distinct(), G.cooccurrence_edges(rows).select("a", "b", "weight")


_SHAPES = {
    "pajek": ("'*Vertices ' || (SELECT count(*) FROM nodes)", "'*Edges'", "i || ' \"' || s || '\"'", "x.i || ' ' || y.i || ' ' || w.weight::DOUBLE", ""),
    "gml": ("'graph ['", "']'", "'  node [ id ' || i || ' label \"' || s || '\" ]'", "'  edge [ source ' || x.i || ' target ' || y.i || ' weight ' || w.weight::DOUBLE || ' ]'", ""),
    "graphml": ("'</graph>'", "'</graphml>'", "'<node id=\"n' || i || '\"><data key=\"l\">' || s || '</data></node>'", "'<edge source=\"n' || x.i || '\" target=\"n' || y.i || '\"><data key=\"w\">' || w.weight::DOUBLE || '</data></edge>'", "WHERE line NOT LIKE '<?xml%' AND line NOT LIKE '<graph %' AND line NOT LIKE '<graphml%' AND line NOT LIKE '<key%'"),
}
for _fmt, (_a, _b, _node, _edge, _where) in _SHAPES.items():

    def _written(spark, d, fmt=_fmt, where=_where):
        lines = spark.read.text(K.export_graph(*network(spark, d), folder(spark, fmt), fmt)).select(F.col("value").alias("line"))
        return lines.where(where.removeprefix("WHERE ")) if where else lines

    QUERIES[f"export_{_fmt}"] = _written
    ORACLES[f"export_{_fmt}"] = f"{_NETWORK} SELECT {_a} AS line UNION ALL SELECT {_b} UNION ALL SELECT {_node} FROM nodes UNION ALL SELECT {_edge} FROM w JOIN nodes x ON x.s = w.a JOIN nodes y ON y.s = w.b"


# cumulative datasets, workflows, streams


@query("lineage_versions", "SELECT 1 AS version, count(*) AS rows FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderstatus <> 'O'")
def _(spark, d):
    orders = load(spark, d, "orders")
    data = K.Lineage(spark, folder(spark, "lineage"), ["o_orderkey"])
    data.append(orders.where("o_orderstatus = 'O'"))
    data.append(orders)
    data.append(orders)  # nothing new
    return data.versions()


@query("lineage_rows", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    data = K.Lineage(spark, folder(spark, "lineage"), ["o_orderkey"])
    data.append(orders.where("o_orderkey % 2 = 0").unionByName(orders))
    data.append(orders)
    return data.read()


@query("lineage_cap", "SELECT c_custkey FROM customer ORDER BY sha1(c_custkey::VARCHAR) LIMIT 100")
def _(spark, d):
    data = K.Lineage(spark, folder(spark, "lineage"), ["c_custkey"])
    data.append(load(spark, d, "customer").select("c_custkey"), max_rows=100)
    data.append(load(spark, d, "customer").select("c_custkey"), max_rows=100)
    return data.read()


@query("lineage_reset", "SELECT p_partkey, p_size FROM part")
def _(spark, d):
    data = K.Lineage(spark, folder(spark, "lineage"), ["p_partkey"])
    data.append(load(spark, d, "part").select("p_partkey", "p_brand"))
    data.reset()
    data.append(load(spark, d, "part").select("p_partkey", "p_size"))
    return data.read()


@query("workflow_monitor", "SELECT 'all' AS node, 'done' AS state, count(*) AS rows FROM orders UNION ALL SELECT 'dear', 'done', count(*) FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT 'by status', 'done', count(DISTINCT o_orderstatus) FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT 'out', 'done', count(DISTINCT o_orderstatus) FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT 'unread', 'waiting', NULL")
def _(spark, d):
    # counts come from the one job that writes the output
    monitor, out = MO.Monitor(), folder(spark, "monitor")
    nodes = [
        {"id": "all", "type": "source", "path": f"{d}/orders.parquet"},
        {"id": "dear", "type": "analysis", "steps": [{"op": "filter_rows", "params": {"column": "o_totalprice", "op": "gt", "value": 1000}}]},
        {"id": "by status", "type": "analysis", "steps": [{"op": "groupby_agg", "params": {"group_col": "o_orderstatus", "agg_col": "o_orderkey", "agg_func": "count"}}]},
        {"id": "out", "type": "output", "path": out},
        {"id": "unread", "type": "source", "path": f"{d}/nation.parquet"},
    ]
    flow.run_workflow(spark, {"nodes": nodes, "connections": [{"from": a, "to": b} for a, b in (("all", "dear"), ("dear", "by status"), ("by status", "out"))]}, monitor=monitor)
    return monitor.rows(spark).drop("nulls")


@query("workflow_resume", "SELECT o_orderstatus, count(*) AS o_orderkey_count FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def _(spark, d):
    steps = [{"op": "filter_rows", "params": {"column": "o_totalprice", "op": "gt", "value": 1000}}, {"op": "groupby_agg", "params": {"group_col": "o_orderstatus", "agg_col": "o_orderkey", "agg_func": "count"}}]
    work = {"nodes": [{"id": "s", "type": "source", "path": f"{d}/orders.parquet"}, {"id": "a", "type": "analysis", "steps": steps}], "connections": [{"from": "s", "to": "a"}]}
    store = folder(spark, "workflow")
    first = flow.run_workflow(spark, work, store)["a"]
    again = flow.run_workflow(spark, work, store)["a"]
    assert again.inputFiles() and sorted(again.inputFiles()) == sorted(first.inputFiles())
    return again.toDF("o_orderstatus", "o_orderkey_count")


@query("compare_runs", "SELECT o_orderkey, o_totalprice, 'removed' AS change, '' AS columns FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 100000")
def _(spark, d):
    def work(bound):
        step = {"op": "filter_rows", "params": {"column": "o_totalprice", "op": "gt", "value": bound}}
        cut = {"op": "select_columns", "params": {"columns": "o_orderkey, o_totalprice"}}
        return {"nodes": [{"id": "s", "type": "source", "path": f"{d}/orders.parquet"}, {"id": "a", "type": "analysis", "steps": [step, cut]}], "connections": [{"from": "s", "to": "a"}]}

    store = folder(spark, "runs")
    for bound in (1000, 100000):
        flow.run_workflow(spark, work(bound), store)
    return flow.compare_runs(spark, store, work(1000), work(100000), "a", ["o_orderkey"])


@query("watch_changes", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1) SELECT k, round(a.v, 4) AS before, round(b.v, 4) AS after, round(coalesce(b.v, 0) - coalesce(a.v, 0), 4) AS delta, CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'gone' WHEN b.v > a.v THEN 'up' WHEN b.v < a.v THEN 'down' ELSE 'same' END AS change FROM a FULL JOIN b USING (k)")
def _(spark, d):
    watch = K.Watch(spark, folder(spark, "watch"), ["k"], "v")
    watch.capture(load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v")))
    changes = watch.capture(load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")))
    return changes.withColumns({c: F.round(c, 4) for c in ("before", "after", "delta")})


@query("script_step", "SELECT s_suppkey, s_acctbal * 2 AS twice FROM supplier")
def _(spark, d):
    def twice(batches):
        for pdf in batches:
            yield pdf.assign(twice=pdf["s_acctbal"] * 2)[["s_suppkey", "twice"]]

    flow.register_script("twice", twice, "s_suppkey bigint, twice double")
    return flow.script(load(spark, d, "supplier"), "twice")


@query("compare_models", "SELECT s_suppkey AS row, m.m AS model, CASE m.m WHEN 'sign' THEN (s_acctbal > 0)::INT ELSE (s_acctbal > 1000)::INT END AS label FROM supplier, (SELECT unnest(['sign', 'rich']) AS m) m")
def _(spark, d):
    def above(bound):
        def run(batches):
            for pdf in batches:
                yield pdf.assign(label=(pdf["s_acctbal"] > bound).astype("int32"))[["s_suppkey", "label"]]

        return run

    for name, bound in (("sign", 0), ("rich", 1000)):
        flow.register_provider(name, above(bound), "s_suppkey bigint, label int")
    return flow.compare_models(load(spark, d, "supplier"), ["sign", "rich"], "s_suppkey")


def _stream(spark, d, name: str) -> DataFrame:
    """A table as a stream of files."""
    rows, files = load(spark, d, name), folder(spark, "files")
    rows.write.parquet(files)
    return spark.readStream.schema(rows.schema).parquet(files)


def _drained(spark, d, name: str, change=lambda rows: rows) -> DataFrame:
    """A table as a stream, changed and written until the source is empty."""
    out = folder(spark, "stream")
    ST.drain(change(_stream(spark, d, name)), out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out)


@query("stream_drain", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    return _drained(spark, d, "events").select("event_id", "event_type", "value")


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return _drained(spark, d, "events", lambda s: ST.first_seen(s.select("user_id", "event_type"), ["user_id", "event_type"]))


@query("stream_accumulate", "SELECT event_id, value FROM events")
def _(spark, d):
    out = folder(spark, "accumulate")
    data = K.Lineage(spark, out, ["event_id"])
    for run in ("one", "two"):  # a second run adds nothing
        ST.accumulate(_stream(spark, d, "events").select("event_id", "value"), data, f"{out}-{run}", f"accumulate-{uuid.uuid4().hex}").awaitTermination()
    return data.read()


@query("stream_busiest", "SELECT user_id AS key, max(n)::BIGINT AS peak FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) RANGE BETWEEN CURRENT ROW AND INTERVAL 60 MINUTE FOLLOWING) AS n FROM events) GROUP BY 1")
def _(spark, d):
    out, setting = folder(spark, "busiest"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = ST.busiest(_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 60, "1 hour")
        stream.writeStream.outputMode("update").foreachBatch(lambda rows, _: rows.write.mode("append").parquet(out)).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(out).groupBy("key").agg(F.max("peak").alias("peak"))


@query("stream_item_key", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR WHEN event_id % 3 = 1 THEN 'e.example/' || user_id ELSE sha1(event_type) END AS item_key FROM events")
def _(spark, d):
    def keyed(s):
        s = s.withColumn("site", F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string"))).withColumn("link", F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("https://www.E.example/"), "user_id", F.lit("/?utm_source=x"))))
        return ST.with_item_key(s, "site", "link", ["event_type"]).select("event_id", "item_key")

    return _drained(spark, d, "events", keyed)


@query("tumbling_counts", "SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def _(spark, d):
    return ST.windowed_counts(load(spark, d, "events"), "ts", by=["event_type"])


@query("sliding_counts", "SELECT s AS start, s + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM (SELECT unnest(list_transform(range(0, 3), lambda k: time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01') - k * INTERVAL 4 HOUR)) AS s FROM events) GROUP BY 1")
def _(spark, d):
    return ST.windowed_counts(load(spark, d, "events"), "ts", "sliding", "12 hours", "4 hours")


@query("session_counts", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS \"end\", user_id, count(*) AS n FROM y GROUP BY user_id, k")
def _(spark, d):
    return ST.windowed_counts(load(spark, d, "events"), "ts", "session", "1 hour", by=["user_id"])


@query("newer_rows", "SELECT event_id FROM events e WHERE ts > coalesce((SELECT max(ts) FROM events s WHERE s.user_id IS NOT DISTINCT FROM e.user_id AND s.event_type = 'view'), TIMESTAMP '1900-01-01')")
def _(spark, d):
    events = load(spark, d, "events")
    return ST.newer_than(events, ST.newest(events.where("event_type = 'view'"), "ts", ["user_id"]), "ts", ["user_id"]).select("event_id")


# values and keys


@query("json_values", "SELECT event_id, event_id::VARCHAR AS item, props->>'k' AS value, props::JSON::VARCHAR AS whole, NULL::VARCHAR AS missing FROM events")
def _(spark, d):
    events = load(spark, d, "events").select("event_id", F.format_string('{"a": {"b": [%d, %s], "7": 1}}', "event_id", "props").alias("t"))
    return events.select("event_id", value_at(F.col("t"), "a.b.0").alias("item"), value_at(F.col("t"), "a.b.1.k").alias("value"), value_at(F.col("t"), "a.b.1").alias("whole"), value_at(F.col("t"), "a.b.2.k").alias("missing"))


ORACLES["json_values"] = ORACLES["json_values"].replace("props::JSON::VARCHAR", "'{\"k\":' || (props->>'k') || '}'")


@query("accent_key", r"SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^0-9a-z\x{4e00}-\x{9fff}]+', ' ', 'g')) AS key FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", accent_key(F.col("text")).alias("key"))


@query(
    "affiliation_countries",
    """WITH names AS (SELECT n_nationkey AS k, n_name FROM nation)
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN a.n_name WHEN 1 THEN a.n_name || '|' || b.n_name WHEN 2 THEN a.n_name ELSE '' END AS countries
FROM customer JOIN names a ON a.k = c_nationkey JOIN names b ON b.k = (c_nationkey + 1) % 25""",
)
def _(spark, d):
    nation, letters = load(spark, d, "nation"), lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    aliases = nation.select(F.concat(F.lit("Land "), letters(F.col("n_nationkey"))).alias("alias"), F.col("n_name").alias("country"))
    own = F.concat(F.lit("Dept of A, 12345 City, a.b@mail.example, land  "), letters(F.col("c_nationkey")), F.lit("."))
    other = F.concat(F.lit("Lab,Land "), letters((F.col("c_nationkey") + 1) % 25))
    k = F.col("c_custkey") % 4
    cell = F.when(k == 0, own).when(k == 1, F.concat(own, F.lit("; "), other)).when(k == 2, F.concat(own, F.lit("\n"), own)).otherwise(F.concat(own, F.lit(" and more")))
    found = affiliation_countries(load(spark, d, "customer").select("c_custkey", cell.alias("address")), "c_custkey", "address", aliases)
    return found.select("id", F.array_join("countries", "|").alias("countries"))


@query("split_names", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    return flow.apply_steps(load(spark, d, "orders"), [{"op": "select_columns", "params": {"columns": " o_orderkey, o_totalprice ,"}}])


# tables behind charts


@query("sankey_links", "SELECT o_orderpriority AS source, o_orderstatus AS target, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2")
def _(spark, d):
    return CH.sankey_links(load(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("sankey_sums", "SELECT l_returnflag AS source, l_linestatus AS target, sum(l_discount) AS value FROM lineitem GROUP BY 1, 2 HAVING sum(l_discount) <> 0")
def _(spark, d):
    return CH.sankey_links(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_discount").select("source", "target", F.round("value", 6).alias("value"))


ORACLES["sankey_sums"] = ORACLES["sankey_sums"].replace("sum(l_discount) AS", "round(sum(l_discount), 6) AS")


@query("sankey_nodes", "SELECT o_orderpriority AS node FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL UNION SELECT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL")
def _(spark, d):
    return CH.sankey_nodes(load(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("dual_line", "SELECT p_size AS x, count(*)::DOUBLE AS \"left\", round(avg(p_retailprice), 6) AS \"right\" FROM part WHERE p_size IS NOT NULL GROUP BY 1")
def _(spark, d):
    return CH.dual_line(load(spark, d, "part"), "p_size", y2="p_retailprice").select("x", "left", F.round("right", 6).alias("right"))


@query("scatter", "SELECT p_size::DOUBLE AS x, p_retailprice AS y, p_brand AS \"group\" FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL")
def _(spark, d):
    return CH.scatter(load(spark, d, "part"), "p_size", "p_retailprice", "p_brand")


@query("word_cloud", "SELECT p_brand AS word, round(sum(p_retailprice), 4) AS value FROM part WHERE trim(p_brand) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return CH.word_cloud(load(spark, d, "part"), "p_brand", "p_retailprice", top_n=10).select("word", F.round("value", 4).alias("value"))
