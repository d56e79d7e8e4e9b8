import pytest
from pyspark.sql import functions as F

from weft.errors import OpError
from weft.plans import flow
from weft.sources.records import detect_format, read_records, references
from weft.sources.sinks import Lineage, export, export_graph
from weft.sources.tables import from_rows, read_table
from weft.streaming import streams

RIS = "TY  - JOUR\nTI  - First paper\nAU  - Lee, A\nAU  - Kim, B\nPY  - 2019/03\nJO  - Testing\nSP  - 1\nEP  - 9\nKW  - one\nKW  - two\nDO  - 10.1000/x1\nER  - \nTY  - JOUR\nTI  - Second paper\nAU  - Roe, C\nPY  - 2018\nER  - \n"
WOS = "FN Test\nVR 1.0\nPT J\nAU Lee, A\n   Kim, B\nTI A long\n   title\nSO TESTING\nPY 2018\nCR Roe C, 2001, NATURE, V1\n   Poe D, 2002, CELL, V2\nER\n\nPT J\nAU Roe, C\nTI Other\nPY 2017\nER\n\nEF\n"
BIB = "@article{a1,\n title = {A {{{Nes}t}ed} title},\n author = {Lee, A and Kim, B},\n year = 2016,\n journal = \"Testing\",\n doi = {10.1000/b1}\n}\n@book{b2,\n title={Second},\n year={2015}\n}\n"
PUBMED = "PMID- 1\nTI  - A study\n      of things\nFAU - Lee, Ann\nFAU - Kim, Bo\nDP  - 2014 Mar\nJT  - Testing\nAID - 10.1000/p1 [doi]\n\nPMID- 2\nTI  - Next\nDP  - 2013\n"
ENW = "%0 Journal Article\n%T Title one\n%A Lee, A\n%A Kim, B\n%D 2012\n%J Testing\n\n%0 Journal Article\n%T Title two\n%D 2011\n"
NET = "{Reference Type}: Journal Article\n{Title}: Title one\n{Author}: Lee, A\n{Author}: Kim, B\n{Year}: 2010\n{Journal}: Testing\n\n{Reference Type}: Journal Article\n{Title}: Title two\n{Year}: 2009\n"
CSSCI = "【来源篇名】Title one\n【来源作者】Lee\n【期刊】Testing\n【年代卷期】2008,5(2):1-9\n\n【来源篇名】Title two\n【年代卷期】2007\n"
REF = "RT Journal Article\nT1 Title one\nA1 Lee\nJF Testing\nYR 2006\n\nRT Journal Article\nT1 Title two\nYR 2005\n"
SCOPUS = 'Authors,Title,Year,Source title,DOI,References\n"Lee A.; Kim B.","Title, one",2004,Testing,10.1000/s1,"Ref A, 2000; Ref B, 2001"\nRoe C.,Title two,2003,Testing,,\n'
DIMENSIONS = 'About the data: exported\nRank,Publication ID,Title,Authors,PubYear,Source title,DOI\n1,p1,Title one,"Lee, A; Kim, B",2002,Testing,10.1000/d1\n2,p2,Title two,"Roe, C",2001,Testing,\n'
LENS = "Lens ID,Title,Author/s,Publication Year,Source Title,DOI\n1,Title one,Lee A; Kim B,2000,Testing,10.1000/l1\n2,Title two,Roe C,1999,Testing,\n"
PMCSV = "PMID,Title,Authors,Journal/Book,Publication Year,DOI\n1,Title one,Lee A,Testing,1998,10.1000/c1\n2,Title two,Roe C,Testing,1997,\n"
TAB = "PT\tAU\tTI\tSO\tPY\nJ\tLee, A; Kim, B\tTitle one\tTESTING\t1996\nJ\tRoe\tTitle two\tTESTING\t1995\n"
SAMPLES = {"ris": RIS, "wos": WOS, "bibtex": BIB, "pubmed": PUBMED, "endnote": ENW, "noteexpress": NET, "cssci": CSSCI, "refworks": REF, "scopus": SCOPUS, "dimensions": DIMENSIONS, "lens": LENS, "pubmed_csv": PMCSV, "wos_table": TAB}


@pytest.mark.parametrize("fmt", sorted(SAMPLES))
def test_record_formats(spark, tmp_path, fmt):
    path = tmp_path / f"{fmt}.txt"
    path.write_text(SAMPLES[fmt], encoding="utf-8")
    assert detect_format(spark, str(path)) == fmt
    rows = read_records(spark, str(path)).orderBy("year", ascending=False).collect()
    assert len(rows) == 2 and all(r["title"] and r["year"] for r in rows)
    assert rows[0]["year"] == rows[1]["year"] + 1
    if fmt in ("ris", "wos", "bibtex", "pubmed", "endnote", "noteexpress", "scopus", "dimensions", "lens", "wos_table"):
        assert len(rows[0]["authors"].split(";")) == 2, rows[0]["authors"]


def test_record_fields(spark, tmp_path):
    for name, text in (("a.ris", RIS), ("b.txt", WOS), ("c.bib", BIB)):
        (tmp_path / name).write_text(text)
    r = read_records(spark, str(tmp_path / "a.ris")).where("year = 2019").first()
    assert (r["pages"], r["keywords"], r["doi"], r["journal"]) == ("1-9", "one;two", "10.1000/x1", "Testing")
    w = read_records(spark, str(tmp_path / "b.txt")).where("year = 2018")
    assert w.first()["title"] == "A long title"
    assert [(x["author"], x["year"], x["journal"]) for x in references(w).orderBy("position").collect()] == [("Roe C", 2001, "NATURE"), ("Poe D", 2002, "CELL")]
    assert read_records(spark, str(tmp_path / "c.bib")).where("year = 2016").first()["title"] == "A Nested title"


def test_tables_round_trip(spark, tmp_path):
    df = from_rows(spark, [{"a": 1, "t": "=1+1"}, {"a": 2, "t": 'x,"y"\nz'}])
    for fmt in ("csv", "json", "parquet"):
        export(df, str(tmp_path / fmt), fmt)
        back = read_table(spark, str(tmp_path / fmt), "jsonl" if fmt == "json" else fmt)
        assert sorted(r["t"] for r in back.collect()) == sorted(["'=1+1" if fmt == "csv" else "=1+1", 'x,"y"\nz'])
    export(df, str(tmp_path / "md"), "md")
    export(df, str(tmp_path / "html"), "html")
    export(df, str(tmp_path / "txt"), "txt", text_column="t")
    for call in (lambda: export(df, "x", "xlsx"), lambda: read_table(spark, "x.xlsx"), lambda: export(df, "x", "txt", "nope")):
        with pytest.raises(OpError):
            call()


def test_graph_export(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([("a", "b", 2.0)], "a string, b string, weight double")
    for fmt, mark in (("graphml", "<edge"), ("gml", "edge ["), ("pajek", "*Edges")):
        export_graph(nodes, edges, str(tmp_path / fmt), fmt)
        assert mark in "\n".join(r[0] for r in spark.read.text(str(tmp_path / fmt)).collect())


def test_lineage_versions(spark, tmp_path):
    store = Lineage(spark, str(tmp_path / "store"), ["k"])
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "again")], "k int, v string")
    assert store.append(a) == 1 and store.append(a) == 1
    assert store.append(spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string")) == 2
    assert sorted(r["k"] for r in store.read().collect()) == [1, 2, 3]
    assert store.read(1).count() == 2
    assert [tuple(r) for r in store.versions().collect()] == [(1, 2), (2, 1)]
    with pytest.raises(OpError):
        store.append(spark.createDataFrame([(1,)], "k int"))


def test_workflow(spark, tmp_path):
    w = {
        "nodes": [
            {"id": "a", "type": "source", "rows": [{"k": 1, "v": 5.0}, {"k": 2, "v": 7.0}, {"k": None, "v": 1.0}]},
            {"id": "b", "type": "source", "rows": [{"k": 2, "w": "two"}]},
            {"id": "c", "type": "analysis", "steps": [{"op": "drop_null", "params": {"columns": ["k"]}}, {"op": "join_tables", "params": {"how": "left", "left_on": "k", "right_on": "k"}}]},
            {"id": "d", "type": "output", "path": str(tmp_path / "out"), "format": "parquet"},
            {"id": "e", "type": "analysis", "steps": [{"op": "nope"}], "disabled": True},
        ],
        "connections": [{"from": "a", "to": "c"}, {"from": "b", "to": "c"}, {"from": "c", "to": "d"}],
    }
    flow.run_workflow(spark, w)
    assert sorted((r["k"], r["w"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, None), (2, "two")]
    assert flow.fingerprints(w)["c"] != flow.fingerprints(w)["d"]
    w["connections"].append({"from": "d", "to": "a"})
    with pytest.raises(OpError):
        flow.run_workflow(spark, w)
    with pytest.raises(OpError):
        flow.model_step(spark.range(1), "zero_shot")


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.windowed_counts(stream, "ts", size="1 day", late="60 days").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, streams.windowed_counts(events, "ts", size="1 day").collect()))
    store = Lineage(spark, str(tmp_path / "store"), ["user_id"])
    streams.accumulate(stream.select("user_id"), store, str(tmp_path / "c2")).awaitTermination(120)
    assert store.read().count() == events.select("user_id").distinct().count()
    keyed = streams.with_item_key(events, id_col="event_id")
    assert keyed.select("item_key").distinct().count() == events.count()
    seen = streams.first_seen(stream, ["user_id"])
    streams.drain(seen, str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("user_id").distinct().count()


def test_an_append_reads_only_what_may_hold_its_keys(spark, tmp_path, monkeypatch):
    from weft.sources import lineage

    monkeypatch.setattr(lineage, "PART_KEYS", 100)
    store = Lineage(spark, str(tmp_path / "store"), ["k"])
    for i in range(3):  # three versions of ten parts
        assert store.append(spark.range(i * 1000, (i + 1) * 1000).select(F.col("id").alias("k"), F.lit(i).alias("v"))) == i + 1
        assert store.parts_read == 0  # all keys are new
    assert store.append(spark.createDataFrame([(1500, 9)], "k long, v int")) == 3 and store.parts_read == 1
    assert store.append(spark.createDataFrame([(1500, 9), (7, 9), (5000, 9)], "k long, v int")) == 4 and store.parts_read == 2
    assert sorted(r["k"] for r in store.read().collect()) == [*range(3000), 5000] and store.read(2).count() == 2000
    assert store.read().where("k in (7, 1500)").agg(F.max("v")).first()[0] == 1
    capped = store.append(spark.range(6000, 7000).select(F.col("id").alias("k"), F.lit(0).alias("v")), max_rows=3101)
    assert capped == 5 and store.capped and store.read().count() == 3101


def test_a_failed_append_leaves_no_trace(spark, tmp_path, monkeypatch):
    from weft.sources import lineage

    store, rows = Lineage(spark, str(tmp_path / "store"), ["k"]), spark.range(50).select(F.col("id").alias("k"))
    store.append(rows)
    before = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
    with monkeypatch.context() as m:
        m.setattr(lineage, "_filter", lambda pdf: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            store.append(rows.withColumn("k", F.col("k") + 100))
    with monkeypatch.context() as m:
        m.setattr(Lineage, "latest", lambda self: 0)  # as if another append had come first
        with pytest.raises(OpError, match="meanwhile"):
            store.append(rows.withColumn("k", F.col("k") + 100))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == before
    assert store.latest() == 1 and store.read().count() == 50
    assert store.append(rows.withColumn("k", F.col("k") + 100)) == 2 and store.read().count() == 100
    store.reset()
    assert store.latest() == 0 and store.append(rows.withColumn("other", F.lit(1))) == 1


def test_bibtex_values_at_any_depth(spark, tmp_path):
    from weft.sources.records import bibtex_fields, bibtex_problems, read_bibtex

    deep = "{" * 40 + "deep" + "}" * 40
    text = (
        "% a comment, with a {brace\n@string{jcp = {x}}\n@article{a1,\n  title = {On " + deep + " {T}itles, \"quoted\" = too},\n  author = \"Ann {\\\"O}ne and Bob Two\",\n  year = 2020 , journal = {J} # { of } # \"K\",\n keywords={a, b; c}}\n"
        "@article{b2, title = {Second}, year = {1999}, abstract = {never {closed,\n author = {Lost}\n"
        "@inproceedings{c3,TITLE=\"Third {with \" inside}\",booktitle={Proc},year=\"2001\"}\n@misc{d4}\n@misc{e5, year = 2000}\n"
    )
    (tmp_path / "x.bib").write_text(text)
    got = {r["title"]: r for r in read_bibtex(spark, str(tmp_path / "x.bib")).collect()}
    assert set(got) == {'On deep Titles, "quoted" = too', "Second", 'Third with " inside'}
    first = got['On deep Titles, "quoted" = too']
    assert (first["authors"], first["year"], first["journal"], first["keywords"]) == ('Ann \\"One;Bob Two', 2020, "J of K", "a;b;c")
    assert got["Second"]["year"] == 1999 and got["Second"]["authors"] is None and got['Third with " inside']["journal"] == "Proc"
    assert [(r["head"][:11], r["field"]) for r in bibtex_problems(spark, str(tmp_path / "x.bib")).collect()] == [("article{b2,", "abstract")]
    assert bibtex_fields("article{k, title = {" + "{" * 100_000 + "}" * 100_000 + "}, year = 3}") == ({"title": "{" * 100_000 + "}" * 100_000, "year": "3"}, None)


def test_monitor_of_nodes_and_streams(spark, tmp_path):
    import time

    from weft.plans.flow import run_workflow
    from weft.plans.monitor import Monitor, StreamMonitor

    monitor = Monitor()
    df = monitor.watch("in", spark.range(10).select(F.when(F.col("id") > 6, F.col("id")).alias("x")), ["x"])
    kept = monitor.watch("kept", df.where("x is not null"))
    assert {r["state"] for r in monitor.rows(spark).collect()} == {"waiting"}
    kept.write.parquet(str(tmp_path / "out"))
    got = {r["node"]: r for r in monitor.rows(spark).collect()}
    assert (got["in"]["rows"], got["in"]["nulls"], got["kept"]["rows"]) == (10, {"x": 7}, 3)
    run = Monitor()
    nodes = [{"id": "a", "type": "source", "rows": [{"k": 1}, {"k": 2}]}, {"id": "b", "type": "analysis", "steps": [{"op": "filter_rows", "params": {"column": "k", "op": "gt", "value": 1}}]}]
    run_workflow(spark, {"nodes": nodes, "connections": [{"from": "a", "to": "b"}]}, monitor=run)["b"].collect()
    assert {(r["node"], r["rows"]) for r in run.rows(spark).collect()} == {("a", 2), ("b", 1)}
    seen = StreamMonitor()
    spark.streams.addListener(seen)
    try:
        spark.range(25).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        stream.writeStream.queryName("good").format("noop").option("checkpointLocation", str(tmp_path / "g")).trigger(availableNow=True).start().awaitTermination(60)
        bad = stream.select(F.raise_error(F.lit("no such luck")).alias("x")).writeStream.queryName("bad").format("noop").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="no such luck"):
            bad.awaitTermination(60)
        for _ in range(100):
            events = seen.rows(spark).collect()
            if sum(e["event"] in ("ended", "failed") for e in events) == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert sum(e["rows"] for e in events if e["event"] == "batch" and e["stream"] == "good") == 25
    assert [(e["stream"], "no such luck" in (e["reason"] or "")) for e in events if e["event"] == "failed"] == [("bad", True)]
    assert [e["stream"] for e in events if e["event"] == "ended"] == ["good"]


def test_busiest_minutes_of_a_stream(spark, tmp_path):
    from weft.operators.timeseries import peak_counts
    from weft.streaming import streams

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select((F.col("user_id") % 20).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    dense = events.withColumn("ts", F.timestamp_micros((F.unix_micros("ts") / 200).cast("bigint"))).unionByName(events.limit(1).withColumn("ts", F.lit(None).cast("timestamp")))
    dense.orderBy("ts").repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(dense.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = streams.busiest(stream, "user_id", "ts", 10, "60 days")
        found.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")) and None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset(provider)
    got = {r["key"]: r["peak"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("key").agg(F.max("peak").alias("peak")).collect()}
    want = {r["key"]: r["peak"] for r in peak_counts(dense.where("ts is not null"), "user_id", "ts").collect()}
    assert got == want and max(want.values()) > 1


def test_csv_keeps_blanks_and_empty_cells(spark, tmp_path):
    cells = ["", None, " ", "\n", " lead", "trail \n", "x\r\n", "\0", ' "q" ', '"', "\\", 'a,"b\n', "\ufeff"]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, t string").coalesce(1)
    export(df, str(tmp_path / "csv"), "csv")
    back = {int(r["id"]): r["t"] for r in read_table(spark, str(tmp_path / "csv"), "csv", "auto").collect()}
    assert back == dict(enumerate(cells))
