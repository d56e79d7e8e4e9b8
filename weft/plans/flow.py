"""Pipelines of named steps, and workflows: graphs of nodes, each one lazy DataFrame."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.errors import OpError
from weft.functions.scalars import names_of
from weft.operators import aggregates, charts, columns, dedupe, entities, joins, order, segment, sparse, spectral, stats, text, timeseries, topics
from weft.runtime import checkpoint
from weft.sources.sinks import Lineage, export
from weft.sources.tables import from_rows, read_table

REGISTRY: dict[str, Callable] = {}


def register(name: str, op: Callable | None = None):
    """Add a step ``(df, **params) -> df``; also as a decorator."""
    if op is None:
        return lambda f: register(name, f)
    if name in REGISTRY:
        raise OpError("register", "name", f"{name!r} is taken")
    REGISTRY[name] = op
    return op


for _module, _names in (
    (columns, "select_columns rename_columns strip_whitespace convert_type fill_null drop_null filter_rows column_calc bin_column extract_time bin_time time_filter neutralise_formulas localise explode_links"),
    (joins, "join_tables anti_join reply_graph verify diff compare_snapshots"),
    (aggregates, "groupby_agg query compare_platform sentiment_evolution label_counts kappa chart_aggregate pivot histogram box_stats stacked_shares model_agreement h_index profile"),
    (charts, "sankey_links sankey_nodes dual_line scatter word_cloud"),
    (order, "sort_rows sample_rows page top_per_group"),
    (dedupe, "drop_duplicates dedupe_similar semantic_dedupe similar_to"),
    (timeseries, "suggest_stages forecast alert stage_order"),
    (segment, "learn_lexicon cut_words"),
    (entities, "entities"),
    (sparse, "dbscan_texts"),
    (spectral, "silhouettes"),
    (text, "word_counts keywords cooccurrence wash aggression text_rank"),
    (stats, "correlation significance anomaly cluster_texts dbscan bot_scores"),
    (topics, "topic_model topic_by_stage topic_map topic_salience topic_coherence topic_flow topic_timeline topic_labels vector_topics vector_clusters"),
):
    for _name in _names.split():
        register(_name, getattr(_module, _name))


#: Parameters that are lists of columns, which may be given as a comma-separated text.
NAME_LISTS = ("columns", "keys", "group_by", "ties")
#: Steps that take a second table.
TWO_TABLES = ("join_tables", "anti_join", "verify", "diff", "compare_snapshots")


def apply_steps(df: DataFrame, steps: list[dict], other: DataFrame | None = None) -> DataFrame:
    """The steps ``{"op": name, "params": {...}}`` one after the other; a two-table step takes ``other``. Lazy but for steps that say otherwise."""
    for k, step in enumerate(steps, 1):
        name = step.get("op")
        if name not in REGISTRY:
            raise OpError("pipeline", f"step {k}", f"{name!r} is no known step")
        params = {k: names_of(v) if k in NAME_LISTS and isinstance(v, str) else v for k, v in (step.get("params") or {}).items()}
        if name in TWO_TABLES:
            if other is None:
                raise OpError(name, "other", f"step {k} needs a second table")
            df = REGISTRY[name](df, other, **params)
        else:
            df = REGISTRY[name](df, **params)
    return df


#: Model-backed operations by name: ``Iterator[pandas.DataFrame] -> Iterator[pandas.DataFrame]``.
PROVIDERS: dict[str, tuple[Callable, str]] = {}


def register_provider(name: str, function: Callable, schema: str) -> None:
    """A model for an operation that needs one (zero-shot labels, coding, reranking, embeddings)."""
    PROVIDERS[name] = (function, schema)


def model_step(df: DataFrame, name: str) -> DataFrame:
    """Rows through a registered model, in Arrow batches; refused by name without one, never replaced by something weaker."""
    if name not in PROVIDERS:
        raise OpError(name, "provider", "no model is registered for it")
    function, schema = PROVIDERS[name]
    return df.mapInPandas(function, schema)


def compare_models(df: DataFrame, names: list[str], id_col: str) -> DataFrame:
    """One table of several models' answers: the columns that each gives, ``model``, and ``row``, the row's id.

    Fewer than two models, and models of other columns than the first, are refused by name.
    """
    if len(names) < 2:
        raise OpError("compare_models", "names", f"{len(names)} models; give two at least")
    out = None
    for name in names:
        answers = model_step(df, name)
        if id_col not in answers.columns:
            raise OpError("compare_models", "id_col", f"model {name!r} gives no column {id_col!r}")
        answers = answers.withColumn("model", F.lit(name)).withColumnRenamed(id_col, "row")
        if out is not None and set(out.columns) != set(answers.columns):
            raise OpError("compare_models", "names", f"model {name!r} gives other columns than {names[0]!r}")
        out = answers if out is None else out.unionByName(answers)
    return out


#: Scripts by name: function over pandas batches, schema of what it gives, version.
SCRIPTS: dict[str, tuple[Callable, str, int]] = {}


def register_script(name: str, function: Callable, schema: str) -> int:
    """Keep a script under a name; a name that is taken gets the next version, which is part of fingerprints. Returns the version."""
    version = SCRIPTS[name][2] + 1 if name in SCRIPTS else 1
    SCRIPTS[name] = function, schema, version
    return version


def script(df: DataFrame, function: Callable | str, schema: str = "") -> DataFrame:
    """A table through a Python function over pandas batches with a stated schema, or through a kept script by its name."""
    if isinstance(function, str):
        if function not in SCRIPTS:
            raise OpError("script", "function", f"no script is named {function!r}")
        function, schema, _ = SCRIPTS[function]
    return df.mapInPandas(function, schema)


def fingerprints(workflow: dict) -> dict[str, str]:
    """A hash for each node of its own description and those before it, so that equal work has an equal name."""
    nodes = {n["id"]: n for n in workflow["nodes"]}
    parents = {i: [c["from"] for c in workflow.get("connections", []) if c["to"] == i] for i in nodes}
    out: dict[str, str] = {}
    for i in ordered(workflow):
        what = {k: v for k, v in nodes[i].items() if k not in ("id", "x", "y")}
        if what.get("type") == "script":
            what["version"] = SCRIPTS[what["name"]][2] if what.get("name") in SCRIPTS else 0
        out[i] = hashlib.sha1(json.dumps([what, [out[p] for p in parents[i]]], sort_keys=True, default=str).encode()).hexdigest()
    return out


def ordered(workflow: dict) -> list[str]:
    """Node ids, each after its parents; cycles and unknown ends are refused."""
    nodes = [n["id"] for n in workflow["nodes"]]
    links = [(c["from"], c["to"]) for c in workflow.get("connections", [])]
    for a, b in links:
        for end in (a, b):
            if end not in nodes:
                raise OpError("workflow", "connections", f"no node {end!r}")
    done: list[str] = []
    while len(done) < len(nodes):
        ready = [n for n in nodes if n not in done and all(a in done for a, b in links if b == n)]
        if not ready:
            raise OpError("workflow", "connections", "the nodes form a circle")
        done += ready
    return done


def stored(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds a table whose writing was completed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def run_workflow(spark: SparkSession, workflow: dict, store: str = "", monitor=None) -> dict[str, DataFrame]:
    """Build each enabled node: ``source`` (path or rows), ``analysis`` (steps), ``merge``, ``fuse``, ``python`` (a registered step), ``model``,
    ``script`` (a kept script), ``accumulate`` (folder, identity) and ``output`` (path, format). A node that several others read is checkpointed once.

    With ``store``, a folder that all executors share, the rows of each node that only computes
    are written there under its fingerprint, and a later run takes them from there. A ``Monitor`` counts the
    rows of each node in the jobs that run it.
    """
    nodes = {n["id"]: n for n in workflow["nodes"] if not n.get("disabled")}
    links = [(c["from"], c["to"]) for c in workflow.get("connections", []) if c["from"] in nodes and c["to"] in nodes]
    kept = {"nodes": list(nodes.values()), "connections": [{"from": a, "to": b} for a, b in links]}
    out: dict[str, DataFrame] = {}
    prints = fingerprints(kept) if store else {}
    for i in ordered(kept):
        n, inputs = nodes[i], [out[a] for a, b in links if b == i]
        kind = n.get("type")
        done = f"{store.rstrip('/')}/{prints[i]}" if store and kind in ("analysis", "merge", "fuse", "python", "model", "script") else ""
        if done and stored(spark, done):
            out[i] = spark.read.parquet(done)
            continue
        if kind != "source" and not inputs:
            raise OpError(kind, "input", f"node {i!r} has none")
        if kind == "source":
            df = from_rows(spark, n["rows"], n.get("schema")) if "rows" in n else read_table(spark, n["path"], n.get("format", ""))
        elif kind == "analysis":
            df = apply_steps(inputs[0], n.get("steps", []), inputs[1] if len(inputs) > 1 else None)
        elif kind == "merge":
            df = joins.merge_tables(inputs, n.get("names"))
        elif kind == "fuse":
            df = joins.fuse(inputs, n["fields"], n["names"], n["id_fields"])
        elif kind == "python":
            df = apply_steps(inputs[0], [{"op": n["op"], "params": n.get("params")}])
        elif kind == "model":
            df = model_step(inputs[0], n["op"])
        elif kind == "script":
            df = script(inputs[0], n["name"])
        elif kind == "accumulate":
            lineage = Lineage(spark, n["folder"], n.get("identity"))
            lineage.append(inputs[0])
            df = lineage.read()
        elif kind == "output":
            df = joins.merge_tables(inputs) if len(inputs) > 1 else inputs[0]
            df = monitor.watch(i, df) if monitor else df
            export(df, n["path"], n.get("format", "parquet"), n.get("text_column", ""))
        else:
            raise OpError("workflow", "type", f"{kind!r} of node {i!r} is unknown")
        if monitor and kind != "output":
            df = monitor.watch(i, df)
        if done:
            df.write.mode("overwrite").parquet(done)
            df = spark.read.parquet(done)
        out[i] = checkpoint(df) if not done and sum(a == i for a, _ in links) > 1 else df
    return out


def compare_runs(spark: SparkSession, store: str, before: dict, after: dict, node: str, keys: list[str] | None = None) -> DataFrame:
    """The rows in which a node's stored output of one workflow differs from that of another, as in ``diff``; a node that was not run is refused."""
    tables = []
    for name, work in (("before", before), ("after", after)):
        prints = fingerprints(work)
        if node not in prints or not stored(spark, f"{store.rstrip('/')}/{prints[node]}"):
            raise OpError("compare_runs", name, f"node {node!r} has no stored output")
        tables.append(spark.read.parquet(f"{store.rstrip('/')}/{prints[node]}"))
    return joins.diff(*tables, keys)
