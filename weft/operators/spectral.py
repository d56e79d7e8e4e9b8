"""Clusters of a network from its normalised Laplacian, whatever its size, and how well they are told apart.

The leading vectors of the network come from block power iteration: the edge table times a table of some numbers a node,
put at right angles again by the block's small Gram matrix. Only that matrix reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weft.errors import OpError, need_columns, need_positive
from weft.operators.skew import join_table
from weft.runtime import checkpoint

#: Eigenvalues among which the largest gap is sought.
GAPS = 20
#: Vectors carried besides those asked for, which makes the others settle sooner.
SPARE = 4
#: Products between two times that the block is put at right angles.
STEPS = 3
#: Numbers of the block (nodes by vectors) that are broadcast to the links, 8 bytes each.
BROADCAST_NUMBERS = 16_000_000


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]) if batch.num_rows else np.zeros((0, len(names)))


def _gram(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """The products of all columns of two lists, summed over the rows: by partition in numpy, then by place."""

    def run(batches):
        total = np.zeros((len(left), len(right)))
        for batch in batches:
            total += _matrix(batch, left).T @ _matrix(batch, right)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

    both = rows.select(*left, *right) if left != right else rows.select(*left)
    found = both.mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # as many as the matrix has places
    out = np.zeros(len(left) * len(right))
    for r in found:
        out[r["i"]] = r["x"]
    return out.reshape(len(left), len(right))


def _combined(rows: DataFrame, names: list[str], by: np.ndarray, key: str) -> DataFrame:
    """``key`` and the columns ``names`` times a small matrix."""
    made = names[: by.shape[1]]

    def run(batches):
        for batch in batches:
            out = _matrix(batch, names) @ by
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), *(pa.array(np.ascontiguousarray(out[:, i])) for i in range(by.shape[1]))], names=[key, *made])

    return rows.select(key, *names).mapInArrow(run, StructType([rows.schema[key], *(StructField(c, DoubleType()) for c in made)]))


def _upright(rows: DataFrame, names: list[str], key: str) -> DataFrame:
    """The columns made of length 1 and at right angles; what has no direction of its own left becomes zeros."""
    rows = checkpoint(rows)
    values, vectors = np.linalg.eigh(_gram(rows, names, names))
    scale = np.where(values > values.max() * 1e-13, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return checkpoint(_combined(rows, names, (vectors * scale)[:, ::-1], key))


def leading_vectors(edges: DataFrame, count: int, weight_col: str = "weight", rounds: int = 24) -> tuple[DataFrame, list[float], list[str]]:
    """``(node, v0, v1, ...)``, the eigenvalues of the normalised Laplacian from 0 on, and the names of the vectors.

    ``edges`` has ends ``a`` and ``b`` and positive weights; each node has an edge. The block starts from hashes of the
    nodes, so reruns agree. A hub's edges are dealt out when they meet its numbers.
    """
    need_columns("leading_vectors", "columns", edges, ["a", "b", weight_col])
    w = _col(weight_col).cast("double")
    plain = edges.where((w > 0) & F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    ends = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), w.alias("w"))
    links = plain.select(F.inline(F.array(ends("a", "b"), ends("b", "a"))))
    links = checkpoint(links.groupBy("x", "y").agg(F.sum("w").alias("w")))
    nodes = checkpoint(links.groupBy("x").agg(F.sum("w").alias("d"), F.count(F.lit(1)).alias("n")))
    n, m = nodes.count(), links.count()
    names = [f"v{i}" for i in range(max(1, min(count + SPARE, n)))]
    scaled = nodes.select("x", (1 / F.sqrt("d")).alias("s"))
    both = join_table(links, scaled, "x", nodes, n, m)
    both = join_table(both.withColumnRenamed("s", "sx"), scaled.withColumnRenamed("x", "y"), "y", nodes.withColumnRenamed("x", "y"), n, m)
    # dealt out once by the node that they lead to: a product then shuffles a row a node
    links = checkpoint(both.select("x", "y", (F.col("w") * F.col("sx") * F.col("s")).alias("w")).repartition("y"))
    start = lambda i: F.xxhash64("x", F.lit(i)).cast("double") / float(1 << 63)
    block = _upright(nodes.select("x", *[start(i).alias(c) for i, c in enumerate(names)]), names, "x") if n else nodes.select("x", *[F.lit(0.0).alias(c) for c in names])

    def times(block: DataFrame) -> DataFrame:
        """The network plus itself in place, times the block: its largest values are the Laplacian's smallest."""
        met = links.join(F.broadcast(block), "x") if n * len(names) <= BROADCAST_NUMBERS else join_table(links, block, "x", nodes, n, m)
        moved = met.groupBy(F.col("y").alias("x")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"{c}_") for c in names])
        return block.join(moved, "x").select("x", *[(F.col(c) + F.col(f"{c}_")).alias(c) for c in names])

    for _ in range(-(-rounds // STEPS) if n else 0):
        for _ in range(STEPS):
            block = times(block)
        block = _upright(block, names, "x")
    if not n:
        return block.withColumnRenamed("x", "node"), [], names
    image = times(block).select("x", *[F.col(c).alias(f"{c}_") for c in names])
    small = _gram(checkpoint(block.join(image, "x")), names, [f"{c}_" for c in names])
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[: max(1, min(count, n))]
    out = _combined(block, names, vectors[:, order], "x")
    return checkpoint(out.withColumnRenamed("x", "node")), [float(max(0.0, 2 - values[i])) for i in order], names[: len(order)]


def spectral_clusters(edges: DataFrame, k: int = 0, weight_col: str = "weight", seed: int = 42, rounds: int = 24) -> DataFrame:
    """``(node, cluster)`` from the normalised Laplacian; ``k`` 0 takes the largest gap of its first eigenvalues.

    Nodes are points of ``k`` leading vectors, scaled to length 1 and parted by k-means. Clusters are numbered from 0 in the
    order of their smallest nodes. Networks of any size; an empty one gives no rows.
    """
    if k < 0:
        raise OpError("spectral_clusters", "k", f"{k} is under 0")
    need_positive("spectral_clusters", "rounds", rounds)
    vectors, values, names = leading_vectors(edges, k or GAPS + 1, weight_col, rounds)
    if not values:
        return vectors.select("node", F.lit(0).alias("cluster"))
    k = k or (int(np.diff(values).argmax()) + 1 if len(values) > 2 else 1)
    names = names[:k]
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)))
    points = vectors.select("node", F.array(*[F.try_divide(F.col(c), size) for c in names]).alias("u"))
    points = points.select("node", F.transform("u", lambda x: F.coalesce(x, F.lit(0.0))).alias("u"))
    return clustered(points, "node", "u", min(len(names), k), seed)


def clustered(points: DataFrame, id_col: str, vector_col: str, k: int, seed: int = 42) -> DataFrame:
    """``(id, cluster)`` by k-means over a vector column, the best of some starts; clusters from 0 in the order of their smallest ids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = checkpoint(points.select(_col(id_col), array_to_vector(_col(vector_col)).alias("features")))
    if k < 2:
        return rows.select(_col(id_col), F.lit(0).alias("cluster"))
    models = [KMeans(k=k, seed=seed + i, maxIter=50, initSteps=5, featuresCol="features", predictionCol="c").fit(rows) for i in range(4)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    found = best.transform(rows).select(_col(id_col), "c")
    firsts = found.groupBy("c").agg(F.min(_col(id_col)).alias("first"))
    from pyspark.sql import Window

    number = firsts.select("c", (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster"))  # a row a cluster
    return found.join(F.broadcast(number), "c").select(_col(id_col), "cluster")


def silhouettes(df: DataFrame, id_col: str, vector_col: str, cluster_col: str, metric: str = "euclidean_squared") -> DataFrame:
    """``(id, cluster, silhouette)`` of each row with a vector and a cluster, exactly as from all pairs, in one pass over the rows.

    The mean squared distance of a row to a cluster follows from the sum of its vectors and of their squared lengths, the
    mean cosine distance from the sum of their directions, so only a row a cluster is sent to all tasks. A row alone in its
    cluster has 0; without a second cluster there is none to compare with, and all have 0. With ``cosine`` rows of length
    0 are left out.
    """
    need_columns("silhouettes", "columns", df, [id_col, vector_col, cluster_col])
    if metric not in ("euclidean_squared", "cosine"):
        raise OpError("silhouettes", "metric", f"{metric!r} is not euclidean_squared or cosine")
    v = F.transform(_col(vector_col), lambda x: x.cast("double"))
    rows = df.select(_col(id_col).alias("id"), _col(cluster_col).alias("cluster"), v.alias("v")).where("cluster is not null and v is not null and not exists(v, x -> x is null)")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("q", dot("v", "v"))
    if metric == "cosine":
        rows = rows.where("q > 0").withColumn("v", F.expr("transform(v, x -> x / sqrt(q))")).withColumn("q", F.lit(1.0))
    parts = rows.select("cluster", "q", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))
    sums = parts.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s"), F.max("n").alias("n"), F.max("q").alias("q"))  # the components of a vector
    few = checkpoint(sums.select("cluster", "n", "q", F.expr("transform(s, x -> x.s)").alias("s")))
    if few.count() > 10_000:
        raise OpError("silhouettes", "cluster_col", "over 10000 clusters; their sums go to all tasks")
    every = few.agg(F.collect_list(F.struct("cluster", "n", "q", "s")).alias("all"))  # at most so many clusters
    both = rows.crossJoin(F.broadcast(every))  # every is one row
    # the sum of squared distances to a cluster's rows, its own among them at 0
    total = lambda c: F.greatest(c["n"] * F.col("q") - 2 * dot("v", c["s"]) + c["q"], F.lit(0.0))
    half = 0.5 if metric == "cosine" else 1.0  # of directions the squared distance is twice the cosine one
    own = F.filter("all", lambda c: c["cluster"] == F.col("cluster"))[0]
    others = F.transform(F.filter("all", lambda c: c["cluster"] != F.col("cluster")), lambda c: total(c) * half / c["n"])
    out = both.select("id", "cluster", own["n"].alias("n"), (total(own) * half / F.greatest(own["n"] - 1, F.lit(1))).alias("a"), F.array_min(others).alias("b"))
    value = F.when((F.col("n") < 2) | F.col("b").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return out.select("id", "cluster", value.alias("silhouette"))
