"""What operators share at run time: tables, fault-tolerant cuts of the lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weft.errors import OpError


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it by themselves."""
    root, context = str(Path(__file__).resolve().parent.parent), spark.sparkContext
    if os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_weft_sent", False):
        return
    path = Path(tempfile.mkdtemp(prefix="weft-")) / "weft.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(Path(root, "weft").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(path))
    context._weft_sent = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without the setting (tests); elsewhere a missing one is
    refused, as a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise OpError("checkpoint", "spark.checkpoint.dir", "set it to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weft-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as run at once, if it is read by fewer: for costly work on rows of a small or badly cut file."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name
