"""A cumulative dataset with versions: what an append adds is there at once or not at all, and it reads only what may hold its keys.

A version is a folder of parts by ranges of key hashes, a Bloom filter for each part, and a manifest entry that is renamed
into place when both are written; without the entry nothing of the version counts. An append asks the filters of all versions
which parts may hold one of its keys, and joins with the rows of those parts alone.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.errors import OpError, need_columns
from weft.runtime import checkpoint, ship

#: Keys of a part, about; and bits of its filter for each, with so many hashes: one key in a million passes wrongly.
PART_KEYS, KEY_BITS, HASHES = 500_000, 30, 20
_ENTRY = "version int, data string, parts int, rows bigint, columns string"
#: The first 32 bits of a key's hash as a number.
_RANGE = "cast(conv(substr(_key, 1, 8), 16, 10) as bigint)"


def _places(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key, a line each."""
    with np.errstate(over="ignore"):
        step = second.astype(np.uint64) | np.uint64(1)
        return ((first.astype(np.uint64)[:, None] + np.arange(HASHES, dtype=np.uint64)[None] * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _filter(pdf: pd.DataFrame) -> pd.DataFrame:
    bits = max(64, KEY_BITS * len(pdf) // 8 * 8)
    held = np.zeros(bits, bool)
    for at in range(0, len(pdf), 1 << 16):
        held[_places(pdf["h1"].to_numpy()[at : at + (1 << 16)], pdf["h2"].to_numpy()[at : at + (1 << 16)], bits).ravel()] = True
    return pd.DataFrame({"part": [pdf["_part"].iloc[0]], "n": [len(pdf)], "bits": [np.packbits(held).tobytes()]})


def _may_hold(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The part, if one of the keys may be in it."""
    found = False
    if len(keys) and len(filters):
        held = np.unpackbits(np.frombuffer(filters["bits"].iloc[0], np.uint8)).astype(bool)
        for at in range(0, len(keys), 1 << 16):
            some = keys.iloc[at : at + (1 << 16)]
            if held[_places(some["h1"].to_numpy(), some["h2"].to_numpy(), len(held))].all(axis=1).any():
                found = True
                break
    return filters[["version", "part"]].head(1) if found else filters[["version", "part"]].head(0)


class Lineage:
    """Rows whose identity is known are not added again; each change is a version, and nothing is rewritten.

    ``parts_read`` says how many parts the last append read, ``capped`` whether it left rows out. Two appends at once: the
    one that comes second to its manifest entry is refused and leaves nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, identity: list[str] | None = None):
        self.spark, self.folder, self.identity, self.capped, self.parts_read = spark, folder.rstrip("/"), identity, False, 0

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self) -> list:
        """The manifest, a row a version."""
        path, files = self._files()
        if not files.exists(path(f"{self.folder}/manifest")):
            return []
        return self.spark.read.schema(_ENTRY).json(f"{self.folder}/manifest/*.json").orderBy("version").collect()

    def versions(self) -> DataFrame:
        """``(version, rows)`` of what each version added."""
        return self.spark.createDataFrame([(e["version"], e["rows"]) for e in self._entries()], "version int, rows bigint")

    def latest(self) -> int:
        return max((e["version"] for e in self._entries()), default=0)

    def _rows(self, entries: list) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/_set={e['data']}" for e in entries])

    def read(self, version: int | None = None) -> DataFrame:
        entries = [e for e in self._entries() if version is None or e["version"] <= version]
        if not entries:
            raise OpError("lineage", "folder", f"{self.folder} has no data yet")
        return self._rows(entries).select(*[F.col(f"`{c}`") for c in json.loads(entries[0]["columns"])])

    def _known(self, new: DataFrame, entries: list) -> DataFrame | None:
        """The keys of the parts that may hold one of ``new``; None if there is none."""
        sizes = self.spark.createDataFrame([(e["version"], e["data"], e["parts"]) for e in entries], "version int, data string, parts int")
        # a key can be in one part of each version
        asked = new.select("h1", "h2", F.expr(_RANGE).alias("r")).crossJoin(F.broadcast(sizes)).select("h1", "h2", "version", F.expr("cast(r * parts div 4294967296 as int)").alias("part"))
        filters = None
        for e in entries:
            one = self.spark.read.parquet(f"{self.folder}/filters/{e['data']}").select(F.lit(e["version"]).alias("version"), "part", "bits")
            filters = one if filters is None else filters.unionByName(one)
        hit = asked.groupBy("version", "part").cogroup(filters.groupBy("version", "part")).applyInPandas(_may_hold, "version int, part int").collect()  # a row a part
        self.parts_read = len(hit)
        folders = {e["version"]: e["data"] for e in entries}
        return self.spark.read.option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/_set={folders[h['version']]}/_part={h['part']}" for h in hit]).select("_key") if hit else None

    def append(self, df: DataFrame, max_rows: int | None = None) -> int:
        """Add rows with new identities; returns the version, the same as before if there are none. Other columns than before are refused.

        With ``max_rows`` the dataset takes no more rows than that, those with the smallest
        identities first; ``capped`` then says whether some were left out.
        """
        keys = self.identity or df.columns
        need_columns("lineage", "identity", df, keys)
        ship(self.spark)
        entries = self._entries()
        if entries and set(json.loads(entries[0]["columns"])) != set(df.columns):
            raise OpError("lineage", "df", f"its columns are {', '.join(df.columns)}, those of the dataset {', '.join(json.loads(entries[0]['columns']))}")
        version, self.capped, self.parts_read = self.latest() if entries else 0, False, 0
        key = F.sha1(F.concat_ws("\u001f", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\u0000")) for k in keys]))
        new = checkpoint(df.withColumn("_key", key).dropDuplicates(["_key"]).withColumns({"h1": F.xxhash64("_key"), "h2": F.xxhash64(F.lit(1), "_key")}))
        known = self._known(new, entries) if entries else None
        if known is not None:
            new = checkpoint(new.join(known, "_key", "left_anti"))
        if max_rows is not None:
            room = max(0, max_rows - sum(e["rows"] for e in entries))
            self.capped = new.count() > room
            new = checkpoint(new.orderBy("_key").limit(room)) if self.capped else new
        rows = new.count()
        if rows:
            self._commit(new, version + 1, rows, df.columns)
            version += 1
        return version

    def _commit(self, new: DataFrame, version: int, rows: int, columns: list[str]) -> None:
        path, files = self._files()
        name, parts = f"{version}-{uuid.uuid4().hex}", -(-rows // PART_KEYS)
        parted = new.withColumn("_part", F.expr(f"cast({_RANGE} * {parts} div 4294967296 as int)"))
        entry = json.dumps({"version": version, "data": name, "parts": parts, "rows": rows, "columns": json.dumps(columns)})
        draft, done = f"{self.folder}/drafts/{name}", False
        try:
            (parted.repartition(parts, "_part") if parts > 1 else parted).drop("h1", "h2").write.partitionBy("_part").parquet(f"{self.folder}/data/_set={name}")
            parted.select("_part", "h1", "h2").groupBy("_part").applyInPandas(_filter, "part int, n bigint, bits binary").write.parquet(f"{self.folder}/filters/{name}")
            files.mkdirs(path(f"{self.folder}/manifest"))
            out = files.create(path(draft), False)
            out.write(bytearray(entry.encode()))
            out.close()
            done = files.rename(path(draft), path(f"{self.folder}/manifest/{version:09d}.json"))
        finally:
            if not done:
                for left in (f"data/_set={name}", f"filters/{name}", f"drafts/{name}"):
                    files.delete(path(f"{self.folder}/{left}"), True)
        if not done:
            raise OpError("lineage", "version", f"{version} has been written by another append meanwhile")

    def reset(self) -> None:
        """Empty the dataset; the next rows are version 1 again and may have other columns."""
        path, files = self._files()
        for kind in ("manifest", "data", "filters", "drafts"):  # the manifest first: then nothing counts
            files.delete(path(f"{self.folder}/{kind}"), True)
