"""Operator 4: sharding with size-tiered compaction.

A store is a folder of immutable Parquet shards and of numbered manifests; the
newest manifest is the table. ``append`` writes arrivals as small shards.
``compact`` looks for tiers (powers of ``fanout``) with at least ``fanout``
shards below the target size and merges each such tier into files of about the
target size: shards are dealt over the files by their bytes, tasks read whole
shards and write one file each, so nothing is shuffled. A change counts once its
manifest is in place under a number that was free; if another writer took that
number, the change is tried again on top of the new manifest, or given up if
shards that it merged are gone. Files that no manifest names (lost tasks,
given-up changes, a writer that died before its manifest) are never read, and
``vacuum`` removes them.

A manifest is put in place by a hard link on local and mounted file systems and
by a rename without overwriting elsewhere. Both are atomic on POSIX systems and
HDFS; an object store whose rename copies needs one writer at a time.

Rows, nulls, repeated rows, very long texts and further columns are stored as
they come, whatever their names; an empty arrival adds a version without shards.
There are no ties: shards of equal size are taken by their paths. The schema of
a manifest has the columns of all arrivals, null in the rows of those without; an
arrival with a column of another type than before is refused.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm import scratch

#: New files that one job writes.
JOB_FILES = 64


class Conflict(RuntimeError):
    """Another writer removed shards that this change needs."""


@dataclass(frozen=True)
class Settings:
    target_bytes: int = 128 << 20
    base_bytes: int = 1 << 20
    fanout: int = 4


def merge_schemas(old: str | None, new: str | None) -> str | None:
    """The columns of ``old`` and those that only ``new`` has, as JSON."""
    if not old or not new or old == new:
        return old or new
    fields = T.StructType.fromJson(json.loads(old)).fields
    known = {f.name.lower(): f for f in fields}
    added = []
    for f in T.StructType.fromJson(json.loads(new)).fields:
        had = known.get(f.name.lower())
        if had is None:
            added.append(f)
        elif had.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {had.dataType.simpleString()} in the store, and not {f.dataType.simpleString()}")
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in fields + added]).json() if added else old


class Store:
    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        self.fs, _ = scratch.filesystem(spark, self.root)
        self.jvm = spark.sparkContext._jvm

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _list(self, name: str) -> list:
        path = self._path(name)
        return list(self.fs.listStatus(path)) if self.fs.exists(path) else []

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._list("manifests")]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path(f"manifests/v{version:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> bool:
        """Put the manifest in place if its number is free."""
        draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target = self._path(f"manifests/v{manifest['version']:09d}.json")
        try:
            return self._link(draft, target) if self.fs.getUri().getScheme() == "file" else self._rename(draft, target)
        finally:
            self.fs.delete(draft, False)

    def _link(self, draft, target) -> bool:
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        return True

    def _rename(self, draft, target) -> bool:
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(target), none)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def _change(self, schema: str | None, added: list[dict], gone: set[str]) -> int:
        while True:
            now = self.manifest()
            if gone - {s["path"] for s in now["shards"]}:
                raise Conflict("shards to be merged are gone")
            shards = [s for s in now["shards"] if s["path"] not in gone] + added
            if self._commit({"version": now["version"] + 1, "schema": merge_schemas(now["schema"], schema), "shards": shards}):
                return now["version"] + 1

    def _write(self, df: DataFrame) -> list[dict]:
        name = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        files = [(s.getPath().getName(), s.getLen()) for s in self._list(name)]
        return [{"path": f"{name}/{f}", "bytes": n} for f, n in sorted(files) if f.endswith(".parquet")]

    def _read(self, paths: list[str], schema: str | None) -> DataFrame:
        shape = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType()
        if not paths:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(*[f"{self.root}/{p}" for p in paths])

    def append(self, df: DataFrame) -> int:
        schema = df.schema.json()
        merge_schemas(self.manifest()["schema"], schema)  # refuses before anything is written
        return self._change(schema, self._write(df), set())

    def tier(self, size: int) -> int:
        s = self.settings
        return max(0, int(math.log(max(size, 1) / s.base_bytes, s.fanout))) if size > s.base_bytes else 0

    def due(self, shards: list[dict]) -> list[list[dict]]:
        """Tiers to merge: similarly sized shards, each below half of the target."""
        s, tiers = self.settings, {}
        for shard in shards:
            if 2 * shard["bytes"] < s.target_bytes:
                tiers.setdefault(self.tier(shard["bytes"]), []).append(shard)
        return [sorted(t, key=lambda x: (x["bytes"], x["path"])) for _, t in sorted(tiers.items()) if len(t) >= s.fanout]

    def _files(self, group: list[dict]) -> list[list[list[str]]]:
        """The shards of each new file, dealt out by bytes, in runs of ``JOB_FILES`` files."""
        total = sum(x["bytes"] for x in group)
        bins: list[list] = [[0, n, []] for n in range(min(len(group), max(1, round(total / self.settings.target_bytes))))]
        for shard in sorted(group, key=lambda x: (-x["bytes"], x["path"])):
            least = bins[0]
            heapq.heapreplace(bins, [least[0] + shard["bytes"], least[1], [*least[2], shard["path"]]])
        paths = [b[2] for b in sorted(bins, key=lambda b: b[1])]
        return [paths[i : i + JOB_FILES] for i in range(0, len(paths), JOB_FILES)]

    def compact(self) -> int:
        """Merge until no tier is due; the number of merges."""
        done, now = 0, self.manifest()
        while groups := self.due(now["shards"]):
            before = len(now["shards"])
            for group in groups:
                merged = [f for files in self._files(group) for f in self._write(reduce(DataFrame.unionAll, [self._read(paths, now["schema"]).coalesce(1) for paths in files]))]
                self._change(now["schema"], merged, {x["path"] for x in group})
                done += 1
            now = self.manifest()
            if len(now["shards"]) >= before:
                break
        return done

    def vacuum(self, versions: int = 1) -> None:
        """Remove the files that none of the last ``versions`` manifests name. No writer may be at work."""
        last = self.version()
        named = {s["path"] for v in range(max(1, last - versions + 1), last + 1) for s in self.manifest(v)["shards"]}
        for folder in self._list("data"):
            name = f"data/{folder.getPath().getName()}"
            held = [f"{name}/{f.getPath().getName()}" for f in self._list(name)]
            for path in held:
                if path not in named:
                    self.fs.delete(self._path(path), False)
            if not named & set(held):
                self.fs.delete(self._path(name), True)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read([s["path"] for s in m["shards"]], m["schema"])


def query(spark: SparkSession, sf_dir: str, arrivals: int = 4) -> DataFrame:
    """The whole table in ``arrivals`` appends, compacted, as the newest manifest has it. Each append reads the table for its own rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = Store(spark, scratch.fresh_path(spark, "shards"))
    for i in range(arrivals):
        store.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == i))
        store.compact()
        store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


SQL = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"
