"""Tables that cut lineage, in the folder that every executor shares.

They are removed when the program ends, and by ``drop`` as soon as nothing needs them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.names import unused


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return f"file://{tempfile.gettempdir()}/tokenloom-checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


class _Made(threading.local):
    """The tables that a thread has made; threads never drop each other's."""

    def __init__(self):
        self.paths: list[str] = []


_MADE = _Made()
_APPLICATIONS: set[str] = set()


def fresh_path(spark: SparkSession, label: str) -> str:
    application = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/tokenloom/{application}"
    if application not in _APPLICATIONS:
        _APPLICATIONS.add(application)
        atexit.register(_remove, spark, folder)
    _MADE.paths.append(f"{folder}/{uuid.uuid4().hex}/{label}")
    return _MADE.paths[-1]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        fs, where = filesystem(spark, path)
        fs.delete(where, True)
    elif path.startswith("file:"):  # the session is over
        shutil.rmtree(path.removeprefix("file:").replace("//", "/"), ignore_errors=True)


def made() -> int:
    """The number of this thread's tables so far, for ``drop``."""
    return len(_MADE.paths)


def drop(spark: SparkSession, since: int) -> None:
    """Remove all tables that this thread made since then but the last one, which must not need them any more."""
    for path in _MADE.paths[since:-1]:
        _remove(spark, path.rpartition("/")[0])
    del _MADE.paths[since:-1]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_of_each(df: DataFrame, *keys: Column) -> DataFrame:
    """Of the rows with equal keys, the one with the smallest hash of all columns; aggregated before it is shuffled."""
    names = unused(df, *[f"_k{n}" for n in range(len(keys))])
    row, least = F.struct(*[df[c] for c in df.columns]), F.xxhash64(*[df[c] for c in df.columns])
    found = df.groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg(F.min_by(row, least).alias("row"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path itself, as JVM objects."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
