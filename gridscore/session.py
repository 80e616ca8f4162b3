"""Session settings, the shared scratch folder and small dimension tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Large expressions are built from Python; recording the call site of every step costs more.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "gridscore", master: str | None = None, **extra: str) -> SparkSession:
    """Start (or reuse) a session. Without ``master`` the submitting cluster decides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    root = tempfile.mkdtemp(prefix="gridscore-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the scratch folder."""
    return os.path.join(scratch_root(spark), "gridscore", f"{name}-{uuid.uuid4().hex}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whatever file system its scheme names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return file_system.exists(hadoop_path)


def small_table(spark: SparkSession, schema: pa.Schema, rows: Sequence[tuple]) -> DataFrame:
    """A dimension given in code. It becomes a local relation, so its exact size is known
    to the optimizer and the broadcast threshold decides how it is joined."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(column), type=field.type) for column, field in zip(columns, schema)]
    return spark.createDataFrame(pa.table(arrays, schema=schema))


def strings(*names: str) -> pa.Schema:
    return pa.schema([(name, pa.string()) for name in names])


def source_bytes(df: DataFrame) -> int:
    """Length of the files that ``df`` reads; no job runs."""
    spark = df.sparkSession
    configuration, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    paths = [path_of(spark.sparkContext._jvm.java.net.URI(name)) for name in df.inputFiles()]
    return sum(path.getFileSystem(configuration).getFileStatus(path).getLen() for path in paths)
