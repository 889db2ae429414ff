"""Cutting the lineage of iterative plans, and tables that several queries share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_shared: dict[tuple, DataFrame] = {}


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local runs without it a folder of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = context.getConf().get("spark.checkpoint.dir")
        if not where and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="nearfold-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in folder()."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` by way of a Parquet table in folder(): a checkpoint keeps what the optimiser knows of its columns, from which it infers
    filters without end where joins go on from columns that were equal once."""
    path = f"{folder(df.sparkSession)}/nearfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, path: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make() once for a session and the files at ``path`` as they are now, written (a checkpoint makes its last stage twice)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in at.getFileSystem(conf).listStatus(at)))
    key = (spark.sparkContext.applicationId, name, files)
    if key not in _shared:
        _shared[key] = written(make())
    return _shared[key]
