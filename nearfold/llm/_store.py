"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Documents of an Arrow batch at most: a batch stands in the JVM and in Python, several times in each.
BATCH = 2_000

_written: list[tuple[SparkSession, str]] = []


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's batches to BATCH rows; a smaller setting of its own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= BATCH:
        spark.conf.set(key, str(BATCH))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only in local runs where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="nearfold-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: the lineage ends there, and a lost executor takes
    no part of it along. Removed by forget(), or when the driver's Python ends."""
    spark = df.sparkSession
    _small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/nearfold-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables are written now."""
    return len(_written)


def forget(since: int) -> None:
    """Removes the tables written after mark() gave ``since``, but for the last: what led to it is not needed any more."""
    for spark, path in _written[since:-1]:
        _delete(spark, path)
    del _written[since:-1]


def _delete(spark: SparkSession, path: str) -> None:
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(hadoop).delete(p, True)


def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return


atexit.register(_remove)
