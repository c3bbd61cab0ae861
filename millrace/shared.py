"""Helpers that every subpackage uses: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Python workers that can open this folder find the package in it, whatever their working folder."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine that
    has none gets a temporary folder, kept in the session; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("millrace.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.shared.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back. What follows no longer depends
    on executors' shuffle files, so a lost executor costs a task and not the whole lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table from written() that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run within this sends at most so many rows at a time to Python: for wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


@contextmanager
def small_row_groups(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written within this has so many rows in a row group: for wide rows, of which Parquet's writer else holds
    100 before it looks at their size, and its readers a whole group at once. zstd, unlike Snappy, decodes them without
    buffers outside the heap."""
    settings = {"parquet.block.row.count.limit": rows, "parquet.page.size.row.check.min": 1, "spark.sql.parquet.compression.codec": "zstd", "parquet.compression.codec.zstd.level": 1}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
