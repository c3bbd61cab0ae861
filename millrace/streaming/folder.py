"""A folder of gzip files as a stream: each new file is decoded once, in the micro-batch that finds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import members

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, table: str = "lines", files_per_trigger: int = 64) -> DataFrame:
    """The stream of a table of millrace.operators.members (lines, bytes or members). Rows of a file
    come together, in order; of different files in no order. An invalid file fails the query."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return {"lines": members.gz_lines, "bytes": members.gz_bytes, "members": members.gz_members}[table](files)
