"""Reading gzip files of any kind, each in the way that splits it: BGZF files by ranges of blocks, large
members from many places at once, small files and small members in one task each."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import framing
from millrace.operators.fixtures import joined_lines
from millrace.plans.parallel import CHUNK, LEAST_CHUNK, opened, parallel_files, parallel_stats
from millrace.sources.pgz import PgzSource, listed


def large_members(path: str, chunk_size: int) -> list[str]:
    """The files at path that start with a plain member and have several chunks; looked at many at a time."""

    def large(name: str) -> bool:
        with opened(name) as f:
            return f.size() > 2 * chunk_size and framing.header(f.read_at(1 << 17, 0))[2] is None

    names = listed(path)
    with ThreadPoolExecutor(32) as pool:
        return [name for name, is_large in zip(names, pool.map(large, names)) if is_large]


def read_gz(spark: SparkSession, path: str, table: str = "bytes", chunk_size: int = CHUNK) -> DataFrame:
    """bytes (path, seq, bytes), lines (path, value), members (path, member_index, checks and lengths) or
    stats (path, uncompressed_bytes, members, chunks_decoded, speculation_failures) of a file, a folder
    or a glob. An invalid file fails. All files with large members are decoded by the same jobs."""
    chunk_size = max(chunk_size, LEAST_CHUNK)
    large = large_members(path, chunk_size)
    spark.dataSource.register(PgzSource)
    source = spark.read.format("pgz").option("chunkSize", chunk_size).option("leaveOut", "\n".join(large))
    shown = {
        "bytes": ["path", "seq", "bytes"], "lines": ["path", "value"],
        "members": ["path", "member_index", "crc32_expected", "isize_expected", "crc32_actual", "raw_length", "crc_ok", "isize_ok"],
        "stats": ["path", "uncompressed_bytes", "members", "chunks_decoded", "speculation_failures"],
    }[table]
    if table == "stats":
        found = source.option("table", "members").load(path)
        out = found.groupBy("path").agg(
            F.sum("raw_length").alias("uncompressed_bytes"), F.count(F.lit(1)).alias("members"), F.count(F.lit(1)).alias("chunks_decoded"), F.lit(0).cast("bigint").alias("speculation_failures")
        )
    else:
        out = source.option("table", table).load(path)
    out = out.select(shown)
    if large:
        decoded, members, dropped = parallel_files(spark, large, chunk_size)
        found = {"bytes": lambda: decoded, "lines": lambda: joined_lines(decoded), "members": lambda: members, "stats": lambda: parallel_stats(decoded, members, dropped)}[table]()
        out = out.unionByName(found.select(*[F.col(c).cast(out.schema[c].dataType) for c in shown]))
    return out
