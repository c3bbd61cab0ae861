"""gzip data from tables, by Spark jobs: what the queries decode again."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import framing
from millrace.functions.checksums import combine
from millrace.plans.parallel import WIDE, opened, read_range
from millrace.shared import rows_a_batch


#: Files that go to Python at a time, and rows that are encoded at a time.
FILES, PIECE = 64, 1000


def path_of(key: str, rows: int) -> Column:
    """Files hold the rows whose keys fall in the same stretch of `rows` keys: bounded files, and
    more of them as the table grows."""
    return F.concat(F.lit("file-"), F.floor(F.col(key) / rows).cast("string"))


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Adds path, and seq (0, 1, ... within a path, in the order of key)."""
    return df.withColumn("path", path_of(key, rows)).withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy(key)).cast("long") - 1)


def _gathered(df: DataFrame, key: str, line: str, rows: int, encode) -> DataFrame:
    """path, content: the lines of a path in the order of key, each encoded where it is and then
    put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                some = batch.slice(at, PIECE)
                parts = [encode(k, (x or "").encode()) for k, x in zip(some.column("k").to_pylist(), some.column("line").to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column("path"), some.column("k"), pa.array(parts, pa.binary())], names=["path", "k", "part"])

    parts = df.select(path_of(key, rows).alias("path"), F.col(key).alias("k"), F.col(line).alias("line")).mapInArrow(run, "path string, k bigint, part binary")
    return parts.groupBy("path").agg(F.expr("listagg(part) WITHIN GROUP (ORDER BY k, part)").alias("content"))


def member_files(df: DataFrame, key: str, line: str, rows: int, empty: bool = False, single: bool = False, newline: bool = True) -> DataFrame:
    """A member for each row, with an empty member after it if empty is set; with single, one member
    for the whole file."""
    end = b"\n" if newline else b""
    if single:
        raw = _gathered(df, key, line, rows, lambda k, x: x + end)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([framing.compressed(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["path", "content"])

        return raw.mapInArrow(run, "path string, content binary")
    nothing = framing.compressed(b"") if empty else b""
    return _gathered(df, key, line, rows, lambda k, x: framing.compressed(x + end) + nothing)


def bgzf_files(df: DataFrame, key: str, line: str, rows: int, plain_from: int | None = None) -> DataFrame:
    """BGZF blocks for each row. Rows whose key modulo rows reaches plain_from are plain members, so
    that files turn from BGZF to plain gzip."""

    def encode(k, x):
        if plain_from is not None and k % rows >= plain_from:
            return framing.compressed(x + b"\n")
        return framing.bgzf(x + b"\n", end=False)

    return _gathered(df, key, line, rows, encode)


def damaged(df: DataFrame, key: str) -> DataFrame:
    """path (the key as text) and content: the gzip value damaged in one of nine ways by key modulo 9."""
    content, n = F.col("content"), F.length("content")
    part = lambda a, size=None: F.substring(content, F.lit(a), size if size is not None else n)
    wrong = lambda a: F.concat(F.substring(content, F.lit(1), a - 1), F.when(F.substring(content, a, F.lit(1)) == F.lit(b"\x00"), F.lit(b"\x01")).otherwise(F.lit(b"\x00")), F.substring(content, a + 1, n))
    crc, size = n - 7, n - 3
    way = F.col(key) % 9
    out = (
        F.when(way == 1, F.concat(F.lit(b"\x1f\x8c"), part(3))).when(way == 2, F.concat(part(1, F.lit(2)), F.lit(b"\x07"), part(4)))
        .when(way == 3, F.concat(part(1, F.lit(3)), F.lit(b"\x20"), part(5))).when(way == 4, part(1, n - 5))
        .when(way == 5, wrong(crc)).when(way == 6, wrong(size)).when(way == 7, wrong(crc)).when(way == 8, F.concat(content, F.lit(b"\x00" * 4))).otherwise(content)
    )
    return df.select(F.col(key).cast("string").alias("path"), out.alias("content"))


def created(path: str):
    """A file to write at a path that executors can open."""
    where = urlparse(path)
    system, name = (pafs.LocalFileSystem(), where.path or path) if where.scheme in ("", "file") else pafs.FileSystem.from_uri(path)
    system.create_dir(name.rsplit("/", 1)[0])
    return system.open_output_stream(name, compression=None)


def saved(files: DataFrame, folder: str) -> str:
    """Writes each file (path, content) into a new folder, where its row is, and returns the folder."""
    target = f"{folder}/files-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with created(f"{target}/{path}.gz") as f:
                    f.write(content.as_buffer())
            yield batch.select(["path"])

    with rows_a_batch(files.sparkSession, FILES):
        files.select("path", "content").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
    return target


def _joined(spark: SparkSession, parts: list[str], target: str, head: bytes = b"", tail: bytes = b"") -> str:
    """Writes the files one after the other to target. One task copies: it is one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with created(target) as out:
                out.write(head)
                for part in parts:
                    with opened(part) as f:
                        while piece := f.read(1 << 22):
                            out.write(piece)
                out.write(tail)
            yield batch

    spark.range(0, 1, 1, 1).mapInArrow(run, "id bigint").write.format("noop").mode("overwrite").save()
    return target


def _one_member(pieces: DataFrame, raw_of, target: str) -> str:
    """One gzip member of what raw_of(batch) yields for the rows of pieces, in the order of their partitions. Each
    partition is compressed by its own task, up to a byte's end; then the parts are copied together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, crc, size, k = zlib.compressobj(6, zlib.DEFLATED, -15), 0, 0, TaskContext.get().partitionId()
        name = f"{target}.parts/{k}-{uuid.uuid4().hex}"
        with created(name) as out:
            for batch in batches:
                for raw in raw_of(batch):
                    crc, size = zlib.crc32(raw, crc), size + len(raw)
                    out.write(engine.compress(raw))
            out.write(engine.flush(zlib.Z_SYNC_FLUSH))
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([name]), pa.array([crc], pa.int64()), pa.array([size], pa.int64())], names=["k", "name", "crc", "size"])

    done = sorted(pieces.mapInArrow(run, "k bigint, name string, crc bigint, size bigint").collect())
    crc = size = 0
    for part in done:
        crc, size = combine(crc, part["crc"], part["size"]), size + part["size"]
    nothing = framing.compressed(b"")
    return _joined(pieces.sparkSession, [part["name"] for part in done], target, nothing[: framing.HEADER], nothing[framing.HEADER : -framing.TRAILER] + struct.pack("<II", crc, size & 0xFFFFFFFF))


def one_file(lines: DataFrame, folder: str) -> str:
    """Writes the lines as one gzip file of one member and returns its path."""

    def raw_of(batch: pa.RecordBatch) -> Iterator[bytes]:
        values = batch.column(0).to_pylist()
        yield ("\n".join(x or "" for x in values) + "\n" * (len(values) > 0)).encode()

    return _one_member(lines, raw_of, f"{folder}/one-{uuid.uuid4().hex}.gz")


def again_compressed(spark: SparkSession, path: str, piece: int = 8 << 20) -> str:
    """Writes the bytes of a file as one gzip member beside it."""
    with opened(path) as f:
        n = -(-f.size() // piece)

    def raw_of(batch: pa.RecordBatch) -> Iterator[bytes]:
        for k in batch.column(0).to_pylist():
            yield read_range(path, k * piece, (k + 1) * piece)

    return _one_member(spark.range(0, n, 1, max(1, n)), raw_of, f"{path}.again.gz")


def whole_file(decoded: DataFrame, folder: str) -> str:
    """Writes gz_bytes rows (path, seq, bytes) of one file as a file and returns its path: each row where it is, then
    the parts are copied together."""
    target = f"{folder}/whole-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for seq, content in zip(batch.column("seq").to_pylist(), batch.column("bytes")):
                names.append(f"{target}.parts/{seq}-{uuid.uuid4().hex}")
                with created(names[-1]) as f:
                    f.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(names, pa.string())], names=["seq", "name"])

    with rows_a_batch(decoded.sparkSession, WIDE):
        done = sorted(decoded.select("seq", "bytes").mapInArrow(run, "seq bigint, name string").collect())
    return _joined(decoded.sparkSession, [part["name"] for part in done], target)


def joined_lines(decoded: DataFrame) -> DataFrame:
    """path, value: lines from gz_bytes rows (path, seq, bytes). What stands between the first and the last line end
    of a row is cut by Spark. A line that runs over rows is put together from the end of one row and the start of
    the next ones: only these ends are gathered by path."""
    b, text = F.col("bytes"), F.col("bytes").cast("string")
    # what is not UTF-8 stays as it is: line ends are looked for by bytes
    head, tail = (F.substring_index(text, "\n", k).cast("binary") for k in (1, -1))
    size, first, behind = F.octet_length(b), F.octet_length(head), F.octet_length(tail)
    several = first + behind + 1 < size
    whole = decoded.where(several).select("path", F.substring(b, first + 2, size - first - behind - 2).alias("whole"))
    lines = whole.select("path", F.explode(F.split(F.decode("whole", "UTF-8"), "\n")).alias("value"))
    kinds = F.array(F.struct(F.lit(1).alias("kind"), head.alias("value")), F.struct(F.lit(2).alias("kind"), tail.alias("value")))
    ends = decoded.select("path", "seq", F.inline(F.when(first < size, kinds).otherwise(F.slice(kinds, 1, 1))))
    order = Window.partitionBy("path").orderBy("seq", "kind")
    # a line starts at each last part (kind 2), and at the very first row
    line = ends.withColumn("line", F.sum((F.col("kind") == 2).cast("int")).over(order))
    whole = line.groupBy("path", "line").agg(F.expr("listagg(value) WITHIN GROUP (ORDER BY seq, kind)").alias("value"))
    # what stands behind the last line end is a line only if something does
    last = F.max("line").over(Window.partitionBy("path")) == F.col("line")
    values = whole.withColumn("last", last).where("NOT last OR octet_length(value) > 0")
    return lines.unionByName(values.select("path", F.decode("value", "UTF-8").alias("value")))
