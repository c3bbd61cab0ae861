"""Tables from files' bytes: members, decoded bytes, files, statistics, lines.

Input is a DataFrame with path and content, as spark.read.format("binaryFile") gives it; it may be
on any store that Spark reads. mode is "FAILFAST" (the first invalid member fails the job) or
"PERMISSIVE" (the members before it are returned; the members table gets a row with error).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import framing

MEMBERS = (
    "path string, member_index int, header_offset bigint, body_offset bigint, trailer_offset bigint, flg int, bgzf_block_size int, crc32_expected bigint, isize_expected bigint, "
    "crc32_actual bigint, raw_length bigint, crc_ok boolean, isize_ok boolean, error string"
)
BYTES = "path string, seq bigint, raw_offset bigint, bytes binary"
FILES = "path string, length bigint, kind string"
#: A decoded row has at most so many bytes.
ROW = 16 << 20
#: So many lines make a batch.
LINES = 10_000


def _arrow(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))]))


def _over_files(df: DataFrame, rows_of, schema: str) -> DataFrame:
    """rows_of(path, content) yields lists of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for rows in rows_of(path, content):
                    yield _arrow(rows, schema)

    return df.select("path", "content").mapInArrow(run, schema)


def gz_members(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """One row per member with its offsets and checks; a null content is an empty file."""

    def rows_of(path, content):
        rows = []
        try:
            for raw, row in framing.members(content or b""):
                rows.append({"path": path, "member_index": len(rows)} | row)
        except framing.GzError as why:
            if mode == "FAILFAST":
                raise
            rows.append({"path": path, "member_index": len(rows), "error": why.kind})
        yield rows

    return _over_files(files, rows_of, MEMBERS)


def gz_bytes(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Decoded bytes in order of (path, seq); a member over ROW bytes makes several rows. Nothing of
    an invalid member is returned."""

    def rows_of(path, content):
        seq = offset = 0
        try:
            for raw, _ in framing.members(content or b""):
                for at in range(0, len(raw), ROW):
                    part = raw[at : at + ROW]
                    yield [{"path": path, "seq": seq, "raw_offset": offset, "bytes": part}]
                    seq, offset = seq + 1, offset + len(part)
        except framing.GzError:
            if mode == "FAILFAST":
                raise

    return _over_files(files, rows_of, BYTES)


def gz_files(files: DataFrame) -> DataFrame:
    """kind: bgzf, gzip, bgzf+gzip (a BGZF start that goes on as plain members), or invalid. Of BGZF
    only headers are read."""

    def kind(content) -> str:
        try:
            end, _, block = framing.header(content)
        except framing.GzError:
            return "invalid"
        if block is None:
            return "gzip"
        at = 0
        while at < len(content):
            try:
                _, _, block = framing.header(content, at)
            except framing.GzError:
                return "invalid"
            if block is None:
                return "bgzf+gzip"
            at += block
        return "bgzf" if at == len(content) else "invalid"

    return _over_files(files, lambda path, content: [[{"path": path, "length": len(content or b""), "kind": kind(content or b"")}]], FILES)


def bgzf_splits(files: DataFrame, target: int = 1 << 20) -> DataFrame:
    """path, seq, content: whole BGZF blocks dealt into parts of about target bytes, found by hopping
    from header to header. From the first member that is not BGZF the rest is one part. The parts
    of one file are decoded by different tasks."""

    def rows_of(path, content):
        at = start = seq = 0
        content = content or b""
        while at < len(content):
            try:
                block = framing.header(content, at)[2]
            except framing.GzError:
                block = None
            step = block if block and at + block <= len(content) else len(content) - at
            if at > start and (at + step - start > target or not block):
                yield [{"path": path, "seq": seq, "raw_offset": start, "bytes": content[start:at]}]
                start, seq = at, seq + 1
            at += step
        yield [{"path": path, "seq": seq, "raw_offset": start, "bytes": content[start:]}]

    return _over_files(files, rows_of, BYTES).select("path", "seq", F.col("raw_offset").alias("offset"), F.col("bytes").alias("content"))


def split_bytes(files: DataFrame, target: int = 1 << 20, tasks: int | None = None) -> DataFrame:
    """gz_bytes of BGZF and mixed files, decoded in parts by many tasks: path, part, seq, bytes."""
    parts = bgzf_splits(files, target)
    dealt = parts.repartition(tasks, "path", "seq") if tasks else parts.repartition("path", "seq")
    named = dealt.select(F.to_json(F.struct("path", "seq")).alias("path"), "content")
    own = F.from_json("path", "path string, seq bigint")
    return gz_bytes(named).select(own["path"].alias("path"), own["seq"].alias("part"), "seq", "bytes")


def gz_stats(files: DataFrame) -> DataFrame:
    """path, compressed_bytes, uncompressed_bytes, members."""
    sizes = files.groupBy("path").agg(F.sum(F.length("content")).alias("compressed_bytes"))
    raw = gz_members(files).groupBy("path").agg(F.sum("raw_length").alias("uncompressed_bytes"), F.count(F.lit(1)).alias("members"))
    return sizes.join(raw, "path")


def gz_lines(files: DataFrame) -> DataFrame:
    """path, value: the lines of the decoded text. A line may run over members; the lines of many small
    members make one batch."""

    def rows_of(path, content):
        rest, held, size = b"", [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array(held, pa.string())], names=["path", "value"])

        for raw in framing.raws(content or b""):
            *lines, rest = (rest + raw).split(b"\n")
            held += [x.decode("utf-8", "replace") for x in lines]
            size += len(raw)
            if len(held) >= LINES or size >= ROW:
                yield told()
                held, size = [], 0
        if rest:
            held.append(rest.decode("utf-8", "replace"))
        if held:
            yield told()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield from rows_of(path, content.as_py())

    return files.select("path", "content").mapInArrow(run, "path string, value string")


def decompressed(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds out: the decoded bytes of a binary column, all members of each value. An empty value
    decodes to nothing, null to null; an invalid one fails."""

    def decode(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in values:
            yield pa.array([None if x is None else b"".join(raw for raw, _ in framing.members(x)) if x else b"" for x in v.to_pylist()], pa.binary())

    return df.withColumn(out, F.arrow_udf(decode, T.BinaryType())(column))


def compressed(df: DataFrame, column: str, out: str, level: int = 6) -> DataFrame:
    """Adds out: a binary column as one gzip member per value."""

    def encode(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in values:
            yield pa.array([None if x is None else framing.compressed(x, level) for x in v.to_pylist()], pa.binary())

    return df.withColumn(out, F.arrow_udf(encode, T.BinaryType())(column))
