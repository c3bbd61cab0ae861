"""Data source "pgz": gzip files read by byte ranges, BGZF files by several tasks each.

spark.dataSource.register(PgzSource); spark.read.format("pgz").option("table", t).load(path) with
table members, bytes, files or lines. path is a file, a folder or a glob that the driver and the
executors can open (a mounted path or a URI of pyarrow's file systems). Options: chunkSize
(compressed bytes per task of a BGZF file, at least 64 KiB), numPartitions (about so many tasks, which
sets chunkSize by the files' sizes), mode (FAILFAST, or PERMISSIVE, which reads each file in one task:
the members before its first invalid one count), leaveOut (paths that are not read, one on each line), pushFilters (true: equality on path picks files;
needs spark.sql.python.filterPushdown.enabled).

A line belongs to the range in which it starts: a range leaves out what stands before its first line
end and reads on behind its end up to the next. Ranges are found by hopping over BGZF headers while
planning, several files at a time; members, rows and bytes before each range come from the trailers.
millrace.plans.reader also decodes one large member by many tasks; for stores that only Spark
reads, use binaryFile with millrace.operators.members instead."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from millrace.functions import framing
from millrace.operators.members import BYTES, FILES, MEMBERS, ROW, _arrow
from millrace.plans.parallel import LEAST_CHUNK, opened, read_range

SCHEMAS = {"members": MEMBERS, "bytes": BYTES, "files": FILES, "lines": "path string, value string"}
_HOP = 1 << 12
_PLANNERS = 32


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    # members, rows and decoded bytes of the file before start
    index: int = 0
    seq: int = 0
    offset: int = 0
    # the same at stop, where ranges follow each other
    end: tuple[int, int, int] | None = None


def listed(path: str) -> list[str]:
    import pyarrow.fs as pafs

    scheme = "://" in path or path.startswith("file:")
    system, root = pafs.FileSystem.from_uri(path) if scheme and not path.startswith("file:/") else (pafs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:"))
    folder, _, name = root.rpartition("/")
    if any(c in name for c in "*?["):
        found = [i.path for i in system.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatch(i.base_name, name)]
    elif system.get_file_info(root).type == pafs.FileType.Directory:
        found = [i.path for i in system.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))]
    else:
        found = [root]
    start = path[: len(path) - len(root)] if scheme and not path.startswith("file:") else ""
    return sorted(start + f for f in found)


def ranges(path: str, chunk: int) -> list[Range]:
    """BGZF blocks, found by hopping over headers, in stretches of about chunk bytes; what follows the
    first other member is one range, as is any other file. Headers and lengths in trailers tell what
    lies before each range."""
    out, at, start = [], 0, 0
    now = first = (0, 0, 0)
    with opened(path) as f:
        size = f.size()
        head = f.read_at(min(_HOP, size), 0)
        while at < size:
            try:
                block = framing.header(head)[2]
            except framing.GzError:
                block = None
            if block is None or block < framing.HEADER + framing.TRAILER or at + block > size:
                break
            if at > start and at + block - start > chunk:
                out.append(Range(path, start, at, *first, now))
                start, first = at, now
            at += block
            tail = f.read_at(min(_HOP + 4, size - at + 4), at - 4)
            raw, head = int.from_bytes(tail[:4], "little"), tail[4:]
            now = (now[0] + 1, now[1] - (-raw // ROW), now[2] + raw)
    if at > start and at < size:
        out.append(Range(path, start, at, *first, now))
        start, first = at, now
    out.append(Range(path, start, size, *first, now if out and at == size else None))
    return out


class PgzReader(DataSourceReader):
    def __init__(self, options):
        self.table = options.get("table", "bytes")
        self.path = options["path"]
        self.chunk = max(int(options.get("chunkSize", 4 << 20)), LEAST_CHUNK)
        self.tasks = int(options.get("numPartitions", 0))
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.left_out = set(options.get("leaveOut", "").split("\n"))
        self.only = None

    def partitions(self):
        files = [p for p in listed(self.path) if p not in self.left_out and (self.only is None or p == self.only)]
        # a file's kind is one row; and nothing behind a file's first error counts, which other tasks can't know
        if self.table == "files" or self.permissive:
            return [Range(p, 0, -1) for p in files]
        with ThreadPoolExecutor(_PLANNERS) as pool:
            chunk = max(LEAST_CHUNK, -(-sum(pool.map(_size, files)) // self.tasks)) if self.tasks else self.chunk
            return [r for found in pool.map(lambda p: ranges(p, chunk), files) for r in found]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema, rows = SCHEMAS[self.table], []
        if part is None:  # what Spark makes of no partitions: all files are left out
            return
        if self.table == "files":
            size, kinds = _size(part.path), {r.start: r for r in ranges(part.path, LEAST_CHUNK)}
            yield _arrow([{"path": part.path, "length": size, "kind": _kind(part.path, size, kinds)}], schema)
            return
        if self.table == "lines":
            yield from _lines(part, self.permissive)
            return
        data = read_range(part.path, part.start, None if part.stop < 0 else part.stop)
        index, seq, offset = part.index, part.seq, part.offset
        try:
            for raw, row in framing.members(data):
                if self.table == "members":
                    moved = {k: row[k] + part.start for k in ("header_offset", "body_offset", "trailer_offset")}
                    rows.append({"path": part.path, "member_index": index} | row | moved)
                else:
                    for at in range(0, len(raw), ROW):
                        rows.append({"path": part.path, "seq": seq, "raw_offset": offset, "bytes": raw[at : at + ROW]})
                        seq, offset = seq + 1, offset + len(raw[at : at + ROW])
                index += 1
                if len(rows) >= 512 or self.table == "bytes" and rows:
                    yield _arrow(rows, schema)
                    rows = []
            counted = (index, seq, offset) if self.table == "bytes" else (index,)
            if part.end is not None and counted != part.end[: len(counted)]:
                raise ValueError(f"BGZF block sizes of {part.path} are not those of its members; mode PERMISSIVE reads the file in one task")
        except framing.GzError as why:
            if not self.permissive:
                raise
            if self.table == "members":
                rows.append({"path": part.path, "member_index": index, "error": why.kind})
        if rows:
            yield _arrow(rows, schema)


def _size(path: str) -> int:
    with opened(path) as f:
        return f.size()


def _lines(part: Range, permissive: bool) -> Iterator[pa.RecordBatch]:
    """The lines that start in a range, but for its first unless it starts the file, and the line that
    starts where it ends or runs over its end."""
    rest, skip = b"", part.start > 0
    with opened(part.path) as f:
        size = f.size()
        stop = size if part.stop < 0 else part.stop

        def told(values: list[bytes]) -> pa.RecordBatch:
            return _arrow([{"path": part.path, "value": x.decode("utf-8", "replace")} for x in values], SCHEMAS["lines"])

        try:
            data = f.read_at(stop - part.start, part.start)
            for raw, _ in framing.members(data):
                *lines, rest = (rest + raw).split(b"\n")
                if lines and skip:
                    del lines[0]
                    skip = False
                if skip:
                    rest = b""
                if lines:
                    yield told(lines)
            if skip:  # one line runs over the whole range: it belongs to a range before
                return
            for raw in framing.stream(lambda at, n: f.read_at(min(n, size - at), at), stop, size):
                end = raw.find(b"\n")
                rest += raw if end < 0 else raw[:end]
                if end >= 0:
                    yield told([rest])
                    return
        except framing.GzError:
            if not permissive:
                raise
        if rest:
            yield told([rest])


class PgzFilteringReader(PgzReader):
    def pushFilters(self, filters):
        """Equality on path picks files while planning."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = f.value
            else:
                yield f


def _kind(path: str, size: int, found: dict) -> str:
    try:
        first = framing.header(read_range(path, 0, 1 << 17))[2]
    except framing.GzError:
        return "invalid"
    if first is None:
        return "gzip"
    last = found[max(found)]
    try:
        rest = framing.header(read_range(path, last.start, last.start + (1 << 17)))[2] if last.start < size else first
    except framing.GzError:
        return "invalid"
    return "bgzf+gzip" if rest is None else "bgzf"


class PgzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgz"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "bytes")]

    def reader(self, schema) -> PgzReader:
        filters = self.options.get("pushFilters", "false").lower() == "true"
        return (PgzFilteringReader if filters else PgzReader)(self.options)
