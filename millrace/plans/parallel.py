"""Large gzip files decoded by many tasks, as a sequence of Spark jobs for all files together.

targets   every chunk_size bytes a task looks for the next block start          -> starts
chunks    starts and the following start                                        -> decode, three times
check     a chunk whose end is not a block's end had a false start after it: that start is dropped,
          the chunk goes on to the next one and is decoded again. After each failure of the same
          chunk twice as many starts are dropped, so that long false stretches take few rounds; before
          that, chains of stored blocks are looked for once where chunks failed, and replace the starts
          that lie within them
          Of a chunk only its length and its last 32 KiB are kept
windows   the last 32 KiB of each chunk: FAN chunks at a time are composed to a map from the window
          before them to that after them; maps are resolved in file order, then the chunks within
bytes     chunks decoded once more, each behind its window, in rows of bounded size, with a CRC32 of each
          member's part
verify    the parts' CRC32s combined per member and compared with the trailers

Files must be readable by path on all executors (a local or mounted path, or a URI that pyarrow's
file systems know)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import splice
from millrace.functions.checksums import combined
from millrace.functions.framing import GzError, header
from millrace.shared import drop_written, rows_a_batch, small_row_groups, written

CHUNK = 4 << 20
LEAST_CHUNK = 64 << 10
FAN = 64
#: So many rows at a time go to Python where decoded bytes do.
WIDE = 8
#: A row of decoded bytes has at most so many; a chunk makes as many rows as it needs.
ROW = 2 << 20
#: tail_places and tail_sources are unsigned numbers of 16 bits, little-endian.
_SPEC = "path string, start_bit bigint, end_bit bigint, known boolean, length bigint, tail binary, tail_places binary, tail_sources binary, error string, tries int"


def opened(path: str):
    where = urlparse(path)
    if where.scheme in ("", "file"):
        return pafs.LocalFileSystem().open_input_file(where.path if where.scheme else path)
    system, name = pafs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def read_range(path: str, start: int, stop: int | None) -> bytes:
    with opened(path) as f:
        size = f.size()
        stop = size if stop is None else min(stop, size)
        return f.read_at(max(0, stop - start), start)


def size_and_body(path: str) -> tuple[int, int]:
    """A file's length, and where the first member's body starts."""
    with opened(path) as f:
        return f.size(), header(f.read_at(1 << 20, 0))[0]


def _column(column: pa.Array, kind: str) -> Iterator[np.ndarray]:
    """The numbers packed in each value of a binary column."""
    return (np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in column)


def _tasks(spark: SparkSession, n: int) -> int:
    """For n pieces of work: a task for each while they are few, then several to a task."""
    return max(1, min(n, 4 * spark.sparkContext.defaultParallelism), n // 16)


def _extents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size, body of each file; headers are read on the driver, many at a time."""
    with ThreadPoolExecutor(32) as pool:
        rows = [(path, *found) for path, found in zip(paths, pool.map(size_and_body, paths))]
    return spark.createDataFrame(rows, "path string, size bigint, body bigint")


def starts_of(files: DataFrame, chunk_size: int) -> DataFrame:
    """path, start_bit, known: each body's first bit (known to have nothing before it) and the block starts
    found after each target. files: path, size, body."""
    n = F.ceil(F.col("size") / chunk_size)
    targets = files.where(n > 1).withColumn("k", F.explode(F.sequence(F.lit(1), n - 1)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found = [], []
            for path, size, body, k in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "body", "k"))):
                start = max(k * chunk_size, body + 1)
                data = read_range(path, start, start + chunk_size + 16384)
                at = splice.find_block(data, 8 * start, min(8 * start + 8 * chunk_size, 8 * size), start)
                if at is None:
                    data = read_range(path, start, start + chunk_size + splice.CHAIN * 65_540)
                    at = (splice.find_chain(data, start, min(start + chunk_size, size), start) or [None])[0]
                    at = at and 8 * at
                if at is not None:
                    paths.append(path)
                    found.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.int64())], names=["path", "start_bit"])

    total = files.agg(F.sum(n - 1)).first()[0] or 0
    found = targets.repartition(_tasks(files.sparkSession, total)).mapInArrow(find, "path string, start_bit bigint")
    return _starts(found.withColumn("known", F.lit(False)).unionByName(files.select("path", (8 * F.col("body")).alias("start_bit"), F.lit(True).alias("known"))))


def _starts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path", "start_bit").agg(F.max("known").alias("known"))


def chains_in(chunks: DataFrame) -> DataFrame:
    """path, start_bit, to: the first chain of stored blocks in each chunk, and how far it is seen to go. Data that
    doesn't compress, such as a gzip file within a gzip file, is stored; what looks like a block in it is none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start_bit", "end_bit"))):
                base = start // 8
                data = read_range(path, base, None if stop is None else -(-stop // 8) + splice.CHAIN * 65_540)
                found = splice.find_chain(data, -(-start // 8), base + len(data) if stop is None else stop // 8, base)
                if found:
                    out.append((path, 8 * found[0], 8 * found[1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "start_bit", "to"])

    return chunks.select("path", "start_bit", "end_bit").mapInArrow(find, "path string, start_bit bigint, to bigint")


def decoded(chunks: DataFrame) -> DataFrame:
    """What each chunk's stretch gives, so far as the windows behind it need it: its length, its tail, or an error."""
    types = {"path": pa.string(), "start_bit": pa.int64(), "end_bit": pa.int64(), "known": pa.bool_(), "length": pa.int64(), **dict.fromkeys(("tail", "tail_places", "tail_sources"), pa.binary()), "error": pa.string(), "tries": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, known, tries in zip(*(batch.column(c).to_pylist() for c in ("path", "start_bit", "end_bit", "known", "tries"))):
                base = start // 8
                got = splice.decode(read_range(path, base, None if stop is None else -(-stop // 8)), start, stop, known, base, splice.WINDOW)
                row = {"path": path, "start_bit": start, "end_bit": stop, "known": known, "error": got.error, "tries": tries}
                if not got.error:
                    row |= {"length": got.length, "tail": got.data, "tail_places": got.places.astype("<u2").tobytes(), "tail_sources": got.sources.astype("<u2").tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array([row.get(c)], t) for c, t in types.items()], names=list(types))

    return chunks.mapInArrow(run, _SPEC)


def speculated(spark: SparkSession, paths: list[str], chunk_size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The chunk table, all chunks proven, and path, dropped: how many of a file's starts were dropped as false.
    Rounds work on a narrow table of one row per chunk, for all files at once; tails are written once per
    attempt."""
    chunk_size = max(chunk_size, LEAST_CHUNK)
    files = _extents(spark, paths)
    order = Window.partitionBy("path").orderBy("start_bit")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = (1 << 63) - 1
    far = F.coalesce("end_bit", F.lit(last))
    until = F.max("to").over(order.rangeBetween(Window.unboundedPreceding, 0))
    starts = written(starts_of(files, chunk_size), "starts")
    todo = starts.select("path", "start_bit", F.lead("start_bit").over(order).alias("end_bit"), "known", F.lit(0).alias("tries"))
    attempts, live, looked = None, None, False
    dropped = files.select("path", F.lit(0).cast("bigint").alias("dropped"))
    names = ["path", "start_bit", "end_bit", "known", "error", "tries"]
    while True:
        todo = written(todo, "todo")
        tried = written(decoded(todo.repartition(_tasks(spark, todo.count()), "path", "start_bit")), "spec")
        attempts = tried if attempts is None else attempts.unionByName(tried)
        live = written(tried.select(names) if live is None else live.unionByName(tried.select(names)), "live")
        # a start is proven if all chunks before it are well; if one before it is not, its own end
        # may be false too, and the worst that dropping starts does is to make chunks longer
        ranked = live.withColumn("k", F.row_number().over(order)).withColumn("earlier", F.lag("error").over(order))
        wrong = ranked.where("error IS NOT NULL")
        first = wrong.groupBy("path").agg(F.min_by(F.struct("end_bit", "error"), "start_bit").alias("it"), F.min("start_bit").alias("from"), F.count(F.lit(1)).alias("n"))
        told = first.agg(F.sum("n").alias("n"), F.min(F.when(F.col("it.end_bit").isNull(), F.struct("path", "it.error"))).alias("bad")).first()
        if not told["n"]:
            break
        if told["bad"]:
            raise GzError("Deflate", told["bad"]["error"])
        if not looked:
            # what is stored tells its own block starts: starts within chains of stored blocks are false. A chunk
            # that begins and ends at false starts may seem well, as codes fall into step again
            looked = True
            doubtful = live.join(F.broadcast(first.select("path", "from")), "path").where(F.col("start_bit") >= F.col("from"))
            chains = written(chains_in(doubtful.repartition(_tasks(spark, doubtful.count()), "path", "start_bit")), "chains")
            marks = live.select("path", "start_bit", "known", F.lit(None).cast("bigint").alias("to")).unionByName(chains.withColumn("known", F.lit(False)))
            chain = F.max(F.col("to").isNotNull()).over(Window.partitionBy("path", "start_bit"))
            marks = written(marks.withColumn("until", until).withColumn("inside", ~chain & ~F.col("known") & (F.col("until") > F.col("start_bit"))), "marks")
            gone = marks.where("inside").groupBy("path").agg(F.count(F.lit(1)).alias("dropped"))
            dropped = dropped.unionByName(written(gone, "dropped"))
            spans = _starts(marks.where("NOT coalesce(inside, false)").select("path", "start_bit", "known")).withColumn("end_bit", F.lead("start_bit").over(order))
            both = spans.withColumn("_end", far).join(live.withColumn("_end", far).select("path", "start_bit", "_end", "error", "tries"), ["path", "start_bit", "_end"], "left").drop("_end")
            both = written(both, "live")
            live, todo = both.where("tries IS NOT NULL").select(names), both.where("tries IS NULL").select("path", "start_bit", "end_bit", "known", F.lit(0).alias("tries"))
            if not todo.isEmpty():
                continue
            ranked = live.withColumn("k", F.row_number().over(order)).withColumn("earlier", F.lag("error").over(order))
            wrong = ranked.where("error IS NOT NULL")
        bad = wrong.where("earlier IS NULL AND end_bit IS NOT NULL")
        top = ranked.groupBy("path").agg(F.max("k").alias("top"))
        wider = bad.join(top, "path").select("path", "start_bit", "known", "k", F.least(F.col("k") + F.expr("shiftleft(1L, tries)"), F.col("top")).alias("to"), (F.col("tries") + 1).alias("tries"))
        ends = wider.join(ranked.select("path", F.col("k").alias("to"), "end_bit"), ["path", "to"])
        # stretches may want the same starts: the later one waits for the next round
        spans = written(ends.withColumn("covered", F.max(far).over(before)).where("covered IS NULL OR covered <= start_bit").select("path", "start_bit", "end_bit", "known", "tries", (F.col("to") - F.col("k")).alias("dropped")), "spans")
        dropped = dropped.unionByName(spans.select("path", "dropped"))
        marks = live.withColumn("to", F.lit(None).cast("bigint")).unionByName(spans.select("path", "start_bit", "end_bit", "known", F.lit(None).cast("string").alias("error"), "tries", far.alias("to")))
        live = written(marks.withColumn("until", until).where("to IS NULL AND (until IS NULL OR start_bit >= until)").select(names), "live")
        todo = spans.select("path", "start_bit", "end_bit", "known", F.col("tries").cast("int").alias("tries"))
    numbered = live.select("path", "start_bit", far.alias("_end"), (F.row_number().over(order).cast("bigint") - 1).alias("chunk_id"))
    # one narrow row per chunk is broadcast, so that the tails stay where they are
    spec = attempts.where("error IS NULL").drop("error", "tries", "known").withColumn("_end", far).join(F.broadcast(numbered), ["path", "start_bit", "_end"])
    return spec.drop("_end"), dropped.groupBy("path").agg(F.sum("dropped").alias("dropped"))


def windows(spec: DataFrame) -> DataFrame:
    """path, chunk_id, window: the bytes before each chunk (at most 32 KiB). What FAN chunks make of
    the window before them is one map, and maps compose: only maps pass through one task per file."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part the map from the window before it to the window after it."""
        now, whole = None, np.zeros(0, np.uint16)
        for batch in batches:
            done = []
            for path, part, tail, places, sources in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "tail")), _column(batch.column("tail_places"), "<u2"), _column(batch.column("tail_sources"), "<u2")):
                if (path, part) != now:
                    if now:
                        done.append((*now, whole.tobytes()))
                    now, whole = (path, part), 256 + np.arange(splice.WINDOW, dtype=np.uint16)
                whole = splice.after(whole, tail, places, sources)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64(), pa.binary()))], names=["path", "part", "map"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([whole.tobytes()], pa.binary())], names=["path", "part", "map"])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The window before each part, in file order."""
        now, window = None, b""
        for batch in batches:
            out = []
            for path, _, whole in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "map"))):
                if path != now:
                    now, window = path, b""
                out.append(window)
                window = splice.filled(np.frombuffer(whole, np.uint16), window)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["path", "part", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, window = None, b""
        for batch in batches:
            keys, out = [], []
            for path, part, chunk, tail, first, places, sources in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "chunk_id", "tail", "first")), _column(batch.column("tail_places"), "<u2"), _column(batch.column("tail_sources"), "<u2")):
                if chunk is None:
                    now, window = (path, part), first
                    continue
                keys.append((path, chunk))
                out.append(window)
                own = splice.resolved(tail, places, sources, window)
                window = (window + own)[-splice.WINDOW :]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), pa.array(out, pa.binary())], names=["path", "chunk_id", "window"])

    rows = spec.select("path", "chunk_id", "tail", "tail_places", "tail_sources", F.floor(F.col("chunk_id") / FAN).alias("part"))
    key = ["path", "part"]
    whole = rows.repartition(*key).sortWithinPartitions(*key, "chunk_id").mapInArrow(maps, "path string, part bigint, map binary")
    first = whole.repartition("path").sortWithinPartitions(*key).mapInArrow(firsts, "path string, part bigint, first binary")
    # a part's first window comes before its chunks
    both = rows.unionByName(first, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("chunk_id"))
    return both.mapInArrow(run, "path string, chunk_id bigint, window binary")


def parallel_files(spark: SparkSession, paths: list[str], chunk_size: int = CHUNK, mode: str = "FAILFAST") -> tuple[DataFrame, DataFrame, DataFrame]:
    """gz_bytes (path, seq, bytes) of all files by the same jobs, with the chunk_id each row is of, the members with their
    checks, and path, dropped: the number of false starts. In mode FAILFAST a member whose CRC32 or length is not that of
    its trailer is an error, else its row says so."""
    spec, dropped = speculated(spark, paths, chunk_size)
    dropped = written(dropped, "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.struct([("ends", pa.bool_()), ("crc", pa.int64()), ("length", pa.int64()), ("expected", pa.int64()), ("isize", pa.int64())])

        def row(path: str, seq: int, k: int, raw: bytes, pieces: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([seq], pa.int64()), pa.array([k], pa.int64()), pa.array([raw], pa.binary()), pa.array([pieces], pa.list_(piece))], names=["path", "seq", "chunk_id", "bytes", "pieces"])

        for batch in batches:
            for path, k, start, stop, seq, window in zip(*(batch.column(c).to_pylist() for c in ("path", "chunk_id", "start_bit", "end_bit", "seq", "window"))):
                base = start // 8
                data = read_range(path, base, None if stop is None else -(-stop // 8))
                held, crc, length, pieces = bytearray(), 0, 0, []
                for raws, trailer in splice.streamed(data, start, stop, [window or None], base):
                    if trailer:
                        pieces.append({"ends": True, "crc": crc, "length": length, "expected": trailer[0], "isize": trailer[1]})
                        crc = length = 0
                        continue
                    held += raws[0]
                    crc, length = zlib.crc32(raws[0], crc), length + len(raws[0])
                    while len(held) > ROW:
                        yield row(path, seq, k, bytes(held[:ROW]), [])
                        del held[:ROW]
                        seq += 1
                pieces.append({"ends": False, "crc": crc, "length": length, "expected": None, "isize": None})
                yield row(path, seq, k, bytes(held), pieces)

    schema = "path string, seq bigint, chunk_id bigint, bytes binary, pieces array<struct<ends:boolean,crc:bigint,length:bigint,expected:bigint,isize:bigint>>"
    # a chunk's last row has its pieces; one without bytes makes a row too
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / ROW))
    before = Window.partitionBy("path").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    chunks = spec.select("path", "chunk_id", "start_bit", "end_bit", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("seq"))
    with rows_a_batch(spark, WIDE):
        both = chunks.join(written(windows(spec), "windows"), ["path", "chunk_id"])
    with rows_a_batch(spark, WIDE), small_row_groups(spark, WIDE):
        out = written(both.repartition(_tasks(spark, spec.count()), "path", "chunk_id").mapInArrow(run, schema), "bytes")
    parts = out.select("path", "seq", F.posexplode("pieces").alias("i", "p")).select("path", "seq", "i", "p.*")
    order = Window.partitionBy("path").orderBy("seq", "i")
    numbered = parts.withColumn("member_index", F.coalesce(F.sum(F.col("ends").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = numbered.withColumn("at", F.row_number().over(Window.partitionBy("path", "member_index").orderBy("seq", "i")).cast("bigint") - 1)
    numbered = written(numbered, "pieces")
    whole = combined(numbered.select("path", "member_index", F.col("at").alias("seq"), "crc", "length"), ["path", "member_index"])
    ends = numbered.where("ends").select("path", "member_index", F.col("expected").alias("crc32_expected"), F.col("isize").alias("isize_expected"))
    members = ends.join(whole, ["path", "member_index"]).select(
        "path", "member_index", "crc32_expected", "isize_expected", F.col("crc").alias("crc32_actual"), F.col("length").alias("raw_length"),
        (F.col("crc") == F.col("crc32_expected")).alias("crc_ok"), (F.col("length") % (1 << 32) == F.col("isize_expected")).alias("isize_ok"),
    )
    members = written(members, "members")
    if mode == "FAILFAST":
        bad = members.where("NOT crc_ok OR NOT isize_ok").agg(F.min(F.struct("path", "member_index", "crc_ok")).alias("it")).first()["it"]
        if bad:
            raise GzError("IsizeMismatch" if bad["crc_ok"] else "CrcMismatch", f"member {bad['member_index']} of {bad['path']}")
    drop_written(spec)
    return out.select("path", "seq", "bytes", "chunk_id"), members, dropped


def parallel_bytes(spark: SparkSession, path: str, chunk_size: int = CHUNK, mode: str = "FAILFAST") -> tuple[DataFrame, DataFrame, int]:
    """parallel_files of one file, with its number of false starts."""
    out, members, dropped = parallel_files(spark, [path], chunk_size, mode)
    return out, members, dropped.first()["dropped"]


def parallel_stats(out: DataFrame, members: DataFrame, failures: int | DataFrame) -> DataFrame:
    """path, uncompressed_bytes, chunks_decoded, members, speculation_failures of what parallel_bytes or parallel_files gave."""
    sizes = out.groupBy("path").agg(F.sum(F.length("bytes")).alias("uncompressed_bytes"), F.count_distinct("chunk_id").alias("chunks_decoded"))
    sizes = sizes.join(members.groupBy("path").agg(F.count(F.lit(1)).alias("members")), "path")
    if isinstance(failures, int):
        return sizes.withColumn("speculation_failures", F.lit(failures).cast("bigint"))
    return sizes.join(failures.select("path", F.col("dropped").alias("speculation_failures")), "path")
