import gzip
import random
import subprocess
import tracemalloc
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.functions import framing, splice
from millrace.functions.framing import GzError
from millrace.operators import fixtures, members
from millrace.plans import parallel
from millrace.plans.parallel import parallel_bytes
from millrace.plans.reader import large_members, read_gz


def ascii_noise(n, seed=0x9E3779B97F4A7C15):
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 95, n) + 32).astype(np.uint8).tobytes()


def words(n, seed=1):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(4000)]
    return " ".join(rng.choices(pool, k=n // 6)).encode()[:n]


def raw_deflate(data, level=6):
    engine = zlib.compressobj(level, zlib.DEFLATED, -15)
    return engine.compress(data) + engine.flush()


def test_preludes_are_empty_and_have_their_phase():
    for phase in range(8):
        head, low = splice.prelude(phase)
        data = raw_deflate(b"after the prelude")
        bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
        moved = np.packbits(np.concatenate([np.zeros(phase, np.uint8), bits]), bitorder="little").tobytes()
        stream, ahead = splice.spliced(moved, phase, None)
        assert ahead == len(head) and low < 1 << max(phase, 1)
        assert zlib.decompressobj(-15).decompress(stream) == b"after the prelude"


@pytest.mark.parametrize("payload,level", [(words(400_000), 6), (words(400_000), 1), (ascii_noise(300_000), 6), (ascii_noise(100_000) + np.random.default_rng(0).bytes(200_000) + ascii_noise(100_000), 1)])
def test_chunks_of_a_stream_come_together(payload, level):
    data = raw_deflate(payload, level)
    starts, at = [0], 8 * 15_000
    while (found := splice.find_block(data, at, 8 * len(data))) is not None:
        starts.append(found)
        at = found + 8 * 15_000
    assert len(starts) > 3
    window = out = b""
    for a, b in zip(starts, [*starts[1:], None]):
        chunk = splice.decode(data + b"12345678", a, b, a == 0)
        assert chunk.error is None
        raw = splice.resolved(chunk.data, chunk.places, chunk.sources, window)
        out += raw
        window = (window + raw)[-splice.WINDOW :]
    assert out == payload


def test_false_ends_are_seen():
    data = raw_deflate(words(200_000))
    true = splice.find_block(data, 8 * 20_000, 8 * len(data))
    assert splice.decode(data, 0, true, True).error is None
    rng = random.Random(2)
    assert all(splice.decode(data, 0, rng.randrange(8, 8 * len(data)), True).error for _ in range(100))


def test_a_copy_from_before_the_start():
    with pytest.raises(GzError):
        splice.resolved(b"abc", np.array([1]), np.array([5]), b"short")


def run(spark, tmp_path, data, chunk=64 << 10, **options):
    path = tmp_path / "x.gz"
    path.write_bytes(data)
    out, members, failures = parallel_bytes(spark, str(path), chunk, **options)
    rows = sorted((r["seq"], bytes(r["bytes"])) for r in out.collect())
    checks = sorted(members.select("member_index", "crc_ok", "isize_ok", "raw_length").collect())
    return b"".join(b for _, b in rows), checks, failures, len(rows)


def test_one_large_member(spark, tmp_path):
    raw = words(1_500_000)
    got, checks, failures, chunks = run(spark, tmp_path, framing.compressed(raw))
    assert got == raw and chunks > 4 and failures == 0
    assert [(c["crc_ok"], c["isize_ok"], c["raw_length"]) for c in checks] == [(True, True, len(raw))]


def test_members_across_chunks(spark, tmp_path):
    parts = [ascii_noise(n, i) for i, n in enumerate([100_000, 200_017, 50_003, 0, 300_000, 1])]
    got, checks, _, _ = run(spark, tmp_path, b"".join(framing.compressed(p, lv) for p, lv in zip(parts, (6, 9, 1, 6, 6, 6))))
    assert got == b"".join(parts)
    assert [c["raw_length"] for c in checks] == [len(p) for p in parts] and all(c["crc_ok"] and c["isize_ok"] for c in checks)


def test_nested_gzip_has_false_starts(spark, tmp_path):
    inner = framing.compressed(ascii_noise(900_000))
    got, checks, failures, _ = run(spark, tmp_path, framing.compressed(inner, 6))
    assert got == inner and failures > 0 and checks[0]["crc_ok"]


def test_small_and_damaged(spark, tmp_path):
    assert run(spark, tmp_path, framing.compressed(b"A"))[0] == b"A"
    bad = bytearray(framing.compressed(words(300_000)))
    bad[-6] ^= 1
    assert not run(spark, tmp_path, bytes(bad), mode="PERMISSIVE")[1][0]["crc_ok"]
    with pytest.raises(GzError, match="CrcMismatch"):
        run(spark, tmp_path, bytes(bad))
    with pytest.raises(GzError):
        run(spark, tmp_path, framing.compressed(words(300_000)) + b"\0" * 100)


def test_system_gzip(spark, tmp_path):
    raw = words(800_000, 5)
    (tmp_path / "plain").write_bytes(raw)
    data = subprocess.run(["gzip", "-c", "-9", str(tmp_path / "plain")], capture_output=True, check=True).stdout
    assert gzip.decompress(data) == raw == run(spark, tmp_path, data)[0]


def test_windows_over_many_parts(spark, tmp_path, monkeypatch):
    """Windows composed in parts of three chunks; the text's copies reach over many chunks."""
    monkeypatch.setattr("millrace.plans.parallel.FAN", 3)
    raw = words(1_200_000, 7)
    got, checks, _, chunks = run(spark, tmp_path, framing.compressed(b"xy") + framing.compressed(raw))
    assert got == b"xy" + raw and chunks > 6 and [c["raw_length"] for c in checks] == [2, len(raw)]


def test_composed_windows():
    rng = np.random.default_rng(4)
    for before in (b"", rng.bytes(100), rng.bytes(splice.WINDOW)):
        whole, window = 256 + np.arange(splice.WINDOW, dtype=np.uint16), before
        for n in (10, 40_000, 5, 3000):
            tail = rng.bytes(n)[-splice.WINDOW :]
            places = np.sort(rng.choice(len(tail), min(len(tail), 4), replace=False))
            sources = rng.integers(splice.WINDOW - max(1, len(window)), splice.WINDOW, len(places)) if window else np.zeros(0, np.int64)
            places = places[: len(sources)]
            whole = splice.after(whole, tail, places, sources)
            window = (window + splice.resolved(tail, places, sources, window))[-splice.WINDOW :]
        assert splice.filled(whole, before) == window


def test_any_file_is_read_in_its_way(spark, tmp_path):
    text = words(900_000, 3).replace(b" a", b"\na").replace(b"\nab", b"\n\nab")
    (tmp_path / "a.large.gz").write_bytes(framing.compressed(text))
    (tmp_path / "b.bgzf.gz").write_bytes(framing.bgzf(text, 5000))
    (tmp_path / "c.small.gz").write_bytes(framing.compressed(text[:1000]) + framing.compressed(b"tail\n"))
    (tmp_path / "d.large.gz").write_bytes(framing.compressed(text[:500_000]) + framing.compressed(text[500_000:] + b"\n"))
    assert [p.rsplit("/", 1)[1] for p in large_members(str(tmp_path), 64 << 10)] == ["a.large.gz", "d.large.gz"]
    files = spark.read.format("binaryFile").load(str(tmp_path))
    name = F.regexp_extract("path", "[^/]*$", 0)
    for table in ("bytes", "lines", "members"):
        got = read_gz(spark, str(tmp_path), table, 64 << 10)
        if table == "bytes":
            whole = {}
            for r in sorted(got.collect(), key=lambda r: (r["path"], r["seq"])):
                whole[r["path"].rsplit("/", 1)[1]] = whole.get(r["path"].rsplit("/", 1)[1], b"") + bytes(r["bytes"])
            assert whole == {"a.large.gz": text, "b.bgzf.gz": text, "c.small.gz": text[:1000] + b"tail\n", "d.large.gz": text + b"\n"}
            continue
        want = {"lines": members.gz_lines, "members": members.gz_members}[table](files)
        columns = [c for c in got.columns if c != "path"]
        assert sorted(map(tuple, got.select(name, *columns).collect())) == sorted(map(tuple, want.select(name, *columns).collect()))
    stats = {r["path"].rsplit("/", 1)[1]: r for r in read_gz(spark, str(tmp_path), "stats", 64 << 10).collect()}
    assert {k: (r["uncompressed_bytes"], r["members"]) for k, r in stats.items()} == {"a.large.gz": (len(text), 1), "b.bgzf.gz": (len(text), len(text) // 5000 + 2), "c.small.gz": (1005, 2), "d.large.gz": (len(text) + 1, 2)}
    assert stats["a.large.gz"]["chunks_decoded"] > 2


def test_a_nested_file_stays_in_chunks(spark, tmp_path):
    """Stored blocks are found where starts were false, so that the file doesn't become one long stretch."""
    inner = framing.compressed(ascii_noise(900_000))
    got, checks, failures, chunks = run(spark, tmp_path, framing.compressed(inner, 6))
    assert got == inner and failures > 0 and checks[0]["crc_ok"] and chunks > 6
    noise = np.random.default_rng(3).bytes(500_000)
    got, _, failures, chunks = run(spark, tmp_path, framing.compressed(noise))
    assert got == noise and failures == 0 and chunks > 5


def test_many_files_take_no_more_jobs(spark, tmp_path, monkeypatch):
    from millrace.plans import parallel

    steps, real = [], parallel.written
    monkeypatch.setattr(parallel, "written", lambda df, label="step": steps.append(label) or real(df, label))
    took = {}
    for n in (1, 4):
        (tmp_path / str(n)).mkdir()
        for i in range(n):
            (tmp_path / str(n) / f"{i}.gz").write_bytes(framing.compressed(words(500_000, i)))
        rows = read_gz(spark, str(tmp_path / str(n)), "stats", 64 << 10).collect()
        assert [(r["uncompressed_bytes"], r["members"]) for r in rows] == [(len(words(500_000)), 1)] * n
        took[n] = len(steps)
        steps.clear()
    assert took[1] == took[4] > 0


def test_one_member_from_many_tasks(spark, tmp_path):
    path = fixtures.one_file(spark.range(0, 5000, 1, 7).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value")), str(tmp_path))
    want = "".join(f"line {i}\n" for i in range(5000)).encode()
    with open(path, "rb") as f:
        assert [raw for raw, _ in framing.members(f.read())] == [want]
    with open(fixtures.again_compressed(spark, path, 1000), "rb") as f, open(path, "rb") as g:
        assert [raw for raw, _ in framing.members(f.read())] == [g.read()]
    out, _, _ = parallel_bytes(spark, path)
    with open(fixtures.whole_file(out, str(tmp_path)), "rb") as f:
        assert f.read() == want
    assert sorted(r["value"] for r in fixtures.joined_lines(out).collect()) == sorted(want.decode().splitlines())


def test_a_chunk_makes_rows_of_bounded_size(spark, tmp_path):
    """A chunk of 64 KiB that decodes to several rows: none is longer than 2 MiB, few are in a row group, and lines run over
    the rows' borders."""
    line = words(900, 11).replace(b"\n", b" ")
    raw = b"".join(b"%d %s\n" % (i, line[i % 7 :]) for i in range(24_000))
    (tmp_path / "x.gz").write_bytes(framing.compressed(raw, 9))
    out, members, failures = parallel_bytes(spark, str(tmp_path / "x.gz"), 64 << 10)
    rows = sorted((r["seq"], bytes(r["bytes"])) for r in out.collect())
    stats = parallel.parallel_stats(out, members, failures).first()
    assert b"".join(x for _, x in rows) == raw and [k for k, _ in rows] == list(range(len(rows)))
    assert max(len(x) for _, x in rows) <= 2 << 20
    assert 1 < stats["chunks_decoded"] < len(rows) and stats["uncompressed_bytes"] == len(raw)
    assert members.first()["crc_ok"] and members.first()["raw_length"] == len(raw)
    written = [pq.ParquetFile(urlparse(f).path).metadata for f in out.inputFiles()]
    assert max(m.row_group(i).num_rows for m in written for i in range(m.num_row_groups)) <= parallel.WIDE
    assert sorted(r["value"] for r in fixtures.joined_lines(out).collect()) == sorted(raw.decode().splitlines())


def test_what_is_held_does_not_grow_with_what_is_decoded():
    raw = b"all the same " * 5_000_000
    data = raw_deflate(raw)
    tracemalloc.start()
    chunk = splice.decode(data + b"12345678", 0, None, True, last=splice.WINDOW)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert chunk.error is None and chunk.length == len(raw) and chunk.data == raw[-splice.WINDOW :]
    assert most < 8 << 20 < len(raw)


@pytest.mark.parametrize("fed,piece", [(3, 1), (64, 50), (1000, 40_000)])
def test_pieces_of_any_size_come_together(monkeypatch, fed, piece):
    """Members, window and end of a stretch, wherever slices of it are cut."""
    monkeypatch.setattr(splice, "FED", fed)
    monkeypatch.setattr(splice, "PIECE", piece)
    parts = [words(200_000), b"x", b"", words(3000)]
    data = b"".join(map(framing.compressed, parts))
    body = framing.header(data)[0]
    assert splice.decode(data, 8 * body, None, True).error is None
    middle = splice.find_block(data, 8 * (body + 20_000), 8 * len(data))
    first, rest = splice.decode(data, 8 * body, middle, True), splice.decode(data, middle, None, False)
    window = first.data[-splice.WINDOW :]
    assert first.data + splice.resolved(rest.data, rest.places, rest.sources, window) == b"".join(parts)
    assert [at + first.length for at, _, _ in rest.members] == np.cumsum([len(x) for x in parts]).tolist()
    # behind its window it is decoded at once, and its last bytes are those of the whole
    known = b"".join(raws[0] for raws, trailer in splice.streamed(data, middle, None, [window]) if not trailer)
    end = splice.decode(data, middle, None, False, last=1000)
    assert first.data + known == b"".join(parts) and end.data == rest.data[-1000:] and end.length == len(rest.data)
    assert end.places.tolist() == [k - len(rest.data) + 1000 for k in rest.places.tolist() if k >= len(rest.data) - 1000]
    with pytest.raises(GzError, match="Deflate"):
        list(splice.streamed(data, middle, None, [window[-10:]]))
    assert splice.decode(data, 8 * body, middle + 5, True).error


def test_lines_over_odd_rows(spark):
    """Line ends at rows' borders, rows without one, characters and bytes cut apart."""
    texts = {"a": ["é\n".encode()[:1], "é\nb".encode()[1:], b"c", b"", b"\n", b"\n\nd\ne\xc3", b"\xa4"], "b": [b"", b""], "c": [b"\n"], "d": [b"x\n", b"y\n"], "e": [b"\nlast"]}
    rows = [(path, seq, bytearray(part)) for path, parts in texts.items() for seq, part in enumerate(parts)]
    got = fixtures.joined_lines(spark.createDataFrame(rows, "path string, seq bigint, bytes binary")).collect()
    assert sorted(map(tuple, got)) == sorted((path, x) for path, parts in texts.items() for x in b"".join(parts).decode().splitlines())
