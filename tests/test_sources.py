import pytest
from pyspark.sql import functions as F

from millrace.functions import framing
from millrace.operators import fixtures, members
from millrace.shared import shared_dir
from millrace.sources.pgz import PgzSource
from millrace.streaming.folder import arriving

TEXT = "".join(f"line number {i}\n" for i in range(30_000)).encode()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("gz")
    (d / "a.bgzf.gz").write_bytes(framing.bgzf(TEXT, 9000, 1))
    (d / "b.gz").write_bytes(framing.compressed(TEXT[:1000]) + framing.compressed(b"") + framing.compressed(TEXT[1000:5000]))
    (d / "c.mixed.gz").write_bytes(framing.bgzf(TEXT, 9000) + framing.compressed(b"tail\n"))
    return d


def load(spark, path, table, **options):
    spark.dataSource.register(PgzSource)
    return spark.read.format("pgz").option("table", table).options(**options).load(str(path))


def whole(df):
    out = {}
    for r in sorted(df.select("path", "seq", "bytes").collect(), key=lambda r: (r["path"], r["seq"])):
        name = r["path"].rsplit("/", 1)[1]
        out[name] = out.get(name, b"") + bytes(r["bytes"])
    return out


def test_bytes_and_splits(spark, folder):
    df = load(spark, folder, "bytes", chunkSize=65536)
    assert df.rdd.getNumPartitions() > 3
    assert whole(df) == {"a.bgzf.gz": TEXT, "b.gz": TEXT[:5000], "c.mixed.gz": TEXT + b"tail\n"}


def test_members_files_lines(spark, folder):
    rows = load(spark, folder, "members").where("path LIKE '%b.gz'").orderBy("header_offset").collect()
    assert [r["raw_length"] for r in rows] == [1000, 0, 4000] and all(r["crc_ok"] for r in rows)
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in load(spark, folder, "files").collect()}
    assert kinds == {"a.bgzf.gz": "bgzf", "b.gz": "gzip", "c.mixed.gz": "bgzf+gzip"}
    assert load(spark, folder / "a*.gz", "lines").count() == 30_000


def test_path_filter(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    one = str(folder / "b.gz")
    assert load(spark, folder, "members", pushFilters="true").where(F.col("path") == one).count() == 3
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_modes(spark, folder, tmp_path):
    bad = framing.compressed(b"good") + framing.compressed(b"bad")[:-9]
    (tmp_path / "bad.gz").write_bytes(bad)
    (tmp_path / "none.gz").write_bytes(b"")
    with pytest.raises(Exception, match="Truncated"):
        load(spark, tmp_path / "bad.gz", "bytes").collect()
    got = load(spark, tmp_path, "members", mode="PERMISSIVE").orderBy("path", "member_index").collect()
    assert [(r["member_index"], r["error"]) for r in got] == [(0, None), (1, "Truncated"), (0, "Truncated")]
    assert whole(load(spark, tmp_path, "bytes", mode="PERMISSIVE")) == {"bad.gz": b"good"}


def test_operators_equal_the_source(spark, folder):
    files = spark.read.format("binaryFile").load(str(folder))
    assert whole(members.gz_bytes(files)) == whole(load(spark, folder, "bytes"))
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in members.gz_files(files).collect()}
    assert kinds == {"a.bgzf.gz": "bgzf", "b.gz": "gzip", "c.mixed.gz": "bgzf+gzip"}
    parts = members.split_bytes(files, 1 << 14)
    assert parts.where("path LIKE '%a.bgzf.gz'").select("part").distinct().count() > 3
    assert parts.agg(F.sum(F.length("bytes"))).first()[0] == 2 * len(TEXT) + 5 + 5000
    stats = {r["path"].rsplit("/", 1)[1]: r["uncompressed_bytes"] for r in members.gz_stats(files).collect()}
    assert stats["b.gz"] == 5000


def test_stream(spark, folder):
    query = arriving(spark, str(folder), "lines", 1).writeStream.format("memory").queryName("arrived").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("arrived").count() == 30_000 + TEXT[:5000].count(b"\n") + 1 + 30_001
    again = members.decompressed(members.compressed(spark.createDataFrame([(b"x" * 10,), (b"",), (None,)], "raw binary"), "raw", "gz"), "gz", "back")
    assert all(r["raw"] == r["back"] for r in again.collect())


def test_ranges_count_through_the_file(spark, tmp_path):
    (tmp_path / "long.gz").write_bytes(framing.bgzf(TEXT * 2, 9000, 1) + framing.bgzf(TEXT, 9000, 1) + framing.compressed(b"tail\n"))
    (tmp_path / "plain.gz").write_bytes(framing.compressed(TEXT[:1000]) + framing.compressed(b"") + framing.compressed(TEXT))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    for table, of in (("members", members.gz_members), ("bytes", members.gz_bytes)):
        split, names = load(spark, tmp_path, table, chunkSize=65536), of(files).columns
        assert split.rdd.getNumPartitions() > 3

        def rows(df):  # binaryFile's paths are URIs
            return sorted(tuple(r[c].rsplit("/", 1)[1] if c == "path" else r[c] for c in names) for r in df.na.fill(-1).na.fill("").collect())

        assert rows(split) == rows(of(files))


def test_nothing_behind_the_first_error(spark, tmp_path):
    data = bytearray(framing.bgzf(TEXT * 3, 9000, 1))
    ends = [r["trailer_offset"] for _, r in framing.members(bytes(data))]
    assert ends[-1] > 2 * 65536
    data[ends[2]] ^= 1
    (tmp_path / "bad.gz").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = load(spark, tmp_path, "members", mode="PERMISSIVE", chunkSize=65536).orderBy("member_index").collect()
    assert [(r["member_index"], r["error"]) for r in got] == [(0, None), (1, None), (2, "CrcMismatch")]
    assert whole(load(spark, tmp_path, "bytes", mode="PERMISSIVE", chunkSize=65536)) == whole(members.gz_bytes(files, "PERMISSIVE")) == {"bad.gz": TEXT[:18000]}
    with pytest.raises(Exception, match="CrcMismatch"):
        load(spark, tmp_path, "bytes", chunkSize=65536).collect()


def lines_of(df):
    return sorted(r["value"] for r in df.collect())


@pytest.mark.parametrize("text", [TEXT * 3, b"x" * 700_000 + b"\n" + TEXT, b"\n" * 1000 + TEXT, TEXT[:-1], b"a\n\n" * 90_000, b"no end" * 100_000])
def test_lines_over_ranges(spark, tmp_path, text):
    (tmp_path / "a.gz").write_bytes(framing.bgzf(text, 4000, 0))
    (tmp_path / "b.gz").write_bytes(framing.bgzf(text, 4001, 0, end=False) + framing.compressed(b"tail\nmore"))
    df = load(spark, tmp_path, "lines", chunkSize=65536)
    assert df.rdd.getNumPartitions() > 6
    want = [x.decode() for whole in (text, text + b"tail\nmore") for x in whole.removesuffix(b"\n").split(b"\n")]
    assert lines_of(df) == sorted(want) == lines_of(members.gz_lines(spark.read.format("binaryFile").load(str(tmp_path))))


def test_number_of_partitions(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(framing.bgzf(TEXT * 4, 4000, 0))
    for n in (2, 5, 9):
        df = load(spark, tmp_path, "bytes", numPartitions=n)
        assert n - 1 <= df.rdd.getNumPartitions() <= n + 1 and whole(df) == {"a.gz": TEXT * 4}


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), type("Context", (), {"master": master})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("spark://host:7077"))
    own = Session("local[2]")
    assert shared_dir(own) == shared_dir(own)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_few_files_at_a_time_go_to_python(spark, tmp_path, monkeypatch):
    asked, real = [], fixtures.rows_a_batch
    monkeypatch.setattr(fixtures, "rows_a_batch", lambda session, rows: asked.append(rows) or real(session, rows))
    df = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    target = fixtures.saved(fixtures.bgzf_files(df, "k", "line", 10), str(tmp_path))
    assert asked == [fixtures.FILES] and load(spark, target, "lines").count() == 3000
