"""Queries of the gzip side and their SQL. Every query makes its gzip data from the given tables with
Spark jobs, decodes it by the operators here and aggregates what comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.checksums import combined
from millrace.operators import fixtures, members
from millrace.plans.parallel import opened, parallel_bytes, parallel_stats
from millrace.plans.reader import read_gz
from millrace.shared import shared_dir, table, written
from millrace.sources.pgz import PgzSource


def members_lang_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as NDJSON members, decoded to lines, parsed, counted by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang")).alias("line"))
    files = fixtures.member_files(docs, "doc_id", "line", 200)
    rows = members.gz_lines(files).select(F.from_json("value", "doc_id bigint, lang string").alias("r"))
    return rows.groupBy(F.col("r.lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def member_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    back = members.decompressed(members.compressed(docs, "raw", "gz"), "gz", "back")
    return back.select("doc_id", F.sha2("back", 256).alias("sha"), F.length("back").cast("long").alias("octets"))


def multi_member_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of many members, an empty one after each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))
    files = fixtures.member_files(docs, "doc_id", "line", 100, empty=True)
    found = members.gz_members(files)
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("members"), F.sum("raw_length").alias("octets"))


def bgzf_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in BGZF files, cut at block headers and decoded in parts."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("line"))
    files = written(fixtures.bgzf_files(pages, "page_id", "line", 250), "bgzf")
    return members.split_bytes(files, 1 << 16).groupBy("path").agg(F.sum(F.length("bytes")).alias("octets"))


def bgzf_then_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that start as BGZF and go on as plain members."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))
    files = written(fixtures.bgzf_files(docs, "doc_id", "line", 300, 200), "mixed")
    kinds = members.gz_files(files).select("path", "kind")
    sizes = members.split_bytes(files, 1 << 16).groupBy("path").agg(F.sum(F.length("bytes")).alias("octets"))
    return sizes.join(kinds, "path")


def crc_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC32 of each page file from the CRC32s of its pages, against the CRC32 of the whole."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("raw"))
    order = fixtures.dealt(pages, "page_id", 50)
    pieces = order.select("path", "seq", F.crc32("raw").alias("crc"), F.length("raw").cast("long").alias("length"))
    whole = combined(pieces, ["path"])
    files = fixtures.member_files(pages.select("page_id", F.decode("raw", "UTF-8").alias("line")), "page_id", "line", 50, single=True, newline=False)
    found = members.gz_members(files).select("path", "crc32_expected", "crc32_actual", "crc_ok", "isize_ok", "raw_length")
    return whole.join(found, "path").select("path", "raw_length", (F.col("crc_ok") & F.col("isize_ok") & (F.col("crc") == F.col("crc32_expected")) & (F.col("length") == F.col("raw_length"))).alias("verified"))


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))
    stats = members.gz_stats(fixtures.member_files(docs, "doc_id", "line", 100))
    return stats.select("path", "uncompressed_bytes", "members", (F.col("compressed_bytes") < F.col("uncompressed_bytes")).alias("smaller"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as text in gzip files, back as lines."""
    text = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")
    events = table(spark, sf_dir, "events").select("event_id", text.alias("line"))
    lines = members.gz_lines(fixtures.member_files(events, "event_id", "line", 5000))
    return lines.groupBy(F.split("value", r"\|")[2].alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gzip value per document, damaged in one of nine ways by doc_id; what the reader says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    files = fixtures.damaged(members.compressed(docs, "raw", "content"), "doc_id")
    rows = members.gz_members(files, "PERMISSIVE").groupBy("path").agg(F.max("error").alias("error"))
    return rows.select(F.col("path").cast("bigint").alias("doc_id"), F.coalesce("error", F.lit("ok")).alias("error"))


def nested_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as one .gz file within another .gz file: the outer one holds blocks that look like its
    own, so starts found there are dropped and their chunks decoded again (restarted)."""
    inner = fixtures.one_file(table(spark, sf_dir, "lineitem").select(F.to_json(F.struct("*")).alias("value")), shared_dir(spark))
    outer = fixtures.again_compressed(spark, inner)
    with opened(outer) as f:
        chunk = max(64 << 10, min(1 << 20, f.size() // 6))
    out, checks, failures = parallel_bytes(spark, outer, chunk)
    again, _, _ = parallel_bytes(spark, fixtures.whole_file(out, shared_dir(spark)), 1 << 20)
    rows = fixtures.joined_lines(again).select(F.from_json("value", "l_returnflag string, l_quantity double").alias("r")).select("r.*")
    counted = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("int")).alias("quantity"))
    stats = parallel_stats(out, checks, failures).select((F.col("speculation_failures") > 0).alias("restarted"), F.col("members").alias("outer_members"))
    return counted.crossJoin(F.broadcast(stats))  # one row


def _pgz(spark: SparkSession, folder: str, table_: str, **options) -> DataFrame:
    spark.dataSource.register(PgzSource)
    return spark.read.format("pgz").option("table", table_).options(**options).load(folder)


def _file_name() -> Column:
    return F.regexp_extract("path", r"([^/]*)\.gz$", 1)


def pgz_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in BGZF files, read by the data source in several ranges a file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))
    found = _pgz(spark, fixtures.saved(fixtures.bgzf_files(docs, "doc_id", "line", 500), shared_dir(spark)), "members", chunkSize=64 << 10)
    return found.groupBy(_file_name().alias("path")).agg(
        F.count(F.lit(1)).alias("members"), (F.max("member_index") + 1).cast("bigint").alias("numbered"), F.count_distinct("member_index").alias("numbers"), F.sum("raw_length").alias("octets")
    )


def pgz_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as NDJSON in BGZF files, back as lines over several ranges a file."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct("page_id", "url", "html")).alias("line"))
    lines = _pgz(spark, fixtures.saved(fixtures.bgzf_files(pages, "page_id", "line", 1000), shared_dir(spark)), "lines", numPartitions=16)
    rows = lines.select(F.from_json("value", "page_id bigint, url string, html string").alias("r")).select("r.*")
    return rows.groupBy((F.col("page_id") % 7).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).alias("chars"), F.max("url").alias("last_url"))


def pgz_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member files, every other one with zeros behind its last member: what counts before the error."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))
    files = fixtures.member_files(docs, "doc_id", "line", 100)
    odd = F.substring_index("path", "-", -1).cast("bigint") % 2 == 1
    broken = files.withColumn("content", F.when(odd, F.concat("content", F.lit(bytearray(4)))).otherwise(F.col("content")))
    found = _pgz(spark, fixtures.saved(broken, shared_dir(spark)), "members", mode="PERMISSIVE")
    return found.groupBy(_file_name().alias("path")).agg(F.count("raw_length").alias("members"), F.sum("raw_length").alias("octets"), F.coalesce(F.max("error"), F.lit("ok")).alias("error"))


def compressed_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and lineitem from gzip text, joined and aggregated."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("line"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_json(F.struct("l_orderkey", "l_quantity")).alias("line"))
    o = members.gz_lines(fixtures.member_files(orders, "o_orderkey", "line", 5000)).select(F.from_json("value", "o_orderkey bigint, o_orderstatus string").alias("o")).select("o.*")
    i = members.gz_lines(fixtures.member_files(items, "l_orderkey", "line", 2000)).select(F.from_json("value", "l_orderkey bigint, l_quantity double").alias("l")).select("l.*")
    return o.join(i, o.o_orderkey == i.l_orderkey).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("long").alias("quantity"))


def single_member_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as one .gz file of one member, decoded from many places at once."""
    line = F.concat_ws(",", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), "l_returnflag", "l_linestatus")
    path = fixtures.one_file(table(spark, sf_dir, "lineitem").select(line.alias("value")), shared_dir(spark))
    out, checks, failures = parallel_bytes(spark, path, 64 << 10)
    lines = fixtures.joined_lines(out)
    counted = lines.groupBy(F.split("value", ",")[3].alias("l_returnflag")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.split("value", ",")[2].cast("bigint")).alias("quantity"))
    good = checks.agg(F.min(F.col("crc_ok") & F.col("isize_ok")).alias("verified")).first()["verified"]
    return counted.withColumn("verified", F.lit(good))


def read_any_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as NDJSON in BGZF files, member files and files of one member, each read in its way."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "text")).alias("line"))
    kind = lambda k: docs.where(F.col("doc_id") % 3 == k)
    named = lambda files, name: files.select(F.concat(F.lit(name), "path").alias("path"), "content")
    files = named(fixtures.bgzf_files(kind(0), "doc_id", "line", 5000), "blocks-").unionByName(named(fixtures.member_files(kind(1), "doc_id", "line", 500), "members-"))
    files = files.unionByName(named(fixtures.member_files(kind(2), "doc_id", "line", 5000, single=True), "single-"))
    lines = read_gz(spark, fixtures.saved(files, shared_dir(spark)), "lines", 64 << 10)
    rows = lines.select(F.from_json("value", "doc_id bigint, lang string, text string").alias("r")).select("r.*")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


QUERIES = [members_lang_count, member_decode, multi_member_concat, bgzf_split, bgzf_then_gzip, crc_verify, file_stats, event_lines, error_rows, nested_gzip, compressed_join_agg, single_member_parallel, pgz_members, pgz_lines, pgz_permissive, read_any_lines]

_FILE = "'file-' || CAST({key} // {n} AS VARCHAR)"

SQL = {
    "members_lang_count": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "member_decode": "SELECT doc_id, sha256(text) AS sha, octet_length(encode(text)) AS octets FROM documents",
    "multi_member_concat": f"SELECT {_FILE.format(key='doc_id', n=100)} AS path, 2 * count(*) AS members, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS octets FROM documents GROUP BY 1",
    "bgzf_split": f"SELECT {_FILE.format(key='page_id', n=250)} AS path, CAST(sum(octet_length(encode(html)) + 1) AS BIGINT) AS octets FROM pages GROUP BY 1",
    "bgzf_then_gzip": f"SELECT {_FILE.format(key='doc_id', n=300)} AS path, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS octets, CASE WHEN max(doc_id % 300) < 200 THEN 'bgzf' WHEN min(doc_id % 300) < 200 THEN 'bgzf+gzip' ELSE 'gzip' END AS kind FROM documents GROUP BY 1",
    "crc_verify": f"SELECT {_FILE.format(key='page_id', n=50)} AS path, CAST(sum(octet_length(encode(html))) AS BIGINT) AS raw_length, true AS verified FROM pages GROUP BY 1",
    "file_stats": f"SELECT {_FILE.format(key='doc_id', n=100)} AS path, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS uncompressed_bytes, count(*) AS members, true AS smaller FROM documents GROUP BY 1",
    "event_lines": "SELECT event_type, count(*) AS n, CAST(sum(length(CAST(event_id AS VARCHAR)) + length(CAST(user_id AS VARCHAR)) + length(event_type) + 2) AS BIGINT) AS chars FROM events GROUP BY event_type",
    "error_rows": "SELECT doc_id, ['ok','BadMagic','UnsupportedMethod','ReservedFlags','Truncated','CrcMismatch','IsizeMismatch','CrcMismatch','Truncated'][1 + doc_id % 9] AS error FROM documents",
    "nested_gzip": "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity, true AS restarted, CAST(1 AS BIGINT) AS outer_members FROM lineitem GROUP BY l_returnflag",
    "compressed_join_agg": "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12, 2))) AS BIGINT) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus",
    "single_member_parallel": "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity, true AS verified FROM lineitem GROUP BY l_returnflag",
    "pgz_members": f"SELECT path, CAST(sum(blocks) AS BIGINT) AS members, CAST(sum(blocks) AS BIGINT) AS numbered, CAST(sum(blocks) AS BIGINT) AS numbers, CAST(sum(octets) AS BIGINT) AS octets FROM (SELECT {_FILE.format(key='doc_id', n=500)} AS path, octet_length(encode(text)) + 1 AS octets, ceil((octet_length(encode(text)) + 1) / 48000.0) AS blocks FROM documents) GROUP BY path",
    "pgz_lines": "SELECT page_id % 7 AS bucket, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars, max(url) AS last_url FROM pages GROUP BY 1",
    "read_any_lines": "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "pgz_permissive": f"SELECT {_FILE.format(key='doc_id', n=100)} AS path, count(*) AS members, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS octets, CASE WHEN min(doc_id // 100) % 2 = 1 THEN 'Truncated' ELSE 'ok' END AS error FROM documents GROUP BY 1",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    return dict(SQL)
