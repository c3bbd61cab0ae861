"""Operator 1: line dedup by content-defined chunks of lines, in DataFrame functions only.

Each line has a 28-bit hash. A rolling hash over the last lines' hashes says where a chunk ends (where
it is a multiple of a divisor, and at the end of the text), so inserted or deleted lines move only the
boundaries next to them. RULES has several such rules: one over three lines for long passages, and
independent ones over single lines, which find short passages between different neighbours more
often. Chunks of two lines or more, of whatever rule, that stand in several places anywhere are
removed but for the first place (smallest doc_id, then hash of the text, then line); a line goes if a
chunk that it belongs to goes. The first place of a line's text is never removed, so no text is lost.

1. every multi-line chunk's 64-bit hash is counted; only hashes that repeat are looked at further.
   Hashes of more than a thousandth of all chunks, of which there are a thousand at most, are broadcast,
   the others joined;
2. documents with such hashes give the chunks' bytes, grouped and compared as such by partial minima of
   their places: a hash collision never removes anything, and a hot chunk is one row a task;
3. the texts are put together again without the chunks found.

Only hashes are shuffled for all documents in step 1. The texts are shuffled by document for steps 2
and 3, once if the table has no other columns (Spark reuses the exchange), else twice. These joins
are merge joins at every size: what is to be removed grows with the corpus.

Defined cases: a null text stays null; an empty text is one empty line and stays; single-line chunks
are never removed; a text of which all chunks go becomes empty; very long texts take time in proportion to
their lines; rows with equal doc_id and text are one document and stay or go alike; rows with a null
doc_id come last; doc_id 2^63 - 1 is reserved; an empty table stays empty; other columns pass through,
and n_lines and removed_lines are replaced if they are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import let
from millrace.llm.batches import unclashed
from millrace.shared import drop_written, written

#: Lines that a rolling hash covers, its bits that are skipped, and the divisor.
RULES = [(3, 0, 4), (1, 0, 2), (1, 1, 2), (1, 2, 2)]
HOT = 1000
_LAST = (1 << 63) - 1
# names of columns that exist only within the operator
_K, _H, _AT, _FIRST, _R = "_millrace_id", "_millrace_hash", "_millrace_at", "_millrace_first", "_millrace_rest"


# a place is one number, since sets of numbers are found by hashing: first line, number of lines
def _place(start: Column, n: Column) -> Column:
    return F.shiftleft(start.cast("bigint"), 31) + n


def _start(place: Column) -> Column:
    return F.shiftright(place, 31).cast("int")


def _n(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def _within(place: Column) -> Column:
    """The numbers of its lines."""
    return F.sequence(_start(place), _start(place) + _n(place) - 1)


def line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("bigint"))


def chunk_bounds(hashes: Column, rule: tuple[int, int, int]) -> Column:
    """array<bigint>: the place of each chunk of several lines."""
    window, skip, divisor = rule

    def rolled(i: Column) -> Column:
        total = F.get(hashes, i)
        for back in range(1, window):
            total = total + 31**back * F.when(i >= back, F.get(hashes, i - back)).otherwise(0)
        return F.shiftright(total, skip)

    last = F.size(hashes) - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (rolled(i) % divisor == 0) | (i == last))
    starts = lambda e: F.transform(e, lambda stop, k: let(F.when(k == 0, 0).otherwise(F.get(e, k - 1) + 1), lambda a: _place(a, stop - a + 1)))
    return F.filter(let(ends, starts), lambda c: _n(c) > 1)


def chunks(lines: Column, rules: list[tuple[int, int, int]] = RULES) -> Column:
    """The chunks of several lines of all rules, each place once."""
    return let(line_hashes(lines), lambda h: F.array_distinct(F.concat(*[chunk_bounds(h, r) for r in rules])))


def _part(lines: Column, place: Column) -> Column:
    return F.transform(_within(place), lambda i: F.get(lines, i))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.withColumn(_K, F.coalesce(F.col(key).cast("bigint"), F.lit(_LAST))).withColumn(_H, F.xxhash64(text))


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[tuple[int, int, int]] = RULES) -> DataFrame:
    """By document (id and hash of its text): the places of its chunks whose hash repeats, and those
    of them that are the first of their text."""
    keyed = _keyed(docs.select(key, text), key, text)
    hashed = lambda lines: F.transform(chunks(lines, rules), lambda c: F.struct(c.alias("at"), F.xxhash64(_part(lines, c)).alias("mark")))
    many = keyed.where(F.contains(text, F.lit("\n"))).select(_K, _H, F.inline(let(F.split(text, "\n", -1), hashed)))
    marks = written(many, "marks")
    counted = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    limit = max(HOT, marks.count() // HOT)
    hot = F.broadcast(counted.where(F.col("n") > limit).select("mark"))
    some = marks.join(hot, "mark", "left_anti").join(counted.where(F.col("n") <= limit).select("mark"), "mark").unionByName(marks.join(hot, "mark"))
    wanted = written(some.groupBy(_K, _H).agg(F.collect_set("at").alias(_AT)), "wanted")
    drop_written(marks)

    looked = keyed.select(_K, _H, text).join(wanted.hint("merge"), [_K, _H])
    told = lambda lines: F.transform(_AT, lambda c: F.struct(c.alias("at"), F.array_join(_part(lines, c), "\n").alias("chunk")))
    occurs = looked.select(_K, _H, F.inline(let(F.split(text, "\n", -1), told)))
    first = occurs.groupBy("chunk").agg(F.min(F.struct(_K, _H, "at")).alias("at"))
    kept = first.groupBy(F.col(f"at.{_K}").alias(_K), F.col(f"at.{_H}").alias(_H)).agg(F.collect_list("at.at").alias(_FIRST))
    return wanted.join(kept.hint("merge"), [_K, _H], "left")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[tuple[int, int, int]] = RULES) -> DataFrame:
    """docs with the text changed, and with n_lines (before) and removed_lines."""
    docs = unclashed(docs, ["n_lines", "removed_lines"])
    gone = repeated_chunks(docs, key, text, rules)
    keyed = _keyed(docs, key, text)
    if set(docs.columns) == {key, text}:  # then step 2 has shuffled the same columns already
        keyed = keyed.drop(key)
    joined = keyed.join(gone.hint("merge"), [_K, _H], "left")
    if key not in keyed.columns:
        joined = joined.withColumn(key, F.when(F.col(_K) != _LAST, F.col(_K)).cast(docs.schema[key].dataType))
    places = F.array_except(_AT, F.coalesce(_FIRST, F.array().cast("array<bigint>")))
    out = F.flatten(F.transform(places, _within))

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
        joined_up = lambda kept: F.struct(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("removed"))
        return let(left, joined_up)

    done = joined.withColumn(_R, F.when(F.size(places) > 0, let(F.split(text, "\n", -1), rest)))
    own = [F.coalesce(f"{_R}.text", text).alias(c) if c == text else F.col(c) for c in docs.columns]
    n_lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    return done.select(*own, F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(f"{_R}.removed", F.lit(0)).cast("long").alias("removed_lines"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL
), hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM lines
), rolled AS (
  SELECT *, h + 31 * coalesce(lag(h, 1) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0) AS r FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ruled AS (
  SELECT doc_id, i, line, 0 AS rule, r % 4 = 0 AS stop FROM rolled UNION ALL SELECT doc_id, i, line, 1, h % 2 = 0 FROM rolled
  UNION ALL SELECT doc_id, i, line, 2, (h // 2) % 2 = 0 FROM rolled UNION ALL SELECT doc_id, i, line, 3, (h // 4) % 2 = 0 FROM rolled
), placed AS (
  SELECT *, coalesce(sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, rule ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ruled
), chunks AS (SELECT doc_id, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, rule, k HAVING count(*) > 1
), judged AS (SELECT *, rank() OVER (PARTITION BY chunk ORDER BY doc_id, start) = 1 AS stays FROM chunks
), gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS i FROM judged WHERE NOT stays
), rebuilt AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.i IS NULL), '') AS text, count(*) AS n_lines, count(g.i) AS removed_lines
  FROM lines l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, r.text, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.removed_lines, 0) AS removed_lines FROM documents d LEFT JOIN rebuilt r USING (doc_id)
"""
