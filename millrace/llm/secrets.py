"""Operator 8: secret scans, in DataFrame functions only.

Base rules are regular expressions; the places of their matches follow from the lengths of the
matches and of what stands between them. The method's own rule looks at candidate strings (runs of
20 or more characters of the base64 alphabets that hold a letter and a digit). A window of WINDOW
characters slides over a candidate; its Shannon entropy is kept up by incremental counts (each step
raises the count of one character and lowers that of another). Hexadecimal candidates and others
have thresholds of their own. The windows that reach it, from the first to the last, are the span.
Candidates that an allow-list pattern matches are suppressed; base spans never are.

Defined cases: a null text counts as empty; places are code points, end exclusive; texts of any length
and with any number of matches take time about in proportion to their length; spans that start at the same place are
ordered by kind, then by end; repeated rows give equal results; an empty table stays empty; other
columns pass through, one named spans is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import let, starts
from millrace.llm.batches import unclashed

# Kinds in their order, base patterns, alphabets, thresholds in bits, allow-list.
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # a run of 16 or more: the same as dropping shorter runs
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
HEX_DIGITS = "0123456789abcdefABCDEF"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLDS = {"hex": 2.8, "base64": 3.7}
WINDOW = 20
ALLOW = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted",
    r"0123456789|(?i:abcdefghij)",
    r"^(.)\1+$",
]
SPAN = "struct<start:int,rank:int,stop:int,kind:string>"


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, stop, hit>>: all matches from left to right; hit is the group's text."""

    def of(cut: Column, hits: Column) -> Column:
        sizes = F.zip_with(F.slice(cut, F.lit(1), F.size(hits)), hits, lambda c, h: F.struct(F.length(c).alias("gap"), F.length(h["whole"]).alias("n"), h["part"].alias("hit")))
        placed = lambda pairs: let(starts(F.transform(pairs, lambda p: p["gap"] + p["n"])), lambda at: F.transform(pairs, lambda p, i: F.struct(
            (F.get(at, i) + p["gap"]).alias("start"), (F.get(at, i) + p["gap"] + p["n"]).alias("stop"), p["hit"].alias("hit"),
        )))
        return let(sizes, placed)

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    hits = F.zip_with(whole, parts, lambda w, p: F.struct(w.alias("whole"), p.alias("part")))
    return let(F.split(text, pattern, -1), lambda cut: let(hits, lambda h: of(cut, h)))


def entropy_range(candidate: Column, alphabet: str, threshold: float, window: int = WINDOW) -> Column:
    """struct<first, last>: from the start of the first window to the end of the last one whose
    entropy reaches the threshold; first is null if none does."""
    size = len(alphabet)
    nlogn = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(0.0)
    codes = F.transform(F.regexp_extract_all(candidate, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(alphabet), c))
    zero = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).cast("double").alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(chars: Column, acc: Column, i: Column) -> Column:
        enters = F.get(chars, i)
        leaves = F.when(i >= window, F.get(chars, i - window)).otherwise(0)
        n, m = F.element_at(acc["counts"], enters), F.when(leaves > 0, F.element_at(acc["counts"], F.greatest(leaves, F.lit(1)))).otherwise(0)
        # what leaves and what enters may be the same character: then nothing changes
        change = F.when(enters == leaves, 0.0).otherwise(nlogn(n + 1) - nlogn(n) + F.when(leaves > 0, nlogn(m - 1) - nlogn(m)).otherwise(0.0))

        def after(total: Column) -> Column:
            counts = F.transform(acc["counts"], lambda v, j: v + F.when(j + 1 == enters, 1).otherwise(0) - F.when(j + 1 == leaves, 1).otherwise(0))
            high = (i >= window - 1) & (F.log2(F.lit(float(window))) - total / window >= threshold)
            first = F.when(acc["first"].isNull() & high, i - window + 1).otherwise(acc["first"])
            return F.struct(counts.alias("counts"), total.alias("sum"), first.alias("first"), F.when(high, i + 1).otherwise(acc["last"]).alias("last"))

        return let(acc["sum"] + change, after)

    walk = lambda chars: F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), zero, lambda acc, i: step(chars, acc, i), lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))
    return let(codes, walk)


def _allowed(candidate: Column, allow: list[str]) -> Column:
    found = F.lit(False)
    for pattern in allow:
        found = found | F.rlike(candidate, F.lit(pattern))
    return found


def entropy_spans(text: Column, thresholds: dict[str, float], allow: list[str], window: int = WINDOW) -> Column:
    fit = F.filter(places(text, CANDIDATE), lambda c: F.rlike(c["hit"], F.lit("[0-9]")) & F.rlike(c["hit"], F.lit("[A-Za-z]")) & ~_allowed(c["hit"], allow))

    def judged(c: Column) -> Column:
        is_hex = F.rlike(c["hit"], F.lit("^[0-9a-fA-F]+$"))
        found = F.when(is_hex, entropy_range(F.lower(c["hit"]), HEX_DIGITS, thresholds["hex"], window)).otherwise(entropy_range(c["hit"], BASE64, thresholds["base64"], window))
        return let(found, lambda r: F.when(r["first"].isNotNull(), _span(c["start"] + r["first"], c["start"] + r["last"], 3)))

    return F.filter(F.transform(fit, judged), lambda s: s.isNotNull())


def _span(start: Column, stop: Column, rank: int) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), stop.cast("int").alias("stop"), F.lit(KINDS[rank]).alias("kind")).cast(SPAN)


def scan(df: DataFrame, text: str = "text", thresholds: dict[str, float] = THRESHOLDS, allow: list[str] = ALLOW) -> DataFrame:
    """Adds spans: array<struct<start, rank, stop, kind>>, by start, then kind in the order of KINDS."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    as_spans = lambda found, rank: F.transform(found, lambda p: _span(p["start"], p["stop"], rank))
    # texts without any match of a rule, nearly all, are scanned for it once
    assign = F.when(F.rlike(t, F.lit(ASSIGN)), as_spans(F.filter(places(t, ASSIGN, 2), lambda p: F.length(p["hit"]) >= 12), 0)).otherwise(none)
    access = F.when(F.contains(t, F.lit("AKIA")), as_spans(F.filter(places(t, ACCESS), lambda p: p["stop"] - p["start"] >= 18), 1)).otherwise(none)
    hexes = F.when(F.rlike(t, F.lit(HEX)), as_spans(places(t, HEX), 2)).otherwise(none)
    entropy = F.when(F.rlike(t, F.lit(CANDIDATE)), entropy_spans(t, thresholds, allow)).otherwise(none)
    return unclashed(df, ["spans"]).withColumn("spans", F.array_sort(F.concat(assign, access, hexes, entropy)))


def report(df: DataFrame) -> DataFrame:
    """Per document the numbers of base spans, a digest of them, and all spans."""
    found = scan(df.select("doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(told(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
    )


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), patterns AS (
  SELECT * FROM (VALUES
    (0, 'assign', '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]{16,}'), (3, 'entropy', '[A-Za-z0-9+/_=-]{20,}')) AS p (rank, kind, pattern)
), matched AS (
  SELECT doc_id, rank, kind, regexp_extract_all(t, pattern) AS hits, regexp_extract_all(t, pattern, CASE WHEN rank = 0 THEN 2 ELSE 0 END) AS parts, string_split_regex(t, pattern) AS gaps
  FROM texts, patterns WHERE regexp_matches(t, pattern)
), placed AS (
  SELECT doc_id, rank, kind, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM matched
), sized AS (
  SELECT doc_id, rank, kind, hit, part,
    sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM placed WINDOW w AS (PARTITION BY doc_id, rank ORDER BY i ROWS UNBOUNDED PRECEDING)
), base AS (
  SELECT doc_id, rank, kind, start, start + length(hit) AS stop FROM sized
  WHERE rank = 0 AND length(part) >= 12 OR rank = 1 AND length(hit) >= 18 OR rank = 2 AND length(hit) >= 16
), candidates AS (
  SELECT *, regexp_full_match(hit, '[0-9a-fA-F]+') AS is_hex FROM sized
  WHERE rank = 3 AND length(hit) >= 20 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND replace(hit, hit[1], '') <> ''
    AND NOT regexp_matches(hit, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|(?i:example|sample|dummy|placeholder|changeme|redacted)|0123456789|(?i:abcdefghij)')
), windows AS (
  SELECT doc_id, rank, kind, start, list_filter(range(length(hit) - 19), lambda i:
    list_aggregate(string_split(substr(CASE WHEN is_hex THEN lower(hit) ELSE hit END, CAST(i + 1 AS BIGINT), 20), ''), 'entropy') >= CASE WHEN is_hex THEN 2.8 ELSE 3.7 END) AS good
  FROM candidates
), spans AS (
  SELECT * FROM base UNION ALL
  SELECT doc_id, rank, kind, start + good[1], start + good[-1] + 20 FROM windows WHERE len(good) > 0
), told AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank, stop) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (doc_id)
"""
