"""Operator 5: license scans, with fuzzy search for short notices.

A notice of n characters is sought with at most n // PER_EDIT edits. By the pigeonhole principle a
text within k edits of the notice holds at least one of the notice's k + 1 parts unchanged, so exact
searches for the parts (seeds) find every place worth a look. There the regex library's
bounded-error matching verifies the notice and gives the span and the edits. Base phrases are exact.

Notices of different licenses may be within each other's edits. So the words that tell a notice from
such neighbours must stand in the match, with less than half the edits that lead to the neighbour's
word; and of spans that overlap only the one with the fewest edits for its length stays (then the
longer, the earlier, and the first by label and notice).

Defined cases: a null text counts as empty; a text without words has no spans and score 0; texts of
any length and with any number of places take time in proportion to their length: long stretches of seeds are
verified in pieces that overlap by more than a notice; rows may repeat and get equal results; an
empty table gives an empty table; clashing columns are replaced, others pass through.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.batches import add_columns

# Base phrases and labels, and short notices and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under the bsd license": "bsd",
    "licensed under the eclipse public license": "epl",
    "licensed under the isc license": "isc",
    "distributed under the boost software license version 1 0": "boost",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the mit license": "mit",
    "released under the mit license": "mit",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
    "subject to the terms of the mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
}
PER_EDIT = 9

_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BASE = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))
FOUND = T.ArrayType(
    T.StructType(
        [T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()),
         T.StructField("edits", T.LongType()), T.StructField("likeness", T.DoubleType()), T.StructField("matched", T.StringType())]
    )
)


def words_of(text: str | None) -> list[bytes]:
    """Lower case for A-Z; words are runs of digits, ASCII letters and anything beyond ASCII."""
    return text.encode().translate(_BYTES).split() if text else []


def seeds(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """The notice in edits + 1 parts, with the place of each."""
    n, k = len(notice), edits + 1
    return [(n * i // k, notice[n * i // k : n * (i + 1) // k].encode()) for i in range(k)]


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def telling_words(notice: str, label: str, notices: dict[str, str], per_edit: int) -> dict[str, int]:
    """The words that tell the notice from those of other labels within its and their edits, and how
    many edits each may have: less than half of what leads to a word of the other."""
    out: dict[str, int] = {}
    for other, its in notices.items():
        if its != label and edit_distance(notice, other) <= len(notice) // per_edit + len(other) // per_edit:
            foreign = set(other.split()) - set(notice.split())
            for word in set(notice.split()) - set(other.split()):
                apart = min([len(word), *(edit_distance(word, w) for w in foreign)])
                out[word] = min(out.get(word, apart), (apart - 1) // 2)
    return out


class NoticeSearch:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str], per_edit: int = PER_EDIT):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = []
        for notice, label in notices.items():
            edits = len(notice) // per_edit
            # the word before must end where the notice starts, and so at its end: notices are whole words
            form = regex.compile(rf"(?b)(?<= )(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}(?= )")
            telling = [(word.encode().decode("latin-1"), most) for word, most in telling_words(notice, label, notices, per_edit).items()]
            self.notices.append((notice, label, edits, seeds(notice, edits), form, telling))

    def base(self, line: bytes) -> list[dict]:
        found = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = line.find(phrase, at + 1)
        words = _word_numbers(line, [at for at, _ in found])
        return sorted(({"label": label, "word": w} for (_, label), w in zip(found, words)), key=lambda x: (x["word"], x["label"]))

    def fuzzy(self, line: bytes) -> list[dict]:
        found: set[tuple] = set()  # edits a character, characters negative, start, label, notice, edits
        for k, (notice, label, edits, parts, form, telling) in enumerate(self.notices):
            windows = []
            for offset, part in parts:
                at = line.find(part)
                while at >= 0:
                    windows.append((max(0, at - offset - edits - 1), min(len(line), at - offset + len(notice) + edits + 1)))
                    at = line.find(part, at + 1)
            whole = len(notice) + edits + 2
            for a, b in _pieces(_joined(windows), 16 * whole, whole):
                # bytes as Latin-1 characters: places in the window are places in the line
                for m in _places(form, line[a:b].decode("latin-1")):
                    words = m[0].split()
                    if all(word in words or most and any(edit_distance(word, w) <= most for w in words) for word, most in telling):
                        n = sum(m.fuzzy_counts)
                        found.add((n / len(notice), m.start() - m.end(), a + m.start(), label, k, n))
        best = _apart(sorted(found))
        first, end = (_word_numbers(line, [x[at] - more for x in best]) for at, more in ((0, 1), (1, 0)))
        out = [{"label": label, "first_word": f, "end_word": e, "edits": n, "likeness": 1 - n / len(self.notices[k][0]), "matched": line[a:b].decode("utf-8", "replace")}
               for (a, b, label, k, n), f, e in zip(best, first, end)]
        return sorted(out, key=lambda x: (x["first_word"], x["label"], x["end_word"], x["edits"]))


def _word_numbers(line: bytes, places: list[int]) -> list[int]:
    """For places of spaces in the line: the number of the word behind each, from 0."""
    if not places:
        return []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    return np.searchsorted(spaces, places).tolist()


def _apart(found: list[tuple]) -> list[tuple]:
    """Of spans that overlap the first in the order given: start, end, label, notice, edits."""
    starts: list[int] = []
    taken: dict[int, tuple] = {}
    for _, size, a, label, k, n in found:
        b = a - size
        at = bisect_right(starts, a)
        if (at == 0 or taken[starts[at - 1]][1] <= a) and (at == len(starts) or starts[at] >= b):
            starts.insert(at, a)
            taken[a] = (a, b, label, k, n)
    return [taken[a] for a in starts]


def _places(form: regex.Pattern, window: str) -> Iterator[regex.Match]:
    """Matches that don't overlap: the best one, and as many again before and behind it. The spaces
    around a match stay with the parts beside it."""
    parts = [(0, len(window))]
    while parts:
        a, b = parts.pop()
        if m := form.search(window, a, b):
            yield m
            parts += [(a, m.start()), (m.end(), b)]


def _pieces(windows: list[tuple[int, int]], size: int, more: int) -> Iterator[tuple[int, int]]:
    """The windows, those longer than size in pieces that overlap by more than any match is long."""
    for a, b in windows:
        while b - a > size:
            yield a, a + size
            a += size - more
        yield a, b


def _joined(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(df: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, per_edit: int = PER_EDIT) -> DataFrame:
    """Adds n_words, base_spans (exact places of phrases, by word) and notice_spans (places of
    notices with their edits), over whole texts."""

    def maker():
        search = NoticeSearch(phrases, notices, per_edit)

        def make(batch: pa.RecordBatch) -> list:
            counts, base, fuzzy = [], [], []
            for t in batch.column(text).to_pylist():
                words = words_of(t)
                line = b" " + b" ".join(words) + b" "
                counts.append(len(words))
                base.append(search.base(line))
                fuzzy.append(search.fuzzy(line))
            span = pa.struct([("label", pa.string()), ("word", pa.int64())])
            place = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64()), ("likeness", pa.float64()), ("matched", pa.string())])
            return [pa.array(counts, pa.int64()), pa.array(base, pa.list_(span)), pa.array(fuzzy, pa.list_(place))]

        return make

    return add_columns(df, [T.StructField("n_words", T.LongType()), T.StructField("base_spans", BASE), T.StructField("notice_spans", FOUND)], maker)


def report(df: DataFrame) -> DataFrame:
    """Per document the counts, first and last base places, labels and score: 1 with a base phrase,
    else the likeness of the best notice, else 0."""
    found = scan(df.select("doc_id", "text"))
    base, words = F.col("base_spans.label"), F.col("base_spans.word")
    return found.select(
        "doc_id", "n_words", F.size("base_spans").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.col("notice_spans.label")))), ",").alias("labels"),
        F.when(F.size("base_spans") > 0, 1.0).otherwise(F.coalesce(F.array_max("notice_spans.likeness"), F.lit(0.0))).alias("score"),
        F.size("notice_spans").cast("long").alias("n_notices"),
    )
