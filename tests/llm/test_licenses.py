import random
import re
import time

import pytest

from millrace.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    found = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), [i for i, _ in found], ",".join(sorted({x for _, x in found}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


ODD = ["", None, "All rights reserved. all-rights\nRESERVED all rights reserved", "CC BY cc by CC-BY xcc by", "É CC BY cc by", "Ganeral Public License", "general public license " * 3, "x" * 10000]


def test_base_against_brute_force(spark):
    texts = ODD + [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, N_WORDS int")
    got = {r["doc_id"]: r for r in licenses.report(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, at, labels = brute(t)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(at), labels), t
        assert (r["first_word"], r["last_word"]) == ((at[0], at[-1]) if at else (None, None))
        assert set(filter(None, labels.split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


@pytest.mark.parametrize("line", ["Released under the MIT Licence.", "Licensed under the Apache Lisense, Version 2.0", "permision is hereby granted, free of charge, to any person", "all rigths reserved"])
def test_fuzzy_finds_and_reports_edits(line):
    search = licenses.NoticeSearch(licenses.PHRASES, licenses.NOTICES)
    w = words("Some words before " + line + " and after")
    found = search.fuzzy((" " + " ".join(w) + " ").encode())
    assert found
    for f in found:
        span = " ".join(w[f["first_word"] : f["end_word"]])
        assert span == f["matched"]
        best = min(distance(span, n) for n, label in licenses.NOTICES.items() if label == f["label"])
        assert best <= f["edits"] <= max(len(n) for n in licenses.NOTICES) // licenses.PER_EDIT


def test_seeds_cover_the_notice():
    for n in licenses.NOTICES:
        k = len(n) // licenses.PER_EDIT
        parts = licenses.seeds(n, k)
        assert len(parts) == k + 1 and b"".join(p for _, p in parts).decode() == n


def test_empty_table(spark):
    assert licenses.report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_worse_places_beside_the_best_are_found():
    search = licenses.NoticeSearch(licenses.PHRASES, licenses.NOTICES)
    worse, best = "licensed under the mit licence", "licensed under the mit license"
    for line in ([worse, best], [best, worse], [worse, best, worse], [worse, worse, best, worse, best]):
        for between in (" ", " and it is "):
            found = [f for f in search.fuzzy(f" {between.join(line)} too ".encode()) if f["matched"] in (worse, best)]
            assert [f["matched"] for f in found] == line and [f["edits"] for f in found] == [x == worse for x in line]


def test_each_notice_has_its_own_label(spark):
    search = licenses.NoticeSearch(licenses.PHRASES, licenses.NOTICES)
    for notice, label in licenses.NOTICES.items():
        assert [(f["label"], f["edits"]) for f in search.fuzzy(f" {notice} ".encode())] == [(label, 0)], notice
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = licenses.report(docs.where("text ILIKE '%CC BY-NC 4.0%' AND NOT text ILIKE '%public license%' AND NOT text ILIKE '%mit license%' AND NOT text ILIKE '%apache license%' AND NOT text ILIKE '%all rights reserved%'"))
    assert {r["labels"] for r in got.select("labels").distinct().collect()} == {"cc-by,cc-by-nc"}
    for text, labels in [("Licensed under CC BY 4.0", ["cc-by"]), ("Licensed under CC BY-ND 4.0", ["cc-by-nd"]), ("Licensed under CC BY-XY 4.0", []), ("Licenced under CC BY-NC 4.0", ["cc-by-nc"]), ("Licensed under the GNU Leser General Public License", ["lgpl"]), ("licensed under the gnu affero general public license", ["agpl"])]:
        assert [f["label"] for f in search.fuzzy((" " + " ".join(words(text)) + " ").encode())] == labels, text


def test_fuzzy_spans_against_brute_force():
    """Edits planted in every notice are found, and no span has another notice nearer to it."""
    rng = random.Random(3)
    search = licenses.NoticeSearch(licenses.PHRASES, licenses.NOTICES)
    for notice, label in list(licenses.NOTICES.items()) * 12:
        telling = licenses.telling_words(notice, label, licenses.NOTICES, licenses.PER_EDIT)
        # the library doesn't look for a last word that is left out as a whole
        spared = {i for m in re.finditer(r"\w+", notice) if m[0] in telling or len(m[0]) < 3 for i in range(m.start(), m.end())}
        own, left = list(notice), [i for i in range(len(notice)) if i not in spared and notice[i] != " "]
        for at in rng.sample(left, rng.randint(0, len(notice) // licenses.PER_EDIT)):
            own[at] = rng.choice(["", "z", "q" + notice[at]])
        own = " ".join("".join(own).split())
        assert distance(own, notice) <= len(notice) // licenses.PER_EDIT
        line = " ".join(["before", "some", own, "after", "it"])
        found = search.fuzzy(f" {line} ".encode())
        nearest = min(distance(own, n) / len(n) for n in licenses.NOTICES)
        assert any(f["label"] == label and f["edits"] <= distance(own, notice) for f in found) or any(f["edits"] / len(f["matched"]) <= nearest + 0.1 for f in found), own
        for f in found:
            assert f["matched"] == " ".join(line.split()[f["first_word"] : f["end_word"]])
            assert min(distance(f["matched"], n) for n, x in licenses.NOTICES.items() if x == f["label"]) <= f["edits"]
        for f, g in zip(found, found[1:]):
            assert f["end_word"] <= g["first_word"]


def test_many_places_take_linear_time():
    search = licenses.NoticeSearch(licenses.PHRASES, licenses.NOTICES)
    began = time.time()
    line = b" " + b"all rights reserved general public license " * 240_000
    assert len(search.base(line)) == 480_000
    assert time.time() - began < 20
    for text, n in (("released under the mit licence ", 10_000), ("all rights reservd ", 10_000)):
        began = time.time()
        assert len(search.fuzzy(f" {text * n}".encode())) == n
        assert time.time() - began < 60


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY 4.0"), (1, "Licensed under CC BY 4.0"), (None, None)], "doc_id bigint, text string")
    got = [tuple(r) for r in licenses.report(df).collect()]
    assert len(got) == 3 and len(set(got)) == 2
