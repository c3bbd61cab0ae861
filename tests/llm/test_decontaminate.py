import random

import numpy as np
import pytest

from millrace.llm import decontaminate as d


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 80))] for _ in range(2))
        assert d.common(a, b) == lcs(a, b)


def brute(texts, items):
    """(doc, item) with STRONG of the item's words in order within a window of 1.25 times its length."""
    out = set()
    for i, t in texts:
        w = d.words_of(t)
        for k, it in items:
            own = d.words_of(it)
            size = len(own) + len(own) // 4
            if own and any(len(set(own) & set(w[s : s + size])) >= 0.4 * len(set(own)) and lcs(own, w[s : s + size]) >= d.STRONG * len(own) for s in range(0, max(1, len(w) - size + 2), max(1, len(own) // 8))):
                out.add((i, k))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    items = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    texts = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    planted = set()
    for n in range(40):
        k, it = rng.choice(items)
        words = it.split()
        for at in rng.sample(range(len(words)), len(words) // 12):
            words[at] = "changed"
        i, body = rng.choice(texts)
        body = body.split()
        at = rng.randint(0, len(body))
        texts.append((100000 + n, " ".join(body[:at] + words + body[at:])))
        planted.add((100000 + n, k))
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id bigint, text string, LEAKS string").repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.report(docs, bench).collect()}
    want = brute(texts, items)
    assert len(planted & got) >= 0.9 * len(planted)
    assert len(want & got) >= 0.9 * len(want)
    assert len(got - want) <= 0.1 * len(got)
    assert d.clean(docs, bench).count() == len(texts) - len({i for i, _ in got})
    whole = sorted(tuple(r) for r in d.report(docs, bench).collect())
    parts = sorted(tuple(r) for r in d.find_leaks(docs, bench, part_bytes=2000).selectExpr("doc_id", "inline(leaks)").collect())
    assert whole == parts


def test_paraphrase_needs_the_answer(spark):  # every window is a candidate here: a few documents have no latent space
    item = "when did the old mill by the river stop turning its heavy stone wheel for the last time in the year eighteen ninety four"
    loose = item.replace("heavy stone ", "").replace("by the river ", "near some water ").replace("for the last time ", "finally ").replace("old ", "")
    filler = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{filler} {loose} {filler}"), (2, f"{filler} {loose.replace('ninety four', 'eighty')} {filler}"), (3, filler), (4, None), (None, ""), (5, item)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item, "eighteen ninety four"), (8, None, None), (None, "", None)], "item_id bigint, text string, answer string")
    got = {(r["doc_id"], r["item_id"], r["answered"]) for r in d.find_leaks(docs, bench, cosine=-1.0).selectExpr("doc_id", "inline(leaks)").collect()}
    assert (5, 7, True) in got and (1, 7, True) in got and not any(i in (2, 3, 4, None) for i, _, _ in got)
    assert d.report(docs, bench.limit(0)).count() == 0
    assert d.report(docs.limit(0), bench).count() == 0


def test_singular_vectors_of_the_sketch():
    rng = np.random.default_rng(0)
    a = rng.poisson(1.0, (3000, 12)) * np.linspace(0.2, 3, 12)
    idf = np.linspace(1, 2, 12)
    omega = d.test_matrix({b"%d" % i: i for i in range(12)}, 12)
    got = d.folded(a.T @ (a @ omega), idf, omega)
    _, s, v = np.linalg.svd(a * idf, full_matrices=False)
    x = (a * idf) @ v.T / s
    y = a @ got
    assert np.allclose(d.unit(x) @ d.unit(x).T, d.unit(y) @ d.unit(y).T, atol=1e-2)


def test_recall_at_production_parameters(spark):
    rng = random.Random(8)
    items = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    texts = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    corpus, planted, copies = [w for _, t in rng.sample(texts, 50) for w in t.split()], {}, []
    for kept in (0.7, 0.6, 0.5):
        for k, it in items * 2:
            own = d.words_of(it)
            answer = len(d.answer_of(it, None)) if kept < d.STRONG else 0
            if kept < d.STRONG and not 0 < answer <= kept * len(own):
                continue
            words = [w.decode() for w in own]
            for at in rng.sample(range(len(own) - answer), len(own) - int(np.ceil(kept * len(own)))):
                words[at] = rng.choice(corpus)
            body = rng.choice(texts)[1].split()
            at = rng.randint(0, len(body))
            copies.append((1_000_000 + len(copies), " ".join(body[:at] + words + body[at:])))
            planted.setdefault(kept, set()).add((copies[-1][0], k))
    docs = spark.createDataFrame(texts + copies, "doc_id bigint, text string").repartition(8)
    got = {(r["doc_id"], r["item_id"]) for r in d.report(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert all(len(own) > 20 and len(own & got) >= 0.9 * len(own) for own in planted.values()), {k: (len(own & got), len(own)) for k, own in planted.items()}


def test_every_copy_in_a_document_is_reported(spark):
    item = "when did the old mill by the river stop turning its heavy stone wheel for the last time"
    docs = spark.createDataFrame([(1, f"{item} and then once more {item}")], "doc_id bigint, text string")
    found = d.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string"), cosine=-1.0).first()["leaks"]
    assert [x["overlap"] for x in found] == [1.0, 1.0]


def test_answer_of_short_last_sentences():
    assert d.answer_of("What is it? It is a blue whale. Yes. Ok.", None) == d.words_of("It is a blue whale. Yes. Ok.")
    assert d.answer_of("Yes. Ok.", None) == []


def test_terms_of_a_large_benchmark_have_ids_of_their_own(spark):
    rows = [(i, " ".join(f"w{(i * 20 + k)}" for k in range(20))) for i in range(2500)]
    known = d.vocabulary(spark.createDataFrame(rows, "item bigint, words string"))
    assert len(known) == 50_000 and sorted(known.values()) == list(range(50_000))
    with pytest.raises(ValueError, match="more than 100 words"):
        d.vocabulary(spark.createDataFrame(rows, "item bigint, words string"), 100)
    text = " ".join(f"filler{i}" for i in range(200))
    docs = spark.createDataFrame([(k, f"{text} {rows[i][1]} {text} {rows[-1][1]}") for k, i in enumerate((0, 7, 1638, 1639, 2400))] + [(99, text)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.report(docs, spark.createDataFrame(rows, "item_id bigint, text string")).collect()}
    assert got == {(k, i) for k, i in enumerate((0, 7, 1638, 1639, 2400))} | {(k, 2499) for k in range(5)}


def test_long_texts_repeated_rows_and_ties(spark):
    items = [(1, "the quick brown fox jumps over the lazy dog while seven wizards brew strong potions at midnight"), (2, "the quick brown fox jumps over the lazy dog while seven wizards brew strong potions at midnight"), (None, "entirely other words make this third item of the benchmark so that it can be told apart from them")]
    rng = random.Random(1)
    long = " ".join(rng.choice([f"n{i}" for i in range(3000)]) for _ in range(150_000))
    docs = spark.createDataFrame([(5, f"{long} {items[0][1]} {long} {items[2][1]}"), (6, items[0][1]), (6, items[0][1]), (7, long)], "doc_id bigint, text string")
    got = [tuple(r) for r in d.report(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()]
    assert sorted((i, k) for i, k, *_ in got if k is not None) == [(5, 1), (5, 2), (6, 1), (6, 1), (6, 2), (6, 2)]
    assert [(i, a, b) for i, k, a, b, *_ in got if k is None] == [(5, a, b) for i, k, a, b, *_ in got if k is None] and len([1 for _, k, *_ in got if k is None]) == 1
    (start, end), = [(a, b) for i, k, a, b, *_ in got if (i, k) == (5, 1)]
    assert start <= 150_000 < end
