import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import jaccard
from millrace.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute(rows):
    """(id, text) -> {id: (n_shingles, component)}; ids are distinct here."""
    sets = {i: shingles(t) for i, t in rows}
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in sets.items():
        shared = {}
        for g in s:
            for j in where[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, size, groups, edits):
    words = [f"w{i}" for i in range(400)]
    rows, common = [], [rng.choice(words) for _ in range(30)]
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))] + common * (g % 2)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    return rows


@pytest.mark.parametrize("long,most", [(48, 1000), (4, 1000), (3, 0)])
def test_components_equal_brute_force(spark, long, most):
    rng = random.Random(long)
    texts = family(rng, 12, 12, 3) + family(rng, 60, 1, 2) + ["", None, "  \x0b\t ", "one two", "ONE  two", "one two three four five", "a" * 100000, "x y z " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, CLS int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, long=long, max_long=most).collect()}
    assert got == brute(rows)


def test_given_documents(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()} == brute(rows)


def test_nulls_ties_and_repeats(spark):
    t = "the quick brown fox jumps over the lazy dog again"
    df = spark.createDataFrame([(5, t), (5, t), (3, t), (None, t), (None, "alone in the dark of the night"), (None, None), (9, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["n_shingles"]) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3, 6), (5, 3, 6), (3, 3, 6), (None, 3, 6), (None, None, 3), (None, None, 0), (9, 9, 0)], key=str)
    stay = jaccard.kept(df.selectExpr("doc_id", "text", "1 AS _K2")).collect()
    assert sorted((r["doc_id"] for r in stay), key=str) == sorted([3, None, None, 9], key=str)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [["one two"], ["one two", "one two"], ["a b c d e"], ["a b c d e", "A b  c d e"], [None], [""], ["one two", None, "two one"]])
def test_tables_of_one_or_two_rows(spark, texts):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()} == brute(rows)


def test_large_groups_over_many_partitions(spark):
    """10,000 copies and a near copy of them, near copies in a list of more than three Arrow batches,
    and short documents that share a passage but don't link."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    texts = [" ".join(base)] * 10_000 + [" ".join(base[:60] + ["changed"] + base[61:])]
    other = [f"o{i}" for i in range(60)]
    for i in range(700):
        own = list(other)
        own[rng.randrange(60)] = f"edit{i}"
        texts.append(" ".join(own))
    texts += [" ".join([f"p{i}" for i in range(60)] + [f"q{k}x{i}" for i in range(9)]) for k in range(300)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    distinct = {t: i for i, t in reversed(rows)}
    want = brute(sorted((i, t) for t, i in distinct.items()))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "31", "spark.sql.execution.arrow.maxRecordsPerBatch": "200"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(40)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, max_long=0).collect()}
        known = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, block=64).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == known == {i: want[distinct[t]] for i, t in rows}


def chain(rng, steps, words=150):
    """Texts that drift: each links with the ones next to it, none of the far ones with each other."""
    own = [f"c{rng.random()}" for _ in range(words)]
    for k in range(steps):
        yield " ".join(own)
        for at in rng.sample(range(words), 1 + k % 3):
            own[at] = f"d{rng.random()}"


@pytest.mark.parametrize("extra", [0, 1, 1000])
def test_pairs_of_a_group_grow_with_its_rows(spark, extra):
    """400 sets, all similar and all in components of their own, would be 79,800 pairs."""
    rng = random.Random(2)
    bits = [int(x) for x in jaccard.bitmap(np.array([rng.getrandbits(64) for _ in range(100)], np.uint64))]
    rows = [(1, i, 100, 100, False, i, bits) for i in range(400)]
    kind = "token bigint, cls bigint, n int, avail int, reach boolean, r bigint, bits array<bigint>"
    df = spark.createDataFrame(rows, kind)
    got = [(r["x"], r["y"]) for r in jaccard._across(df, 512, **({} if extra == 1 else {"extra": extra})).collect()]
    pairs = [p for p in got if p != (None, None)]
    assert len(pairs) == len(set(pairs)) == min(79_800, 399 + extra * 400) and all(x > y for x, y in pairs)
    assert ((None, None) in got) == (extra < 1000)
    assert len(set(components(spark.createDataFrame(pairs, "a bigint, b bigint")).select("root").collect())) == 1
    no = {}
    for x, y in pairs:
        no.setdefault(x, []).append(y)
    told = spark.createDataFrame([(*r, no.get(r[1])) for r in rows], kind + ", no array<bigint>")
    again = {(r["x"], r["y"]) for r in jaccard._across(told, 512, extra).collect()} - {(None, None)}
    assert not again & set(pairs) and bool(again) == (extra < 1000)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 3, 60, 64, 65, 130, 3000, 40_000)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, k).astype(np.uint64)]) for s in sets for k in (0, 1, len(s) // 8)]
    maps, everyone = jaccard.Bitmaps([jaccard.bitmap(s).tolist() for s in sets]), np.arange(len(sets))
    for i, s in enumerate(sets):
        differ = np.array([len(np.setxor1d(s, t)) for t in sets])
        got = maps.apart(i, everyone)
        assert (got <= differ).all() and got[i] == 0
        assert (got[differ < 40] >= differ[differ < 40] - 4).all() or len(s) < 4


def test_rounds_tell_all_pairs(spark, monkeypatch):
    """So few pairs a round that several rounds are needed, with pairs near the threshold that don't link."""
    rounds, across = [], jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda members, block, extra: rounds.append(extra) or across(members, block, extra * 0.01))
    rng = random.Random(4)
    texts = [t for _ in range(2) for t in chain(rng, 150)] + family(rng, 80, 2, 6)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, long=3, max_long=50, block=16).collect()}
    assert got == brute(rows)
    assert len(rounds) > 1


def lists_of(rows, long, size):
    """What _lists gives for sorted (token, n, cls) rows that come in batches of size."""
    kinds = (pa.int64(), pa.int32(), pa.int64())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + size]), kinds)], names=["token", "n", "cls"]) for at in range(0, len(rows), size)]
    return [r for b in jaccard._lists(iter(batches), long) for r in b.to_pylist()]


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_lists_come_whole_over_batches(size):
    rows = [(1, 10, 5)] + [(2, 10, i) for i in range(200)] + [(3, 10, 7), (3, 10, 8), (3, 40, 9)] + [(4, 10, i) for i in range(5)]
    got = lists_of(rows, 4, size)
    assert sorted(r["cls"] for r in got if r["token"] == 2) == list(range(200))
    assert sorted(r["cls"] for r in got if r["token"] == 4) == list(range(5))
    assert [(r["cls"], r["near"]) for r in got if r["token"] is None] == [(7, []), (8, [7]), (9, [])]


def test_component_chains(spark):
    rng = np.random.default_rng(1)
    order = rng.permutation(200)
    edges = [(int(a), int(b)) for a, b in zip(order[:149], order[1:150])] + [(7, 7), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {int(x): int(order[:150].min()) for x in order[:150]} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    hub = [(5, i) for i in range(10, 3000)] + [(4000, i) for i in range(2990, 3500)] + [(6000, 6001)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(hub, "a bigint, b bigint")).collect()}
    assert got == {i: 5 for i in [5, 4000, *range(10, 3500)]} | {6000: 6000, 6001: 6000}
