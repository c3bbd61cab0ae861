import hashlib
import random
import time

from millrace.llm import lines


def brute(rows):
    """(id, text), ids distinct and not null, except that null comes last."""
    places, texts = {}, {}
    for d, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0])):
        own = texts[d] = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in own]
        for window, skip, divisor in lines.RULES:
            start = 0
            for j in range(len(own)):
                rolled = sum(31**back * h[j - back] for back in range(window) if j >= back)
                if (rolled >> skip) % divisor == 0 or j == len(own) - 1:
                    if j > start:
                        places.setdefault(tuple(own[start : j + 1]), []).append((d is None, d or 0, start))
                    start = j + 1
    gone = set()
    for chunk, at in places.items():
        gone |= {(none, d, i) for none, d, start in at if (none, d, start) != min(at) for i in range(start, start + len(chunk))}
    return [(d, None if t is None else "\n".join(x for i, x in enumerate(texts[d]) if (d is None, d or 0, i) not in gone)) for d, t in rows]


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1, "own") for d, t in rows], "doc_id bigint, text string, source string, N_LINES int, gone string").repartition(3)
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "source", "gone", "n_lines", "removed_lines"]
    got = got.collect()
    assert all(r["gone"] == "own" for r in got)
    before = {d: t for d, t in rows}
    for r in got:
        if r["text"] is not None and r["doc_id"] is not None:
            assert r["n_lines"] == before[r["doc_id"]].count("\n") + 1
    return sorted([(r["doc_id"], r["text"]) for r in got], key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [f"line {i}" for i in range(30)]
    shared = [[rng.choice(pool) for _ in range(rng.randint(3, 30))] for _ in range(6)]
    texts = []
    for _ in range(80):
        body = [f"own {rng.random()}" for _ in range(rng.randint(0, 6))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randint(0, len(body))
            body[at:at] = s
        texts.append("\n".join(body))
    texts += ["", None, "\n", "\n\n\n\n\n\n", "a\r\nb", "one line", "one line", ("x\ny\nz\n" * 400), "\n".join(f"l{i}" for i in range(5000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    want = brute(rows)
    assert run(spark, rows) == sorted(want, key=str)
    assert sum(len(t or "") for _, t in want) < sum(len(t or "") for t in texts)


def test_shifted_passage_is_found(spark):
    passage = "\n".join(f"passage {i} with some words" for i in range(40))
    got = dict(run(spark, [(1, "start\n" + passage), (2, "a\nb\nc\n" + passage + "\nend")]))
    assert got[1] == "start\n" + passage
    assert len(got[2]) < 0.4 * len(passage)


def test_repeated_rows_and_empty_table(spark):
    t = "\n".join(f"line {i}" for i in range(20))
    assert [x for _, x in run(spark, [(1, t), (1, t)])] == [t, t]
    assert run(spark, []) == []


def test_no_line_is_lost(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice([f"line {k}" for k in range(12)]) for _ in range(rng.randint(1, 9)))) for i in range(300)]
    got = run(spark, rows)
    assert got == sorted(brute(rows), key=str)
    assert {x for _, t in rows for x in t.split("\n")} == {x for _, t in got for x in t.split("\n") if x}


def test_short_passages_between_different_lines():
    """The share of planted passages of whole lines of which lines are removed, by their length."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    line = lambda: " ".join(rng.choices(words, k=18))
    caught = {}
    for m in (1, 2, 3, 4, 6, 10):
        rows, n = [], 400
        for i in range(n):
            passage = [line() for _ in range(m)]
            rows += [(2 * i + k, "\n".join([*(line() for _ in range(3)), *passage, *(line() for _ in range(3))])) for k in range(2)]
        caught[m] = sum(a[1] != b[1] for a, b in zip(rows, brute(rows))) / n
    assert caught[1] == 0 and caught[2] > 0.1 and caught[3] > 0.3 and caught[4] > 0.5 and caught[6] > 0.8 and caught[10] > 0.97


def test_long_text_of_repeated_lines(spark):
    text = "\n".join(f"line {i % 40_000}" for i in range(80_000))
    began = time.time()
    r = lines.dedup_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert time.time() - began < 90
    assert r["n_lines"] == 80_000 and r["removed_lines"] > 39_900
