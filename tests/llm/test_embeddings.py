import math

import numpy as np
import pytest

from millrace.llm import embeddings


def brute(vectors, cosine=0.95):
    good = [i for i, v in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(vectors))}
    for a in good:
        for b in good:
            if a != b and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links[a].add(b)
    comp = list(range(len(vectors)))
    for a in range(len(vectors)):
        todo, seen = [a], {a}
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        comp[a] = min(seen)
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


@pytest.mark.parametrize("block", [2048, 7])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    vectors = [rng.standard_normal(32) for _ in range(60)]
    vectors += [vectors[i] + rng.standard_normal(32) * 0.12 for i in range(20) for _ in range(3)]
    vectors += [vectors[0]] * 9 + [vectors[1] * 1000, vectors[2] * 1e-30]
    vectors = [[float(np.float32(x)) for x in v] for v in vectors] + [None, [], [0.0] * 32, [1.0] * 31 + [None], [float("nan")] * 32, [float("inf")] + [1.0] * 31, [1.0], [2.0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, CLS int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, recall=0.9999, block=block).collect()}
    assert got == brute(vectors)


def test_recall_on_given_vectors(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = int(((x @ x.T >= 0.95).sum() - len(x)))
    got = embeddings.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()
    assert len(got) == len(rows)
    assert 0.99 * true <= sum(r["n_links"] for r in got) <= true


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()) == [("4", 2, 4, True), ("4", 2, 4, True), ("None", 2, 4, False)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_hash_probability():
    assert 0.86 < embeddings.agree(math.sqrt(0.1)) < 0.87
    k, tables = embeddings.shape(50_000)
    assert 1 - (1 - embeddings.agree(math.sqrt(0.1)) ** k) ** tables >= 0.99
