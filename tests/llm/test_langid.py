import zlib

import numpy as np

from millrace.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy_and_defined_cases(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(-1, None, "en", "x"), (-2, "1234 %% !!", "fr", None), (None, "the end of the day", None, None), (-3, "", None, "s")], docs.schema)
    got = langid.evaluate(docs.unionByName(odd)).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == len(truth) + 4
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert {r["lang_pred"] for r in got} <= set(truth.values()) | {"und"}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (-1, -2, -3))
    assert all(0 <= r["score"] <= 1 for r in got)


def test_only_text_and_labels_count(spark):
    docs = spark.read.parquet(SF)
    a = {r["doc_id"]: r["lang_pred"] for r in langid.evaluate(docs).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in langid.evaluate(docs.withColumn("source", docs.doc_id.cast("string")).withColumn("Score", docs.doc_id)).collect()}
    assert a == b


def test_nothing_to_learn(spark):
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert langid.evaluate(rows).collect()[0]["lang_pred"] == "und"
    assert langid.evaluate(rows.limit(0)).count() == 0


def vector(text, idf):
    """The normalised TF-IDF vector of a text, n-gram by n-gram."""
    clean = b" " + bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()) + b" "
    n = [0] * langid.DIMS
    low = (1 << 32) - 1
    for i in range(len(clean) - 1):
        pair = clean[i] * 257 + clean[i + 1]
        n[((pair * 2246822519 & low) >> 9) % (langid.DIMS // 4)] += 1
        if i + 2 < len(clean):
            three = (pair * 2654435761 + clean[i + 2] * 40503 & low) >> 7
            n[langid.DIMS // 4 + three % (langid.DIMS * 3 // 4)] += 1
    v = np.log1p(np.array(n)) * idf
    return v / (np.linalg.norm(v) or 1)


def test_nearest_centroid_by_hand(spark):
    docs = spark.read.parquet(SF).where("doc_id < 400").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()] + ["the", "\u00e9\u00e8 " * 30_000, "x", "the", "THE"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, LANG_PRED string").repartition(3)
    got = langid.predict(df, model).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        cosine = model.centroids @ vector(t, model.idf)
        best = int(np.argmax(cosine))
        assert abs(r["score"] - min(1, max(0, cosine[best]))) < 1e-4
        assert cosine[model.langs.index(r["lang_pred"]) :].max() > cosine[best] - 1e-5
        assert r["rejected"] == (1 - cosine[best] > model.radii[best]) or abs(1 - cosine[best] - model.radii[best]) < 1e-4
    assert len({tuple(got[i])[1:] for i in (40, 43)}) == 1
    assert all(len([x for x in model.langs if x == name]) <= langid.CLUSTERS for name in model.langs)
