import re

import numpy as np

from millrace.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    truth = {r["_id"]: r["label"] for r in quality.label_classes(labels.where("doc_id % 2 = 1")).collect()}
    judged = {r["doc_id"]: r for r in quality.judge(docs, half).select("doc_id", "kept", "p_good", "p_junk", "p_toxic").collect()}
    assert len(judged) == docs.count()
    rate = lambda c: np.mean([judged[i]["kept"] for i, k in truth.items() if k == c])
    assert rate(0) > 0.98
    assert rate(1) < 0.1 and rate(2) < 0.1
    assert all(abs(r["p_good"] + r["p_junk"] + r["p_toxic"] - 1) < 1e-9 for r in judged.values())


def test_sites_shrink_to_their_prior(spark):
    rows = [(i, "x", "big", "big/a", 3.0 if i % 2 else -3.0, -5.0) for i in range(400)] + [(900, "x", "tiny", "tiny/a", 3.0, -5.0)] + [(1000 + i, "x", "clean", f"clean/{i % 3}", -4.0, -5.0) for i in range(300)]
    rows += [(5000, "x", None, None, -4.0, -5.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _host string, _path string, l_junk double, l_toxic double")
    model = quality.Evidence({b"x": (0.0, 0.0)}, np.zeros((5, 2)), np.array([0.8, 0.15, 0.05]))
    got = {r["_path"]: r for r in quality.sites(df, model, "_host", "_path").collect()}
    assert got["clean/0"]["site_good"] > got["tiny/a"]["site_good"] > 0.4
    assert got["big/a"]["site_good"] < got["clean/0"]["site_good"]
    assert None in got


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (1, None, None, None, 1), (None, "", "s", "en", 2), (3, "x" * 100000, "s", "en", 3)], "doc_id bigint, text string, source string, lang string, KEPT int")
    none = spark.createDataFrame([(9, 1, 0), (None, 0, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    got = quality.judge(docs, none).collect()
    assert len(got) == 4 and all(r["kept"] for r in got)
    some = spark.createDataFrame([(1, 0, 0), (1, 1, None), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.judge(docs, some).count() == 4
    assert {r["_id"]: r["label"] for r in quality.label_classes(some).collect()} == {1: 1, 3: 0}
    assert quality.judge(docs.limit(0), some).count() == 0


def by_hand(rows, shares):
    """(host, path, l_junk, l_toxic) -> p_good, p_junk, p_toxic of each, by the formulas of the docstring."""
    ratio = np.exp(np.minimum(60, np.array([[0.0, a, b] for _, _, a, b in rows])))
    soft = ratio * shares
    soft /= soft.sum(axis=1, keepdims=True)
    sums = {}
    for (host, path, *_), p in zip(rows, soft):
        for site in (("all",), (host,), (host, path)):
            sums[site] = sums.get(site, np.zeros(4)) + np.append(p, 1)
    whole = sums["all",][:3] / sums["all",][3]

    def weight(level, mean):
        groups = [(v[3], (1 - v[0] / v[3] - mean(k)) ** 2, mean(k) * (1 - mean(k))) for k, v in sums.items() if len(k) == level and k != ("all",)]
        n = sum(g[0] for g in groups)
        between = max(0.0, sum(g[0] * g[1] for g in groups) - sum(g[2] for g in groups)) / n
        return np.clip(sum(g[0] * g[2] for g in groups) / n / max(between, 1e-12) - 1, 5, 100_000)

    k = weight(1, lambda _: 1 - whole[0])
    hosts = {s[0]: (v[:3] + k * whole) / (v[3] + k) for s, v in sums.items() if len(s) == 1 and s != ("all",)}
    m = weight(2, lambda s: 1 - hosts[s[0]][0])
    paths = {s: (v[:3] + m * hosts[s[0]]) / (v[3] + m) for s, v in sums.items() if len(s) == 2}
    out = np.array([r * paths[h, p] for (h, p, *_), r in zip(rows, ratio)])
    return out / out.sum(axis=1, keepdims=True)


def test_posterior_over_hosts_and_paths_by_hand(spark, monkeypatch):
    model = quality.Evidence({b"bad": (2.0, -1.0), b"foul": (-1.0, 3.0), b"fine": (-1.5, -2.0)}, np.vstack([np.eye(2), np.zeros((3, 2))]), np.array([0.7, 0.2, 0.1]))
    monkeypatch.setattr(quality, "fit", lambda *a, **k: model)
    rng = np.random.default_rng(2)
    sites = [("https://Good.example/blog/", ["fine", "fine", "bad"]), ("https://good.example/spam/", ["bad", "bad", "fine"]), ("http://u@foul.example:80/x/", ["foul", "foul", "fine"]), ("https://tiny.example/", ["bad"])]
    rows = [(i, words, f"{site}page{i}?q=/a/b", None) for i, (site, words) in enumerate([(s, str(rng.choice(w)) + " text") for s, w in sites for _ in range(60 if "tiny" not in s else 1)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, url string, P_GOOD string").repartition(4)
    got = quality.judge(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).orderBy("doc_id").collect()
    host = [re.sub(r"^.*@|:80$", "", r[2].split("/")[2]).lower() for r in rows]
    path = [f"{h}/{r[2].split('/')[3] if '/page' in r[2] and r[2].count('/page') and len(r[2].split('?')[0].split('/')) > 4 else ''}" for h, r in zip(host, rows)]
    want = by_hand([(h, p, *model.ratios(r[1])) for h, p, r in zip(host, path, rows)], model.shares)
    assert np.allclose([[r["p_good"], r["p_junk"], r["p_toxic"]] for r in got], want, atol=1e-9)
    assert [r["kept"] for r in got] == (want[:, 0] >= quality.KEEP).tolist()
    by_word = {(p, r[1]): w for p, r, w in zip(path, rows, want[:, 0])}
    assert by_word["good.example/blog", "bad text"] > by_word["good.example/spam", "bad text"]  # the same text, another path


def test_equal_texts_with_different_labels_make_one_fit(spark):
    rows = [(i, f"good words here {i % 50} number{i}", "s", "en") for i in range(400)] + [(1000 + i, f"junk junk {i % 40}", "s", "en") for i in range(120)]
    docs = spark.createDataFrame(rows + [(5000, rows[0][1], "s", "en"), (5001, rows[0][1], "s", "en")], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows] + [(5000, 0, 0), (5001, 1, 1)], "doc_id bigint, quality int, toxic int")
    fits = [quality.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 7)]
    assert fits[0].weights and fits[0].weights == fits[1].weights and np.allclose(fits[0].calibration, fits[1].calibration)
