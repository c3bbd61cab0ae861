"""Operator 2: quality classification by hierarchical empirical Bayes.

1. Document evidence: a naive Bayes classifier over the presence of words and of binned shape
   features (symbols, capitals, repetition, lengths) for the classes good, junk and toxic. Its
   features and weights are counted on four fifths of a bounded sample of labelled documents (at most
   MAX_LABELLED, chosen by a hash of doc_id; equal texts count once) and its scores are calibrated on the other fifth. At most
   MAX_FEATURES features, those that separate the classes best, are kept.
2. Sites: the evidence of all documents is summed by host and by path. A host's class shares are
   its sum shrunk towards the global shares, a path's are shrunk towards its host's. How strongly
   (the prior's weight) is estimated from the spread between hosts and between paths.
3. A document's posterior is its evidence times its path's shares. It is rejected where good has
   less than KEEP.

Hosts and paths may be as skewed as they like: they are only ever grouped by partial sums, and joined.

Defined cases: a null text counts as empty (its shape features say so); null hosts and paths are
sites of their own; labels for unknown documents, with nulls or repeated are harmless (a document is
toxic if any row says so, else junk if any row says so, and so is a text that stands in several labelled
documents); very long texts are read whole, as a set of words; features of equal score are chosen by
name; without any labelled document evidence is neutral and everything is kept; repeated rows are judged alike; an empty table stays empty; clashing
columns are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log2
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.batches import add_columns, unclashed
from millrace.shared import drop_written, written

CLASSES = ["good", "junk", "toxic"]
MAX_LABELLED = 20_000
MAX_FEATURES = 20_000
MIN_DOCS = 6
MIN_Z = 4.5
KEEP = 0.5
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_KIND = np.zeros(256, np.uint8)
_KIND[list(range(65, 91))] = 1
_KIND[list(range(48, 58))] = 2
_KIND[list(range(33, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 127))] = 3
_KIND[[32, 10, 9, 13]] = 4


_TRIPLES = [bytes([b]) * 3 for b in np.flatnonzero(_KIND == 3).tolist()]


def features(text: str | None) -> set[bytes]:
    """Words of the whole text, and names of bins like `#upper=3`."""
    raw = (text or "").encode()
    words = raw.translate(_WORD).split()
    own = set(words)
    n = max(1, len(raw))
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=5) / n
    share = lambda x: min(8, int(log2(1 + 255 * x)))
    shape = {
        "upper": share(kinds[1]), "digit": share(kinds[2]), "symbol": share(kinds[3]), "space": int(20 * kinds[4]), "words": int(log2(1 + len(words))),
        "distinct": int(10 * len(own) / max(1, len(words))), "length": min(20, len(raw) // max(1, len(words))), "pipe": share(raw.count(b" | ") / n), "shout": share(raw.count(b"!!") / n),
        "again": share(sum(map(eq, words, words[1:])) / max(1, len(words))), "triple": share(sum(raw.count(t) for t in _TRIPLES) / n),
    }
    own.update(f"#{k}={v}".encode() for k, v in shape.items())
    return own


class Evidence:
    """Log-likelihood ratios against good, one for junk and one for toxic, and the global shares."""

    def __init__(self, weights: dict[bytes, tuple[float, float]], calibration: np.ndarray, shares: np.ndarray):
        self.weights, self.calibration, self.shares = weights, calibration, shares

    def raw(self, text: str | None) -> np.ndarray:
        """Sums over words, then over shape features: of junk, of toxic."""
        out = np.zeros(4)
        for f in sorted(self.weights.keys() & features(text)):
            at = 2 if f[:1] == b"#" else 0
            out[at : at + 2] += self.weights[f]
        return out

    def ratios(self, text: str | None) -> np.ndarray:
        return np.append(self.raw(text), 1.0) @ self.calibration - np.log(self.shares[1:] / self.shares[0])


def label_classes(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, label (0 good, 1 junk, 2 toxic); rows without a usable label are left out."""
    one = labels.where(F.col(key).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    both = one.groupBy(F.col(key).alias("_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return both.select("_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("label"))


def calibrated(raw: np.ndarray, label: np.ndarray, rounds: int = 200, ridge: float = 0.02) -> np.ndarray:
    """Multinomial logistic regression of the class on the raw scores: 5 x 2 coefficients."""
    x = np.column_stack([raw, np.ones(len(raw))])
    y = np.eye(3)[label][:, 1:]
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    k = x.shape[1]
    w = np.zeros((k, 2))
    for _ in range(rounds):
        p = np.exp(np.clip(x @ w, -30, 30))
        p /= 1 + p.sum(axis=1, keepdims=True)
        grad = x.T @ (p - y) / len(x) + ridge * w / len(x)
        q = np.maximum(p * (1 - p), 1e-6)
        for j in range(2):  # a Newton step for each class
            h = (x * q[:, j : j + 1]).T @ x / len(x) + np.eye(k) * (ridge / len(x) + 1e-9)
            w[:, j] -= 0.5 * np.linalg.solve(h, grad[:, j])
    return w / scale[:, None]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Evidence:
    # at most max_labelled rows of two numbers: small enough to broadcast whatever the corpus
    sample = label_classes(labels, key).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    joined = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
    shown = joined.groupBy("_text").agg(F.min("_id").alias("_id"), F.max("label").alias("label"))
    fifth = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(5))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = [Counter(), Counter(), Counter()]
            for t, c in zip(batch.column("_text").to_pylist(), batch.column("label").to_pylist()):
                by[c].update(features(t))
                by[c][b"#"] += 1
            names = sorted(set().union(*by))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array([c[f] for f in names], pa.int64()) for c in by)], names=["feature", *CLASSES])

    sums = [F.sum(c).alias(c) for c in CLASSES]
    counted = written(shown.where(fifth > 0).mapInArrow(count, "feature binary, good bigint, junk bigint, toxic bigint").groupBy("feature").agg(*sums).where(f"good + junk + toxic >= {MIN_DOCS}"), "features")
    total = counted.where(F.col("feature") == F.lit(bytearray(b"#"))).first()
    if total is None:
        return Evidence({}, np.zeros((5, 2)), np.ones(3) / 3)
    size = np.array([total[c] for c in CLASSES], float)
    all_docs = size.sum()

    def z(c: str, n: float) -> Column:
        seen = F.col("good") + F.col("junk") + F.col("toxic")
        expected = seen * (n / all_docs)
        return F.abs(F.col(c) - expected) / F.sqrt(F.greatest(expected * (1 - seen / (all_docs + 1)), F.lit(0.25)))

    apart = F.greatest(*[z(c, n) for c, n in zip(CLASSES[1:], size[1:])])
    chosen = counted.where(F.col("feature") != F.lit(bytearray(b"#"))).withColumn("z", apart).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(max_features).collect()
    drop_written(counted)
    odds = lambda k, n: (k + 0.1) / (n + 0.2)
    weights = {bytes(r["feature"]): tuple(float(np.log(odds(r[c], n) / odds(r["good"], size[0]))) for c, n in zip(CLASSES[1:], size[1:])) for r in chosen}
    model = Evidence(weights, np.zeros((5, 2)), (size + 1) / (all_docs + 3))
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [spread.value.raw(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(raw, pa.list_(pa.float64()))], names=["label", "raw"])

    rows = shown.where(fifth == 0).select("_text", "label").mapInArrow(score, "label int, raw array<double>").limit(2 * max_labelled).collect()
    if rows:
        model.calibration = calibrated(np.array([r["raw"] for r in rows]), np.array([r["label"] for r in rows]))
    return model


def with_evidence(docs: DataFrame, model: Evidence, text: str = "text") -> DataFrame:
    """Adds l_junk and l_toxic, the document's calibrated log-likelihood ratios against good."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def maker():
        def make(batch: pa.RecordBatch) -> list:
            own = np.array([spread.value.ratios(t) for t in batch.column(text).to_pylist()])
            return [pa.array(own[:, 0]), pa.array(own[:, 1])]

        return make

    return add_columns(docs, [T.StructField("l_junk", T.DoubleType()), T.StructField("l_toxic", T.DoubleType())], maker)


def posterior(shares: list[Column]) -> list[Column]:
    """Class shares of a document from its evidence and the class shares of where it comes from."""
    weights = [shares[0], shares[1] * F.exp(F.least("l_junk", F.lit(60.0))), shares[2] * F.exp(F.least("l_toxic", F.lit(60.0)))]
    total = weights[0] + weights[1] + weights[2]
    return [w / total for w in weights]


def prior_weight(groups: DataFrame, sums: str, mean: Column) -> float:
    """Empirical-Bayes weight of the prior, in documents, by the method of moments: the variance of
    the groups' bad shares around their prior mean, less what sampling explains."""
    bad = 1 - F.col(sums) / F.col("n")
    row = groups.select("n", F.pow(bad - mean, 2).alias("d"), (mean * (1 - mean)).alias("v")).agg(
        F.sum(F.col("n") * F.col("d")).alias("d"), F.sum("v").alias("v"), F.sum(F.col("n") * F.col("v")).alias("nv"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")
    ).first()
    if not row["k"] or not row["n"] or not row["nv"]:
        return 100.0
    between = max(0.0, row["d"] - row["v"]) / row["n"]
    return float(np.clip(row["nv"] / row["n"] / max(between, 1e-12) - 1, 5.0, 100_000.0))


def sites(evident: DataFrame, model: Evidence, host: str, path: str) -> DataFrame:
    """host, path, site_good, site_junk, site_toxic, host_good, n_path: shrunk class shares."""
    start = [F.lit(float(s)) for s in model.shares]
    soft = evident.select(host, path, *[p.alias(c) for p, c in zip(posterior(start), CLASSES)])
    sums = [F.sum(c).alias(c) for c in CLASSES]
    paths = written(soft.groupBy(host, path).agg(F.count(F.lit(1)).alias("n"), *sums), "paths")
    hosts = paths.groupBy(host).agg(F.sum("n").alias("n"), *sums)
    whole = hosts.agg(F.sum("n").alias("n"), *sums).first()
    shares = np.array([whole[c] for c in CLASSES]) / whole["n"] if whole["n"] else model.shares
    shares = np.maximum(shares, 1e-6)
    k = prior_weight(hosts, "good", F.lit(float(1 - shares[0])))
    host_shares = hosts.select(F.col(host).alias("_own"), *[((F.col(c) + k * float(s)) / (F.col("n") + k)).alias(f"host_{c}") for c, s in zip(CLASSES, shares)])
    joined = paths.join(host_shares, F.col(host).eqNullSafe(F.col("_own"))).drop("_own")
    m = prior_weight(joined, "good", 1 - F.col("host_good"))
    return joined.select(host, path, *[((F.col(c) + m * F.col(f"host_{c}")) / (F.col("n") + m)).alias(f"site_{c}") for c in CLASSES], "host_good", F.col("n").alias("n_path"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds p_good, p_junk, p_toxic (the posterior), site_good, host_good and kept."""
    docs = unclashed(docs, ["_host", "_path", "p_good", "p_junk", "p_toxic", "site_good", "site_junk", "site_toxic", "host_good", "n_path", "kept", "l_junk", "l_toxic"])
    model = fit(docs, labels, key, text)
    placed = docs.withColumn("_host", host).withColumn("_path", path)
    # texts are scored once: the scores are needed for the sites and, with them, for each document
    evident = written(with_evidence(placed, model, text), "evident")
    shrunk = written(sites(evident.select("_host", "_path", "l_junk", "l_toxic"), model, "_host", "_path"), "sites")
    there = shrunk.select(F.col("_host").alias("_sh"), F.col("_path").alias("_sp"), "site_good", "site_junk", "site_toxic", "host_good")
    joined = evident.join(there, F.col("_host").eqNullSafe(F.col("_sh")) & F.col("_path").eqNullSafe(F.col("_sp")), "left")
    shares = [F.coalesce(f"site_{c}", F.lit(float(s))) for c, s in zip(CLASSES, model.shares)]
    good, junk, toxic = posterior(shares)
    known = F.lit(bool(model.weights))
    return joined.select(*docs.columns, good.alias("p_good"), junk.alias("p_junk"), toxic.alias("p_toxic"), "site_good", "host_good", (~known | (good >= KEEP)).alias("kept"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


def url_path(url: Column) -> Column:
    """The host and the first folder of the path, which sites mostly are sorted by."""
    return F.concat_ws("/", url_host(url), F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#]+)/", 1))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """classify() for the documents table. A url column gives hosts and paths. Where there is none, as in
    the table given, what is nearest to them stands for them: the source for the host, and each
    language's part of a source for a path. That third level is weak then, as a language is no path."""
    if "url" in documents.columns:
        return classify(documents, labels, url_host(F.col("url")), url_path(F.col("url")))
    return classify(documents, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
