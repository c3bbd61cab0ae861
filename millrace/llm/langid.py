"""Operator 7: language identification by the nearest of several centroids per language.

A text becomes a TF-IDF vector of hashed byte n-grams (two and three bytes of the lower-cased text,
everything but letters read as a space) of length one. Training groups the vectors of each language
into up to CLUSTERS spherical k-means clusters; a text gets the language of the centroid with the
highest cosine. Each centroid has a radius, the largest distance (1 - cosine) that its training
texts had but for outliers; beyond it the nearest language is still given, and rejected is true.

The model is fitted on a bounded sample of labelled rows: about MAX_TRAIN rows, shared out evenly
among the languages, chosen by a hash of doc_id. Everything else covers all rows and whole texts.

Defined cases: a null text, or one without a letter, gives `und`, score 0 and rejected; with no
learnable row every text gives `und`; very long texts are counted whole; of centroids with equal
cosines the first counts, by language and cluster; repeated rows get equal results; an empty table
stays empty; predict() passes other columns on and replaces those named like its outputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.batches import add_columns

DIMS = 1 << 13
CLUSTERS = 4
MAX_TRAIN = 2400
OUTLIERS = 0.01
_LETTER = regex.compile(r"\p{L}")
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram stands in the whole text."""
    b = np.frombuffer((" " + text.lower() + " ").encode().translate(_CLEAN), np.uint8).astype(np.uint32)
    pair = b[:-1] * np.uint32(257) + b[1:]
    three = (pair[:-1] * np.uint32(2654435761) + b[2:] * np.uint32(40503)) >> np.uint32(7)
    grams = np.concatenate([(pair * np.uint32(2246822519) >> np.uint32(9)) % (DIMS // 4), DIMS // 4 + three % (DIMS * 3 // 4)])
    return np.bincount(grams.astype(np.intp), minlength=DIMS)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids and each row's cosine to its own. Starts from rows that are far
    from those chosen before."""
    chosen = [unit(rows.mean(axis=0, keepdims=True))[0]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(rows[np.argmin(np.max(rows @ np.array(chosen).T, axis=1))])
    centre = np.array(chosen)
    for _ in range(rounds):
        near = np.argmax(rows @ centre.T, axis=1)
        centre = unit(np.array([rows[near == i].mean(axis=0) if (near == i).any() else centre[i] for i in range(len(centre))]))
    return centre, np.max(rows @ centre.T, axis=1)


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, radii: np.ndarray):
        self.langs, self.idf, self.centroids, self.radii = langs, idf, centroids, radii

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        for at in range(0, len(known), 256):
            rows = known[at : at + 256]
            vectors = unit(np.log1p(np.array([counts(texts[i]) for i in rows], np.float32)) * self.idf)
            cosine = vectors @ self.centroids.T
            best = np.argmax(cosine, axis=1)
            for i, j, c in zip(rows, best.tolist(), cosine[np.arange(len(rows)), best].tolist()):
                lang[i], score[i], rejected[i] = self.langs[j], min(1.0, max(0.0, c)), bool(1 - c > self.radii[j])
        return lang, score, rejected


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_train: int = MAX_TRAIN, clusters: int = CLUSTERS) -> Model:
    """Learns from the rows of df with a text and a lang; about max_train of them reach the driver,
    as sparse counts."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[lang]: r["n"] for r in labelled.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang).limit(max_train).collect()}
    each = max(1, max_train // max(1, len(sizes)))
    grain = 1_000_000
    keep = F.create_map(*[F.lit(x) for lang_, n in sizes.items() for x in (lang_, min(grain, -(-each * grain // n)))]) if sizes else None
    if not sizes:
        return Model([], np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0))
    sample = labelled.where(F.pmod(F.xxhash64(key), F.lit(grain)) < keep[F.col(lang)]).select(lang, text)

    def maker():
        def make(batch: pa.RecordBatch) -> list:
            rows = [counts(t) for t in batch.column(text).to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            return [pa.array([x.astype("i4") for x in at], pa.list_(pa.int32())), pa.array([r[x].astype("i4") for r, x in zip(rows, at)], pa.list_(pa.int32()))]

        return make

    ints = T.ArrayType(T.IntegerType())
    rows = add_columns(sample, [T.StructField("gram", ints), T.StructField("n", ints)], maker).select(lang, "gram", "n").limit(2 * max_train).toArrow()
    matrix = np.zeros((len(rows), DIMS), np.float32)
    for i, (gram, n) in enumerate(zip(rows["gram"], rows["n"])):
        matrix[i, gram.values.to_numpy()] = n.values.to_numpy()
    idf = (np.log((1 + len(rows)) / (1 + (matrix > 0).sum(axis=0))) + 1).astype(np.float32)
    matrix = unit(np.log1p(matrix) * idf)
    of = np.array(rows[lang].to_pylist())
    langs, centroids, radii = [], [], []
    for name in sorted(set(of.tolist())):
        own = matrix[of == name]
        centre, cosine = cluster(own, clusters)
        near = np.argmax(own @ centre.T, axis=1)
        for i in range(len(centre)):
            if (near == i).any():
                langs.append(name)
                centroids.append(centre[i])
                radii.append(float(np.quantile(1 - cosine[near == i], 1 - OUTLIERS)) + 0.05)
    return Model(langs, idf, np.array(centroids, np.float32), np.array(radii))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (cosine to the nearest centroid) and rejected."""
    spread = df.sparkSession.sparkContext.broadcast(model)

    def maker():
        def make(batch: pa.RecordBatch) -> list:
            lang, score, rejected = spread.value.predict(batch.column(text).to_pylist())
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

        return make

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return add_columns(df, fields, maker)


def evaluate(documents: DataFrame) -> DataFrame:
    """Learns from rows whose crc32 of doc_id modulo 4 is not 2 (a null doc_id is never learned
    from) and predicts all rows."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    learn = documents.where(F.col("doc_id").isNotNull() & ~held).select("doc_id", "text", "lang")
    return predict(documents.select("doc_id", "text"), fit(learn)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
