"""Operator 9: embedding near-duplicates by Euclidean p-stable hashing.

Vectors are scaled to length one, where cosine c is distance sqrt(2 - 2c). A table's hash is the
floor of k random Gaussian projections (plus offsets) in steps of WIDTH; two vectors at distance d
agree in one with the known probability p(d). k grows with the logarithm of the number of vectors,
so that far vectors seldom meet; the number of tables is what a pair right at the threshold needs to
meet in at least one with probability RECALL (closer pairs meet more surely). Within buckets exact
cosines in double precision decide.

Equal vectors are one class with a count. A bucket larger than BLOCK is dealt into blocks, and every
pair of its blocks is a unit of work of its own, so no task holds a whole hot bucket. A pair that
meets in several tables counts in the first of them, which its hash keys tell. Tasks don't list
pairs: for each vector they give the number of links found, and one edge to its component in the block.

Defined cases: a null vector, one with a null, NaN or infinite component, of length zero or empty
links with nothing; vectors of different lengths don't link; repeated rows are vectors of their own;
rows with a null vec_id count as vectors but can't name a component; very long vectors are compared
whole; of equal ids in a component the smallest names it, ties change nothing; an empty table stays empty;
other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.shared import drop_written, written

COSINE = 0.95
WIDTH = 1.9
RECALL = 0.99
BLOCK = 2048
SEED = 20


def agree(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection is equal for vectors at this distance."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Projections per table, and tables."""
    k = max(6, math.ceil(math.log(max(rows, 2)) / -math.log(agree(math.sqrt(2)))))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - agree(math.sqrt(2 - 2 * cosine)) ** k))


def unit(vectors: np.ndarray) -> np.ndarray:
    # scaled by the largest component first: squares neither overflow nor vanish
    v = vectors / np.max(np.abs(vectors), axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def hashed(classes: DataFrame, projections: int, tables: int) -> DataFrame:
    """Adds keys: one per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            keys = np.zeros((len(vectors), tables), np.int64)
            sizes = np.array([len(v) for v in vectors])
            for dim in set(sizes.tolist()):
                if dim not in planes:
                    rng = np.random.default_rng(SEED + dim)
                    planes[dim] = rng.standard_normal((dim, tables * projections)), rng.uniform(0, WIDTH, tables * projections), rng.integers(-(1 << 62), 1 << 62, (tables, projections)) | 1
                a, b, mix = planes[dim]
                at = np.flatnonzero(sizes == dim)
                cells = np.floor((unit(np.array([vectors[i] for i in at], np.float64)) @ a + b) / WIDTH).astype(np.int64).reshape(len(at), tables, projections)
                own = (cells * mix).sum(axis=2)  # wraps around
                keys[at] = (own ^ (own >> 29)) * np.int64(0x1B873593CC9E2D51) + dim
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cls", "m", "v")), pa.array(list(keys), pa.list_(pa.int64()))], names=["cls", "m", "v", "keys"])

    return classes.mapInArrow(run, "cls bigint, m bigint, v array<double>, keys array<bigint>")


def _links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by table, key, p, q. For each class of a pair of blocks: links and root."""
    names = ["t", "key", "p", "q", "own", "cls", "m", "v", "keys"]
    held: list[tuple] = []
    mark = None

    def work(rows: list[tuple]) -> pa.RecordBatch | None:
        t, p, q = rows[0][0], rows[0][2], rows[0][3]
        own = np.array([r[4] for r in rows])
        cls, m = np.array([r[5] for r in rows], np.int64), np.array([r[6] for r in rows], np.int64)
        keys = np.array([r[8] for r in rows], np.int64)[:, :t]
        if len(rows) < 2 or t and (keys == keys[0]).all(axis=0).any():
            return None  # all of them meet in an earlier table
        v = unit(np.array([r[7] for r in rows], np.float64))
        a, b = (np.flatnonzero(own == x) for x in (p, q))
        link = v[a] @ v[b].T >= cosine
        i, j = np.nonzero(link)
        fresh = np.ones(len(i), bool)
        for at in range(0, len(i), 100_000) if t else ():
            s = slice(at, at + 100_000)
            fresh[s] = ~(keys[a[i[s]]] == keys[b[j[s]]]).any(axis=1)
        i, j = a[i[fresh]], b[j[fresh]]
        away = i != j
        i, j = i[away], j[away]
        if not len(i):
            return None
        n = np.zeros(len(rows), np.int64)
        np.add.at(n, i, m[j])
        if p != q:
            np.add.at(n, j, m[i])
        root = cls.copy()
        while True:  # smallest label over links, until nothing changes
            before = root.copy()
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            if (before == root).all():
                break
        hit = n > 0
        return pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(n[hit]), pa.array(root[hit])], names=["cls", "n", "root"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if row[:4] != mark:
                if len(held) > 1 and (out := work(held)):
                    yield out
                held, mark = [], row[:4]
            held.append(row)
    if len(held) > 1 and (out := work(held)):
        yield out


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept."""
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    flat = df.select(F.col(key).alias("vec_id"), F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    rows = written(flat.withColumn("cls", F.when(F.coalesce(good, F.lit(False)), F.xxhash64("v"))), "vectors")
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("rep"), F.first("v").alias("v"))
    classes = written(classes, "classes")
    projections, tables = shape(classes.count(), cosine, recall)
    signed = written(hashed(classes.select("cls", "m", "v"), projections, tables), "hashed")
    places = signed.select("cls", F.posexplode("keys").alias("t", "key"))
    buckets = places.groupBy("t", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = places.join(buckets, ["t", "key"]).withColumn("blocks", F.ceil(F.col("c") / block).cast("int"))
    dealt = met.withColumn("own", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.select("cls", "t", "key", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).join(signed, "cls")
    order = ["t", "key", "p", "q"]
    sorted_units = units.select(*order, "own", "cls", "m", "v", "keys").repartition(*order).sortWithinPartitions(*order)
    found = written(sorted_units.mapInArrow(lambda it: _links(it, cosine), "cls bigint, n bigint, root bigint"), "links")
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = components(found.select("cls", "root").distinct(), "cls", "root").withColumnRenamed("node", "cls")
    by_root = classes.select("cls", "rep", "m").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = by_root.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = written(by_root.join(smallest, "root").join(links, "cls", "left").select("cls", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "component")
    for done in (classes, signed, found):
        drop_written(done)
    out = rows.select("vec_id", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
