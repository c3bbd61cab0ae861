"""Operator 4: n-gram Jaccard self-join by T-occurrence search (DivideSkip).

A document is the set of its distinct five-word shingles; documents with equal sets form a class.
Two classes link when their Jaccard similarity is at least SHARE_NUM / SHARE_DEN (0.8). A partner of
a set of n shingles that is not larger shares at least T = ceil(0.8 n) of them, so it stands in T of the
set's n inverted lists at least. All links between different sets are found, exactly:

1. Shingles are counted to order them by the length of their lists, those of fewer than LONG sets
   first. The order only decides how much work is done: any order gives the same links. At most
   MAX_LONG of the long ones, the longest, are broadcast for it.
2. Every set skips its L longest lists, L = T - K for a small K (spare). A partner then stands in at
   least K = T - L of the n - L lists left, and the same holds the other way round: only these lists
   are built.
3. A heap merge of a set's short lists counts how often each candidate occurs. Lists that turn out
   longer than LONG are skipped too: with s of a set's lists skipped on top, L grows by s, and
   candidates with fewer than K - s occurrences are dropped.
4. The candidates are probed in the skipped lists: whether a candidate stands in a shingle's list is
   looked up by binary search for the shingle in the candidate's sorted set. Pairs that reach the
   overlap become links.
5. Only sets that skip K lists or more in step 3 can have a partner that no short list shows: those
   of large groups of near copies. Each is compared with its list's most typical set first. What is
   then still in different components is compared within its list in blocks of BLOCK by BLOCK, each a
   unit of work of its own; sizes, the shingles that no other set has and a parity bitmap of each set
   rule pairs out before any text is compared.
6. Verification goes in rounds: each class with its most frequent candidate and the typical
   class of long lists first; then all other candidates that are not yet in one component. Pairs
   within a component can't change it, so they are never listed, however large the group is. Of what
   5. leaves, a unit lists first the pairs that join its components if they link (fewer than its
   rows) and as many others as it has rows; where that isn't all, another round lists what components
   and pairs known not to link leave, with four times as many others, until all is listed.

Rows of a hot class or list are spread: copies are grouped by partial sums, list members are joined
with their typical set by a salted key, and lists over LONG never come to one task.

Defined cases: a null or empty text, or one of white space, has an empty set, links with nothing and
is its own component; a very long text is one set like any other; rows with equal doc_id are one
document for the result's component_id (the smallest id reachable); a null doc_id counts as no id,
and a component without any id has null; ties between candidates or typical sets are broken by the
hash of the set and change no result; an empty table stays empty; other columns are ignored by the join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import least_count, pieces
from millrace.llm.components import components
from millrace.llm.shingles import WordHashes, shingle_set
from millrace.shared import drop_written, rows_a_batch, written

SHARE_NUM, SHARE_DEN = 4, 5
SIZE = 5
SPARE = 8
LONG = 48
MAX_LONG = 1_000_000
BLOCK = 512
SALTS = 32
TEXT_PAIRS = 500
_FLUSH = 3_000_000


def spare(n: int) -> int:
    """K: how many of the lists that aren't skipped a partner must stand in."""
    return max(1, min(SPARE, n // 16))


def _spare(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(SPARE), F.floor(n / 16))).cast("int")


def _repeated(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return found[n > 1].view(np.int64), n[n > 1]


def long_shingles(texts: DataFrame, size: int = SIZE, long: int = LONG, most: int = MAX_LONG) -> tuple[np.ndarray, np.ndarray]:
    """The shingles with long lists, ascending, and the logarithm of their lengths; at most `most` of
    them, those with the largest counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sets, seen, total = WordHashes(), [], set(), 0

        def flush() -> pa.RecordBatch:
            token, n = _repeated(sets)
            sets.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingle_set(hashes.of(text), size)
                mark = xxhash.xxh3_64_intdigest(own.tobytes())
                if len(own) and mark not in seen:
                    seen.add(mark)
                    sets.append(own)
                    total += len(own)
                if total >= _FLUSH:
                    yield flush()
                    total = 0
        yield flush()

    counted = written(texts.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= long), "long")
    least = least_count(counted, most)
    if least is None:
        drop_written(counted)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    found = counted.where(F.col("n") >= least).select("token", F.floor(F.log2("n") * 2).cast("byte").alias("step")).toArrow()
    drop_written(counted)
    tokens = found["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["step"].to_numpy().astype(np.uint8)[order]


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes by their low bits: at least 16 bits for each shingle, so that hardly
    any two fall together, of sets of up to 2,048; at least as many bits as shingles of any set."""
    least = max(64, 1 << (len(own) - 1).bit_length())
    bits = max(least, min(16 * least, 1 << 15))
    parity = np.bincount((own & np.uint64(bits - 1)).astype(np.intp), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def prepared(docs: DataFrame, long: tuple[np.ndarray, np.ndarray], key: str, text: str, size: int) -> DataFrame:
    """doc_id, th (hash of the text), cls (null for an empty set), n, and, where the task meets the
    class for the first time, prefix (the shingles whose lists aren't skipped, shortest lists first),
    cold (how many of them are not known to be long) and share (of long ones in the set)."""
    spread = docs.sparkSession.sparkContext.broadcast(long)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, (long, step) = WordHashes(), set(), spread.value
        for whole in batches:
            for a, b in pieces(whole.column("text").to_pylist(), 4_000_000):
                batch = whole.slice(a, b - a)
                cls, n, prefix, cold, share = [], [], [], [], []
                for t in batch.column("text").to_pylist():
                    own = shingle_set(hashes.of(t), size)
                    n.append(len(own))
                    mark = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None
                    cls.append(mark)
                    if mark is None or mark in seen:
                        for x in (prefix, cold, share):
                            x.append(None)
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(mark)
                    first = len(own) - -(-SHARE_NUM * len(own) // SHARE_DEN) + spare(len(own))
                    plain, last = own, own[:0]
                    if len(long):
                        at = np.minimum(np.searchsorted(long, own), len(long) - 1)
                        hit = long[at] == own
                        plain, last = own[~hit], own[hit][np.argsort(step[at[hit]], kind="stable")]
                    prefix.append(np.concatenate([plain, last])[:first].view(np.int64))
                    cold.append(min(first, len(plain)))
                    share.append(1 - len(plain) / len(own))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("th"), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(prefix, longs), pa.array(cold, pa.int32()), pa.array(share, pa.float32())],
                    names=["doc_id", "th", "cls", "n", "prefix", "cold", "share"],
                )

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, th bigint, cls bigint, n int, prefix array<bigint>, cold int, share float")


def _lists(batches: Iterator[pa.RecordBatch], long: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, n, cls, each class once in a list. For each class of a list: the not
    larger classes there that are large enough, sorted (none for the smallest). A list longer than
    `long` is passed on with its token instead."""
    passing = None  # a token whose list is longer than what was held of it

    def emit(token: np.ndarray, n: np.ndarray, cls: np.ndarray, more: bool) -> Iterator[pa.RecordBatch]:
        nonlocal passing
        own, near, by = [], [], []
        edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True]).tolist() if len(token) else []
        for a, b in zip(edge, edge[1:]):
            c, m, mark = cls[a:b], n[a:b], int(token[a])
            if mark == passing or b - a > long:
                own.extend(c.tolist())
                near.extend([None] * len(c))
                by.extend([mark] * len(c))
            elif b - a > 1:
                start = np.searchsorted(m, -(-SHARE_NUM * m // SHARE_DEN))
                for i in range(len(c)):
                    own.append(int(c[i]))
                    near.append(np.sort(c[start[i] : i]))
                    by.append(None)
        passing = int(token[-1]) if more else None
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(by, pa.int64())], names=["cls", "near", "token"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
    for batch in batches:
        held = [np.r_[h, batch.column(c).to_numpy()] for h, c in zip(held, ("token", "n", "cls"))]
        if not len(held[0]):
            continue
        last = int(np.searchsorted(held[0], held[0][-1]))
        if last:
            yield from emit(*(h[:last] for h in held), False)
            held = [h[last:] for h in held]
        if len(held[0]) > long:  # long for certain: the rest of it may come in parts
            yield from emit(*held, True)
            held = [h[:0] for h in held]
    yield from emit(*held, False)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cls: heap merge of each class's lists, counting occurrences; `first` marks the
    most frequent candidate."""

    def rows() -> Iterator[tuple[int, list[int]]]:
        for batch in batches:
            yield from zip(batch.column("cls").to_pylist(), batch.column("near").to_pylist())

    def told(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["x", "y", "times", "first"])

    out: list[tuple] = []
    for own, group in groupby(rows(), lambda r: r[0]):
        found = [(c, sum(1 for _ in same)) for c, same in groupby(heapq.merge(*(near for _, near in group)))]
        best = max(found, key=lambda f: (f[1], -f[0]))[0]
        out += [(own, c, k, c == best) for c, k in found]
        if len(out) > 20_000:
            yield told(out)
            out = []
    if out:
        yield told(out)


def _similar_size(n: str, m: str) -> Column:
    return F.least(n, m) * SHARE_DEN >= F.greatest(n, m) * SHARE_NUM


def _across(members: DataFrame, block: int = BLOCK, extra: float = 1) -> DataFrame:
    """Pairs (x, y) of the same token, but of different components r, that sizes, shingles of their
    own and bitmaps don't rule out and that aren't in `no`. A unit of work gives those that may join
    its components (less than its rows) and, of the others, at most `extra` times its rows; a row of
    nulls says that it has more. members: token, cls, n, avail, reach, r, bits and, if pairs are
    known not to link, no (for the larger cls of each)."""
    if "no" not in members.columns:
        members = members.withColumn("no", F.lit(None).cast("array<bigint>"))
    counted = members.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(counted, ["token", "salt"]).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "cls", "n", "avail", "reach", "r", "bits", "no")
    order = ["token", "p", "q"]

    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        p, q = rows[0][1], rows[0][2]
        side, cls, n, avail, reach, root = (np.array([r[k] for r in rows]) for k in (3, 4, 5, 6, 7, 8))
        maps = Bitmaps([r[9] for r in rows])
        no = {(int(cls[i]), y) for i, r in enumerate(rows) for y in r[10] or ()}
        a, b = np.flatnonzero(side == p), np.flatnonzero(side == q)
        up = {r: r for r in root.tolist()}

        def find(r: int) -> int:
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        x, y, left = [], [], int(extra * len(rows))
        for i in a.tolist():
            j = b[b > i] if p == q else b
            j = j[root[j] != root[i]]
            most = np.minimum(n[i], n[j])
            most = np.where(reach[i] & reach[j], np.minimum(most, np.minimum(avail[i], avail[j])), most)
            j = j[most * (SHARE_NUM + SHARE_DEN) >= (n[i] + n[j]) * SHARE_NUM]
            if not len(j):
                continue
            for k in j[maps.apart(i, j) * (SHARE_NUM + SHARE_DEN) <= (n[i] + n[j]) * (SHARE_DEN - SHARE_NUM)].tolist():
                pair = int(max(cls[i], cls[k])), int(min(cls[i], cls[k]))
                if pair in no:
                    continue
                s, t = find(int(root[i])), find(int(root[k]))
                if s != t:
                    up[t] = s
                elif left > 0:
                    left -= 1
                else:
                    left = -1
                    continue
                x.append(pair[0])
                y.append(pair[1])
        if left < 0:
            x.append(None)
            y.append(None)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, unit in groupby(rows, lambda r: r[:3]):
            if (out := pairs(list(unit))).num_rows:
                yield out

    return units.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "x bigint, y bigint")


class Bitmaps:
    """Bitmaps of many sets, compared by the size of the smaller one: a larger one is folded."""

    def __init__(self, bits: list[list[int]]):
        self.size = np.array([len(b) for b in bits])
        self.of, self.at = {}, np.zeros(len(bits), np.int64)
        for size in set(self.size.tolist()):
            own = np.flatnonzero(self.size == size)
            self.at[own] = np.arange(len(own))
            self.of[size] = np.array([bits[i] for i in own.tolist()], np.int64).view(np.uint64).reshape(len(own), size)

    @staticmethod
    def folded(maps: np.ndarray, size: int) -> np.ndarray:
        while maps.shape[1] > size:
            half = maps.shape[1] // 2
            maps = maps[:, :half] ^ maps[:, half:]
        return maps

    def apart(self, i: int, j: np.ndarray) -> np.ndarray:
        """For each set of j at least how many shingles it and set i don't share."""
        out, own = np.zeros(len(j), np.int64), self.of[int(self.size[i])][self.at[i] : self.at[i] + 1]
        for size in np.unique(self.size[j]).tolist():
            at = np.flatnonzero(self.size[j] == size)
            few = min(size, own.shape[1])
            step = max(1, (1 << 22) // size)
            for k in range(0, len(at), step):
                some = at[k : k + step]
                out[some] = np.bitwise_count(self.folded(self.of[size][self.at[j[some]]], few) ^ self.folded(own, few)).sum(axis=1, dtype=np.int64)
        return out


def _texts(wanted: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """wanted (cls, ...), one row for each cls, with a text of the class."""
    ends = wanted.join(classes.select("cls", "rep", "th"), "cls").withColumn("rep", F.coalesce("rep", F.lit(-1)))
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(-1)).alias("rep"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.join(ends, ["rep", "th"]).select(*wanted.columns, "text").dropDuplicates(["cls"])


def _bitmaps(wanted: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """cls, bits for the classes wanted (cls, once each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            bits = [bitmap(shingle_set(hashes.of(t.as_py()), size)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(bits, pa.list_(pa.int64()))], names=["cls", "bits"])

    with rows_a_batch(docs.sparkSession, TEXT_PAIRS):
        return written(_texts(wanted, docs, classes, key, text).select("cls", "text").mapInArrow(run, "cls bigint, bits array<bigint>"), "bits")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Links (a, b) among the pairs (x, y, hot), by their texts. A y whose pairs are hot has its text
    copied SALTS times: there are more pairs of it than that."""
    ends = pairs.select(F.col("x").alias("cls"), F.lit(False).alias("hot")).unionByName(pairs.select(F.col("y").alias("cls"), "hot")).groupBy("cls").agg(F.max("hot").alias("hot"))
    texts = written(_texts(ends, docs, classes, key, text), "texts")
    salted = pairs.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("x"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    one = texts.select(F.col("cls").alias("x"), F.col("text").alias("tx"))
    other = texts.select(F.col("cls").alias("y"), F.col("text").alias("ty"), F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0))).alias("salt"))
    both = salted.join(one, "x").join(other, ["y", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        kept: dict[int, np.ndarray] = {}
        held = 0

        def own(cls: int, t: pa.Scalar) -> np.ndarray:
            nonlocal held
            if cls not in kept:
                if held > 1_000_000:
                    kept.clear()
                    held = 0
                kept[cls] = shingle_set(hashes.of(t.as_py()), size)
                held += len(kept[cls])
            return kept[cls]

        for batch in batches:
            a, b = [], []
            for x, y, tx, ty in zip(*(batch.column(c) for c in ("x", "y", "tx", "ty"))):
                small, large = sorted((own(x.as_py(), tx), own(y.as_py(), ty)), key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[at] == small).sum())
                if SHARE_DEN * shared >= SHARE_NUM * (len(small) + len(large) - shared):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    with rows_a_batch(docs.sparkSession, TEXT_PAIRS):
        links = written(both.mapInArrow(run, "a bigint, b bigint"), "links")
    drop_written(texts)
    return links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, long: int = LONG, max_long: int = MAX_LONG, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, th (xxhash64 of the text), cls (equal sets have equal cls;
    null for an empty set), n_shingles, and component_id (smallest doc_id reachable by links)."""
    longest = long_shingles(docs.select(text), size, long, max_long)
    rows = written(prepared(docs, longest, key, text, size), "sets")
    # the smallest id of a class with its text's hash; ids come last if null
    classes = written(
        rows.where("cls IS NOT NULL").groupBy("cls", "n")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep"), F.max(F.struct("share", "cold", "prefix")).alias("own"))
        .select("cls", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("th"), "own.share", "own.cold", "own.prefix"), "classes")
    postings = classes.select("cls", "n", "cold", F.posexplode("prefix").alias("at", "token"))
    short = postings.where("at < cold").select("token", "n", "cls").repartition("token").sortWithinPartitions("token", "n", "cls")
    lists = written(short.mapInArrow(lambda it: _lists(it, long), "cls bigint, near array<bigint>, token bigint"), "lists")
    # skips: how many of a class's lists are skipped on top; avail: the shingles that other classes may have too
    met = lists.groupBy("cls").agg(F.count(F.lit(1)).alias("met"), F.count("token").alias("late"))
    skips, alone = F.size("prefix") - F.col("cold") + F.coalesce("late", F.lit(0)), F.col("cold") - F.coalesce("met", F.lit(0))
    reach = F.size("prefix") > F.col("cold")  # then all its shingles that aren't long were looked up
    known = written(classes.join(met, "cls", "left").select("cls", "n", "share", skips.cast("int").alias("skips"), reach.alias("reach"), F.when(reach, F.col("n") - alone).otherwise(F.col("n")).cast("int").alias("avail")), "known")
    counted = lists.where("size(near) > 0").select("cls", "near").repartition("cls").sortWithinPartitions("cls").mapInArrow(_merged, "x bigint, y bigint, times int, first boolean")
    mine, other = (known.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("skips").alias(f"s{c}")) for c in "xy")
    enough = F.col("times") >= F.least(_spare(F.col("nx")), _spare(F.col("ny"))) - F.least("sx", "sy")
    candidates = written(counted.join(mine, "x").join(other, "y").where(enough).select("x", "y", "first"), "candidates")
    late = lists.where("token IS NOT NULL").select("token", "cls")
    wide = known.where(F.col("skips") >= _spare(F.floor(F.col("n") * SHARE_NUM / SHARE_DEN))).select("cls", "n", "share")
    skipped = written(postings.where("at >= cold").select("token", "cls").unionByName(late).join(wide, "cls"), "skipped")
    typical = skipped.groupBy("token").agg(F.max(F.struct("share", F.negative("n").alias("n"), "cls")).alias("top"), F.count(F.lit(1)).alias("many")).where("many > 1")
    typical = typical.select("token", F.col("top.cls").alias("y"), (-F.col("top.n")).alias("ny"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spread = skipped.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    star = spread.join(typical, ["token", "salt"]).where((F.col("cls") != F.col("y")) & _similar_size("n", "ny")).select(F.col("cls").alias("x"), "y").distinct()
    begin = candidates.where("first").select("x", "y", F.lit(False).alias("hot")).unionByName(star.withColumn("hot", F.lit(True)))
    begin = written(begin.groupBy("x", "y").agg(F.max("hot").alias("hot")), "pairs")
    links = _verified(begin, docs, classes, key, text, size)
    root = written(components(links), "roots")

    def rooted(frame: DataFrame, cls: str, name: str) -> DataFrame:
        return frame.join(root.select(F.col("node").alias(cls), F.col("root").alias(name)), cls, "left").withColumn(name, F.coalesce(name, F.col(cls)))

    # what is left is told by text in rounds: each tells all that may join components, and more of the other pairs
    # than the one before it, until no list has any that weren't told
    rest = rooted(rooted(candidates.where("NOT first").select("x", "y"), "x", "rx"), "y", "ry").where("rx <> ry").select("x", "y")
    extra, bits, unlinked, told = 1, None, None, False
    while not told:
        members = rooted(skipped.select("token", "cls"), "cls", "r")
        split = members.groupBy("token").agg(F.min("r").alias("low"), F.max("r").alias("high")).where("low <> high").select("token", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        apart = members.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(split, ["token", "salt"]).drop("salt")
        if bits is None:
            bits = _bitmaps(apart.select("cls").distinct(), docs, classes, key, text, size)
        apart = apart.join(known.select("cls", "n", "avail", "reach"), "cls").join(bits, "cls")
        if unlinked is not None:
            apart = apart.join(unlinked.groupBy(F.col("x").alias("cls")).agg(F.collect_list("y").alias("no")), "cls", "left")
        found = written(_across(apart, block, extra).distinct(), "found")
        told, listed = found.where("x IS NULL").isEmpty(), found.where("x IS NOT NULL")
        more = written((rest.unionByName(listed).distinct().join(begin, ["x", "y"], "left_anti") if unlinked is None else listed).withColumn("hot", F.lit(False)), "pairs")
        fresh = None if more.isEmpty() else _verified(more, docs, classes, key, text, size)
        if not told:
            ordered = (links if fresh is None else fresh).select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
            tested = listed.join(ordered, ["x", "y"], "left_anti")
            before, unlinked = unlinked, written(tested if unlinked is None else unlinked.unionByName(tested), "unlinked")
            if before is not None:
                drop_written(before)
        if fresh is not None:
            before, links = links, written(links.unionByName(fresh), "links")
            for done in (before, fresh, root):
                drop_written(done)
            root = written(components(links), "roots")
        for done in (found, more):
            drop_written(done)
        extra *= 4
    if unlinked is not None:
        drop_written(unlinked)
    by_root = rooted(classes.select("cls", "rep"), "cls", "root")
    smallest = by_root.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = written(by_root.join(smallest, "root").select("cls", "component_id"), "component")
    for done in (classes, lists, known, candidates, skipped, begin, links, bits, root):
        drop_written(done)
    return rows.select("doc_id", "th", "cls", F.col("n").cast("bigint").alias("n_shingles")).join(of_class, "cls", "left").withColumn(
        "component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    ).select("doc_id", "th", "cls", "n_shingles", "component_id")


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that are linked with a smaller doc_id: one of each group stays.
    Rows with equal doc_id and text are one document and stay or go together; rows without an id
    stay where no row of their group has one."""
    found = near_duplicates(docs.select(key, text), key, text)
    stay = found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.coalesce("doc_id", F.lit(-1)).alias("_millrace_id"), F.col("th").alias("_millrace_hash")).distinct()
    marked = docs.withColumn("_millrace_id", F.coalesce(F.col(key).cast("bigint"), F.lit(-1))).withColumn("_millrace_hash", F.xxhash64(text))
    return marked.join(stay, ["_millrace_id", "_millrace_hash"], "left_semi").select(*docs.columns)
