"""Operator 10: benchmark decontamination by latent semantic retrieval.

Terms are the words that the benchmark's items use: no other word can be part of a leak.

1. One pass over all documents counts in how many passages (PASSAGE words) each term stands, and
   sums the passages' sketch A'(A Omega) of the term counts A: the randomised range finder with one
   power step. Weighting by idf is a diagonal factor D, and D A' A Omega spans the same space as the
   sketch of the weighted matrix for the test matrix Omega / D, so one pass is enough. Omega's signs
   come from a hash of the term. Sums are grouped by term; what reaches the driver has one row of RANK
   numbers for each term of the benchmark, whatever the corpus.
2. The sketch gives singular vectors V and values S. A text's latent vector is folded in, as the sum
   of idf(w) V[w] / S over its terms, so that the directions all texts of a language share don't
   drown the others.
3. A second pass slides windows of each benchmark item's length over each document; their latent
   vectors are differences of running sums. Windows with enough terms whose cosine with the item
   reaches COSINE are candidates; overlapping ones are joined. COSINE lies well below
   sqrt(WEAK), what a window with WEAK of an item's energy has at best: precision is left to step 4.
   Cosines are only computed where a leak is possible: a window that shares WEAK of an item's words
   has 1 / RARE at least among the 1 - WEAK + 1 / RARE rarest of them (pigeonhole), so windows without
   so many of these nearby are passed by.
4. Each window of the item's length in a joined candidate is verified by the longest common
   subsequence of words of the item and the window: it is a leak with at least STRONG of the item's
   words in order, or with at least WEAK of them if the item's answer stands in the window, word for
   word (paraphrases). Of overlapping leaks of an item the longest is reported. The answer is the
   item's answer column, or else its last sentences, as many as have ANSWER_WORDS words or more.

The benchmark is broadcast: its terms with their vectors, of which there may be MAX_TERMS (more are an
error), and its items, in parts of at most PART_BYTES of text. Terms and vectors are those of the whole
benchmark for each part, so parts don't change results; each makes a pass of its own over the documents.

Defined cases: null or wordless texts and items never match; items with equal texts are reported
each; a null item_id or doc_id is kept as it is; repeated rows give equal results; very long texts are
searched whole, in time and memory in proportion to the longest; of equally long leaks of an item that overlap, the
first is reported; with an empty benchmark or no documents nothing is found; clashing columns are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.batches import add_columns
from millrace.shared import drop_written, written

MAX_TERMS = 1 << 22
PART_BYTES = 32 << 20
RANK = 32
PASSAGE = 64
COSINE = 0.3
STRONG, WEAK = 0.7, 0.5
ANSWER_WORDS = 3
STRIDES = 8
RARE = 8
# words of documents that are looked at together
_WORDS = 100_000
_STRETCH = 1 << 12
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD).split() if text else []


def vocabulary(items: DataFrame, most: int = MAX_TERMS) -> dict[bytes, int]:
    """An id for each word of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(set().union(*map(words_of, batch.column(0).to_pylist())), pa.binary())], names=["word"])

    words = items.select("words").mapInArrow(run, "word binary").distinct().limit(most + 1).toArrow()["word"].to_pylist()
    if len(words) > most:
        raise ValueError(f"the benchmark has more than {most} words")
    return {w: i for i, w in enumerate(sorted(words))}


def terms_of(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """A term id for each word, -1 for words that no item has."""
    return np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))


def test_matrix(known: dict[bytes, int], rank: int = RANK) -> np.ndarray:
    """A row of random signs for each term, at most 64."""
    marks = np.array([xxhash.xxh64_intdigest(w, 11) for w in known], np.uint64)
    return 1 - 2 * np.unpackbits(marks.view(np.uint8).reshape(-1, 8), axis=1)[:, :rank].astype(np.float32)


class Sketch:
    """Sums over passages: in how many each term stands, and A'(A Omega)."""

    def __init__(self, omega: np.ndarray):
        self.omega = omega
        self.df = np.zeros(len(omega), np.int64)
        self.total = np.zeros(omega.shape, np.float64)
        self.passages = 0

    def add(self, docs: list[np.ndarray]) -> None:
        parts, at = [], 0
        for d in docs:
            parts.append(at + np.arange(len(d)) // PASSAGE)
            at += -(-len(d) // PASSAGE)
        self.passages += at
        if not at:
            return
        term, passage = np.concatenate(docs), np.concatenate(parts)
        known = term >= 0
        term, passage = term[known], passage[known]
        if not len(term):
            return
        start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        projected = np.add.reduceat(self.omega[term], start, axis=0)
        own = np.cumsum(np.r_[0, passage[1:] != passage[:-1]])
        order = np.argsort(term, kind="stable")
        term, own = term[order], own[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        self.total[term[first]] += np.add.reduceat(projected[own], first, axis=0)
        new = np.r_[True, (term[1:] != term[:-1]) | (own[1:] != own[:-1])]
        np.add.at(self.df, term[new], 1)


def basis(docs: DataFrame, known: dict[bytes, int], text: str = "text", rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """For each term idf(w) V[w] / S, over all passages of all documents, and its number of passages."""
    size = len(known)
    rank = min(rank, 64, max(1, size))
    spread = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        sketch, held, n = Sketch(test_matrix(known, rank)), [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                own = terms_of(words_of(t), known)
                held.append(own)
                n += len(own)
                if n > 100_000:
                    sketch.add(held)
                    held, n = [], 0
        sketch.add(held)
        hit = np.flatnonzero(sketch.df)
        cells = [pa.array(hit), pa.array(sketch.df[hit]), *(pa.array(sketch.total[hit, j]) for j in range(rank))]
        # one more row counts the passages
        cells = [pa.concat_arrays([c, pa.array([v], c.type)]) for c, v in zip(cells, [-1, sketch.passages, *[0.0] * rank])]
        yield pa.RecordBatch.from_arrays(cells, names=names)

    names = ["term", "df", *(f"s{j}" for j in range(rank))]
    schema = "term bigint, df bigint, " + ", ".join(f"s{j} double" for j in range(rank))
    summed = written(docs.select(text).mapInArrow(run, schema).groupBy("term").agg(*[F.sum(c).alias(c) for c in names[1:]]), "sketch")
    rows = summed.toArrow()
    drop_written(summed)
    at, counts = rows["term"].to_numpy(), rows["df"].to_numpy()
    real = at >= 0
    passages = int(counts[~real].sum())
    df, whole = np.zeros(size, np.int64), np.zeros((size, rank))
    df[at[real]] = counts[real]
    for j in range(rank):
        whole[at[real], j] = rows[f"s{j}"].to_numpy()[real]
    return folded(whole, np.log((2 + passages) / (1 + df)), test_matrix(known, rank)), df


def folded(total: np.ndarray, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """idf(w) V[w] / S: what a word adds to a text's latent vector. V and S are the right singular
    vectors and the singular values of the weighted matrix, by the Nystrom form of the sketch."""
    core = omega.T.astype(float) @ total
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(1e-12, 1e-10 * value.max(initial=0.0))
    if not good.any():
        return np.zeros_like(total, np.float32)
    half = (total * idf[:, None]) @ (vector[:, good] / np.sqrt(value[good]))
    v, s, _ = np.linalg.svd(half, full_matrices=False)
    keep = s > 1e-6 * s.max(initial=0.0)
    return (idf[:, None] * v[:, keep] / s[keep]).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if (hit := where.get(w)) is not None:
            up = row & hit
            row = ((row + up) | (row - up)) & full
    return len(a) - row.bit_count()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them) for each row, one after the other."""
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(first - start, size)


class Search:
    def __init__(self, items: list[tuple], known: dict[bytes, int], latent: np.ndarray, df: np.ndarray, cosine: float = COSINE):
        self.latent, self.cosine = latent, cosine
        self.items = [(item, w, frozenset(w), answer_of(text, answer)) for item, text, answer in items if (w := words_of(text))]
        self.terms = [terms_of(w, known) for _, w, _, _ in self.items]
        self.words = np.array([len(w) for w in self.terms], np.int64)
        self.vectors = unit(np.array([latent[t].sum(axis=0) for t in self.terms], np.float32).reshape(len(self.terms), latent.shape[1]))
        self.stride = np.maximum(1, self.words // STRIDES)
        # a leak has at least WEAK of an item's words, less what a stride may cut off
        self.least = np.maximum(1, (WEAK * self.words - self.stride).astype(np.int64))
        # the rarest words of each item: any leak has so many of them (self.rare); by term, the items
        self.rare = np.maximum(1, self.words // RARE)
        rare = [np.unique(t[np.lexsort((t, df[t]))[: len(t) - int(np.ceil(WEAK * len(t))) + n]]) for t, n in zip(self.terms, self.rare.tolist())]
        term, item = np.concatenate([*rare, np.zeros(0, np.int32)]), np.repeat(np.arange(len(rare)), [len(r) for r in rare])
        self.by_term = item[np.argsort(term, kind="stable")]
        self.n_items = np.append(np.bincount(term, minlength=len(df)), 0)  # -1, a word of no item, has none
        self.first = np.append(np.cumsum(self.n_items[:-1]) - self.n_items[:-1], 0)
        self.marked = np.zeros(len(df) + 1, bool)

    def find(self, docs: list[list[bytes]], terms: list[np.ndarray]) -> list[list[dict]]:
        """Leaks in each document: item, first and end word of the window, overlap and whether the
        answer was found."""
        out: list[list[dict]] = [[] for _ in docs]
        length = np.array([len(t) for t in terms], np.int64)
        begin = np.cumsum(length) - length
        flat = np.concatenate([*terms, np.zeros(0, np.int32)])
        for item, doc, lo, hi in zip(*(x.tolist() for x in self.spans(flat, begin, length))):
            name, wanted, bag, answer = self.items[item]
            at = int(begin[doc])
            out[doc] += [{"item_id": name} | leak for leak in self.verified(wanted, bag, answer, docs[doc], lo - at, hi - at)]
        return [sorted(found, key=lambda x: (x["first_word"], x["end_word"], str(x["item_id"]))) for found in out]

    def spans(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """item, document, first and end word (in flat) of joined candidates with enough of the item's words."""
        at = np.flatnonzero(self.n_items[flat] > 0)
        n = self.n_items[flat[at]]
        item, place = self.by_term[_ranges(self.first[flat[at]], n)], np.repeat(at, n)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        doc = np.searchsorted(begin, place, "right") - 1
        # a window that verified looks at, of the words of one document, has enough rare words of the item
        first = np.arange(len(item))
        last = np.minimum(first + self.rare[item] - 1, max(0, len(item) - 1))
        full = (item[last] == item) & (doc[last] == doc) & (place[last] - place < self.words[item] + self.words[item] // 4) & (last - first == self.rare[item] - 1)
        inside = np.zeros(len(item) + 1, np.int64)
        np.add.at(inside, first[full], 1)
        np.add.at(inside, last[full] + 1, -1)
        some = np.cumsum(inside[:-1]) > 0
        item, place, doc = item[some], place[some], doc[some]
        size, stride, half = self.words[item], self.stride[item], self.words[item] // 2
        # windows whose surroundings, half an item on either side, have the place in them
        windows = -(-np.maximum(1, length[doc] - size + stride) // stride)
        low = np.maximum(0, (place - begin[doc] - half - size) // stride + 1)
        high = np.minimum(windows - 1, (place - begin[doc] + half) // stride)
        some = low <= high
        item, doc, low, high = item[some], doc[some], low[some], high[some]
        if not len(item):
            return item, doc, low, high
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (low[1:] > high[:-1] + 1)])
        low, n = low[new], high[np.append(new[1:], len(high)) - 1] - low[new] + 1
        item, doc = np.repeat(item[new], n), np.repeat(doc[new], n)
        start = begin[doc] + _ranges(low, n) * self.stride[item]
        stop = np.minimum(start + self.words[item], begin[doc] + length[doc])
        hit = self.near(flat, item, start, stop)
        item, doc, start, stop = item[hit], doc[hit], start[hit], stop[hit]
        half = self.words[item] // 2
        start, stop = np.maximum(begin[doc], start - half), np.minimum(begin[doc] + length[doc], stop + half)
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])]) if len(item) else item
        item, doc, start, stop = item[new], doc[new], start[new], stop[np.append(new[1:], len(stop)) - 1] if len(new) else stop[new]
        enough = self.enough(flat, item, start, stop)
        return item[enough], doc[enough], start[enough], stop[enough]

    def near(self, flat: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which windows have enough terms and a cosine of COSINE with their item, in their order."""
        order = np.argsort(start, kind="stable")
        edge = np.searchsorted(start[order], np.arange(0, len(flat) + _STRETCH, _STRETCH))
        hits = [np.zeros(0, np.int64)]
        for a, b, lo in zip(edge, edge[1:], range(0, len(flat), _STRETCH)):
            w = order[a:b]
            if not len(w):
                continue
            own = flat[lo : int(stop[w].max())]
            place = own >= 0
            before = np.cumsum(np.r_[0, place])
            running = np.zeros((before[-1] + 1, self.latent.shape[1]))
            np.cumsum(self.latent[own[place]], axis=0, out=running[1:], dtype=float)
            x, y = before[start[w] - lo], before[stop[w] - lo]
            full = y - x >= self.least[item[w]]
            w, x, y = w[full], x[full], y[full]
            for k in range(0, len(w), _STRETCH):
                part = slice(k, k + _STRETCH)
                latent = running[y[part]] - running[x[part]]
                norm = np.sqrt(np.einsum("ij,ij->i", latent, latent))
                score = np.einsum("ij,ij->i", latent, self.vectors[item[w[part]]])
                hits.append(w[part][score >= self.cosine * np.maximum(norm, 1e-9)])
        return np.sort(np.concatenate(hits))

    def enough(self, flat: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which spans have a window, of those that verified looks at, with WEAK of the item's words."""
        out = np.zeros(len(item), bool)
        edge = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True]) if len(item) else []
        for a, b in zip(edge, edge[1:]):
            own, n = self.terms[item[a]], int(self.words[item[a]])
            wide, step = n + n // 4, max(1, n // 8)
            size = stop[a:b] - start[a:b]
            self.marked[own] = True
            shared = np.cumsum(np.r_[0, self.marked[flat[_ranges(start[a:b], size)]]])
            self.marked[own] = False
            windows = -(-np.maximum(1, size - wide + step) // step)
            first = np.repeat(np.cumsum(size) - size, windows)
            x = _ranges(np.zeros(len(windows), np.int64), windows) * step
            y = np.minimum(x + wide, np.repeat(size, windows))
            good = shared[first + y] - shared[first + x] >= WEAK * n
            out[a + np.repeat(np.arange(b - a), windows)[good]] = True
        return out

    def verified(self, wanted: list[bytes], bag: frozenset, answer: list[bytes], words: list[bytes], lo: int, hi: int) -> list[dict]:
        """The windows of about the item's length between lo and hi that are leaks; of overlapping
        ones the best."""
        size, step, found = len(wanted) + len(wanted) // 4, max(1, len(wanted) // 8), []
        # the words they share bound the common subsequence
        shared = [0, *accumulate(map(bag.__contains__, words[lo:hi]))]
        distinct = WEAK * len(wanted) - (len(wanted) - len(bag))
        for a in range(lo, max(lo + 1, hi - size + step), step):
            b = min(hi, a + size)
            if shared[b - lo] - shared[a - lo] < WEAK * len(wanted) or len(bag.intersection(words[a:b])) < distinct:
                continue
            n = common(wanted, words[a:b])
            if n < WEAK * len(wanted):
                continue
            near = words[max(lo, a - step) : min(hi, b + step)]
            answered = bool(answer) and any(near[i : i + len(answer)] == answer for i in range(len(near) - len(answer) + 1))
            if n >= STRONG * len(wanted) or answered:
                found.append((n, a, b, answered))
        best: list[dict] = []
        taken: list[tuple] = []
        for n, a, b, answered in sorted(found, key=lambda x: (-x[0], x[1])):
            if all(b <= c or d <= a for c, d in taken):
                best.append({"first_word": a, "end_word": b, "overlap": n / len(wanted), "answered": answered})
                # only the words that the subsequence needs are taken: another copy may stand right beside it
                end = bisect_left(range(b), n, lo=a, key=lambda x: common(wanted, words[a:x]))
                taken.append((bisect_left(range(end), 1, lo=a, key=lambda x: common(wanted, words[x + 1 : end]) < n), end))
        return best


def answer_of(text: str, answer: str | None) -> list[bytes]:
    if answer:
        return words_of(answer)
    sentences, last = re.split(r"[.!?]\s+", text.strip()), []
    while sentences and len(last) < ANSWER_WORDS:
        last = words_of(sentences.pop()) + last
    return last if len(last) >= ANSWER_WORDS else []


LEAKS = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("overlap", T.DoubleType()), T.StructField("answered", T.BooleanType())])
)
_PLACES = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("overlap", pa.float64()), ("answered", pa.bool_())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", cosine: float = COSINE, rank: int = RANK, part_bytes: int = PART_BYTES) -> DataFrame:
    """Adds leaks: array<struct<item_id, first_word, end_word, overlap, answered>>, over whole texts."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where(F.col("text").isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col("text").alias("words"), answer.alias("answer"))
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // part_bytes))
    context = docs.sparkSession.sparkContext
    known = vocabulary(items)
    none = T.StructField("leaks", LEAKS)
    if not known:
        return add_columns(docs, [none], lambda: lambda batch: [pa.nulls(batch.num_rows, _PLACES).fill_null([])])
    space = context.broadcast((known, *basis(docs, known, text, rank)))
    out, found = docs, []
    for k in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k)
        spread = context.broadcast([tuple(r) for r in own.orderBy("item", "words").collect()])
        found.append(f"_millrace_leaks_{k}" if parts > 1 else "leaks")
        out = add_columns(out, [T.StructField(found[-1], LEAKS)], _finder(spread, space, cosine, text))
    if parts == 1:
        return out
    order = lambda a, b: F.when(_place(a) < _place(b), -1).when(_place(a) > _place(b), 1).otherwise(0)
    return out.withColumn("leaks", F.array_sort(F.concat(*found), order)).drop(*found)


def _place(leak: Column) -> Column:
    return F.struct(leak["first_word"], leak["end_word"], leak["item_id"].cast("string"))


def _finder(spread: Broadcast, space: Broadcast, cosine: float, text: str):
    def maker():
        known, latent, df = space.value
        search = Search(spread.value, known, latent, df, cosine)

        def make(batch: pa.RecordBatch) -> list:
            found: list[list[dict]] = []
            held, terms, n = [], [], 0
            for t in batch.column(text):
                held.append(words_of(t.as_py()))
                terms.append(terms_of(held[-1], known))
                n += len(held[-1])
                if n > _WORDS:
                    found += search.find(held, terms)
                    held, terms, n = [], [], 0
            return [pa.array(found + search.find(held, terms), _PLACES)]

        return make

    return maker


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every leak found: doc_id, item_id, first_word, end_word, overlap, answered."""
    found = find_leaks(documents.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.inline("leaks"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item was found."""
    return find_leaks(documents, benchmark).where(F.size("leaks") == 0).select(*documents.columns)
