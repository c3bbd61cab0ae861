"""Operator 6: byte-level BPE encoding and decoding by corpus-level merge replay.

1. One pass counts the corpus's words (matches of the pattern): tasks count their own, Spark adds
   the counts up by word.
2. The words that occur most (at most FREQUENT of them, of at most WORD_BYTES bytes each) are dealt
   to tasks by their hash and replayed there, once for the whole corpus. They are what is broadcast:
   bounded in number and size, and the words of which most of any text consists.
3. A second pass encodes the texts. The distinct words of a run of documents that aren't among the
   frequent ones are replayed together where they stand: they occur so seldom that moving their ids
   to their documents would cost more than their merges.

A replay lays its words out on one tape of symbols. An inverted index leads from each token pair to
the places on the tape where it stands. Merges are applied in the order of their ranks over all
words at once, each at the places of its pair, and a merge touches only the two neighbours of its
place. Where a merge brings up a pair of a lower rank, its word waits for that pair first.

Defined cases: a null text counts as empty and has no ids; rows may repeat and keep their number;
very long texts, and words of millions of letters, take time in proportion to their length and memory
in proportion to the longest text; the order of equal counts decides nothing but work; an empty table gives an
empty table; any other column passes through, but for one named like an output, which is replaced.
Null ids decode to null. A byte or an id that the rank file doesn't have is an error.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.batches import add_columns, least_count, unclashed
from millrace.shared import drop_written, written

FREQUENT = 400_000
WORD_BYTES = 64
#: Counts of at most so many words are held by a task, and words of so many bytes are replayed at once.
_COUNTED = 400_000
_TAPE = 1_000_000
_TEXT = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encodes lists of words (bytes) by the ranks, all words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # every way to cut a token into two tokens: the pairs that can merge, and to what
        self.merged = {(left << 24) | right: rank for token, rank in ranks.items() for i in range(1, len(token))
                       if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed as little-endian unsigned 32-bit integers."""
        out, run, size = [], [], 0
        for w in words:
            run.append(w)
            size += len(w)
            if size >= _TAPE:
                out += self._replayed(run)
                run, size = [], 0
        return out + self._replayed(run)

    def _replayed(self, words: list[bytes]) -> list[bytes]:
        whole = [self.ranks.get(w) for w in words]
        out = [b"" if rank is None else rank.to_bytes(4, "little") for rank in whole]
        rest = [k for k, rank in enumerate(whole) if rank is None and words[k]]
        if rest:
            for k, ids in zip(rest, self._merge([words[k] for k in rest])):
                out[k] = ids
        return out

    def _merge(self, words: list[bytes]) -> list[bytes]:
        merged = self.merged
        try:
            one = {b: self.ranks[bytes([b])] for b in set().union(*words)}
        except KeyError as byte:
            raise ValueError(f"the rank file has no token for the byte {byte}") from None
        # a border stands before, between and behind the words: no pair crosses it
        tape = array("i", [-1])
        for w in words:
            tape.extend(map(one.__getitem__, w))
            tape.append(-1)
        after, before = array("i", range(1, len(tape) + 1)), array("i", range(-1, len(tape) - 1))
        index: dict[int, list[int]] = {}  # token pair -> places of its left token
        queue: list[int] = []  # rank and pair of each entry of the index, as one number

        def enter(pair: int, rank: int, at: int) -> None:
            places = index.get(pair)
            if places is None:
                index[pair] = [at]
                heappush(queue, rank << 48 | pair)
            else:
                places.append(at)

        symbols = np.frombuffer(tape, np.int32).astype(np.int64)
        pairs = symbols[:-1] << 24 | symbols[1:]
        first = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
        first = first[np.argsort(pairs[first], kind="stable")]
        edge = np.flatnonzero(np.r_[True, pairs[first[1:]] != pairs[first[:-1]], True]).tolist() if len(first) else []
        for a, b in zip(edge, edge[1:]):
            pair = int(pairs[first[a]])
            if (rank := merged.get(pair)) is not None:
                index[pair] = first[a:b].tolist()
                heappush(queue, rank << 48 | pair)
        del symbols, pairs, first
        low, get = (1 << 48) - 1, merged.get
        while queue:
            top = heappop(queue)
            rank, pairs = top >> 48, [top & low]
            while queue and queue[0] >> 48 == rank:  # other cuts of the same token
                pairs.append(heappop(queue) & low)
            places = sorted((at, pair) for pair in pairs for at in index.pop(pair)) if len(pairs) > 1 else zip(sorted(index.pop(pairs[0])), repeat(pairs[0]))
            wait = -1  # places before it belong to a word in which a lower rank came up
            for at, pair in places:
                right = after[at]
                if tape[at] != pair >> 24 or tape[right] != pair & 0xFFFFFF:
                    continue  # merged meanwhile
                if at < wait:
                    enter(pair, rank, at)
                    continue
                beyond, back = after[right], before[at]
                tape[at], tape[right] = rank, -2
                after[at], before[beyond] = beyond, at
                lower = False
                if (next_ := tape[beyond]) >= 0 and (now := get(new := rank << 24 | next_)) is not None:
                    enter(new, now, at)
                    lower = now < rank
                if (last := tape[back]) >= 0 and (now := get(new := last << 24 | rank)) is not None:
                    enter(new, now, back)
                    lower = lower or now < rank
                if lower:
                    wait = at + 1
                    while tape[wait] != -1:
                        wait += 1
        ids = np.frombuffer(tape, np.int32)
        ids = ids[ids != -2]
        edge = np.flatnonzero(ids == -1).tolist()
        return [ids[a + 1 : b].astype("<u4").tobytes() for a, b in zip(edge, edge[1:])]


class _Known(dict):
    """Ids by word: the frequent words for good, those of a run of documents for its time."""

    def __init__(self, words: dict):
        super().__init__(words)
        self.fresh: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.fresh[word]


def _words(texts: pa.Array, words_of) -> Iterator[tuple[int, int, list[list[str]]]]:
    """Ranges of rows of about _TEXT bytes, and the words of each row."""
    sizes = np.cumsum(np.r_[0, pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + _TEXT, "right")) - 1)
        yield a, b, [words_of(t) if t else [] for t in texts.slice(a, b - a).to_pylist()]
        a = b


def frequent_words(df: DataFrame, replay: Broadcast, pattern: str, text: str = "text", most: int = FREQUENT) -> dict[str, bytes]:
    """The ids of the words that occur most in df, at most `most` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, held = regex.compile(pattern).findall, Counter()

        def told() -> pa.RecordBatch:
            own = [w for w in held if len(w.encode()) <= WORD_BYTES]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([held[w] for w in own], pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, _, split in _words(batch.column(0), words_of):
                for own in split:
                    held.update(own)
                if len(held) > _COUNTED:
                    yield told()
                    held.clear()
        yield told()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = replay.value.encode([w.encode() for w in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["word", "ids"])

    counted = df.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = written(counted, "words")
    least = least_count(counted, most)
    if least is None:
        drop_written(counted)
        return {}
    found = counted.where(F.col("n") >= least).select("word").repartition("word").mapInArrow(ids, "word string, ids binary").toArrow()
    drop_written(counted)
    return dict(zip(found["word"].to_pylist(), found["ids"].to_pylist()))


def _spelled(ranks: dict[bytes, int]):
    tokens = {rank: token for token, rank in ranks.items()}

    def spell(packed: bytes | None) -> bytes | None:
        try:
            return None if packed is None else b"".join(map(tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        except KeyError as rank:
            raise ValueError(f"the rank file has no token {rank}") from None

    return spell


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Adds out: the ids of the whole text, each packed as a little-endian unsigned 32-bit integer
    (unpack_ids gives them as an array). Every match of pattern is encoded on its own, as the
    public rank-file tokenizers do it, without special tokens. With decoded, a column of that name
    has the bytes that the ids spell: what decode() adds, by the same tasks. The driver reads the
    rank file."""
    context = df.sparkSession.sparkContext
    replay = context.broadcast(MergeReplay(load_ranks(ranks_path)))
    known = context.broadcast(frequent_words(df, replay, pattern, text, frequent))
    df = unclashed(df, [out, *([decoded] if decoded else [])])
    names = df.columns
    added = [T.StructField(c, T.BinaryType()) for c in (out, decoded) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, ids_of, spell = regex.compile(pattern).findall, _Known(known.value), _spelled(replay.value.ranks)
        for batch in batches:
            for a, b, split in _words(batch.column(text), words_of):
                fresh = list(set().union(*split).difference(ids_of))
                ids_of.fresh = dict(zip(fresh, replay.value.encode([w.encode() for w in fresh])))
                packed = [b"".join(map(ids_of.__getitem__, own)) for own in split]
                new = [pa.array(packed, pa.binary())] + ([pa.array(map(spell, packed), pa.binary())] if decoded else [])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *new], names=names + [f.name for f in added])

    return df.mapInArrow(run, T.StructType([*df.schema, *added]))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds out: the bytes that the packed ids spell."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def maker():
        spell = _spelled(ranks.value)
        return lambda batch: [pa.array([spell(p) for p in batch.column(ids).to_pylist()], pa.binary())]

    return add_columns(df, [T.StructField(out, T.BinaryType())], maker)


def unpack_ids(df: DataFrame, ids: str = "ids", out: str = "id_list") -> DataFrame:
    """Adds out: the packed ids as an array of bigint."""

    def maker():
        return lambda batch: [pa.array([None if p is None else np.frombuffer(p, "<u4").astype("i8") for p in batch.column(ids).to_pylist()], pa.list_(pa.int64()))]

    return add_columns(df, [T.StructField(out, T.ArrayType(T.LongType()))], maker)


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: the number of ids, and hex digests of the ids and of the bytes they decode to."""
    both = encode(df.select("doc_id", "text"), ranks_path, pattern, decoded="decoded")
    return both.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
