"""CRC32 of a whole from the CRC32s of its parts, and that as a grouped aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLYNOMIAL = 0xEDB88320
FAN = 1024


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
        if not vector:
            break
    return out


def _powers() -> list[list[int]]:
    """Matrices over GF(2) that append 1, 2, 4, ... zero bytes to what a CRC covers."""
    bit = [POLYNOMIAL, *(1 << i for i in range(31))]
    for _ in range(3):
        bit = [_times(bit, x) for x in bit]
    out = [bit]
    for _ in range(62):
        out.append([_times(out[-1], x) for x in out[-1]])
    return out


_ZEROS = _powers()


def combine(left: int, right: int, right_length: int) -> int:
    """CRC32 of a + b from that of a, that of b and the length of b."""
    step = 0
    while right_length:
        if right_length & 1:
            left = _times(_ZEROS[step], left)
        right_length >>= 1
        step += 1
    return left ^ right


def _folded(rows: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """One row per group of keys, its pieces combined in the order of seq. A task goes through its groups one after
    the other, however many there are."""
    names = [*keys, "seq", "crc", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if now is not None and now[: len(keys)] == list(row[: len(keys)]):
                    now[-2:] = combine(now[-2], row[-2], row[-1]), now[-1] + row[-1]
                else:
                    if now is not None:
                        done.append(now)
                    now = list(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(n).type) for c, n in zip(zip(*done), names)], names=names)
            kinds = [batch.schema.field(n).type for n in names]
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(now, kinds)], names=names)

    return rows.select(names).repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(run, schema)


def combined(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, crc, length of each group from its pieces (keys, seq, crc, length), in the order of
    seq (consecutive from 0). Pieces are folded FAN at a time first, so that no task has all pieces
    of a large group."""
    types = dict(pieces.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", seq bigint, crc bigint, length bigint"
    part = pieces.select(*keys, "seq", "crc", "length").withColumn("_part", F.floor(F.col("seq") / FAN))
    first = _folded(part, [*keys, "_part"], schema.replace(", seq bigint", ", _part bigint, seq bigint", 1))
    return _folded(first, keys, schema).drop("seq")
