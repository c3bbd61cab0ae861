"""Adding columns to a DataFrame by a function over Arrow batches, in tasks of any number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unclashed(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that an operator is about to add (Spark compares names without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def add_columns(df: DataFrame, fields: list[T.StructField], maker: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """maker() is called once in each task and returns the function that makes the new columns of
    a batch; what it keeps between batches must be bounded. All other columns pass through."""
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + list(make(batch)), names=kept + names)

    return df.mapInArrow(run, schema)


def pieces(texts: list, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about size characters together (a longer text stands alone)."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def least_count(counted: DataFrame, most: int, n: str = "n") -> int | None:
    """A count that at most `most` rows of counted reach: the smallest such, in steps of a quarter
    of a power of two, of which the driver gets one row each. None if there is no such row."""
    steps = counted.groupBy(F.floor(F.log2(n) * 4).alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in steps:
        total += r["rows"]
        if total > most:
            break
        least = r["least"]
    return least
