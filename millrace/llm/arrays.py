"""Expressions over array columns that several operators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once: it is bound as the element of an array."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _starts(sizes: Column, first: Column) -> Column:
    """first, first + sizes[0], ...: each step copies what is there, so this is for short arrays."""
    zero = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(sizes, zero, step, lambda acc: acc["out"])


def starts(sizes: Column) -> Column:
    """array<int>: the sum of the sizes before each element. Sums run within blocks, whose own sums
    run over blocks, so long arrays don't copy all of what is there at each element."""

    def of(whole: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), F.lit(_BLOCK)), lambda a: F.slice(whole, a, F.lit(_BLOCK)))
        total = lambda b: F.aggregate(b, F.lit(0), lambda s, n: (s + n).cast("int"))
        return let(blocks, lambda bs: let(_starts(F.transform(bs, total), F.lit(0)), lambda firsts: F.flatten(F.transform(bs, lambda b, i: _starts(b, F.get(firsts, i))))))

    return let(sizes, of)
