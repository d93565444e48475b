"""Sums along arrays as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable is never inlined by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(numbers: Column) -> Column:
    """For each number of an array, the sum of those before it. Blocks of the square root of the length keep the arrays that grow by appending short."""
    none = F.array().cast("array<int>")

    def run(part: Column, start: Column) -> Column:
        return F.aggregate(
            part, F.struct(start.cast("int").alias("at"), none.alias("out")),
            lambda acc, n: F.struct((acc["at"] + n).cast("int").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"],
        )

    def blocked(a: Column, m: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), m - 1), lambda b: F.slice(a, b * m + 1, m))
        total = lambda block: F.aggregate(block, F.lit(0), lambda x, y: x + y)
        return let(blocks, lambda bs: let(run(F.transform(bs, total), F.lit(0)), lambda at: F.flatten(F.transform(bs, lambda block, b: run(block, F.get(at, b))))))

    found = let(numbers, lambda a: let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int")), lambda m: blocked(a, m)))
    return F.when(F.size(numbers) > 0, found).otherwise(none)
