"""Sequential folds over arrays that stay in the JVM and take time in proportion to the array.

Appending to an array copies it, so a fold that emits an element a step is quadratic. ``scanned`` folds a chunk at a time: what
is copied is a chunk, or a list of chunks, and only far beyond a million elements would the list's length be felt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunked(items: Column) -> Column:
    """The array cut into arrays of CHUNK elements; no chunk for an empty one."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / CHUNK).cast("int") - 1), lambda c: F.slice(x, c * CHUNK + 1, CHUNK))
    return let(items, lambda x: F.when(F.size(x) > 0, cut(x)).otherwise(F.slice(F.array(x), 1, 0)))


def scanned(items: Column, state: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], out_type: str) -> Column:
    """For each element ``out(state before it, element)``, in order, where ``step(state, element)`` is the state behind it."""
    none = F.array().cast(f"array<{out_type}>")
    nones = F.array().cast(f"array<array<{out_type}>>")

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["s"], x).alias("s"), F.concat(acc["o"], F.array(out(acc["s"], x).cast(out_type))).alias("o"))

    def chunk(acc: Column, c: Column) -> Column:
        done = F.aggregate(c, F.struct(acc["s"].alias("s"), none.alias("o")), one)
        return let(done, lambda d: F.struct(d["s"].alias("s"), F.concat(acc["o"], F.array(d["o"])).alias("o")))

    return F.aggregate(chunked(items), F.struct(state.alias("s"), nones.alias("o")), chunk, lambda acc: F.flatten(acc["o"]))


def offsets(lengths: Column) -> Column:
    """The sum of all lengths before each."""
    return scanned(lengths, F.lit(0), lambda s, n: s + n, lambda s, n: s, "int")
