"""Work along an array inside one row, in time that grows with the array and not with its square.

``aggregate`` copies its state element by element at each step, so a plain fold that gathers outputs, or
that carries a deep stack, takes the square of the array.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outputs are gathered in chunks of so many, and chunks of chunks.
CHUNK = 32


def built(make: Callable[..., Column]) -> Callable[..., Column]:
    """Long expressions over columns of fixed names are put together once a JVM, not once a query: that
    takes thousands of calls to it."""
    made: dict = {}

    @functools.wraps(make)
    def get(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in made:
            made[key] = make(*args)
        return made[key]

    return get


def once(d: DataFrame, **columns: Column) -> DataFrame:
    """``d`` with columns that are computed once a row; a plain projection would be repeated wherever a
    lambda, a filter or a generator reads them."""
    return d.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunked(values: Column, size: int = CHUNK) -> Column:
    """``values`` (a bound variable or column) as an array of arrays."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda c: F.slice(values, c * size + 1, F.lit(size)))
    return F.when(F.size(values) > 0, cut).otherwise(F.slice(F.array(values), 1, 0))


def scan(values: Column, near: Column, step: Callable[[Column, Column, Column], Column], kind: str, far: Column | None = None, between=None, finish=None) -> Column:
    """An output for each element, in order, each step seeing the state that the one before left.

    ``step`` of (far, near, element) gives a struct of the next near state, s, and the output, o, of type
    ``kind``.  ``far`` is state that steps read but only ``between`` changes, after each chunk: from (far,
    near) it gives a struct of both, f and s.  ``finish`` makes the result of (far, near, outputs), by
    default the outputs.
    """
    far = F.lit(0) if far is None else far
    between = between or (lambda f, s: F.struct(f.alias("f"), s.alias("s")))
    finish = finish or (lambda f, s, outs: outs)
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(f: Column):
        return lambda a, x: let(step(f, a["s"], x), lambda r: F.struct(r["s"].alias("s"), F.concat(a["o"], F.array(r["o"])).alias("o")))

    def chunk(a: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(a["s"].alias("s"), none.alias("o")), one(a["f"]))
        return let(done, lambda r: let(between(a["f"], r["s"]), lambda b: F.struct(b["f"].alias("f"), b["s"].alias("s"), F.concat(a["o"], F.array(r["o"])).alias("o"))))

    def chunks(a: Column, xss: Column) -> Column:
        done = F.aggregate(xss, F.struct(a["f"].alias("f"), a["s"].alias("s"), nothing.alias("o")), chunk)
        return let(done, lambda r: F.struct(r["f"].alias("f"), r["s"].alias("s"), F.concat(a["o"], F.array(F.flatten(r["o"]))).alias("o")))

    start = F.struct(far.alias("f"), near.alias("s"), nothing.alias("o"))
    return let(values, lambda v: let(chunked(v), lambda c: F.aggregate(chunked(c), start, chunks, lambda a: finish(a["f"], a["s"], F.flatten(a["o"])))))


def grouped(pairs: Column) -> Column:
    """Structs (k, v) as a map from each k to its values, in ascending order; by one sort."""

    def cut(p: Column) -> Column:
        first = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (F.get(p, i - 1)["k"] != x["k"]), i)), lambda i: i.isNotNull())
        run = lambda f: lambda b, j: F.slice(p, b + 1, F.coalesce(F.get(f, j + 1), F.size(p)) - b)
        return let(first, lambda f: F.map_from_entries(F.transform(f, lambda b, j: F.struct(F.get(p, b)["k"], F.transform(run(f)(b, j), lambda x: x["v"])))))

    return let(F.array_sort(F.filter(pairs, lambda x: x["k"].isNotNull())), cut)
