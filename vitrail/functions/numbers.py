"""Rounding and clamping with the arithmetic of IEEE doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(x) -> Column:
    """A double literal, or a column as double (a bare SQL 0.38 would be a decimal)."""
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(dbl(lo), F.least(dbl(hi), x))


def half_up(x: Column) -> Column:
    """Round half towards positive infinity, to a whole number."""
    return F.floor(x + dbl(0.5))


def thousandths(x: Column) -> Column:
    """Three decimals, half up; not ``round(x, 3)``, which rounds the decimal expansion."""
    return half_up(x * dbl(1000)).cast("double") / dbl(1000)


def score3(x: Column) -> Column:
    """Clamped to [0, 1], then three decimals."""
    return thousandths(clamp(x))


def whole_ms(x: Column) -> Column:
    """A time in whole milliseconds; negative and not finite times become 0."""
    bad = F.isnan(x) | (x < 0) | (x == dbl(float("inf")))
    return F.when(x.isNull() | bad, F.lit(0).cast("long")).otherwise(half_up(x).cast("long"))


def band(x: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut that ``x`` reaches."""
    out = F.lit(rest)
    for cut, name in reversed(cuts):
        out = F.when(x >= dbl(cut), name).otherwise(out)
    return out


def hypotenuse_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


# The same in DuckDB SQL, for the twins of the queries.


def sql_round3(x: str) -> str:
    return f"(floor(({x})::DOUBLE * 1000::DOUBLE + 0.5::DOUBLE)::DOUBLE / 1000::DOUBLE)"


def sql_score3(x: str) -> str:
    return sql_round3(f"greatest(0::DOUBLE, least(1::DOUBLE, {x}))")
