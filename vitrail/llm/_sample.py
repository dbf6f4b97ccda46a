"""Bounded, seed-free samples for fitting classifiers: for each label, documents of least hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, n: int):
    """crc32 of the id as text, modulo n (a null id: 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")), F.lit(n)), F.lit(0).cast("long"))


def window(text: str, doc_id: str, chars: int):
    """At most ``chars`` characters of a text, from a place that hangs on the id's hash."""
    start = F.pmod(F.xxhash64(F.col(f"`{doc_id}`")), F.greatest(F.length(f"`{text}`") - chars, F.lit(0)) + 1)
    return F.substring(F.col(f"`{text}`"), start.cast("int") + 1, F.lit(chars))


def by_label(rows: DataFrame, label: str, doc_id: str, per_label: int) -> DataFrame:
    """At most ``per_label`` ids for each label: of each of so many hash buckets the least hash.

    One row for each label and bucket at most, with map-side combination; so the size is bounded
    by labels x per_label however many rows there are.
    """
    h = F.xxhash64(F.col(f"`{doc_id}`"))
    return (
        rows.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull())
        .select(F.col(f"`{label}`").alias("label"), F.pmod(h, F.lit(per_label)).alias("slot"), F.struct(h.alias("h"), F.col(f"`{doc_id}`").alias("id")).alias("x"))
        .groupBy("label", "slot")
        .agg(F.min("x").alias("x"))
        .select("label", F.col("x.id").alias("id"))
    )
