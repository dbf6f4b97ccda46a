"""Writers: export folders, text reports, keyed stores and reading back by request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def export_label(created: Column, tag: Column) -> Column:
    """Folder of an export: its time and a safe tag."""
    return F.concat(F.date_format(created, "yyyy-MM-dd'T'HH-mm-ss"), F.lit("_"), T.file_tag(tag))


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """(label, name, content) as one text table, partitioned by artifact name; parallel, any store."""
    artifacts.select("label", "name", "content").write.mode("overwrite").partitionBy("name").parquet(path)


def meta_json(row_columns: list[str]) -> Column:
    """A capture's metadata as JSON; absent fields are left out."""
    return F.to_json(F.struct(*row_columns), {"ignoreNullFields": "true"})


def write_reports(reports: DataFrame, path: str) -> None:
    """(report) as text files, a report in each record."""
    reports.select(F.col("report").alias("value")).write.mode("overwrite").option("lineSep", "\n\f\n").text(path)


def write_store(store: DataFrame, path: str) -> None:
    """A keyed store as a new version (see ``operators.report.upsert`` for its rows)."""
    store.write.mode("errorifexists").parquet(path)


def lookup(store: DataFrame, request_id: str) -> DataFrame:
    """The record of a request; the filter reaches the scan."""
    return store.where(F.col("request_id") == request_id)
