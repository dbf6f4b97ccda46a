"""Screenshots from files, or as data URLs in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: File names are <capture_id>.<kind>.png; kinds are full and clip.
NAME = r"([^/]+)\.(full|clip)\.png$"


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(capture_id, kind, png, length) of the PNG files below a folder; other files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(folder)
    name = lambda group: F.regexp_extract("path", NAME, group)
    return files.select(name(1).alias("capture_id"), name(2).alias("kind"), F.col("content").alias("png"), "length").where("kind <> ''")


def decoded(data_url: Column) -> Column:
    """Bytes of a PNG data URL; anything else raises."""
    ok = data_url.startswith("data:image/png;base64,")
    return F.when(ok, T.data_url_bytes(data_url)).otherwise(F.raise_error(F.lit("not a PNG data URL")).cast("binary"))


def clip_size(width: Column, height: Column) -> Column:
    """Size of a clip: at least one pixel each way."""
    return F.struct(F.greatest(F.lit(1.0), width).alias("width"), F.greatest(F.lit(1.0), height).alias("height"))
