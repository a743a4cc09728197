"""Streaming ingest of new blob files: stateless, each file once. An extension; one-shot reading needs none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.sources.raster import decode_blobs, raster_info

#: The end of a file's name that tells where its blob lies in the raster.
PLACE = "@([0-9]+)_([0-9]+)$"


def _blobs(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    place = [F.coalesce(F.expr("try_cast(x AS int)".replace("x", f"regexp_extract(name, '{PLACE}', {k})")), F.lit(0)).alias(c) for k, c in ((1, "first_row"), (2, "first_col"))]
    files = files.select(name.alias("name"), "content")
    return files.select(F.url_decode(F.regexp_replace("name", PLACE, "")).alias("raster_id"), *place, F.col("content").alias("blob"))


def stream_info(spark: SparkSession, path: str) -> DataFrame:
    return raster_info(_blobs(spark, path))


def stream_pixels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A damaged file ends the stream; with strict=False it gives no pixels, and stream_info() tells what is wrong."""
    return decode_blobs(_blobs(spark, path), strict)
