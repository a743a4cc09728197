"""Rasters as relations: raster_id, band, row, col, depth, value; every place is present, NULL where invalid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["raster_id", "band"]
PLACE = [*KEY, "row", "col"]
PIXELS = "raster_id string, band int, row int, col int, depth int, value double"


def from_table(df: DataFrame, place: Column, width: int, value: Column, raster_id: str = "r", band: Column | None = None, valid: Column | None = None, depth: Column | None = None) -> DataFrame:
    """pixels from rows with a dense number `place` (from 0, row by row) and a value."""
    v = value.cast("double")
    return df.select(
        F.lit(raster_id).alias("raster_id"),
        (F.lit(0) if band is None else band).cast("int").alias("band"),
        F.floor(place / width).cast("int").alias("row"),
        F.pmod(place, F.lit(width)).cast("int").alias("col"),
        (F.lit(0) if depth is None else depth).cast("int").alias("depth"),
        (v if valid is None else F.when(valid, v)).alias("value"),
    )


def from_layers(df: DataFrame, place: Column, width: int, values: list[Column], **more) -> DataFrame:
    """pixels of several depths, one column each."""
    whole = df.select("*", F.posexplode(F.array(*[v.cast("double") for v in values])).alias("_depth", "_value"))
    return from_table(whole, place, width, F.col("_value"), depth=F.col("_depth"), **more)


def union_bands(parts: list[DataFrame]) -> DataFrame:
    """One raster of several single bands, numbered in order."""
    return reduce(DataFrame.unionByName, [p.withColumn("band", F.lit(i)) for i, p in enumerate(parts)])


def mask_where(pixels: DataFrame, keep: Column) -> DataFrame:
    return pixels.withColumn("value", F.when(keep, F.col("value")))


def set_value(pixels: DataFrame, where: Column, value: float | None) -> DataFrame:
    """Sets places valid with a value, or invalid with None."""
    return pixels.withColumn("value", F.when(where, F.lit(value).cast("double")).otherwise(F.col("value")))


def valid_pixels(pixels: DataFrame) -> DataFrame:
    return pixels.where(F.col("value").isNotNull())


def pixel(pixels: DataFrame, row: int, col: int, band: int = 0, depth: int = 0) -> DataFrame:
    return pixels.where((F.col("row") == row) & (F.col("col") == col) & (F.col("band") == band) & (F.col("depth") == depth))


def fill_nodata(pixels: DataFrame, value: float) -> DataFrame:
    return pixels.withColumn("value", F.coalesce("value", F.lit(float(value))))


def dimensions(pixels: DataFrame) -> DataFrame:
    per = pixels.groupBy(*KEY).agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"), (F.max("depth") + 1).alias("depths"))
    return per.withColumn("num_pixels", F.col("width").cast("bigint") * F.col("height"))


def packed_mask(pixels: DataFrame, width: int) -> DataFrame:
    """The validity bits of each band, eight places a byte, the first place highest."""
    place = F.col("row").cast("bigint") * width + F.col("col")
    bit = F.when(F.col("value").isNotNull(), F.call_function("shiftleft", F.lit(1), (7 - F.pmod(place, F.lit(8))).cast("int"))).otherwise(0)
    return pixels.where("depth = 0").groupBy(*KEY, F.floor(place / 8).alias("byte_no")).agg(F.sum(bit).alias("byte"))


def from_packed_mask(masks: DataFrame, width: int) -> DataFrame:
    """raster_id, band, row, col, valid from packed_mask()'s rows; bits past the end are the caller's to drop."""
    bits = masks.select(*KEY, "byte_no", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    place = F.col("byte_no") * 8 + F.col("bit")
    return bits.select(*KEY, F.floor(place / width).cast("int").alias("row"), F.pmod(place, F.lit(width)).cast("int").alias("col"), (F.getbit("byte", 7 - F.col("bit")) == 1).alias("valid"))


def const_image(spark, width: int, height: int, value: float | None, raster_id: str = "r") -> DataFrame:
    return from_table(spark.range(width * height), F.col("id"), width, F.lit(value), raster_id)
