"""Quantisation within a tolerance, and what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastrum.functions.columns import is_integer


def levels(v: Column, low: Column, tolerance: float, dtype: str) -> Column:
    """Steps of two tolerances above the tile's least value; plain differences for lossless integers."""
    if is_integer(dtype) and tolerance == 0.5:
        return (v - low).cast("bigint")
    if tolerance == 0:
        return F.when(v > low, 1).otherwise(0).cast("bigint")
    return F.floor((v - low) * (1.0 / (2 * tolerance)) + 0.5).cast("bigint")


def values(q: Column, low: Column, high: Column, tolerance: float, dtype: str) -> Column:
    step = 1.0 if is_integer(dtype) and tolerance == 0.5 else 2 * tolerance
    return F.least(low + q * step, high)


def quantize(pixels: DataFrame, block: int, tolerance: float, dtype: str) -> DataFrame:
    """Each valid place with tile_row, tile_col, low and q."""
    from rastrum.operators.tiles import tile_quants

    return tile_quants(pixels, block, tolerance, dtype)


def dequantize(pixels: DataFrame, block: int, tolerance: float, dtype: str) -> DataFrame:
    """pixels as a reader would see them: valid values moved by at most the tolerance."""
    from rastrum.operators.tiles import TILE, tile_quants

    rows = tile_quants(pixels, block, tolerance, dtype)
    high = F.max("value").over(Window.partitionBy(*TILE))
    return rows.withColumn("restored", values(F.col("q"), F.col("low"), high, tolerance, dtype))
