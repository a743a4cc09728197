"""Tiles: their statistics, the form each would be stored in, its cost, and the choice of the tile size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastrum.functions import columns as C
from rastrum.operators.grid import KEY
from rastrum.operators.quantize import levels
from rastrum.operators.stats import number

TILE = [*KEY, "tile_row", "tile_col", "depth"]


def assign_tiles(pixels: DataFrame, block: int) -> DataFrame:
    return pixels.withColumns({"tile_row": F.floor(F.col("row") / block).cast("int"), "tile_col": F.floor(F.col("col") / block).cast("int")})


def tile_stats(pixels: DataFrame, block: int) -> DataFrame:
    v = number()
    return assign_tiles(pixels, block).groupBy(*TILE).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count("value").alias("n"))


def tile_quants(pixels: DataFrame, block: int, tolerance: float, dtype: str) -> DataFrame:
    """Each valid place with its tile's offset `low` and its quantised value `q`."""
    tiled = assign_tiles(pixels.where("value IS NOT NULL"), block)
    w = Window.partitionBy(*TILE)
    return tiled.withColumn("low", F.min("value").over(w)).withColumn("q", levels(F.col("value"), F.col("low"), tolerance, dtype))


def tile_costs(pixels: DataFrame, block: int, tolerance: float, dtype: str) -> DataFrame:
    """n, low, high, mode (zero, const, raw, stuffed) and bytes of every tile; tiles without valid places are zero."""
    # One aggregate: a tile has block * block values at most, so the distinct ones are a small array.
    t = assign_tiles(pixels, block).groupBy(*TILE).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"), F.collect_set("value").alias("known"))
    t = t.withColumn("distinct", F.size(F.array_distinct(F.transform("known", lambda v: levels(v, F.col("low"), tolerance, dtype)))))
    top = levels(F.col("high"), F.col("low"), tolerance, dtype)
    width = C.TYPES[C.CODE[dtype]][1]
    raw = 1 + F.col("n") * width
    spread = (F.col("high") - F.col("low")) / (2 * tolerance) if tolerance else F.lit(float("inf"))
    stuffed = 1 + C.reduced_width(F.col("low"), dtype) + C.block_cost(F.col("n"), top, F.col("distinct"))
    zero = (F.col("n") == 0) | ((F.col("low") == 0) & (F.col("high") == 0))
    const = (F.col("low") == F.col("high")) | ((spread <= C.max_quant(dtype)) & (top == 0))
    mode = F.when(zero, "zero").when(const, "const").when((spread > C.max_quant(dtype)) | (stuffed >= raw), "raw").otherwise("stuffed")
    t = t.withColumn("mode", mode)
    size = F.when(F.col("mode") == "zero", 1).when(F.col("mode") == "const", 1 + C.reduced_width(F.col("low"), dtype)).when(F.col("mode") == "raw", raw).otherwise(stuffed)
    return t.select(*TILE, "n", "low", "high", "mode", size.cast("bigint").alias("bytes"))


def select_block_size(pixels: DataFrame, tolerance: float, dtype: str) -> DataFrame:
    """bytes of all tiles at 8 and at 16, and the smaller size, over all tiles of the band."""
    a, b = (tile_costs(pixels, k, tolerance, dtype).groupBy(*KEY).agg(F.sum("bytes").alias(f"bytes_{k}")) for k in (8, 16))
    return a.join(b, KEY).withColumn("block", F.when(F.col("bytes_16") < F.col("bytes_8"), 16).otherwise(8))


def sample_positions(pixels: DataFrame, block: int) -> DataFrame:
    """Tiles on which a size may be tried: the corners, the centre and three edges' midpoints."""
    size = pixels.groupBy(*KEY).agg(F.floor(F.max("row") / block).cast("int").alias("r"), F.floor(F.max("col") / block).cast("int").alias("c"))
    mid = lambda x: F.floor(F.col(x) / 2).cast("int")
    zero = F.lit(0)
    places = [(zero, zero), (zero, F.col("c")), (F.col("r"), zero), (F.col("r"), F.col("c")), (mid("r"), mid("c")), (zero, mid("c")), (mid("r"), zero), (mid("r"), F.col("c"))]
    return size.select(*KEY, F.inline(F.array_distinct(F.array(*[F.struct(a.alias("tile_row"), b.alias("tile_col")) for a, b in places]))))


def lut_index(pixels: DataFrame, block: int, tolerance: float, dtype: str) -> DataFrame:
    """Each valid place with the index of its level among its tile's distinct levels."""
    rows = tile_quants(pixels, block, tolerance, dtype)
    return rows.withColumn("index", F.dense_rank().over(Window.partitionBy(*TILE).orderBy("q")) - 1)
