"""Neighbour and depth predictors; windows run within a row, a column, a tile or a place, never over a whole raster.

The masked 8-bit predictor falls back on the last valid value in scan order: within a row by a window, and from the rows
before by one value for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rastrum.functions.columns import wrap8
from rastrum.operators.grid import KEY, PLACE


def _row() -> WindowSpec:
    return Window.partitionBy(*KEY, "depth", "row").orderBy("col")


def _column() -> WindowSpec:
    return Window.partitionBy(*KEY, "depth", "col").orderBy("row")


def delta_predict(pixels: DataFrame) -> DataFrame:
    """delta, modulo 256, to the left neighbour, else the upper one, else the last valid value, else 0."""
    row = [*KEY, "depth", "row"]
    last = pixels.groupBy(*row).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("col"))).alias("last"))
    earlier = Window.partitionBy(*KEY, "depth").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*row, F.last("last", ignorenulls=True).over(earlier).alias("_carried"))
    rows = pixels.withColumn("_above", F.lag("value").over(_column())).join(carried, row)
    before = F.last("value", ignorenulls=True).over(_row().rowsBetween(Window.unboundedPreceding, -1))
    base = F.coalesce(F.lag("value").over(_row()), F.col("_above"), before, F.col("_carried"), F.lit(0.0))
    return rows.withColumn("delta", wrap8((F.col("value") - base).cast("bigint"))).select(*pixels.columns, "delta")


def row_delta(pixels: DataFrame, column: str = "value") -> DataFrame:
    v = F.col(column).cast("bigint")
    return pixels.withColumn("delta", v - F.coalesce(F.lag(v).over(_row()), F.lit(0)))


def cross_delta(pixels: DataFrame) -> DataFrame:
    """The row difference, then its difference down the column."""
    rows = row_delta(pixels)
    return rows.withColumn("delta", F.col("delta") - F.coalesce(F.lag("delta").over(_column()), F.lit(0)))


def restore_rows(deltas: DataFrame) -> DataFrame:
    return deltas.withColumn("value", F.sum("delta").over(_row().rowsBetween(Window.unboundedPreceding, 0)))


def restore_cross(deltas: DataFrame) -> DataFrame:
    down = deltas.withColumn("delta", F.sum("delta").over(_column().rowsBetween(Window.unboundedPreceding, 0)))
    return restore_rows(down)


def field_difference(a: Column, b: Column, mantissa: int, bits: int) -> Column:
    """a - b on the lower `mantissa` bits and on the others, each wrapping in its field."""
    low, high = F.lit((1 << mantissa) - 1), F.lit(1 << (bits - mantissa))
    part = F.pmod(a.bitwiseAND(low) - b.bitwiseAND(low), F.lit(1 << mantissa))
    return F.shiftleft(F.pmod(F.shiftright(a, mantissa) - F.shiftright(b, mantissa), high), mantissa).bitwiseOR(part)


def sequence_delta(rows: DataFrame, level: int, keys: list[str], place: str = "pos", column: str = "v") -> DataFrame:
    """`level` rounds of byte differences, round k from place k on, modulo 256."""
    w = Window.partitionBy(*keys).orderBy(place)
    for k in range(1, level + 1):
        rows = rows.withColumn(column, F.when(F.col(place) >= k, wrap8(F.col(column) - F.lag(column, 1, 0).over(w))).otherwise(F.col(column)))
    return rows


def stride_delta(rows: DataFrame, keys: list[str], place: str = "pos", column: str = "v", stride: int = 7) -> DataFrame:
    """Byte differences at every stride-th place only."""
    w = Window.partitionBy(*keys).orderBy(place)
    here = (F.pmod(F.col(place), F.lit(stride)) == 0) & (F.col(place) >= 1)
    return rows.withColumn(column, F.when(here, wrap8(F.col(column) - F.lag(column, 1, 0).over(w))).otherwise(F.col(column)))


def depth_diff(pixels: DataFrame) -> DataFrame:
    """diff: to the depth before at the same place; NULL at depth 0."""
    return pixels.withColumn("diff", F.col("value") - F.lag("value").over(Window.partitionBy(*PLACE).orderBy("depth")))


def xor_neighbours(pixels: DataFrame) -> DataFrame:
    """raster_id, band, diff: XOR of each place with its right and its lower neighbour, where both are valid."""
    v = F.col("value").cast("bigint")
    rows = pixels.select(*KEY, v.bitwiseXOR(F.lead(v).over(_row())).alias("right"), v.bitwiseXOR(F.lead(v).over(_column())).alias("below"))
    return rows.select(*KEY, F.explode(F.array("right", "below")).alias("diff")).where("diff IS NOT NULL")


def rle_runs(rows: DataFrame, keys: list[str], place: str, column: str) -> DataFrame:
    """start, n and value of runs of equal values."""
    w = Window.partitionBy(*keys).orderBy(place)
    new = F.when(F.col(column).eqNullSafe(F.lag(column).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    run = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return run.groupBy(*keys, "_run").agg(F.min(place).alias("start"), F.count("*").alias("n"), F.first(column).alias("v")).drop("_run")
