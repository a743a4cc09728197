"""The choices that precede encoding, one row per band: tolerance, missing values, version and mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrum.functions import columns as C
from rastrum.operators import predict, stats, tiles
from rastrum.operators.grid import KEY

#: Decimal grids on which values may lie exactly, the coarsest first, and the places from which planes are told.
FACTORS = (1, 2, 10, 20, 100, 200, 1000, 2000, 10000)
LEAST_FOR_PLANES = 5000


def raise_tolerance(pixels: DataFrame, tolerance: float) -> DataFrame:
    """Each band's tolerance, raised to half the step of the coarsest decimal grid on which all its values lie."""
    v = F.col("value")
    off = [F.max(F.abs(F.floor(v * f + 0.5) - v * f)).alias(f"off_{f}") for f in FACTORS]
    per = pixels.where("value IS NOT NULL").groupBy(*KEY).agg(*off)
    best = F.lit(float(tolerance))
    if tolerance > 0:
        for f in reversed(FACTORS):
            if 0.5 / f > tolerance:
                # Rounding may move a value by what is below the requested tolerance, in units of the grid.
                best = F.when(F.col(f"off_{f}") / f <= F.lit(tolerance / 1e6), F.lit(0.5 / f)).otherwise(best)
    return per.select(*KEY, best.alias("tolerance"))


def bit_plane_cut(pixels: DataFrame, bits: int, eps: float = 0.01) -> DataFrame:
    """cut: how many low bit planes are noise, -1 where a band is too small to tell; tolerance: what that allows."""
    counts = stats.bit_plane_counts(predict.xor_neighbours(pixels), bits)
    valid = stats.valid_counts(pixels).select(*KEY, "valid")
    noisy = F.abs(1 - 2 * F.col("ones") / F.col("n")) < eps
    per = counts.groupBy(*KEY).agg(F.coalesce(F.min(F.when(~noisy, F.col("bit"))), F.lit(bits)).alias("first"), F.max("n").alias("pairs"))
    known = (F.col("valid") >= LEAST_FOR_PLANES) & (F.coalesce("pairs", F.lit(0)) >= LEAST_FOR_PLANES)
    out = valid.join(per, KEY, "left").withColumn("cut", F.when(known, F.col("first")).otherwise(-1).cast("int"))
    cut = F.expr("CAST(shiftright(shiftleft(CAST(1 AS BIGINT), greatest(cut, 0)), 1) AS DOUBLE)")
    return out.select(*KEY, "cut", F.greatest(cut, F.lit(0.5)).alias("tolerance"))


def nodata_sentinel(low: Column, tolerance: float, dtype: str, no_data: float) -> Column:
    """The given value if it is more than two tolerances below the data, else one that is; NULL if there is none."""
    limit = low - 2 * tolerance
    if C.is_integer(dtype):
        least = float(C.TYPES[C.CODE[dtype]][2])
        options = [F.floor(limit).cast("double") - s for s in (1, 10, 100, 1000)]
        found = F.coalesce(*[F.when(x >= least, x) for x in options])
    else:
        # Steps that the type can tell from the data; infinities are no values.
        typed = (lambda x: x.cast("float").cast("double")) if dtype == "f32" else (lambda x: x)
        options = [typed(limit - s) for s in (1.0, 10.0, 100.0, 1000.0, 1e4, 1e6, 1e9)]
        found = F.coalesce(*[F.when((x < limit) & (x > F.lit(float("-inf"))), x) for x in options])
    return F.when(F.lit(float(no_data)) < limit, F.lit(float(no_data))).otherwise(found)


def nodata_plan(pixels: DataFrame, no_data: float, tolerance: float, dtype: str) -> DataFrame:
    per = stats.nodata_stats(pixels, no_data)
    return per.withColumn("sentinel", F.when(F.col("mixed"), nodata_sentinel(F.col("low"), tolerance, dtype, no_data)))


def nodata_remap(pixels: DataFrame, plan: DataFrame, no_data: float) -> DataFrame:
    """pixels with the sentinel in the place of the missing value; one row of the plan per band."""
    rows = pixels.join(plan.select(*KEY, "sentinel"), KEY)
    new = F.when((F.col("value") == no_data) & F.col("sentinel").isNotNull(), F.col("sentinel")).otherwise(F.col("value"))
    return rows.withColumn("value", new).drop("sentinel")


def encode_plan(pixels: DataFrame, tolerance: float, dtype: str) -> DataFrame:
    """One row per band: range, valid places, version, tile size and the way of encoding, with its cost where known."""
    tolerance = C.normal_tolerance(tolerance, dtype)
    floats = not C.is_integer(dtype)
    # One aggregate over pixels, by depth; what follows it are a few rows for each band.
    v = stats.number()
    per = pixels.groupBy(*KEY, "depth").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count("value").alias("valid"))
    base = per.groupBy(*KEY).agg(
        F.coalesce(F.min("low"), F.lit(0.0)).alias("min_value"), F.coalesce(F.max("high"), F.lit(0.0)).alias("max_value"), F.sum("valid").alias("valid"),
        F.count("*").alias("depths"), F.bool_and(F.coalesce(F.col("low") == F.col("high"), F.lit(True))).alias("flat"),
    )
    plan = base.join(base.groupBy("raster_id").agg(F.count("*").alias("bands")), "raster_id")
    version = C.blob_version(F.col("depths"), F.col("bands"), F.lit(False), F.lit(floats and tolerance == 0))
    plan = plan.withColumn("version", version).withColumn("tolerance", F.lit(tolerance))
    if floats and tolerance == 0:
        sizes = base.select(*KEY, F.lit(None).cast("int").alias("block"), F.lit(None).cast("bigint").alias("tile_bytes"))
    else:
        sizes = tiles.select_block_size(pixels, tolerance, dtype).select(*KEY, "block", F.least("bytes_8", "bytes_16").alias("tile_bytes"))
    mode = F.when(F.col("valid") == 0, "empty").when((F.col("min_value") == F.col("max_value")) | F.col("flat"), "const")
    mode = mode.when(F.lit(floats and tolerance == 0), "float planes")
    if dtype in ("i8", "u8") and tolerance == 0.5:
        h = stats.histogram(predict.delta_predict(pixels), "delta")
        ideal = stats.entropy(h).select(*KEY, F.col("bytes").cast("bigint").alias("huffman_bytes"))
        plan = plan.join(ideal, KEY, "left")
        mode = mode.when(F.col("huffman_bytes") < F.col("tile_bytes"), "delta Huffman")
    else:
        plan = plan.withColumn("huffman_bytes", F.lit(None).cast("bigint"))
    return plan.join(sizes, KEY).withColumn("mode", mode.otherwise("tiles")).drop("flat")
