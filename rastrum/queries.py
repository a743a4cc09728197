"""Queries of the raster operators over tables that serve as rasters, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.functions import columns as C
from rastrum.operators import grid, predict, quantize, stats, tiles
from rastrum.plans import planner
from rastrum.sources import raster

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, view: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH px AS ({VIEWS[view]}) {sql}" if view else sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Views: tables with dense keys as rasters.
VIEWS = {
    "events": "SELECT 0 AS band, (event_id // 100)::INT AS row, (event_id % 100)::INT AS col, 0 AS depth, value FROM events",
    "masked": "SELECT 0 AS band, (event_id // 100)::INT AS row, (event_id % 100)::INT AS col, 0 AS depth, CASE WHEN event_type <> 'error' THEN value END AS value FROM events",
    "bands": "SELECT (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS band, ((row_number() OVER e - 1) // 50)::INT AS row, ((row_number() OVER e - 1) % 50)::INT AS col, 0 AS depth, value FROM events WINDOW e AS (PARTITION BY event_type ORDER BY event_id)",
    "sizes": "SELECT 0 AS band, (p_partkey // 50)::INT AS row, (p_partkey % 50)::INT AS col, 0 AS depth, p_size::DOUBLE AS value FROM part",
    "sizes_masked": "SELECT 0 AS band, (p_partkey // 50)::INT AS row, (p_partkey % 50)::INT AS col, 0 AS depth, CASE WHEN p_partkey % 7 <> 3 THEN p_size::DOUBLE END AS value FROM part",
    "nations": "SELECT 0 AS band, (c_custkey // 50)::INT AS row, (c_custkey % 50)::INT AS col, 0 AS depth, c_nationkey::DOUBLE AS value FROM customer",
    "layers": "SELECT 0 AS band, (p_partkey // 50)::INT AS row, (p_partkey % 50)::INT AS col, d AS depth, CASE WHEN d = 0 THEN p_size WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size + 1 END::DOUBLE AS value FROM part, (VALUES (0), (1)) v(d)",
    "bytes": "SELECT 0 AS band, (o_orderkey // 100)::INT AS row, (o_orderkey % 100)::INT AS col, 0 AS depth, ((o_totalprice * 100)::BIGINT % 256)::DOUBLE AS value FROM orders",
    "totals": "SELECT 0 AS band, (o_orderkey // 100)::INT AS row, (o_orderkey % 100)::INT AS col, 0 AS depth, ((o_totalprice * 100)::BIGINT % 65536)::DOUBLE AS value FROM orders",
    "vectors": "SELECT 0 AS band, vec_id::INT AS row, (generate_subscripts(embedding, 1) - 1)::INT AS col, 0 AS depth, unnest(embedding)::DOUBLE AS value FROM embeddings",
}


def events(spark, d, valid: Column | None = None) -> DataFrame:
    return grid.from_table(_t(spark, d, "events"), F.col("event_id"), 100, F.col("value"), "events", valid=valid)


def masked(spark, d) -> DataFrame:
    return events(spark, d, F.col("event_type") != "error")


def bands(spark, d) -> DataFrame:
    from pyspark.sql import Window

    e = _t(spark, d, "events")
    k = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    names = e.select("event_type").distinct()
    number = names.withColumn("band", F.row_number().over(Window.orderBy("event_type")) - 1)  # one row per event type
    return grid.from_table(e.withColumn("k", k).join(number, "event_type"), F.col("k"), 50, F.col("value"), "events", band=F.col("band"))


def sizes(spark, d, valid: Column | None = None) -> DataFrame:
    return grid.from_table(_t(spark, d, "part"), F.col("p_partkey"), 50, F.col("p_size"), "part", valid=valid)


def sizes_masked(spark, d) -> DataFrame:
    return sizes(spark, d, F.col("p_partkey") % 7 != 3)


def nations(spark, d) -> DataFrame:
    return grid.from_table(_t(spark, d, "customer"), F.col("c_custkey"), 50, F.col("c_nationkey"), "customer")


def layers(spark, d) -> DataFrame:
    second = F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(F.col("p_size") + 1)
    return grid.from_layers(_t(spark, d, "part"), F.col("p_partkey"), 50, [F.col("p_size"), second], raster_id="part")


def vectors(spark, d) -> DataFrame:
    rows = _t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return grid.from_table(rows, F.col("vec_id") * 64 + F.col("i"), 64, F.col("v"), "embeddings")


def totals(spark, d) -> DataFrame:
    """Cents, of which the lower bits are noise."""
    cents = F.pmod((F.col("o_totalprice") * 100).cast("decimal(20,0)").cast("bigint"), F.lit(65536))
    return grid.from_table(_t(spark, d, "orders"), F.col("o_orderkey"), 100, cents, "orders")


def low_bytes(spark, d) -> DataFrame:
    return totals(spark, d).withColumn("value", F.pmod("value", F.lit(256.0)))


TILED = "SELECT *, row // {b} AS tile_row, col // {b} AS tile_col FROM px"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return quantize_lossy(spark, d)


# Masks, projections and statistics.
@query("SELECT band, coalesce(min(value), 0) AS min_value, coalesce(max(value), 0) AS max_value, count(value) AS valid, count(*) AS places FROM px GROUP BY band", "bands")
def band_stats(spark, d):
    return stats.band_stats(bands(spark, d)).drop("raster_id")


@query("SELECT band, depth, coalesce(min(value), 0) AS min_value, coalesce(max(value), 0) AS max_value, count(value) AS valid, count(*) AS places FROM px GROUP BY band, depth", "layers")
def depth_stats(spark, d):
    return stats.depth_stats(layers(spark, d)).drop("raster_id")


@query("SELECT count(value) AS valid, count(*) AS places, count(value) = count(*) AS all_valid FROM px", "masked")
def valid_count(spark, d):
    return stats.valid_counts(masked(spark, d)).select("valid", "places", "all_valid")


@query("SELECT band, count(value) = count(*) AS all_valid FROM px GROUP BY band", "bands")
def all_valid_flag(spark, d):
    return stats.valid_counts(bands(spark, d)).select("band", "all_valid")


@query("SELECT ((row * 100 + col) // 8)::BIGINT AS byte_no, sum(CASE WHEN value IS NOT NULL THEN 1 << (7 - (row * 100 + col) % 8) ELSE 0 END)::BIGINT AS byte FROM px GROUP BY 1", "masked")
def packed_mask(spark, d):
    return grid.packed_mask(masked(spark, d), 100).select("byte_no", F.col("byte").cast("bigint").alias("byte"))


@query("SELECT row, col, value IS NOT NULL AS valid FROM px", "masked")
def unpacked_mask(spark, d):
    pixels = masked(spark, d)
    found = grid.from_packed_mask(grid.packed_mask(pixels, 100), 100)
    size = grid.dimensions(pixels).select(*grid.KEY, "num_pixels")  # bits past the end are no places
    return found.join(size, grid.KEY).where(F.col("row") * 100 + F.col("col") < F.col("num_pixels")).select("row", "col", "valid")


@query("SELECT row, col, value FROM px WHERE value IS NOT NULL", "masked")
def valid_pixels(spark, d):
    return grid.valid_pixels(masked(spark, d)).select("row", "col", "value")


@query("SELECT row, col, value FROM px WHERE row = 3 AND col = 17", "events")
def pixel_lookup(spark, d):
    return grid.pixel(events(spark, d), 3, 17).select("row", "col", "value")


@query("SELECT row, col, coalesce(value, -9999.0)::DOUBLE AS value FROM px", "masked")
def fill_nodata(spark, d):
    return grid.fill_nodata(masked(spark, d), -9999).select("row", "col", "value")


@query("SELECT row, col, CASE WHEN row = 0 THEN 1.0 WHEN col = 0 THEN NULL ELSE value END::DOUBLE AS value FROM px", "masked")
def set_pixels(spark, d):
    off = grid.set_value(masked(spark, d), F.col("col") == 0, None)
    return grid.set_value(off, F.col("row") == 0, 1.0).select("row", "col", "value")


@query("SELECT band, max(col) + 1 AS width, max(row) + 1 AS height, 1 AS depths, (max(col)::BIGINT + 1) * (max(row) + 1) AS num_pixels FROM px GROUP BY band", "bands")
def dimensions(spark, d):
    return grid.dimensions(bands(spark, d)).drop("raster_id")


@query("SELECT 0 AS band, row, col, value FROM px UNION ALL SELECT 1, row, col, value * 2 FROM px", "sizes")
def union_bands(spark, d):
    a = sizes(spark, d)
    return grid.union_bands([a, a.withColumn("value", F.col("value") * 2)]).select("band", "row", "col", "value")


@query("SELECT i::INT AS code, n AS dtype, w AS size, i < 6 AS is_integer, i NOT IN (1, 3, 5) AS is_signed FROM (VALUES (0, 'i8', 1), (1, 'u8', 1), (2, 'i16', 2), (3, 'u16', 2), (4, 'i32', 4), (5, 'u32', 4), (6, 'f32', 4), (7, 'f64', 8)) v(i, n, w)")
def dtype_table(spark, d):
    return spark.createDataFrame([(i, n, w, C.is_integer(n), C.is_signed(n)) for i, (n, w, *_) in enumerate(C.TYPES)], "code int, dtype string, size int, is_integer boolean, is_signed boolean")


# Tiles and quantisation.
@query(f"SELECT tile_row, tile_col, min(value) AS low, max(value) AS high, count(value) AS n FROM ({TILED.format(b=8)}) GROUP BY 1, 2", "masked")
def tile_stats(spark, d):
    return tiles.tile_stats(masked(spark, d), 8).select("tile_row", "tile_col", "low", "high", "n")


def _costs(block: int, tolerance: float, dtype: str) -> str:
    low, high, width, steps = "low", "high", C.TYPES[C.CODE[dtype]][1], 1 / (2 * tolerance)
    whole = C.is_integer(dtype) and tolerance == 0.5
    q = lambda v: f"({v} - {low})::BIGINT" if whole else f"floor(({v} - {low}) * {steps!r}::DOUBLE + 0.5)::BIGINT"
    reduced = {
        "u8": "1",
        "f64": "CASE WHEN low = floor(low) AND low BETWEEN -32768 AND 32767 THEN 2 WHEN low = floor(low) AND low BETWEEN -2147483648 AND 2147483647 THEN 4 WHEN low::FLOAT::DOUBLE = low THEN 4 ELSE 8 END",
    }[dtype]
    bl = lambda x: f"(CASE WHEN {x} = 0 THEN 0 ELSE length(bin({x})) END)"
    return rf"""
, t AS ({TILED.format(b=block)}),
s AS (SELECT tile_row, tile_col, min(value) AS low, max(value) AS high, count(value) AS n FROM t GROUP BY 1, 2),
k AS (SELECT tile_row, tile_col, count(DISTINCT {q("value")}) AS u FROM t JOIN s USING (tile_row, tile_col) WHERE value IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, {q("high")} AS top, (high - low) / {2 * tolerance!r}::DOUBLE AS spread, 1 + n * {width} AS raw,
        1 + CASE WHEN n < 256 THEN 1 WHEN n < 65536 THEN 2 ELSE 4 END AS head FROM s LEFT JOIN k USING (tile_row, tile_col)),
b AS (SELECT *, (head + (n * {bl("top")} + 7) // 8)::BIGINT AS plain,
        (head + 1 + ((u - 1) * {bl("top")} + 7) // 8 + (n * {bl("(u - 1)")} + 7) // 8)::BIGINT AS tab, {reduced} AS w FROM m),
c AS (SELECT *, 1 + w + CASE WHEN u BETWEEN 2 AND 255 AND tab < plain THEN tab ELSE plain END AS stuffed FROM b),
f AS (SELECT *, CASE WHEN n = 0 OR (low = 0 AND high = 0) THEN 'zero' WHEN low = high OR (spread <= {C.max_quant(dtype)} AND top = 0) THEN 'const'
        WHEN spread > {C.max_quant(dtype)} OR stuffed >= raw THEN 'raw' ELSE 'stuffed' END AS mode FROM c),
costs AS (SELECT tile_row, tile_col, n, low, high, mode, (CASE mode WHEN 'zero' THEN 1 WHEN 'const' THEN 1 + w WHEN 'raw' THEN raw ELSE stuffed END)::BIGINT AS bytes FROM f)
"""


@query(_costs(8, 0.5, "u8") + "SELECT tile_row, tile_col, mode, bytes FROM costs", "sizes_masked")
def tile_cost(spark, d):
    return tiles.tile_costs(sizes_masked(spark, d), 8, 0.5, "u8").select("tile_row", "tile_col", "mode", "bytes")


@query(_costs(16, 0.25, "f64") + "SELECT mode, count(*) AS tiles, sum(bytes)::BIGINT AS bytes FROM costs GROUP BY mode", "masked")
def tile_mode(spark, d):
    return tiles.tile_costs(masked(spark, d), 16, 0.25, "f64").groupBy("mode").agg(F.count("*").alias("tiles"), F.sum("bytes").alias("bytes"))


@query(
    f"SELECT a.bytes AS bytes_8, b.bytes AS bytes_16, CASE WHEN b.bytes < a.bytes THEN 16 ELSE 8 END AS block FROM (WITH px AS ({VIEWS['sizes']}) {_costs(8, 0.5, 'u8')} SELECT sum(bytes)::BIGINT AS bytes FROM costs) a, (WITH px AS ({VIEWS['sizes']}) {_costs(16, 0.5, 'u8')} SELECT sum(bytes)::BIGINT AS bytes FROM costs) b"
)
def block_size(spark, d):
    return tiles.select_block_size(sizes(spark, d), 0.5, "u8").select("bytes_8", "bytes_16", "block")


@query(
    "SELECT DISTINCT x.tile_row::INT AS tile_row, x.tile_col::INT AS tile_col FROM (SELECT unnest([{'tile_row': 0, 'tile_col': 0}, {'tile_row': 0, 'tile_col': c}, {'tile_row': r, 'tile_col': 0}, {'tile_row': r, 'tile_col': c}, {'tile_row': r // 2, 'tile_col': c // 2}, {'tile_row': 0, 'tile_col': c // 2}, {'tile_row': r // 2, 'tile_col': 0}, {'tile_row': r // 2, 'tile_col': c}]) AS x FROM (SELECT max(row) // 8 AS r, max(col) // 8 AS c FROM px))",
    "events",
)
def sample_positions(spark, d):
    return tiles.sample_positions(events(spark, d), 8).select("tile_row", "tile_col")


@query(f"SELECT row, col, (value - min(value) OVER (PARTITION BY tile_row, tile_col))::BIGINT AS q FROM ({TILED.format(b=8)})", "sizes")
def quantize_lossless(spark, d):
    return quantize.quantize(sizes(spark, d), 8, 0.5, "u8").select("row", "col", "q")


@query(f"SELECT tile_row, tile_col, min(low) AS low, max(floor((value - low) * 1.0::DOUBLE + 0.5))::BIGINT AS max_quant, count(*) AS n FROM (SELECT *, min(value) OVER (PARTITION BY tile_row, tile_col) AS low FROM ({TILED.format(b=8)})) GROUP BY 1, 2", "events")
def quantize_lossy(spark, d):
    rows = quantize.quantize(events(spark, d), 8, 0.5, "f64")
    return rows.groupBy("tile_row", "tile_col").agg(F.min("low").alias("low"), F.max("q").alias("max_quant"), F.count("*").alias("n"))


@query(
    f"SELECT row, col, round(least(low + floor((value - low) * 10.0::DOUBLE + 0.5) * 0.1::DOUBLE, high), 6) AS restored, abs(least(low + floor((value - low) * 10.0::DOUBLE + 0.5) * 0.1::DOUBLE, high) - value) <= 0.05 + 1e-12 AS within FROM (SELECT *, min(value) OVER t AS low, max(value) OVER t AS high FROM ({TILED.format(b=8)}) WINDOW t AS (PARTITION BY tile_row, tile_col)) WHERE value IS NOT NULL",
    "masked",
)
def dequantize_error(spark, d):
    rows = quantize.dequantize(masked(spark, d), 8, 0.05, "f64").where("value IS NOT NULL")
    return rows.select("row", "col", F.round("restored", 6).alias("restored"), (F.abs(F.col("restored") - F.col("value")) <= 0.05 + 1e-12).alias("within"))


@query(f"SELECT row, col, (dense_rank() OVER (PARTITION BY tile_row, tile_col ORDER BY value) - 1)::INT AS index FROM ({TILED.format(b=8)})", "sizes")
def lut_index(spark, d):
    return tiles.lut_index(sizes(spark, d), 8, 0.5, "u8").select("row", "col", F.col("index").cast("int").alias("index"))


@query("SELECT row, col, CASE WHEN value BETWEEN -128 AND 127 THEN 1 WHEN value BETWEEN 0 AND 255 THEN 1 ELSE 2 END AS i16, CASE WHEN value BETWEEN 0 AND 255 THEN 1 ELSE 2 END AS u16 FROM (SELECT row, col, value * 9 AS value FROM px)", "nations")
def type_reduce(spark, d):
    v = F.col("value") * 9
    return nations(spark, d).select("row", "col", C.reduced_width(v, "i16").alias("i16"), C.reduced_width(v, "u16").alias("u16"))


@query("SELECT row, col, greatest(-128, least(127, trunc(value * 7 - 900)))::DOUBLE AS i8, greatest(0, least(255, trunc(value)))::DOUBLE AS u8, ((value::BIGINT * 7 - 900) % 256 + 256) % 256 AS wrapped FROM (SELECT row, col, value::DOUBLE AS value FROM px)", "sizes")
def saturating_cast(spark, d):
    v = F.col("value")
    return sizes(spark, d).select("row", "col", C.sat_cast(v * 7 - 900, "i8").alias("i8"), C.sat_cast(v, "u8").alias("u8"), C.wrap8(v.cast("bigint") * 7 - 900).alias("wrapped"))


@query("SELECT DISTINCT tile_col, (((tile_col * 8 % 256) >> 3) & 15) << 2 AS v3, (((tile_col * 8 % 256) >> 3) & 14) << 2 AS v5 FROM (SELECT (col // 8)::INT AS tile_col FROM px)", "events")
def integrity_bits(spark, d):
    t = tiles.assign_tiles(events(spark, d), 8).select("tile_col").distinct()
    return t.select("tile_col", C.integrity_bits(F.col("tile_col") * 8, 3).alias("v3"), C.integrity_bits(F.col("tile_col") * 8, 5).alias("v5"))


# Predictors, histograms, entropy.
DELTA = "SELECT *, (((value - coalesce(lag(value) OVER (PARTITION BY row ORDER BY col), lag(value) OVER (PARTITION BY col ORDER BY row), last_value(value IGNORE NULLS) OVER (ORDER BY row, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT % 256) + 256) % 256 AS delta FROM px"


@query(f"SELECT row, col, delta FROM ({DELTA}) WHERE value IS NOT NULL", "sizes_masked")
def delta_predictor(spark, d):
    return predict.delta_predict(sizes_masked(spark, d)).where("value IS NOT NULL").select("row", "col", "delta")


@query(f"SELECT delta AS bin, count(*) AS n FROM ({DELTA}) WHERE value IS NOT NULL GROUP BY 1", "sizes_masked")
def delta_histogram(spark, d):
    return stats.histogram(predict.delta_predict(sizes_masked(spark, d)), "delta").select("bin", "n")


@query("SELECT value::BIGINT AS bin, count(*) AS n FROM px WHERE value IS NOT NULL GROUP BY 1", "sizes_masked")
def direct_histogram(spark, d):
    return stats.histogram(sizes_masked(spark, d), "value").select("bin", "n")


@query("SELECT round(-sum(n / t * log2(n / t)), 9) AS bits FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM px GROUP BY value)", "sizes")
def entropy_bits(spark, d):
    return stats.entropy(stats.histogram(sizes(spark, d), "value")).select(F.round("bits", 9).alias("bits"))


@query("SELECT floor((-sum(n / t * log2(n / t)) * any_value(t) + 7) / 8)::BIGINT AS bytes FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM px WHERE (row * 50 + col) % 7 = 0 GROUP BY value)", "sizes")
def entropy_bytes(spark, d):
    rows = sizes(spark, d).withColumn("pos", F.col("row") * 50 + F.col("col"))
    return stats.sampled_entropy(rows, "pos", "value").select(F.col("bytes").cast("bigint").alias("bytes"))


@query(f"SELECT (SELECT count(DISTINCT value) FROM px) AS bins, (SELECT count(DISTINCT delta) FROM ({DELTA})) AS delta_bins, (SELECT count(*) >= 248 AND max(n) * 256 < 2 * sum(n) FROM (SELECT count(*) AS n FROM px GROUP BY value)) AND (SELECT count(DISTINCT delta) FROM ({DELTA})) >= 64 AS high_entropy", "bytes")
def entropy_class(spark, d):
    p = low_bytes(spark, d)
    return stats.high_entropy(stats.histogram(p, "value"), stats.histogram(predict.delta_predict(p), "delta")).select("bins", "delta_bins", "high_entropy")


XOR = "SELECT unnest([xor(v, lead(v) OVER (PARTITION BY row ORDER BY col)), xor(v, lead(v) OVER (PARTITION BY col ORDER BY row))]) AS x FROM (SELECT *, value::BIGINT AS v FROM px)"


@query(f"SELECT b::INT AS bit, sum((x >> b) & 1)::BIGINT AS ones, count(*) AS n FROM ({XOR}), (VALUES (0), (1), (2), (3), (4)) bits(b) WHERE x IS NOT NULL GROUP BY b", "nations")
def bitplane_counts(spark, d):
    return stats.bit_plane_counts(predict.xor_neighbours(nations(spark, d)), 5).select("bit", "ones", "n")


def _cut(bits: int, eps: float) -> str:
    return f"SELECT CASE WHEN (SELECT count(value) FROM px) >= 5000 THEN coalesce(min(CASE WHEN abs(1 - 2 * ones / n) >= {eps} THEN b END), {bits}) ELSE -1 END::INT AS cut FROM (SELECT b, sum((x >> b) & 1)::DOUBLE AS ones, count(*) AS n FROM ({XOR}), range({bits}) bits(b) WHERE x IS NOT NULL GROUP BY b)"


@query(_cut(5, 0.01), "nations")
def bitplane_cut(spark, d):
    return planner.bit_plane_cut(nations(spark, d), 5).select("cut")


@query(f"SELECT cut, greatest(0.5, CASE WHEN cut > 0 THEN 2.0 ** (cut - 1) ELSE 0 END)::DOUBLE AS tolerance FROM ({_cut(16, 0.05)})", "totals")
def bitplane_tolerance(spark, d):
    """The cut of noisy integers, and the tolerance in the header of the blob that is written with it."""
    pixels = totals(spark, d)
    info = raster.raster_info(raster.encode_pixels(pixels, "u16", bit_planes=0.05), strict=True)
    return planner.bit_plane_cut(pixels, 16, 0.05).select("raster_id", "cut").join(info.select("raster_id", "tolerance"), "raster_id").select("cut", "tolerance")


@query("SELECT row, col, (v - coalesce(lag(v) OVER (PARTITION BY row ORDER BY col), 0)) AS delta FROM (SELECT *, value::BIGINT AS v FROM px)", "sizes")
def row_delta(spark, d):
    return predict.row_delta(sizes(spark, d)).select("row", "col", "delta")


@query("SELECT row, col, r - coalesce(lag(r) OVER (PARTITION BY col ORDER BY row), 0) AS delta FROM (SELECT row, col, v - coalesce(lag(v) OVER (PARTITION BY row ORDER BY col), 0) AS r FROM (SELECT *, value::BIGINT AS v FROM px))", "sizes")
def cross_delta(spark, d):
    return predict.cross_delta(sizes(spark, d)).select("row", "col", "delta")


@query("SELECT row, col, value::BIGINT AS value FROM px", "sizes")
def restore_cross(spark, d):
    return predict.restore_cross(predict.cross_delta(sizes(spark, d))).select("row", "col", F.col("value").cast("bigint").alias("value"))


def _bytes_of(pixels: DataFrame) -> DataFrame:
    return pixels.select("row", F.col("col").alias("pos"), F.col("value").cast("bigint").alias("v"))


@query("SELECT row, pos, CASE WHEN pos >= 2 THEN (((a - lag(a) OVER (PARTITION BY row ORDER BY pos)) % 256) + 256) % 256 ELSE a END AS v FROM (SELECT row, col AS pos, CASE WHEN col >= 1 THEN (((value - lag(value) OVER (PARTITION BY row ORDER BY col))::BIGINT % 256) + 256) % 256 ELSE value::BIGINT END AS a FROM px)", "sizes")
def sequence_delta(spark, d):
    return predict.sequence_delta(_bytes_of(sizes(spark, d)), 2, ["row"])


@query("SELECT row, col AS pos, CASE WHEN col % 7 = 0 AND col >= 1 THEN (((value - lag(value) OVER (PARTITION BY row ORDER BY col))::BIGINT % 256) + 256) % 256 ELSE value::BIGINT END AS v FROM px", "sizes")
def stride_delta(spark, d):
    return predict.stride_delta(_bytes_of(sizes(spark, d)), ["row"])


@query(
    "SELECT row, col, (((((a >> 3) - (b >> 3)) % 32 + 32) % 32) << 3) | ((((a & 7) - (b & 7)) % 8 + 8) % 8) AS diff FROM (SELECT row, col, value::BIGINT AS a, coalesce(lag(value) OVER (PARTITION BY row ORDER BY col), 0)::BIGINT AS b FROM px)",
    "sizes",
)
def field_delta(spark, d):
    from pyspark.sql import Window

    v = F.col("value").cast("bigint")
    b = F.coalesce(F.lag(v).over(Window.partitionBy("row").orderBy("col")), F.lit(0).cast("bigint"))
    rows = sizes(spark, d).select("row", "col", v.alias("a"), b.alias("b"))
    return rows.select("row", "col", predict.field_difference(F.col("a"), F.col("b"), 3, 8).alias("diff"))


@query("SELECT row, col, (b.value - a.value) AS diff FROM px a JOIN px b USING (row, col) WHERE a.depth = 0 AND b.depth = 1", "layers")
def depth_diff(spark, d):
    return predict.depth_diff(layers(spark, d)).where("depth = 1").select("row", "col", "diff")


@query("SELECT row, min(col) AS start, count(*) AS n, any_value(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY col) - row_number() OVER (PARTITION BY row, v ORDER BY col) AS g FROM (SELECT row, col, (value > 25)::INT AS v FROM px)) GROUP BY row, v, g", "sizes")
def rle_runs(spark, d):
    rows = sizes(spark, d).select("row", "col", (F.col("value") > 25).cast("int").alias("v"))
    return predict.rle_runs(rows, ["row"], "col", "v")


@query(
    "SELECT row, (f(b) * 65536 + f(a))::BIGINT AS checksum FROM (SELECT row, sum(w)::BIGINT AS a, sum((n - i) * w)::BIGINT AS b FROM (SELECT row, col AS i, value::BIGINT AS w, count(*) OVER (PARTITION BY row) AS n FROM px) GROUP BY row)".replace(
        "f(b)", "(CASE WHEN b % 65535 = 0 THEN 65535 ELSE b % 65535 END)"
    ).replace("f(a)", "(CASE WHEN a % 65535 = 0 THEN 65535 ELSE a % 65535 END)"),
    "sizes",
)
def fletcher32(spark, d):
    words = sizes(spark, d).select("row", F.col("col").alias("i"), F.col("value").cast("bigint").alias("w"))
    return stats.fletcher32(words, ["row"])


# Planning.
def _raised(tolerance: float) -> str:
    off = ", ".join(f"max(abs(floor(value * {f} + 0.5) - value * {f})) / {f} AS f{f}" for f in planner.FACTORS)
    step = " ".join(f"WHEN f{f} <= {tolerance / 1e6!r} THEN {0.5 / f!r}::DOUBLE" for f in planner.FACTORS if 0.5 / f > tolerance)
    return f"SELECT band, CASE {step} ELSE {tolerance!r}::DOUBLE END AS tolerance FROM (SELECT band, {off} FROM px GROUP BY band)"


@query(_raised(0.001), "bands")
def tolerance_raise(spark, d):
    return planner.raise_tolerance(bands(spark, d), 0.001).select("band", "tolerance")


@query(_raised(0.001), "bands")
def raised_header(spark, d):
    """What the headers of blobs say that are written with a tolerance."""
    return raster.raster_info(raster.encode_pixels(bands(spark, d), "f64", 0.001), strict=True).select("band", "tolerance")


@query("SELECT bool_or(m > 0 AND m < 2) AS mixed, min(low) AS low, max(high) AS high FROM (SELECT row, col, count(*) FILTER (value = 0) AS m, min(CASE WHEN value <> 0 THEN value END) AS low, max(CASE WHEN value <> 0 THEN value END) AS high FROM px GROUP BY ALL)", "layers")
def nodata_flag(spark, d):
    return stats.nodata_stats(layers(spark, d), 0.0).select("mixed", "low", "high")


@query("SELECT CASE WHEN 0 < min(value) - 2 * 2.0 THEN 0 ELSE floor(min(value) - 4.0) - 1 END::DOUBLE AS sentinel FROM px WHERE value <> 0", "layers")
def nodata_sentinel(spark, d):
    return planner.nodata_plan(layers(spark, d), 0.0, 2.0, "i32").select("sentinel")


@query("SELECT row, col, depth, CASE WHEN value = 0 THEN (SELECT floor(min(value) - 4.0) - 1 FROM px WHERE value <> 0) ELSE value END::DOUBLE AS value FROM px", "layers")
def nodata_remap(spark, d):
    pixels = layers(spark, d)
    return planner.nodata_remap(pixels, planner.nodata_plan(pixels, 0.0, 2.0, "i32"), 0.0).select("row", "col", "depth", "value")


@query("SELECT band, count(value) AS valid, 6 AS version, min(value) AS min_value, max(value) AS max_value FROM px GROUP BY band", "bands")
def encode_plan(spark, d):
    return planner.encode_plan(bands(spark, d), 0.01, "f64").select("band", "valid", "version", "min_value", "max_value")


@query(
    f"""SELECT valid, 3 AS version, block, tile_bytes, huffman_bytes, CASE WHEN huffman_bytes < tile_bytes THEN 'delta Huffman' ELSE 'tiles' END AS mode
FROM (SELECT count(value) AS valid FROM ({VIEWS["sizes_masked"]})),
(SELECT CASE WHEN b16 < b8 THEN 16 ELSE 8 END AS block, least(b8, b16) AS tile_bytes FROM (WITH px AS ({VIEWS["sizes_masked"]}) {_costs(8, 0.5, "u8")} SELECT sum(bytes)::BIGINT AS b8 FROM costs), (WITH px AS ({VIEWS["sizes_masked"]}) {_costs(16, 0.5, "u8")} SELECT sum(bytes)::BIGINT AS b16 FROM costs)),
(WITH px AS ({VIEWS["sizes_masked"]}) SELECT floor((-sum(n / t * log2(n / t)) * any_value(t) + 7) / 8)::BIGINT AS huffman_bytes FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM ({DELTA}) WHERE value IS NOT NULL GROUP BY delta))"""
)
def encode_plan_8_bit(spark, d):
    return planner.encode_plan(sizes_masked(spark, d), 0.5, "u8").select("valid", "version", "block", "tile_bytes", "huffman_bytes", "mode")


@query()
def huffman_lengths(spark, d):
    """Code lengths of each band's values; the 256 counts of a band are one group."""
    import pyarrow as pa

    from rastrum.codec.huffman import code_lengths

    def one(g: pa.Table) -> pa.Table:
        import numpy as np

        counts = np.zeros(256, np.int64)
        counts[g.column("bin").to_numpy()] = g.column("n").to_numpy()
        n = code_lengths(counts)
        used = np.flatnonzero(counts)
        return pa.table({"bin": pa.array(used), "n": pa.array(counts[used]), "bits": pa.array(n[used])})

    h = stats.histogram(sizes(spark, d), "value")
    return h.groupBy("raster_id", "band").applyInArrow(one, "bin bigint, n bigint, bits bigint")


@query("SELECT round(-sum(n / t * log2(n / t)), 9) AS ideal, true AS complete, true AS within FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM px GROUP BY value)", "sizes")
def huffman_cost(spark, d):
    """Whether the code is complete (its Kraft sum is 1), and its bits per value at least the entropy and less than one more."""
    bits = huffman_lengths(spark, d).agg((F.sum(F.col("n") * F.col("bits")) / F.sum("n")).alias("cost"), F.sum(F.pow(2.0, -F.col("bits"))).alias("kraft"))
    ideal = stats.entropy(stats.histogram(sizes(spark, d), "value")).agg(F.max("bits").alias("ideal"))
    one = bits.withColumn("one", F.lit(1)).join(ideal.withColumn("one", F.lit(1)), "one")
    return one.select(F.round("ideal", 9).alias("ideal"), (F.col("kraft") == 1).alias("complete"), F.col("cost").between(F.col("ideal") - 1e-9, F.col("ideal") + 1).alias("within"))


# Blobs: written and read again.
def _again(pixels: DataFrame, dtype: str, tolerance: float | None = None, no_data: float | None = None) -> DataFrame:
    return raster.decode_blobs(raster.encode_pixels(pixels, dtype, tolerance, no_data=no_data))


@query("SELECT row, col, value FROM px", "sizes_masked")
def roundtrip_huffman(spark, d):
    return _again(sizes_masked(spark, d), "u8").select("row", "col", "value")


@query("SELECT row, col, value FROM px", "nations")
def roundtrip_tiles(spark, d):
    return _again(nations(spark, d), "i32").select("row", "col", "value")


@query("SELECT row, col, value FROM px", "vectors")
def roundtrip_float_lossless(spark, d):
    return _again(vectors(spark, d), "f32").select("row", "col", "value")


@query("SELECT row, col, depth, value FROM px", "layers")
def roundtrip_nodata(spark, d):
    return _again(layers(spark, d), "f64", no_data=0.0).select("row", "col", "depth", "value")


@query("SELECT row, col, value IS NOT NULL AS valid, round(value, 2) AS value FROM px", "masked")
def roundtrip_lossy(spark, d):
    """A tolerance below half the values' grid, so that rounding gives them back."""
    return _again(masked(spark, d), "f64", 0.004).select("row", "col", F.col("value").isNotNull().alias("valid"), F.round("value", 2).alias("value"))


@query("SELECT 0 AS band, 3 AS version, 50 AS width, max(row) + 1 AS height, 1 AS depth, 1 AS bands, 'u8' AS dtype, count(value) AS valid_pixels, 0.5::DOUBLE AS tolerance, min(value) AS min_value, max(value) AS max_value FROM px", "sizes_masked")
def header_info(spark, d):
    info = raster.raster_info(raster.encode_pixels(sizes_masked(spark, d), "u8"), strict=True)
    return info.select("band", "version", "width", "height", "depth", "bands", "dtype", "valid_pixels", "tolerance", "min_value", "max_value")


@query("SELECT row, col, 7.5::DOUBLE AS value FROM px", "sizes")
def roundtrip_const(spark, d):
    return _again(sizes(spark, d).withColumn("value", F.lit(7.5)), "f64").select("row", "col", "value")


@query("SELECT band, row, col, value FROM px", "bands")
def roundtrip_bands(spark, d):
    """Bands of one raster; places of a last, short row that no pixel has come back invalid."""
    return _again(bands(spark, d), "f64").where("value IS NOT NULL").select("band", "row", "col", "value")


@query("SELECT row, col, depth, value FROM px", "layers")
def roundtrip_depths(spark, d):
    """Integers of two depths, the second as differences to the first."""
    return _again(layers(spark, d), "i32").select("row", "col", "depth", "value")


#: For each type: a factor and an offset of values from 1 to 50.
SPREAD = {"i8": (5, -128), "u8": (5, 0), "i16": (1300, -32768), "u16": (1300, 0), "i32": (85_000_000, -(2**31)), "u32": (85_000_000, 0), "f32": (0.25, -3), "f64": (0.1, 1e9)}


@query(" UNION ALL ".join(f"SELECT '{t}' AS dtype, row, col, (value * {a!r}::DOUBLE + {b!r}::DOUBLE) AS value FROM px" for t, (a, b) in SPREAD.items()), "sizes_masked")
def roundtrip_types(spark, d):
    """Each type without loss, next to the ends of its range."""
    out = None
    for t, (a, b) in SPREAD.items():
        pixels = sizes_masked(spark, d).withColumn("value", F.col("value") * F.lit(float(a)) + F.lit(float(b)))
        one = raster.decode_blobs(raster.encode_pixels(pixels, t), dtype=t).select(F.lit(t).alias("dtype"), "row", "col", "value")
        out = one if out is None else out.unionByName(one)
    return out


# Blobs in forms that the writer does not make, laid out by hand.
def laid_out(pixels: DataFrame, kind: str) -> DataFrame:
    """(raster_id, first_row, first_col, blob), as encode_pixels(). kind: sweep, sweep_3 (version 3), version_2 or older."""
    import numpy as np
    import pyarrow as pa

    def one(g: pa.Table) -> pa.Table:
        from rastrum.codec import samples

        values, valid = (x[:, :, 0] for x in raster.part_arrays(g))
        if kind == "older":
            blob = samples.older(values.astype(np.float32), valid, 0.5)
        else:
            small = values.astype(np.uint8)[:, :, None]
            blob = samples.version_2(small, valid) if kind == "version_2" else samples.one_sweep(small, valid, 3 if kind == "sweep_3" else 4)
        place = {c: pa.array([g.column(c)[0].as_py()], pa.int32()) for c in ("first_row", "first_col")}
        return pa.table({"raster_id": [kind], **place, "blob": pa.array([blob], pa.binary())})

    return raster.in_parts(pixels).groupBy(*raster.PART).applyInArrow(one, "raster_id string, first_row int, first_col int, blob binary")


KINDS = ("sweep", "sweep_3", "version_2", "older")


def all_kinds(spark, d) -> DataFrame:
    out = laid_out(sizes_masked(spark, d), KINDS[0])
    for k in KINDS[1:]:
        out = out.unionByName(laid_out(sizes_masked(spark, d), k))
    return out


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, row, col, value FROM px" for k in KINDS), "sizes_masked")
def decode_kinds(spark, d):
    """Blobs of one sweep, of version 2 and of the older format, with counts and values in tiles."""
    return raster.decode_blobs(all_kinds(spark, d)).select(F.col("raster_id").alias("kind"), "row", "col", "value")


@query(
    "SELECT kind, v AS version, 50 AS width, (SELECT max(row) + 1 FROM px) AS height, 1 AS depth, 1 AS bands, t AS dtype, 0.5::DOUBLE AS tolerance, (SELECT max(value) FROM px) AS max_value FROM (VALUES ('sweep', 4, 'u8'), ('sweep_3', 3, 'u8'), ('version_2', 2, 'u8'), ('older', 1, 'f32')) k(kind, v, t)",
    "sizes_masked",
)
def header_kinds(spark, d):
    info = raster.raster_info(all_kinds(spark, d), strict=True)
    return info.select(F.col("raster_id").alias("kind"), "version", "width", "height", "depth", "bands", "dtype", "tolerance", "max_value")


@query(
    f"""SELECT 'bands' AS name, band, 6 AS version, 5 AS bands, 1 AS depth, 'f64' AS dtype, count(value) AS valid_pixels, min(value) AS min_value, max(value) AS max_value FROM ({VIEWS["bands"]}) GROUP BY band
UNION ALL SELECT 'depths', 0, 5, 1, 2, 'i32', count(*) // 2, min(value), max(value) FROM ({VIEWS["layers"]})
UNION ALL SELECT 'no data', 0, 6, 1, 2, 'i32', count(*) // 2, (SELECT floor(min(value) - 1) - 1 FROM ({VIEWS["layers"]}) WHERE value <> 0), max(value) FROM ({VIEWS["layers"]})"""
)
def header_versions(spark, d):
    """Versions as bands, depths and missing values need them."""
    blobs = {"bands": raster.encode_pixels(bands(spark, d), "f64"), "depths": raster.encode_pixels(layers(spark, d), "i32"), "no data": raster.encode_pixels(layers(spark, d), "i32", no_data=0.0)}
    infos = [raster.raster_info(b, strict=True).select(F.lit(n).alias("name"), "band", "version", "bands", "depth", "dtype", "valid_pixels", "min_value", "max_value") for n, b in blobs.items()]
    return infos[0].unionByName(infos[1]).unionByName(infos[2])


@query("SELECT 0 AS damaged_pixels, 2::BIGINT AS errors, count(*) AS good_pixels FROM px", "sizes")
def damaged_blobs(spark, d):
    """A null and a damaged blob between good ones, read permissively: no pixels of theirs, an error each."""
    good = raster.encode_pixels(sizes(spark, d), "u8")
    bad = good.where("first_row = 0 AND first_col = 0").select("first_row", "first_col", F.explode(F.array(F.struct(F.lit("null").alias("raster_id"), F.lit(None).cast("binary").alias("blob")), F.struct(F.lit("cut").alias("raster_id"), F.expr("substring(blob, 1, 100)").alias("blob")))).alias("x")).select("x.raster_id", "first_row", "first_col", "x.blob")
    blobs = good.unionByName(bad)
    pixels = raster.decode_blobs(blobs, strict=False).agg(F.count(F.when(F.col("raster_id") != "part", 1)).cast("int").alias("damaged_pixels"), F.count("*").alias("good_pixels"))
    errors = raster.raster_info(blobs).agg(F.count("error").alias("errors"))
    return pixels.withColumn("one", F.lit(1)).join(errors.withColumn("one", F.lit(1)), "one").drop("one")


# Rules of the format.
@query("SELECT v AS version, CASE v WHEN 2 THEN 58 WHEN 3 THEN 62 WHEN 6 THEN 90 ELSE 66 END AS size FROM range(2, 7) t(v)")
def header_sizes(spark, d):
    return spark.range(2, 7).select(F.col("id").alias("version"), C.header_size(F.col("id")).alias("size"))


@query("SELECT code, ['i8', 'u8', 'i16', 'u16', 'i32', 'u32', 'f32', 'f64'][code + 1] AS dtype FROM range(8) t(code)")
def dtype_codes(spark, d):
    return spark.range(8).select(F.col("id").alias("code"), C.dtype_of(F.col("id").cast("int")).alias("dtype"))


@query(
    "SELECT depth, bands, n AS no_data, f AS float_lossless, CASE WHEN n OR f OR bands > 1 THEN 6 WHEN depth > 1 THEN 5 ELSE 3 END AS version FROM range(1, 4) a(depth), range(1, 4) b(bands), (VALUES (true), (false)) c(n), (VALUES (true), (false)) e(f)"
)
def version_choice(spark, d):
    cases = spark.range(36).select(
        (F.col("id") % 3 + 1).alias("depth"), (F.floor(F.col("id") / 3) % 3 + 1).alias("bands"), (F.floor(F.col("id") / 9) % 2 == 1).alias("no_data"), (F.floor(F.col("id") / 18) % 2 == 1).alias("float_lossless")
    )
    return cases.withColumn("version", C.blob_version(F.col("depth"), F.col("bands"), F.col("no_data"), F.col("float_lossless")))


ASKED = (0.0, 0.01, 0.4, 0.5, 0.9, 1.0, 2.7)


@query(" UNION ALL ".join(f"SELECT '{t}' AS dtype, {a!r}::DOUBLE AS asked, greatest(0.5, floor({a!r}))::DOUBLE AS tolerance" if C.is_integer(t) else f"SELECT '{t}', {a!r}::DOUBLE, {a!r}::DOUBLE" for t, *_ in C.TYPES for a in ASKED))
def tolerance_rules(spark, d):
    """The tolerance that headers hold for what is asked for: integers at least 0.5 and whole above."""
    return spark.createDataFrame([(t, a, C.normal_tolerance(a, t)) for t, *_ in C.TYPES for a in ASKED], "dtype string, asked double, tolerance double")
