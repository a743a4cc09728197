"""Statistics of bands, depths and histograms; each is one partial and one final aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrum.operators.grid import KEY, PLACE


def number(value: str = "value") -> Column:
    """The value if it is one; NaN counts for nothing."""
    return F.when(~F.isnan(value), F.col(value))


def _range(extra: list[str]) -> list[Column]:
    v = number()
    return [F.coalesce(F.min(v), F.lit(0.0)).alias("min_value"), F.coalesce(F.max(v), F.lit(0.0)).alias("max_value"), F.count("value").alias("valid"), F.count("*").alias("places")]


def band_stats(pixels: DataFrame) -> DataFrame:
    """min_value, max_value (0 without valid places), valid and places of each band."""
    return pixels.groupBy(*KEY).agg(*_range([]))


def depth_stats(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*KEY, "depth").agg(*_range(["depth"]))


def valid_counts(pixels: DataFrame) -> DataFrame:
    per = pixels.where("depth = 0").groupBy(*KEY).agg(F.count("value").alias("valid"), F.count("*").alias("places"))
    return per.withColumn("all_valid", F.col("valid") == F.col("places"))


def nodata_stats(pixels: DataFrame, no_data: float) -> DataFrame:
    """mixed: whether some place is missing at some depths only; the range of what is not missing."""
    missing = F.col("value") == no_data
    per = pixels.where("value IS NOT NULL").groupBy(*PLACE).agg(
        F.sum(F.when(missing, 1).otherwise(0)).alias("m"), F.count("*").alias("n"), F.min(F.when(~missing, number())).alias("low"), F.max(F.when(~missing, number())).alias("high")
    )
    return per.groupBy(*KEY).agg(F.bool_or((F.col("m") > 0) & (F.col("m") < F.col("n"))).alias("mixed"), F.min("low").alias("low"), F.max("high").alias("high"))


def histogram(rows: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(*(keys if keys is not None else KEY), F.col(column).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def entropy(hist: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """bits: per symbol; bytes: of all symbols, as an ideal coder would need."""
    total, n = F.sum("n"), F.col("n")
    bits = F.log2(total) - F.sum(n * F.log2(n)) / total  # -sum(n / total * log2(n / total)), in one aggregate
    out = hist.groupBy(*(keys if keys is not None else KEY)).agg(bits.alias("bits"), total.alias("total"))
    return out.withColumn("bytes", F.floor((F.col("bits") * F.col("total") + 7) / 8))


def sampled_entropy(rows: DataFrame, place: str, column: str, stride: int = 7) -> DataFrame:
    """entropy() of every stride-th byte."""
    return entropy(histogram(rows.where(F.pmod(F.col(place), F.lit(stride)) == 0), column))


def high_entropy(direct: DataFrame, deltas: DataFrame) -> DataFrame:
    """Bands whose bytes are close to uniform, where entropy coding is not worth a try."""
    a = direct.groupBy(*KEY).agg(F.count("*").alias("bins"), F.max("n").alias("top"), F.sum("n").alias("total"))
    b = deltas.groupBy(*KEY).agg(F.count("*").alias("delta_bins"))
    flat = (F.col("bins") >= 248) & (F.col("top") * 256 < 2 * F.col("total")) & (F.col("delta_bins") >= 64)
    return a.join(b, KEY).select(*KEY, "bins", "delta_bins", flat.alias("high_entropy"))


def bit_plane_counts(diffs: DataFrame, bits: int, column: str = "diff") -> DataFrame:
    """How many XOR differences have each bit set; n of them."""
    x = F.col(column).cast("bigint")
    one = diffs.where(x.isNotNull()).groupBy(*KEY).agg(F.count("*").alias("n"), *[F.sum(F.getbit(x, F.lit(b)).cast("bigint")).alias(f"b{b}") for b in range(bits)])
    pairs = F.array(*[F.struct(F.lit(b).alias("bit"), F.col(f"b{b}").alias("ones")) for b in range(bits)])
    return one.select(*KEY, "n", F.inline(pairs))


def fletcher32(words: DataFrame, keys: list[str], n: Column | None = None) -> DataFrame:
    """Checksums of sequences of 16-bit words: `i` from 0 and `w`; the length is the number of rows."""
    fold = lambda x: F.when(F.pmod(x, m) == 0, m).otherwise(F.pmod(x, m))
    m, w = F.lit(65535).cast("bigint"), F.col("w").cast("bigint")
    # A word counts as often as there are words from it on: n - i times, which is one aggregate and no second pass for n.
    per = words.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("a"), F.sum(F.pmod(F.col("i").cast("bigint"), m) * w).alias("b"))
    b = F.pmod(F.col("n"), m) * F.pmod(F.col("a"), m) - F.pmod(F.col("b"), m)
    return per.select(*keys, (fold(b) * 65536 + fold(F.col("a"))).cast("bigint").alias("checksum"))
