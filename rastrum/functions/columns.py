"""Column expressions of the raster model: casts, bit counts, costs and format rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, width in bytes, least and largest value, by type code; floats have no bounds here.
TYPES = (
    ("i8", 1, -128, 127), ("u8", 1, 0, 255), ("i16", 2, -32768, 32767), ("u16", 2, 0, 65535),
    ("i32", 4, -(2**31), 2**31 - 1), ("u32", 4, 0, 2**32 - 1), ("f32", 4, None, None), ("f64", 8, None, None),
)
CODE = {name: i for i, (name, *_) in enumerate(TYPES)}
NUMPY = {"i8": "int8", "u8": "uint8", "i16": "int16", "u16": "uint16", "i32": "int32", "u32": "uint32", "f32": "float32", "f64": "float64"}


def is_integer(dtype: str) -> bool:
    return CODE[dtype] < 6


def is_signed(dtype: str) -> bool:
    return dtype not in ("u8", "u16", "u32")


def max_quant(dtype: str) -> int:
    """The largest quantised value of a tile."""
    return 2**15 - 1 if CODE[dtype] < 4 else 2**30 - 1


def sat_cast(x: Column, dtype: str) -> Column:
    """A DOUBLE as the type would hold it: truncated, held within its bounds, NaN as 0. Floats pass as they are."""
    if not is_integer(dtype):
        return x.cast("float").cast("double") if dtype == "f32" else x
    _, _, low, high = TYPES[CODE[dtype]]
    return F.when(F.isnan(x), 0.0).otherwise(F.signum(x) * F.floor(F.abs(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))))


def wrap8(x: Column) -> Column:
    return F.pmod(x, F.lit(256))


def bit_length(x: Column) -> Column:
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x.cast("bigint"))))


def count_width(n: Column) -> Column:
    """Bytes of a block's count."""
    return F.when(n < 256, 1).when(n < 65536, 2).otherwise(4)


def block_cost(n: Column, top: Column, distinct: Column) -> Column:
    """Bytes of a bit-stuffed block of n values up to `top`: plain, or by a table of the distinct ones if smaller."""
    bits = bit_length(top)
    head = 1 + count_width(n)
    plain = head + F.ceil(n * bits / 8)
    table = head + 1 + F.ceil((distinct - 1) * bits / 8) + F.ceil(n * bit_length(distinct - 1) / 8)
    return F.when((distinct >= 2) & (distinct <= 255) & (table < plain), table).otherwise(plain).cast("bigint")


def reduced_width(x: Column, dtype: str) -> Column:
    """Bytes of the smallest type that holds a tile's offset."""
    whole, width = x == F.floor(x), TYPES[CODE[dtype]][1]
    fits = lambda t: whole & x.between(float(TYPES[CODE[t]][2]), float(TYPES[CODE[t]][3]))
    chains = {
        "i16": [("i8", 1), ("u8", 1)], "u16": [("u8", 1)], "i32": [("u8", 1), ("i16", 2), ("u16", 2)], "u32": [("u8", 1), ("u16", 2)],
        "f32": [("u8", 1), ("i16", 2)], "f64": [("i16", 2), ("i32", 4)],
    }.get(dtype, [])
    out = F.lit(width)
    if dtype == "f64":
        out = F.when(x.cast("float").cast("double") == x, 4).otherwise(out)
    for t, w in reversed(chains):
        out = F.when(fits(t), w).otherwise(out)
    return out


def integrity_bits(first_column: Column, version: int) -> Column:
    """The tile flag's check bits, from the tile's first column."""
    return F.shiftleft(F.shiftright(F.pmod(first_column, F.lit(256)), 3).bitwiseAND(F.lit(14 if version >= 5 else 15)), 2)


def header_size(version: Column) -> Column:
    return F.when(version == 2, 58).when(version == 3, 62).when(version.isin(4, 5), 66).when(version == 6, 90)


def blob_version(depth: Column, bands: Column, has_no_data: Column, float_lossless: Column) -> Column:
    return F.when(has_no_data | (bands > 1) | float_lossless, 6).when(depth > 1, 5).otherwise(3)


def dtype_of(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t[0]) for t in TYPES]), code + 1)


def normal_tolerance(tolerance: float, dtype: str) -> float:
    """What is asked for, as the format holds it: integers at least 0.5 and whole above, floats at least 0."""
    if is_integer(dtype):
        return max(float(int(tolerance)) if tolerance > 0 else 0.0, 0.5)
    return max(tolerance, 0.0)
