"""Encoding and decoding of whole raster blobs: headers, masks, modes and tiles."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from rastrum.codec import huffman, planes, tiling
from rastrum.codec.bits import BadBlob, fletcher32, rle, take, unrle
from rastrum.codec.tiling import DTYPES, to_type

MAGIC = b"Lerc2 "
SIZES = {2: 58, 3: 62, 4: 66, 5: 66, 6: 90}
TILING, DELTA_HUFFMAN, PLAIN_HUFFMAN, FLOAT_PLANES = 0, 1, 2, 3
MAX_BANDS = 1 << 16


@dataclass
class Header:
    version: int
    rows: int
    cols: int
    depth: int
    valid: int
    block: int
    size: int
    dtype: int
    error: float
    low: float
    high: float
    more: int = 0
    pass_no_data: bool = False
    no_data: float = 0.0
    no_data_orig: float = 0.0
    checksum: int = 0


@dataclass
class Band:
    """values (rows, cols, depth), valid (rows, cols); what is invalid holds 0."""

    header: Header
    values: np.ndarray
    valid: np.ndarray


def read_header(data: bytes, at: int = 0) -> Header:
    if take(data, at, 6) != MAGIC:
        raise BadBlob("no magic")
    version = struct.unpack("<i", take(data, at + 6, 4))[0]
    if version not in SIZES:
        raise BadBlob(f"version {version}")
    raw, p = take(data, at, SIZES[version]), 10
    checksum = 0
    if version >= 3:
        checksum = struct.unpack_from("<I", raw, p)[0]
        p += 4
    rows, cols = struct.unpack_from("<2i", raw, p)
    p += 8
    depth = 1
    if version >= 4:
        depth = struct.unpack_from("<i", raw, p)[0]
        p += 4
    valid, block, size, dtype = struct.unpack_from("<4i", raw, p)
    p += 16
    more = flag = 0
    if version >= 6:
        more, flag = struct.unpack_from("<iB", raw, p)
        p += 8
    error, low, high = struct.unpack_from("<3d", raw, p)
    nd, orig = struct.unpack_from("<2d", raw, p + 24) if version >= 6 else (0.0, 0.0)
    if rows <= 0 or cols <= 0 or depth <= 0 or not 0 <= valid <= rows * cols or size < SIZES[version] or not 0 <= dtype < 8 or more < 0:
        raise BadBlob("header")
    return Header(version, rows, cols, depth, valid, block, size, dtype, error, low, high, more, bool(flag), nd, orig, checksum)


def write_header(h: Header) -> bytes:
    out = MAGIC + struct.pack("<i", h.version) + (struct.pack("<I", h.checksum) if h.version >= 3 else b"") + struct.pack("<2i", h.rows, h.cols)
    out += struct.pack("<i", h.depth) if h.version >= 4 else b""
    out += struct.pack("<4i", h.valid, h.block, h.size, h.dtype)
    if h.version >= 6:
        out += struct.pack("<i4B", h.more, h.pass_no_data, int(h.dtype < 6), 0, 0)
    out += struct.pack("<3d", h.error, h.low, h.high)
    return out + (struct.pack("<2d", h.no_data, h.no_data_orig) if h.version >= 6 else b"")


def split_bands(data: bytes) -> list[tuple[int, int]]:
    """(start, size) of each band's blob, from headers alone."""
    out, at = [], 0
    while at < len(data) and data[at : at + 6] == MAGIC and len(out) < MAX_BANDS:
        h = read_header(data, at)
        if at + h.size > len(data):
            raise BadBlob(f"blob of {h.size} bytes at {at}, {len(data) - at} left")
        out.append((at, h.size))
        at += h.size
        if h.version >= 6 and h.more == 0:
            break
    if not out:
        raise BadBlob("no magic")
    return out


def scan(data: bytes) -> list[Header]:
    """Headers of all bands, without decoding."""
    return [read_header(data, at) for at, _ in split_bands(data)]


def verify(data: bytes, h: Header) -> None:
    if h.version >= 3 and fletcher32(data[14 : h.size]) != h.checksum:
        raise BadBlob("checksum")


def _flag_byte(h: Header) -> bool:
    return (h.dtype <= 1 and h.error == 0.5) or (h.dtype >= 6 and h.version >= 6 and h.error == 0)


def decode_band(data: bytes, before: np.ndarray | None = None) -> Band:
    """One band's blob; before: the mask of the band before, which a band may use again."""
    h = read_header(data)
    data = take(data, 0, h.size)
    verify(data, h)
    dtype, n = np.dtype(DTYPES[h.dtype]), h.rows * h.cols
    at = SIZES[h.version]
    size = struct.unpack("<i", take(data, at, 4))[0]
    at += 4
    if h.valid in (0, n):
        valid = np.full(n, h.valid == n)
        at += max(0, size)
    elif size <= 0:
        if before is None or before.size != n:
            raise BadBlob("no mask to use again")
        valid = before.ravel()
    else:
        valid = np.unpackbits(np.frombuffer(unrle(take(data, at, size), (n + 7) // 8), np.uint8))[:n].astype(bool)
        at += size
    out = np.zeros((n, h.depth), dtype)
    band = lambda: Band(h, out.reshape(h.rows, h.cols, h.depth), valid.reshape(h.rows, h.cols))
    if not h.valid:
        return band()
    if h.low == h.high:
        out[valid] = to_type(np.array(h.low), dtype)
        return _remap(band())
    highs = np.full(h.depth, h.high)
    if h.version >= 4:
        width = dtype.itemsize * h.depth
        lows = np.frombuffer(take(data, at, width), dtype.newbyteorder("<")).astype(np.float64)
        highs = np.frombuffer(take(data, at + width, width), dtype.newbyteorder("<")).astype(np.float64)
        at += 2 * width
        if (lows == highs).all():
            out[valid] = to_type(lows, dtype)
            return _remap(band())
    sweep = take(data, at, 1)[0]
    at += 1
    if sweep:
        count = int(valid.sum()) * h.depth
        out[valid] = np.frombuffer(take(data, at, count * dtype.itemsize), dtype.newbyteorder("<")).reshape(-1, h.depth)
        return _remap(band())
    mode = TILING
    if _flag_byte(h):
        mode = take(data, at, 1)[0]
        at += 1
    if mode in (DELTA_HUFFMAN, PLAIN_HUFFMAN) and h.dtype <= 1 and (mode == DELTA_HUFFMAN or h.version >= 4):
        got, _ = huffman.decode(data, at, int(valid.sum()) * h.depth, h.version)
        got = got - (128 if h.dtype == 0 else 0)
        if mode == PLAIN_HUFFMAN:
            out[valid] = got.reshape(-1, h.depth).astype(dtype)
        else:
            for d, g in enumerate(got.reshape(h.depth, -1)):
                out[:, d] = _undelta(g, valid.reshape(h.rows, h.cols)).astype(np.uint8).view(dtype).ravel()
    elif mode == FLOAT_PLANES and h.dtype >= 6:
        for d in range(h.depth):
            got, at = planes.decode_slice(data, at, (h.rows, h.cols), h.dtype == 7)
            out[:, d] = got.ravel()
        out[~valid] = 0
    elif mode == TILING:
        shape = (h.rows, h.cols, h.depth)
        out = tiling.read_tiles(data, at, shape, h.dtype, h.error, h.version, h.block, valid.reshape(h.rows, h.cols), highs).reshape(n, h.depth)
    else:
        raise BadBlob(f"mode {mode}")
    return _remap(band())


def _remap(b: Band) -> Band:
    if b.header.pass_no_data:
        dtype = b.values.dtype
        own, orig = to_type(np.array(b.header.no_data), dtype), to_type(np.array(b.header.no_data_orig), dtype)
        b.values[b.valid[:, :, None] & (b.values == own)] = orig
    return b


def delta(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Of 8-bit values, modulo 256: to the left neighbour if valid, else the one above if valid, else the last valid."""
    v = values.astype(np.int64)
    left, above = np.zeros_like(v), np.zeros_like(v)
    left[:, 1:], above[1:] = v[:, :-1], v[:-1]
    has_left, has_above = np.zeros_like(valid), np.zeros_like(valid)
    has_left[:, 1:], has_above[1:] = valid[:, :-1], valid[:-1]
    seq = v[valid]
    last = np.zeros_like(v)
    last[valid] = np.r_[0, seq[:-1]]
    base = np.where(has_left, left, np.where(has_above, above, last))
    return (v - base)[valid] & 255


def _undelta(deltas: np.ndarray, valid: np.ndarray) -> np.ndarray:
    rows, cols = valid.shape
    if valid.all():
        d = deltas.reshape(rows, cols).copy()
        d[:, 0] = np.cumsum(d[:, 0])
        return np.cumsum(d, axis=1) & 255
    out, last, at = np.zeros((rows, cols), np.int64), 0, 0
    for r in range(rows):
        ok = valid[r]
        places = np.flatnonzero(ok)
        if not len(places):
            continue
        sums = np.cumsum(deltas[at : at + len(places)])
        at += len(places)
        # Runs of valid places: the first of each counts from the place above or else from the last valid one.
        first = np.flatnonzero(np.r_[True, np.diff(places) > 1])
        ends = np.r_[first[1:], len(places)] - 1
        above = np.where(valid[r - 1, places[first]], out[r - 1, places[first]], -1).tolist() if r else [-1] * len(first)
        before = np.r_[0, sums[ends[:-1]]].tolist()
        shift = []
        for base, begun, end in zip(above, before, sums[ends].tolist()):
            shift.append((last if base < 0 else base) - begun)
            last = (end + shift[-1]) & 255
        out[r, places] = (sums + np.repeat(shift, ends - first + 1)) & 255
    return out


def no_data_sentinel(low: float, error: float, dtype: int, no_data: float) -> float:
    """A value below all others by more than two tolerances; the given one if it is already."""
    limit = low - 2 * error
    if no_data < limit:
        return no_data
    if dtype < 6:
        least = np.iinfo(DTYPES[dtype]).min
        for step in (1, 10, 100, 1000):
            if least <= (x := np.floor(limit) - step):
                return float(x)
    else:
        for step in (1, 10, 100, 1000, 1e4, 1e6, 1e9):
            x = float(np.array(limit - step).astype(DTYPES[dtype]))
            if np.isfinite(x) and x < limit:
                return x
    raise ValueError("no value is left below the data for missing ones")


def encode_band(values: np.ndarray, valid: np.ndarray, error: float, more: int = 0, many: bool = False, no_data: float | None = None) -> bytes:
    """error: 0.5 is lossless for integers, 0 for floats. values (rows, cols, depth) in the type to write."""
    rows, cols, depth = values.shape
    code = DTYPES.index(values.dtype.name)
    v = values[valid]
    float_lossless = code >= 6 and error == 0
    sentinel = None
    if no_data is not None and depth > 1:
        missing = v == np.array(no_data).astype(values.dtype)
        if missing.any() and not missing.all():
            sentinel = no_data_sentinel(float(v[~missing].min()), error, code, float(no_data))
            values = values.copy()
            values[valid[:, :, None] & (values == np.array(no_data).astype(values.dtype))] = sentinel
            v = values[valid]
    if v.size and code >= 6 and np.isnan(v).any():
        raise ValueError("NaN is not a pixel value; mark the pixel invalid")
    lows = v.min(axis=0) if len(v) else np.zeros(depth)
    highs = v.max(axis=0) if len(v) else np.zeros(depth)
    version = 6 if sentinel is not None or many or float_lossless else 5 if depth > 1 else 3
    h = Header(version, rows, cols, depth, int(valid.sum()), 8, 0, code, error, float(lows.min()), float(highs.max()), more)
    if sentinel is not None:
        h.pass_no_data, h.no_data, h.no_data_orig = True, sentinel, float(no_data)
    n = rows * cols
    mask = rle(np.packbits(valid.ravel()).tobytes()) if 0 < h.valid < n else b""
    body = struct.pack("<i", len(mask)) + mask
    # Positive and negative zero compare equal but are not the same bits.
    zeros = code >= 6 and len(v) and h.low == h.high == 0 and len(np.unique(np.signbit(v))) > 1
    if h.valid and (h.low != h.high or zeros and float_lossless):
        if zeros:
            h.high = float(np.finfo(values.dtype).tiny)
        if version >= 4:
            typed = values.dtype.newbyteorder("<")
            top = np.full(depth, h.high) if zeros else highs
            body += np.asarray(lows).astype(typed).tobytes() + np.asarray(top).astype(typed).tobytes()
        signs = float_lossless and any(lo == hi == 0 for lo, hi in zip(lows, highs))
        if version < 4 or not (lows == highs).all() or zeros or signs:
            body += b"\0" + _payload(values, valid, h)
    h.size = SIZES[version] + len(body)
    blob = bytearray(write_header(h) + body)
    struct.pack_into("<I", blob, 10, fletcher32(bytes(blob[14:])))
    return bytes(blob)


def _payload(values: np.ndarray, valid: np.ndarray, h: Header) -> bytes:
    if h.dtype >= 6 and h.error == 0:
        filled = np.where(valid[:, :, None], values, values.dtype.type(0))
        return bytes([FLOAT_PLANES]) + b"".join(planes.encode_slice(np.ascontiguousarray(filled[:, :, d])) for d in range(h.depth))
    tiles = lambda block, measure=False: tiling.write_tiles(values, valid, h.dtype, h.error, h.version, block, measure)
    best, h.block = tiles(8), 8
    if tiles(16, True) < len(best):
        best, h.block = tiles(16), 16
    if not _flag_byte(h):
        return best
    best = bytes([TILING]) + best
    bias = 128 if h.dtype == 0 else 0
    steps = np.concatenate([delta(values[:, :, d], valid) for d in range(h.depth)])
    steps = (steps + bias) & 255 if not bias else (((steps + 128) & 255) - 128 + bias)
    coded = [(huffman.encode(steps), DELTA_HUFFMAN)]
    if h.version >= 4:
        coded.append((huffman.encode(values[valid].ravel().astype(np.int64) + bias), PLAIN_HUFFMAN))
    for data, mode in coded:
        if data is not None and len(data) + 1 < len(best):
            best = bytes([mode]) + data
    return best


def encode(bands: list[tuple[np.ndarray, np.ndarray]], errors: list[float], no_data: float | None = None) -> bytes:
    """One string of a blob for each band."""
    k = len(bands)
    return b"".join(encode_band(v, m, e, k - 1 - i, k > 1, no_data) for i, ((v, m), e) in enumerate(zip(bands, errors)))


def decode(data: bytes) -> list[Band]:
    """All bands of a blob in this format."""
    out: list[Band] = []
    for at, size in split_bands(data):
        out.append(decode_band(data[at : at + size], out[-1].valid if out else None))
    return out
