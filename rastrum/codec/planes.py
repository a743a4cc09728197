"""Lossless floats: predictors on the fields of a float's bits, split into byte planes that are coded one by one."""

from __future__ import annotations

import math
import struct

import numpy as np

from rastrum.codec import huffman
from rastrum.codec.bits import BadBlob, take

NONE, ROWS, ROWS_COLUMNS = 0, 1, 2
HUFFMAN, CONSTANT, RAW, PACKED = 0, 1, 2, 3
MAX_LEVEL = 5
#: Bytes of a plane on which levels and predictors are tried, and the evenly spaced blocks that they are taken in.
SNIPPET, BLOCKS = 8192, 4


def _fields(bits: np.ndarray, op) -> np.ndarray:
    """op on the lower (mantissa) field and on the upper field of each word, wrapping within the field."""
    low = bits.dtype.type((1 << (23 if bits.dtype.itemsize == 4 else 52)) - 1)
    return (op(bits & low) & low) | (op(bits & ~low) & ~low)


def difference(bits: np.ndarray, axis: int) -> np.ndarray:
    def op(x: np.ndarray) -> np.ndarray:
        out = x.copy()
        if axis == 1:
            out[:, 1:] -= x[:, :-1]
        else:
            out[1:] -= x[:-1]
        return out

    return _fields(bits, op)


def running(bits: np.ndarray, axis: int) -> np.ndarray:
    return _fields(bits, lambda x: np.cumsum(x, axis=axis, dtype=x.dtype))


def to_bits(values: np.ndarray) -> np.ndarray:
    """float32 with the sign between mantissa and exponent; float64 as it is."""
    if values.dtype == np.float64:
        return values.view(np.uint64).copy()
    b = values.astype(np.float32).view(np.uint32)
    return (b & 0x7FFFFF) | (b >> 31 << 23) | ((b >> 23 & 0xFF) << 24)


def from_bits(b: np.ndarray) -> np.ndarray:
    if b.dtype == np.uint64:
        return b.view(np.float64)
    return ((b & 0x7FFFFF) | (b >> 23 & 1) << 31 | (b >> 24) << 23).astype(np.uint32).view(np.float32)


def predict(bits: np.ndarray, predictor: int) -> np.ndarray:
    if predictor >= ROWS:
        bits = difference(bits, 1)
    return difference(bits, 0) if predictor == ROWS_COLUMNS else bits


def unpredict(bits: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == ROWS_COLUMNS:
        bits = running(bits, 0)
    return running(bits, 1) if predictor >= ROWS else bits


def level_delta(plane: np.ndarray, level: int) -> np.ndarray:
    for k in range(1, level + 1):
        out = plane.copy()
        out[k:] -= plane[k - 1 : -1] if k <= len(plane) - 1 else plane[:0]
        plane = out
    return plane


def level_restore(plane: np.ndarray, level: int) -> np.ndarray:
    for k in range(level, 0, -1):
        out = plane.copy()
        if k - 1 < len(plane):
            out[k - 1 :] = np.cumsum(plane[k - 1 :], dtype=np.uint8)
        plane = out
    return plane


def entropy_bytes(plane: np.ndarray) -> float:
    c = np.bincount(plane, minlength=256)
    c = c[c > 0]
    return float((c * np.log2(len(plane) / c)).sum() / 8) if len(plane) else 0.0


def _packbits(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            piece = literal[i : i + 128]
            out.extend(bytes([len(piece) - 1]) + piece)
        literal.clear()

    for s, n in zip(starts.tolist(), np.diff(np.r_[starts, len(a)]).tolist()):
        if n < 3:
            literal += data[s : s + n]
            continue
        flush()
        while n:
            k = min(n, 129)
            if k == 1:
                literal.append(data[s])
            else:
                out.extend(bytes([126 + k, data[s]]))
            n -= k
    flush()
    return bytes(out)


def _unpackbits(data: bytes, n: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < n:
        b = take(data, at, 1)[0]
        if b <= 127:
            out += take(data, at + 1, b + 1)
            at += b + 2
        else:
            out += take(data, at + 1, 1) * (b - 126)
            at += 2
    if len(out) != n:
        raise BadBlob("packed plane")
    return bytes(out)


def compress(plane: np.ndarray) -> bytes:
    data = plane.tobytes()
    if len(data) and data.count(data[:1]) == len(data):
        return bytes([CONSTANT, data[0]]) + struct.pack("<I", len(data))
    best = bytes([RAW]) + data
    if entropy_bytes(plane) + 1 < len(best):
        coded = huffman.encode(plane.astype(np.int64))
        if coded is not None and len(coded) + 1 < len(best):
            best = bytes([HUFFMAN]) + coded
    # Runs of three and more take two bytes each, at least; other bytes are literals.
    runs = np.diff(np.flatnonzero(np.r_[True, plane[1:] != plane[:-1], True]))
    if 1 + runs[runs < 3].sum() + 2 * (-(-runs[runs >= 3] // 129)).sum() <= len(best):
        packed = bytes([PACKED]) + _packbits(data)
        best = packed if len(packed) < len(data) + 1 and len(packed) <= len(best) else best
    return best


def expand(data: bytes, n: int) -> np.ndarray:
    mode, rest = take(data, 0, 1)[0], data[1:]
    if mode == CONSTANT:
        value, count = struct.unpack("<BI", take(rest, 0, 5))
        if count != n:
            raise BadBlob("constant plane")
        return np.full(n, value, np.uint8)
    if mode == RAW:
        return np.frombuffer(take(rest, 0, n), np.uint8)
    if mode == PACKED:
        return np.frombuffer(_unpackbits(rest, n), np.uint8)
    if mode == HUFFMAN:
        return huffman.decode(rest, 0, n, 6)[0].astype(np.uint8)
    raise BadBlob("plane mode")


def _planes(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bits.reshape(-1, 1).view(np.uint8).T)


def sample_blocks(n: int, unit: int = 1) -> list[slice]:
    """Evenly spaced blocks of about SNIPPET units among n * unit, in whole multiples of unit; everything if that is little more."""
    each = max(1, math.ceil(SNIPPET / BLOCKS / max(1, unit)))
    if n <= BLOCKS * each:
        return [slice(0, n)]
    return [slice(at, at + each) for at in (round(k * (n - each) / (BLOCKS - 1)) for k in range(BLOCKS))]


def encode_slice(values: np.ndarray) -> bytes:
    """One depth, (rows, columns) of float32 or float64."""
    bits = to_bits(np.ascontiguousarray(values))
    rows = sample_blocks(bits.shape[0], bits.shape[1])
    cost = lambda k: sum(entropy_bytes(p) for s in rows for p in _planes(np.ascontiguousarray(predict(bits[s], k))))
    predictor = min((cost(k), k) for k in (NONE, ROWS, ROWS_COLUMNS))[1]
    out = [bytes([predictor])]
    for i, plane in enumerate(_planes(np.ascontiguousarray(predict(bits, predictor)))):
        some = sample_blocks(len(plane))
        tried = lambda k: sum(entropy_bytes(level_delta(plane[s], k)) for s in some)
        level, size = 0, tried(0)
        while level < MAX_LEVEL - predictor and (less := tried(level + 1)) < size:
            level, size = level + 1, less
        coded = compress(level_delta(plane, level))
        out.append(struct.pack("<BBI", i, level, len(coded)) + coded)
    return b"".join(out)


def decode_slice(data: bytes, at: int, shape: tuple[int, int], double: bool) -> tuple[np.ndarray, int]:
    n, width = shape[0] * shape[1], 8 if double else 4
    predictor = take(data, at, 1)[0]
    if predictor > ROWS_COLUMNS:
        raise BadBlob("predictor")
    at += 1
    planes = np.zeros((n, width), np.uint8)
    for _ in range(width):
        i, level, size = struct.unpack("<BBI", take(data, at, 6))
        if i >= width or level > MAX_LEVEL:
            raise BadBlob("byte plane")
        planes[:, i] = level_restore(expand(take(data, at + 6, size), n), level)
        at += 6 + size
    bits = planes.view(np.uint64 if double else np.uint32).reshape(shape)
    return from_bits(np.ascontiguousarray(unpredict(bits, predictor))), at
