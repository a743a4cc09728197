"""Blobs in forms that the writer does not make: one sweep, version 2, and the older format. For tests and queries of the reader."""

from __future__ import annotations

import struct

import numpy as np

from rastrum.codec import legacy
from rastrum.codec.bits import bit_length, fletcher32, rle
from rastrum.codec.blob import DTYPES, SIZES, TILING, Header, write_header
from rastrum.codec.tiling import STUFFED_TILE, ZERO_TILE


def pack_high_first(values: np.ndarray, bits: int) -> bytes:
    """The older layout: highest bit first in little-endian words, of the last word only the upper bytes in use."""
    if not bits or not len(values):
        return b""
    flags = (np.asarray(values, np.uint64)[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    used = (len(values) * bits + 7) // 8
    packed = np.packbits(flags.astype(np.uint8).ravel()).tobytes()
    words = np.frombuffer(packed + b"\0" * (-len(packed) % 4), ">u4").astype("<u4").tobytes()
    rest = used % 4
    return words if not rest else words[:-4] + words[len(words) - rest :]


def _block(q: np.ndarray) -> bytes:
    bits = bit_length(int(q.max(initial=0)))
    return struct.pack("<BH", bits | 1 << 6, len(q)) + pack_high_first(q, bits)


def _finished(h: Header, body: bytes) -> bytes:
    h.size = SIZES[h.version] + len(body)
    out = bytearray(write_header(h) + body)
    if h.version >= 3:
        struct.pack_into("<I", out, 10, fletcher32(bytes(out[14:])))
    return bytes(out)


def _begun(values: np.ndarray, valid: np.ndarray, version: int, error: float) -> tuple[Header, bytes]:
    rows, cols, depth = values.shape
    v = values[valid]
    low, high = (float(v.min()), float(v.max())) if len(v) else (0.0, 0.0)
    h = Header(version, rows, cols, depth, int(valid.sum()), 8, 0, DTYPES.index(values.dtype.name), error, low, high)
    mask = b"" if valid.all() else rle(np.packbits(valid.ravel()).tobytes())
    return h, struct.pack("<i", len(mask)) + mask


def one_sweep(values: np.ndarray, valid: np.ndarray, version: int = 4) -> bytes:
    """(rows, cols, depth): valid values as they stand."""
    h, body = _begun(values, valid, version, 0.5 if values.dtype.kind != "f" else 0.0)
    typed, v = values.dtype.newbyteorder("<"), values[valid]
    if version >= 4 and len(v):
        body += v.min(axis=0).astype(typed).tobytes() + v.max(axis=0).astype(typed).tobytes()
    return _finished(h, body + b"\1" + v.astype(typed).tobytes())


def version_2(values: np.ndarray, valid: np.ndarray) -> bytes:
    """8-bit values (rows, cols, 1) in tiles that are stuffed in the older layout."""
    h, body = _begun(values, valid, 2, 0.5)
    body += b"\0" + bytes([TILING])
    for r in range(0, h.rows, 8):
        for c in range(0, h.cols, 8):
            v = values[r : r + 8, c : c + 8, 0][valid[r : r + 8, c : c + 8]].astype(np.int64)
            flag = (((c & 255) >> 3) & 15) << 2
            body += bytes([flag | STUFFED_TILE, v.min()]) + _block(v - v.min()) if len(v) and v.any() else bytes([flag | ZERO_TILE])
    return _finished(h, body)


def older(values: np.ndarray, valid: np.ndarray, error: float) -> bytes:
    """Values (rows, cols) in the older format, validity as tiles of counts and values as tiles of steps of two tolerances."""
    rows, cols = values.shape
    down, across = max(1, rows // 8), max(1, cols // 8)
    tiles = [(r, c) for r in legacy._spans(rows, down) for c in legacy._spans(cols, across)]
    counts, steps = b"", b""
    for r, c in tiles:
        ok, v = valid[r, c], values[r, c][valid[r, c]].astype(np.float64)
        if ok.all() or not ok.any():
            counts += bytes([4 if ok.all() else 2])
        else:
            counts += bytes([1 | 2 << 6, 0]) + _block(ok.ravel().astype(np.int64))
        if not len(v):
            steps += bytes([2])
        elif v.min() == v.max():
            steps += bytes([3]) + struct.pack("<f", v.min())
        else:
            steps += bytes([1]) + struct.pack("<f", v.min()) + _block(np.floor((v - v.min()) / (2 * error) + 0.5).astype(np.int64))
    head = legacy.MAGIC + struct.pack("<4id", legacy.VERSION, legacy.KIND, rows, cols, error)
    top = float(values[valid].max(initial=0))
    return head + struct.pack("<3if", down, across, len(counts), 1.0) + counts + struct.pack("<3if", down, across, len(steps), top) + steps
