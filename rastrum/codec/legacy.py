"""The older blob format: one band of float32 with a count section (validity) and a value section."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from rastrum.codec.bits import BadBlob, take, unpack_high_first, unrle

MAGIC = b"CntZImage "
VERSION, KIND, MOST = 11, 8, 20000
_WIDTHS = {0: "<f4", 1: "<i2", 2: "<i1"}
_COUNTS = {0: "<u4", 1: "<u2", 2: "<u1"}


@dataclass
class Info:
    rows: int
    cols: int
    error: float
    high: float


class _Bytes:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def get(self, form: str) -> tuple:
        raw = take(self.data, self.at, struct.calcsize(form))
        self.at += len(raw)
        return struct.unpack(form, raw)

    def many(self, n: int, kind: str) -> np.ndarray:
        raw = take(self.data, self.at, n * np.dtype(kind).itemsize)
        self.at += len(raw)
        return np.frombuffer(raw, kind)

    def block(self, most: int) -> np.ndarray:
        head = self.get("<B")[0]
        bits, code = head & 63, head >> 6
        if code not in _COUNTS or bits > 31:
            raise BadBlob("block")
        n = int(self.many(1, _COUNTS[code])[0])
        if n > most:
            raise BadBlob("too many elements")
        return unpack_high_first(self.many((n * bits + 7) // 8, "<u1").tobytes(), n, bits)


def is_legacy(data: bytes) -> bool:
    return data[: len(MAGIC)] == MAGIC


def _header(b: _Bytes) -> tuple[int, int, float]:
    take(b.data, 0, len(MAGIC))
    b.at = len(MAGIC)
    version, kind, rows, cols = b.get("<4i")
    error = b.get("<d")[0]
    if version != VERSION or kind != KIND or not 0 < rows <= MOST or not 0 < cols <= MOST:
        raise BadBlob("header")
    return rows, cols, error


def info(data: bytes) -> Info:
    """Size, tolerance and largest value; sections are skipped, not decoded."""
    b = _Bytes(data)
    rows, cols, error = _header(b)
    *_, size, _ = b.get("<3if")
    b.at += size
    return Info(rows, cols, error, b.get("<3if")[3])


def _spans(n: int, tiles: int):
    """Tiles of equal size and a last one of what remains."""
    size = n // tiles
    return [slice(i * size, min(n, (i + 1) * size)) for i in range(tiles)] + ([slice(tiles * size, n)] if tiles * size < n else [])


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(values, valid), both (rows, cols)."""
    b = _Bytes(data)
    rows, cols, error = _header(b)
    down, across, size, high = b.get("<3if")
    end = b.at + size
    if size < 0 or down < 0 or across < 0:
        raise BadBlob("section")
    count = np.zeros((rows, cols), np.float32)
    whole = False
    if not down and not across:
        if size:
            count = np.unpackbits(np.frombuffer(unrle(take(data, b.at, size), (rows * cols + 7) // 8), np.uint8))[: rows * cols].reshape(rows, cols).astype(np.float32)
        else:
            count[:] = high
            whole = high > 0
    elif not down or not across:
        raise BadBlob("section")
    else:
        for r in _spans(rows, down):
            for c in _spans(cols, across):
                flag = b.get("<B")[0]
                tile = count[r, c]
                if flag in (2, 3, 4):
                    tile[:] = {2: 0, 3: -1, 4: 1}[flag]
                elif flag == 0:
                    tile[:] = b.many(tile.size, "<f4").reshape(tile.shape)
                elif flag & 63 == 1:
                    if flag >> 6 not in _WIDTHS:
                        raise BadBlob("offset")
                    offset = float(b.many(1, _WIDTHS[flag >> 6])[0])
                    q = b.block(tile.size)
                    if len(q) < tile.size:
                        raise BadBlob("tile size")
                    tile[:] = offset + q.reshape(tile.shape)
                else:
                    raise BadBlob("count tile")
    b.at = end
    valid = count > 0
    values = np.zeros((rows, cols), np.float32)
    down, across, size, high = b.get("<3if")
    if size < 0 or (down == 0) != (across == 0) or down < 0:
        raise BadBlob("section")
    if not down:
        values[valid] = high
        return values, valid
    for r in _spans(rows, down):
        for c in _spans(cols, across):
            flag = b.get("<B")[0]
            tile, ok = values[r, c], valid[r, c]
            mode = flag & 63
            if mode == 2:
                continue
            if mode == 0:
                tile[ok] = b.many(int(ok.sum()), "<f4")
                continue
            if mode not in (1, 3) or flag >> 6 not in _WIDTHS:
                raise BadBlob("value tile")
            offset = float(b.many(1, _WIDTHS[flag >> 6])[0])
            if mode == 3:
                tile[ok] = offset
                continue
            q = b.block(tile.size)
            n = tile.size if whole else int(ok.sum())
            if len(q) < n:
                raise BadBlob("tile size")
            got = np.minimum((offset + q[:n] * (2 * error)).astype(np.float32), np.float32(high))
            if whole:
                tile[:] = got.reshape(tile.shape)
            else:
                tile[ok] = got
    return values, valid
