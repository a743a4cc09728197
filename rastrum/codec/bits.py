"""Bit packing, bit-stuffed blocks, run lengths and the checksum of raster blobs."""

from __future__ import annotations

import struct

import numpy as np


class BadBlob(ValueError):
    """Bytes that are not a raster blob, or a damaged one."""


def take(data: bytes, at: int, n: int) -> bytes:
    if n < 0 or at + n > len(data):
        raise BadBlob(f"{n} bytes needed at {at}, {len(data) - at} left")
    return data[at : at + n]


def pack(values: np.ndarray, bits: int) -> bytes:
    """Lowest bit first, as many bytes as the bits need."""
    v = np.asarray(values, np.uint32)
    if bits == 0 or not len(v):
        return b""
    planes = (v[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 0:
        return np.zeros(n, np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (flags.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def unpack_high_first(data: bytes, n: int, bits: int) -> np.ndarray:
    """The older layout: highest bit first in little-endian words; a last word of fewer bytes is its upper part."""
    if bits == 0:
        return np.zeros(n, np.uint32)
    rest = len(data) % 4
    whole = data if not rest else data[: len(data) - rest] + b"\0" * (4 - rest) + data[len(data) - rest :]
    words = np.frombuffer(whole, "<u4").astype(">u4")
    flags = np.unpackbits(words.view(np.uint8))[: n * bits].reshape(n, bits)
    return (flags.astype(np.uint64) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


_COUNT = {0: "<I", 1: "<H", 2: "<B"}


def _count(n: int) -> tuple[int, bytes]:
    code = 2 if n < 256 else 1 if n < 65536 else 0
    return code << 6, struct.pack(_COUNT[code], n)


def bit_length(x: int) -> int:
    return int(x).bit_length()


def write_block(q: np.ndarray) -> bytes:
    """A bit-stuffed block, by the smaller of plain values and a table of distinct values with indices."""
    q = np.asarray(q, np.uint32)
    top = int(q.max()) if len(q) else 0
    bits = bit_length(top)
    code, count = _count(len(q))
    plain = bytes([bits | code]) + count + pack(q, bits)
    known = np.unique(q)
    if top and 2 <= len(known) <= 255 and known[0] == 0:
        own = bit_length(len(known) - 1)
        table = bytes([bits | 32 | code]) + count + bytes([len(known)]) + pack(known[1:], bits) + pack(np.searchsorted(known, q), own)
        if len(table) < len(plain):
            return table
    return plain


def read_block(data: bytes, at: int, most: int, version: int) -> tuple[np.ndarray, int]:
    """The values of a block and where it ends."""
    head = take(data, at, 1)[0]
    bits, table, code = head & 31, head & 32, head >> 6
    if code not in _COUNT:
        raise BadBlob("count width")
    width = struct.calcsize(_COUNT[code])
    n = struct.unpack(_COUNT[code], take(data, at + 1, width))[0]
    at += 1 + width
    if n > most:
        raise BadBlob("too many elements")
    get = unpack if version >= 3 else unpack_high_first

    def part(n: int, bits: int, at: int) -> tuple[np.ndarray, int]:
        size = (n * bits + 7) // 8
        return get(take(data, at, size), n, bits), at + size

    if not table:
        return part(n, bits, at)
    own = take(data, at, 1)[0] - 1
    values, at = part(own, bits, at + 1)
    index, at = part(n, bit_length(own), at)
    if len(index) and index.max() > own:
        raise BadBlob("table index")
    return np.r_[np.uint32(0), values][index], at


END = -32768
#: Equal bytes from which on a run is worth its count, and the longest run or literal.
LEAST_RUN, LONGEST = 5, 32767


def rle(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    out, literal = [], bytearray()

    def flush() -> None:
        for i in range(0, len(literal), LONGEST):
            piece = literal[i : i + LONGEST]
            out.append(struct.pack("<h", len(piece)) + piece)
        literal.clear()

    for s, n in zip(starts.tolist(), np.diff(np.r_[starts, len(a)]).tolist()):
        if n < LEAST_RUN:
            literal += data[s : s + n]
            continue
        flush()
        while n:
            k = min(n, LONGEST)
            out.append(struct.pack("<hB", -k, data[s]))
            n -= k
    flush()
    return b"".join(out) + struct.pack("<h", END)


def unrle(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while True:
        n = struct.unpack("<h", take(data, at, 2))[0]
        at += 2
        if n == END:
            break
        if n > 0:
            out += take(data, at, n)
            at += n
        else:
            out += take(data, at, 1) * -n
            at += 1
        if len(out) > size:
            raise BadBlob("run lengths")
    if len(out) != size:
        raise BadBlob("run lengths")
    return bytes(out)


def fletcher32(data: bytes) -> int:
    """Closed form over big-endian 16-bit words; an odd last byte is a word's upper one."""
    w = np.frombuffer(data + b"\0" * (len(data) % 2), ">u2").astype(np.uint64)
    weight = np.arange(len(w), 0, -1, dtype=np.uint64) % 65535
    low, high = int(w.sum()) % 65535, int((weight * w).sum()) % 65535
    return (high or 65535) << 16 | (low or 65535)
