"""Canonical Huffman coding of bytes."""

from __future__ import annotations

import heapq
import struct

import numpy as np

from rastrum.codec.bits import BadBlob, read_block, take, write_block

LONGEST, WINDOW = 32, 16


def code_lengths(counts: np.ndarray) -> np.ndarray | None:
    """A length for each symbol with a count; None with fewer than two symbols or a length over LONGEST."""
    heap = [(int(c), i, [i]) for i, c in enumerate(counts) if c]
    if len(heap) < 2:
        return None
    out, tie = np.zeros(len(counts), np.int64), len(counts)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        both = a[2] + b[2]
        out[both] += 1
        heapq.heappush(heap, (a[0] + b[0], tie, both))
        tie += 1
    return out if out.max() <= LONGEST else None


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes from the longest down, within a length by falling symbol... each next code is one more, cut to its length."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (-int(lengths[s]), s)):
        n = int(lengths[s])
        code >>= max(0, before - n)
        codes[s] = code
        code, before = code + 1, n
    return codes


def used_range(lengths: np.ndarray) -> tuple[int, int]:
    """The shortest range of symbols, around the end if need be, that holds all that are used."""
    used, n = np.flatnonzero(lengths), len(lengths)
    gaps = np.diff(np.r_[used, used[0] + n])
    k = int(np.argmax(gaps))
    if k == len(used) - 1 or gaps[k] <= used[0] + n - used[-1]:
        return int(used[0]), int(used[-1]) + 1
    return int(used[k + 1]), int(used[k]) + 1 + n


def _high_first(codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Codes one after another, highest bits first, in little-endian words."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    at = np.arange(total) - np.repeat(ends - lengths, lengths)
    flags = (np.repeat(codes, lengths) >> (np.repeat(lengths, lengths) - 1 - at).astype(np.uint64)) & np.uint64(1)
    packed = np.packbits(flags.astype(np.uint8))
    packed = np.r_[packed, np.zeros(-len(packed) % 4, np.uint8)]
    return packed.view(">u4").astype("<u4").tobytes()


def write_table(lengths: np.ndarray, codes: np.ndarray) -> bytes:
    i0, i1 = used_range(lengths)
    k = np.arange(i0, i1) % len(lengths)
    return struct.pack("<4i", 4, len(lengths), i0, i1) + write_block_plain(lengths[k]) + _high_first(codes[k], lengths[k])


def write_block_plain(values: np.ndarray) -> bytes:
    block = write_block(np.asarray(values, np.uint32))
    if block[0] & 32:  # code lengths are always stored plainly
        from rastrum.codec.bits import _count, bit_length, pack

        bits = bit_length(int(np.max(values)))
        code, count = _count(len(values))
        return bytes([bits | code]) + count + pack(values, bits)
    return block


class _Reader:
    """Bits highest first in little-endian words, from a byte on."""

    def __init__(self, data: bytes, at: int):
        tail = data[at:]
        words = np.frombuffer(tail + b"\0" * (-len(tail) % 4), "<u4").astype(">u4")
        self.bits = np.r_[np.unpackbits(words.view(np.uint8)), np.zeros(64, np.uint8)]


def read_table(data: bytes, at: int, version: int) -> tuple[np.ndarray, np.ndarray, int]:
    v, size, i0, i1 = struct.unpack("<4i", take(data, at, 16))
    if v < 2 or not 0 <= i0 < i1 or not 0 < size <= 1 << 15 or i1 - i0 > size:
        raise BadBlob("code table")
    found, at = read_block(data, at + 16, i1 - i0, version)
    lengths, codes = np.zeros(size, np.int64), np.zeros(size, np.uint64)
    k = np.arange(i0, i1) % size
    lengths[k] = found
    if lengths.max() > LONGEST:
        raise BadBlob("code length")
    bits, pos = _Reader(data, at).bits, 0
    for s in k.tolist():
        n = int(lengths[s])
        for b in bits[pos : pos + n].tolist():
            codes[s] = codes[s] * np.uint64(2) + np.uint64(b)
        pos += n
    return lengths, codes, at + (pos + 31) // 32 * 4


def encode(symbols: np.ndarray, table_size: int = 256) -> bytes | None:
    """Table, data and one word to read ahead; None if there is no code."""
    lengths = code_lengths(np.bincount(symbols, minlength=table_size))
    if lengths is None:
        return None
    codes = canonical(lengths)
    return write_table(lengths, codes) + _high_first(codes[symbols], lengths[symbols]) + b"\0\0\0\0"


def decode(data: bytes, at: int, n: int, version: int) -> tuple[np.ndarray, int]:
    """n symbols and where their words, with the one to read ahead, end."""
    lengths, codes, at = read_table(data, at, version)
    bits = _Reader(data, at).bits
    longest = int(lengths.max())
    by_code = {(int(lengths[s]), int(codes[s])): int(s) for s in np.flatnonzero(lengths)}
    out, pos = [], 0
    if longest <= WINDOW:
        symbol, size = np.full(1 << longest, -1, np.int64), np.zeros(1 << longest, np.int32)
        for (k, c), s in by_code.items():
            symbol[c << (longest - k) : (c + 1) << (longest - k)] = s
            size[c << (longest - k) : (c + 1) << (longest - k)] = k
        if not n:
            return np.zeros(0, np.int64), at + 4
        # The next `longest` bits at every place, from the 32 bits that begin at each byte.
        four = np.packbits(bits).astype(np.uint32)
        four = np.r_[four, np.zeros(3, np.uint32)]
        four = four[:-3] << np.uint32(24) | four[1:-2] << np.uint32(16) | four[2:-1] << np.uint32(8) | four[3:]
        window = ((four[:, None] >> (32 - longest - np.arange(8, dtype=np.uint32))) & np.uint32((1 << longest) - 1)).ravel()
        # Where the next symbol begins, and the one after 2, 4 and 8 of them; a walk by eights, then all between.
        after = np.minimum(np.arange(len(window), dtype=np.int32) + size[window], len(window) - 1)
        by2 = after[after]
        by8 = by2[by2]
        by8 = memoryview(by8[by8])
        eighth, pos = [], 0
        for _ in range((n + 7) // 8):
            eighth.append(pos)
            pos = by8[pos]
        places = np.empty((len(eighth), 8), np.int64)
        places[:, 0] = eighth
        for k in range(1, 8):
            places[:, k] = after[places[:, k - 1]]
        places = places.ravel()[:n]
        taken = size[window[places]]
        end = int(places[-1] + taken[-1])
        if not taken.all() or end > len(bits) - 64:
            raise BadBlob("Huffman data")
        return symbol[window[places]], at + (end + 31) // 32 * 4 + 4
    stream = bits.tolist()
    for _ in range(n):
        code = k = 0
        while (k, code) not in by_code:
            if k > longest or pos >= len(stream):
                raise BadBlob("Huffman data")
            code, k, pos = code * 2 + stream[pos], k + 1, pos + 1
        out.append(by_code[k, code])
    return np.array(out, np.int64), at + (pos + 31) // 32 * 4 + 4
