"""Tiles of a band, all of them at once: rows of an array are tiles, and rows alike in form are written or read together."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from rastrum.codec.bits import BadBlob, read_block, take

#: By type code.
DTYPES = ("int8", "uint8", "int16", "uint16", "int32", "uint32", "float32", "float64")
#: Smaller types of a tile's offset: (code, type) by type code, the smallest first.
REDUCED = {2: ((2, 0), (1, 1)), 3: ((1, 1),), 4: ((3, 1), (2, 2), (1, 3)), 5: ((2, 1), (1, 3)), 6: ((2, 1), (1, 2)), 7: ((3, 2), (2, 4), (1, 6))}
RAW_TILE, STUFFED_TILE, ZERO_TILE, CONST_TILE = 0, 1, 2, 3
#: Values that are laid out at once.
STRIP = 1 << 20


def to_type(x: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """float64 to a type as a saturating, truncating cast, NaN being 0 for integers."""
    if dtype.kind == "f":
        return x.astype(dtype)
    i = np.iinfo(dtype)
    return np.clip(np.trunc(np.nan_to_num(x, nan=0.0, posinf=float(i.max), neginf=float(i.min))), i.min, i.max).astype(dtype)


def as_rows(x: np.ndarray, block: int) -> np.ndarray:
    """(rows, cols, depth) to one row for each tile and depth, filled up with zeros past the edges."""
    rows, cols, depth = x.shape
    down, across = -(-rows // block), -(-cols // block)
    if rows % block or cols % block:
        x = np.pad(x, ((0, down * block - rows), (0, across * block - cols), (0, 0)))
    return x.reshape(down, block, across, block, depth).transpose(0, 2, 4, 1, 3).reshape(down * across * depth, block * block)


def from_rows(x: np.ndarray, shape: tuple[int, int, int], block: int) -> np.ndarray:
    rows, cols, depth = shape
    down, across = -(-rows // block), -(-cols // block)
    return x.reshape(down, across, depth, block, block).transpose(0, 3, 1, 4, 2).reshape(down * block, across * block, depth)[:rows, :cols]


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack_rows(q: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros((len(q), 0), np.uint8)
    flags = (q[:, :, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(flags.astype(np.uint8).reshape(len(q), -1), axis=1, bitorder="little")


def unpack_rows(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros((len(data), n), np.uint32)
    flags = np.unpackbits(data, axis=1, bitorder="little")[:, : n * bits].reshape(len(data), n, bits)
    whole = np.zeros((len(data), n, 32), np.uint8)
    whole[:, :, :bits] = flags
    return np.packbits(whole, axis=2, bitorder="little").view("<u4")[:, :, 0]


def _groups(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of the rows alike in all keys."""
    if not len(keys[0]):
        return
    order = np.lexsort(keys)
    change = np.zeros(len(order) - 1, bool)
    for k in keys:
        change |= k[order][1:] != k[order][:-1]
    yield from np.split(order, np.flatnonzero(change) + 1)


@dataclass
class Forms:
    """The smallest form of each row: mode, and what writing it needs."""

    values: np.ndarray
    ok: np.ndarray
    n: np.ndarray
    low: np.ndarray
    q: np.ndarray
    bits: np.ndarray
    distinct: np.ndarray  # 0 where values are stuffed plainly
    code: np.ndarray
    kind: np.ndarray
    mode: np.ndarray
    size: np.ndarray

    def write(self, out: np.ndarray, at: np.ndarray, flag: np.ndarray, rows: np.ndarray, raw: np.ndarray | None) -> None:
        """Each of the rows at its place, with its flag; raw: the rows' values in the band's type."""
        mode = self.mode[rows]
        out[at[rows]] = flag[rows] | mode | np.where((mode == CONST_TILE) | (mode == STUFFED_TILE), self.code[rows] << 6, 0)
        put = lambda i, begin, data: out.__setitem__(at[i][:, None] + begin + np.arange(data.shape[1]), data)
        some = rows[(mode == CONST_TILE) | (mode == STUFFED_TILE)]
        width = np.zeros(len(self.n), np.int64)
        for g in _groups(self.kind[some]):
            i = some[g]
            typed = np.dtype(DTYPES[self.kind[i[0]]]).newbyteorder("<")
            width[i] = typed.itemsize
            put(i, 1, self.low[i].astype(typed).view(np.uint8).reshape(len(i), -1))
        some = rows[mode == RAW_TILE]
        for g in _groups(self.n[some]):
            i = some[g]
            put(i, 1, np.ascontiguousarray(raw[i][self.ok[i]].reshape(len(i), -1)).view(np.uint8).reshape(len(i), -1))
        some = rows[mode == STUFFED_TILE]
        for g in _groups(self.n[some], self.bits[some], self.distinct[some], width[some]):
            i = some[g]
            n, bits, known = int(self.n[i[0]]), int(self.bits[i[0]]), int(self.distinct[i[0]])
            count = 2 if n < 256 else 1 if n < 65536 else 0
            head = bytes([bits | (32 if known else 0) | count << 6]) + struct.pack({2: "<B", 1: "<H", 0: "<I"}[count], n) + (bytes([known]) if known else b"")
            q = self.q[i][self.ok[i]].reshape(len(i), n)
            if known:
                order = np.argsort(q, axis=1, kind="stable")
                ranked = np.take_along_axis(q, order, 1)
                new = np.diff(ranked, axis=1) != 0
                index = np.zeros_like(q)
                np.put_along_axis(index, order, np.concatenate([np.zeros((len(i), 1), np.uint32), np.cumsum(new, axis=1, dtype=np.uint32)], axis=1), 1)
                table = ranked[:, 1:][new].reshape(len(i), known - 1)
                body = np.concatenate([pack_rows(table, bits), pack_rows(index, (known - 1).bit_length())], axis=1)
            else:
                body = pack_rows(q, bits)
            begin = 1 + int(width[i[0]])
            put(i, begin, np.broadcast_to(np.frombuffer(head, np.uint8), (len(i), len(head))))
            put(i, begin + len(head), body)


def forms(values: np.ndarray, ok: np.ndarray, dtype: int, error: float, narrow: bool, exact: bool, raw_width: int | None) -> Forms:
    """values: float64. dtype: the type of offsets; raw_width: bytes of a value as it stands, None if that is not allowed."""
    n = ok.sum(axis=1)
    low = np.where(n > 0, np.where(ok, values, np.inf).min(axis=1), 0.0)
    high = np.where(n > 0, np.where(ok, values, -np.inf).max(axis=1), 0.0)
    top = (high - low) / (2 * error)
    zero = (low == 0) & (high == 0)
    const = ~zero & ((low == high) | (np.floor(np.minimum(top, 2.0**62) + 0.5) == 0))
    can = ~zero & ~const & (top <= ((1 << 15) - 1 if narrow else (1 << 30) - 1))
    step = np.where(ok & can[:, None], values - low[:, None], 0.0)
    q = (step if exact else np.floor(step * (1 / (2 * error)) + 0.5)).astype(np.uint32)
    bits = bit_lengths(q.max(axis=1, initial=0))
    distinct = 1 + (np.diff(np.sort(q, axis=1), axis=1) != 0).sum(axis=1)
    code, kind = np.zeros(len(n), np.int64), np.full(len(n), dtype)
    left = np.ones(len(n), bool)
    for c, k in REDUCED.get(dtype, ()):
        t = np.dtype(DTYPES[k])
        with np.errstate(over="ignore"):
            fits = low.astype(np.float32).astype(np.float64) == low if t.kind == "f" else (low == np.floor(low)) & (low >= np.iinfo(t).min) & (low <= np.iinfo(t).max)
        code[left & fits], kind[left & fits] = c, k
        left &= ~fits
    width = np.array([np.dtype(x).itemsize for x in DTYPES])[kind]
    head = 1 + np.where(n < 256, 1, np.where(n < 65536, 2, 4))
    plain = head + (n * bits + 7) // 8
    table = head + 1 + ((distinct - 1) * bits + 7) // 8 + (n * bit_lengths(distinct - 1) + 7) // 8
    tabled = (distinct >= 2) & (distinct <= 255) & (table < plain)
    stuffed = 1 + width + np.where(tabled, table, plain)
    whole = 1 + n * (raw_width or 0)
    raw = ~zero & ~const & (~can | (stuffed >= whole)) if raw_width else np.zeros(len(n), bool)
    if (~zero & ~const & ~can & ~raw).any():
        raise BadBlob("tile range")
    mode = np.where(zero, ZERO_TILE, np.where(const, CONST_TILE, np.where(raw, RAW_TILE, STUFFED_TILE)))
    size = np.where(zero, 1, np.where(const, 1 + width, np.where(raw, whole, stuffed)))
    return Forms(values, ok, n, low, q, bits, np.where(tabled, distinct, 0), code, kind, mode, size)


def _strips(rows: int, cols: int, depth: int, block: int) -> Iterator[slice]:
    each = max(1, STRIP // max(1, cols * depth * block)) * block
    for r in range(0, rows, each):
        yield slice(r, min(rows, r + each))


def write_tiles(values: np.ndarray, valid: np.ndarray, dtype: int, error: float, version: int, block: int, measure: bool = False) -> bytes | int:
    """The tiles of (rows, cols, depth); measure: only their size."""
    rows, cols, depth = values.shape
    exact = dtype < 6 and error == 0.5
    pattern = 14 if version >= 5 else 15
    out, total = [], 0
    typed = values.astype(values.dtype.newbyteorder("<"), copy=False)
    for s in _strips(rows, cols, depth, block):
        raw = as_rows(typed[s], block)
        ok = np.repeat(as_rows(valid[s][:, :, None], block), depth, axis=0)
        v = raw.astype(np.float64)
        plain = forms(v, ok, dtype, error, dtype < 4, exact, typed.dtype.itemsize)
        size, other = plain.size, None
        # Differences to the depth before only where that is exact, so errors never add up.
        if depth > 1 and exact and version >= 5:
            d = np.arange(len(v)) % depth > 0
            step = np.where(d[:, None], v - np.roll(v, 1, axis=0), 0.0)
            least, most = np.where(ok, step, np.inf).min(axis=1), np.where(ok, step, -np.inf).max(axis=1)
            may = d & (plain.n > 0) & (least >= -(2.0**31)) & (most < 2.0**31) & (most - least <= ((1 << 15) - 1 if dtype < 4 else (1 << 30) - 1))
            other = forms(np.where(may[:, None], step, 0.0), ok, 4, error, dtype < 4, exact, None)
            better = may & (other.size < size)
            size = np.where(better, other.size, size)
        total += int(size.sum())
        if measure:
            continue
        across = -(-cols // block)
        first = (np.arange(len(v)) // depth) % across * block
        flag = (((first & 255) >> 3) & pattern) << 2
        at = np.cumsum(size) - size
        data = np.zeros(int(size.sum()), np.uint8)
        if other is None:
            plain.write(data, at, flag, np.arange(len(v)), raw)
        else:
            plain.write(data, at, flag, np.flatnonzero(~better), raw)
            other.write(data, at, flag | 4, np.flatnonzero(better), None)
        out.append(data.tobytes())
    return total if measure else b"".join(out)


_COUNT = {0: struct.Struct("<I"), 1: struct.Struct("<H"), 2: struct.Struct("<B")}
_TYPED = tuple(struct.Struct("<" + c) for c in "bBhHiIfd")


def read_tiles(data: bytes, at: int, shape: tuple[int, int, int], dtype: int, error: float, version: int, block: int, valid: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """(rows, cols, depth) from tiles that begin at a place; what is invalid holds 0."""
    if block <= 0:
        raise BadBlob("block size")
    rows, cols, depth = shape
    kind = np.dtype(DTYPES[dtype])
    area = as_rows(np.ones((rows, cols, 1), bool), block)
    ok = as_rows(valid[:, :, None], block)
    n_ok, n_area = ok.sum(axis=1).tolist(), area.sum(axis=1).tolist()
    across = -(-cols // block)
    pattern = 14 if version >= 5 else 15
    reduced = {(b, c): k for b in range(8) for c, k in [(0, b), *REDUCED.get(b, ())]} | {(b, c): b for b in (0, 1) for c in range(4)}
    many = len(n_ok) * depth
    offset, stuffed, raws = np.zeros(many), [], []
    modes, diffs = bytearray(many), bytearray(many)
    for t in range(len(n_ok)):
        check = ((t % across * block & 255) >> 3) & pattern
        for d in range(depth):
            i = t * depth + d
            if at >= len(data):
                raise BadBlob(f"1 bytes needed at {at}, 0 left")
            flag = data[at]
            at += 1
            diff = version >= 5 and bool(flag & 4)
            if (flag >> 2) & pattern != check or diff and d == 0:
                raise BadBlob("tile")
            mode = modes[i] = flag & 3
            diffs[i] = diff
            if mode == ZERO_TILE:
                continue
            if mode == RAW_TILE:
                if diff:
                    raise BadBlob("raw tile with differences")
                take(data, at, n_ok[t] * kind.itemsize)
                raws.append((i, at, n_ok[t]))
                at += n_ok[t] * kind.itemsize
                continue
            own = reduced.get((4 if diff and dtype < 6 else dtype, flag >> 6))
            if own is None:
                raise BadBlob("reduced type")
            typed = _TYPED[own]
            offset[i] = typed.unpack(take(data, at, typed.size))[0]
            at += typed.size
            if mode == CONST_TILE:
                continue
            if version < 3:
                q, at = read_block(data, at, n_area[t], version)
                stuffed.append((i, len(q), q))
                continue
            head, code = take(data, at, 1)[0], 0
            code = head >> 6
            if code not in _COUNT:
                raise BadBlob("count width")
            n = _COUNT[code].unpack(take(data, at + 1, _COUNT[code].size))[0]
            if n > n_area[t]:
                raise BadBlob("too many elements")
            if n != n_ok[t] and n != n_area[t]:
                raise BadBlob("tile size")
            at += 1 + _COUNT[code].size
            bits, known = head & 31, 0
            if head & 32:
                known = take(data, at, 1)[0]
                at += 1
                size = ((known - 1) * bits + 7) // 8 + (n * (known - 1).bit_length() + 7) // 8 if known else -1
            else:
                size = (n * bits + 7) // 8
            take(data, at, size)
            stuffed.append((i, n, at, bits, known if head & 32 else -1))
            at += size

    whole = np.frombuffer(data, np.uint8)
    out = np.zeros((many, block * block))
    tile = np.arange(many) // depth

    def place(i: np.ndarray, n: int, q: np.ndarray) -> None:
        """q, one row of n for each of the tiles, at the valid places, or at all."""
        at_ok = n == np.array([n_ok[k] for k in tile[i]])
        for some, where in ((at_ok, ok), (~at_ok, area)):
            if some.any():
                row, col = np.nonzero(where[tile[i[some]]])
                out[i[some][row], col] = q[some].ravel()

    if version < 3:
        for i, n, q in stuffed:
            if n != n_ok[tile[i]] and n != n_area[tile[i]]:
                raise BadBlob("tile size")
            place(np.array([i]), n, q[None, :])
    elif stuffed:
        found = np.array(stuffed, np.int64)
        for g in _groups(found[:, 1], found[:, 3], found[:, 4]):
            i, n, bits, known = found[g, 0], int(found[g[0], 1]), int(found[g[0], 3]), int(found[g[0], 4])
            get = lambda begin, k, bits: unpack_rows(whole[begin[:, None] + np.arange((k * bits + 7) // 8)], k, bits)
            begin = found[g, 2]
            if known < 0:
                q = get(begin, n, bits)
            else:
                index = get(begin + ((known - 1) * bits + 7) // 8, n, (known - 1).bit_length())
                if index.size and index.max() > known - 1:
                    raise BadBlob("table index")
                table = np.concatenate([np.zeros((len(i), 1), np.uint32), get(begin, known - 1, bits)], axis=1)
                q = np.take_along_axis(table, index.astype(np.int64), 1)
            place(i, n, q.astype(np.float64))
    mode, diff = np.frombuffer(modes, np.uint8), np.frombuffer(diffs, np.uint8).astype(bool)
    high = np.tile(highs, len(n_ok))
    is_q = mode == STUFFED_TILE
    out[is_q] = np.minimum(offset[is_q, None] + out[is_q] * (2 * error), np.where(diff[is_q], np.inf, high[is_q])[:, None])
    out[mode == CONST_TILE] = offset[mode == CONST_TILE, None]
    for g in _groups(np.array([n for *_, n in raws], np.int64)):
        i, begin, n = np.array([raws[k][0] for k in g]), np.array([raws[k][1] for k in g]), raws[g[0]][2]
        if n:
            place(i, n, whole[begin[:, None] + np.arange(n * kind.itemsize)].view(kind.newbyteorder("<")).astype(np.float64))
    for d in range(1, depth):
        i = np.flatnonzero(diff & (np.arange(many) % depth == d))
        if len(i):
            before = to_type(out[i - 1], kind).astype(np.float64)
            got = out[i] + before
            out[i] = np.where((mode[i] == ZERO_TILE)[:, None], got, np.minimum(got, highs[d]))
    out[~np.repeat(ok, depth, axis=0)] = 0
    return to_type(from_rows(out, shape, block), kind)
