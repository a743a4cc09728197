"""The codec alone: exact round trips, error bounds, hand-made blobs and damaged ones."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rastrum import codec
from rastrum.codec import bits, blob, huffman, legacy, planes


def again(v, m, error, no_data=None, many=1):
    out = codec.decode(codec.encode([(v, m)] * many, [error] * many, no_data))
    assert len(out) == many
    for b in out:
        assert (b.valid == m).all()
    return out[-1].values


@pytest.mark.parametrize("dtype", blob.DTYPES)
@pytest.mark.parametrize("shape", [(1, 1, 1), (1, 63, 1), (63, 1, 1), (20, 33, 1), (16, 16, 3)])
@pytest.mark.parametrize("share", [1.0, 0.6, 0.0])
def test_round_trip(dtype, shape, share):
    rng = np.random.default_rng(len(dtype) + sum(shape))
    t = np.dtype(dtype)
    if t.kind == "f":
        makes = [rng.normal(0, 100, shape), np.cumsum(rng.normal(0, 1, shape), axis=1), np.full(shape, 3.25), rng.random(shape) * 10.0 ** rng.integers(-30, 30, shape)]
    else:
        i = np.iinfo(t)
        makes = [rng.integers(i.min, i.max, shape, endpoint=True), rng.integers(0, 4, shape), np.full(shape, 7), np.clip(np.cumsum(rng.integers(-2, 3, shape), axis=1) + 50, i.min, i.max)]
    m = rng.random(shape[:2]) < share
    for k, v in enumerate(makes):
        v = v.astype(t)
        got = again(v, m, 0.5 if t.kind != "f" else 0, many=1 + k % 2)
        assert got[m].tobytes() == v[m].tobytes()
        got = again(v, m, 2.0)
        assert np.abs(got[m].astype(float) - v[m].astype(float)).max(initial=0) <= 2.0 + 4 * np.finfo(np.float32).eps * np.abs(v[m].astype(float)).max(initial=0)


def test_float_extremes():
    f = np.finfo(np.float32)
    v = np.array([0.0, -0.0, 1, -1, f.max, f.min, f.tiny, 1e-45], np.float32).reshape(2, 4, 1)
    assert again(v, np.ones((2, 4), bool), 0).tobytes() == v.tobytes()
    z = np.array([[0.0, -0.0]], np.float32).reshape(1, 2, 1)
    assert again(z, np.ones((1, 2), bool), 0).tobytes() == z.tobytes()


def test_no_data_at_some_depths():
    k = np.arange(64).reshape(8, 8)
    v = np.stack([k + 10.0, np.where(k % 5 == 0, -9999, k + 110.0)], 2).astype(np.float32)
    for error in (0, 0.01):
        got = again(v, np.ones((8, 8), bool), error, -9999.0)
        assert ((got == -9999) == (v == -9999)).all() and np.abs(got - v).max() <= error + 1e-4
    low = np.stack([k + 10, np.where(k % 3 == 0, 300, k + 15)], 2).astype(np.uint16)
    assert (again(low, np.ones((8, 8), bool), 0.5, 300) == low).all()


def test_versions_and_sizes():
    v = np.arange(64, dtype=np.int32).reshape(8, 8, 1)
    m = np.ones((8, 8), bool)
    one, two = codec.encode([(v, m)], [0.5]), codec.encode([(v, m)] * 2, [0.5] * 2)
    assert [h.version for h in codec.scan(one)] == [3] and [h.version for h in codec.scan(two)] == [6, 6]
    assert codec.scan(one)[0].size == len(one) and sum(n for _, n in codec.split_bands(two)) == len(two)
    assert codec.scan(codec.encode([(np.repeat(v, 2, axis=2), m)], [0.5]))[0].version == 5
    assert codec.encode([(v, m)], [0.5]) == one


def test_damaged_blobs():
    v = np.arange(64, dtype=np.int32).reshape(8, 8, 1)
    good = codec.encode([(v, np.ones((8, 8), bool))], [0.5])
    for bad in (b"", b"what?", good[:-1], good[:40], good[:70] + bytes([good[70] ^ 1]) + good[71:], good[:6] + struct.pack("<i", 9) + good[10:]):
        with pytest.raises(ValueError):
            codec.decode(bad)
    empty = bytearray(good)
    struct.pack_into("<i", empty, 30, 0)  # a blob of no size would never end
    with pytest.raises(ValueError):
        codec.split_bands(bytes(empty))


def hand_made(version: int, tile: bytes, low: float, high: float, dtype: int = 1, rows: int = 2, cols: int = 2) -> bytes:
    """A blob laid out by hand, all places valid."""
    h = blob.Header(version, rows, cols, 1, rows * cols, 8, 0, dtype, 1.0, low, high)
    body = struct.pack("<i", 0) + b"\0" + tile
    h.size = blob.SIZES[version] + len(body)
    out = bytearray(blob.write_header(h) + body)
    if version >= 3:
        struct.pack_into("<I", out, 10, bits.fletcher32(bytes(out[14:])))
    return bytes(out)


def test_hand_made_tiles():
    # raw bytes; a constant; offset 1 and two bits each: 0 1 2 3, times 2 and no more than 6
    assert codec.decode(hand_made(3, bytes([0, 9, 8, 7, 6]), 6, 9))[0].values.ravel().tolist() == [9, 8, 7, 6]
    assert codec.decode(hand_made(3, bytes([3, 5]), 4, 6))[0].values.ravel().tolist() == [5] * 4
    assert codec.decode(hand_made(3, bytes([1, 1, 2 | 2 << 6, 4, 0b11100100]), 1, 6))[0].values.ravel().tolist() == [1, 3, 5, 6]
    # the older layout packs from the highest bit of a word down; one byte is the word's top
    assert codec.decode(hand_made(2, bytes([1, 1, 2 | 2 << 6, 4, 0b00011011]), 1, 6))[0].values.ravel().tolist() == [1, 3, 5, 6]
    # a table of two values, 0 and 3, with indices of one bit
    assert codec.decode(hand_made(3, bytes([1, 0, 2 | 32 | 2 << 6, 4, 2, 3, 0b1010]), 0, 6))[0].values.ravel().tolist() == [0, 6, 0, 6]


def test_legacy():
    head = b"CntZImage " + struct.pack("<4id", 11, 8, 2, 2, 0.5)
    mask = bits.rle(np.packbits([1, 1, 0, 1]).tobytes())
    count = struct.pack("<3if", 0, 0, len(mask), 1.0) + mask
    tile = bytes([1 | 2 << 6, 10, 2 | 2 << 6, 3, 0b00011000])  # offset 10 in a byte, levels 0 1 2
    data = head + count + struct.pack("<3if", 1, 1, len(tile), 12.0) + tile
    values, valid = legacy.decode(data)
    assert valid.tolist() == [[True, True], [False, True]] and values.tolist() == [[10, 11], [0, 12]]
    assert legacy.info(data) == legacy.Info(2, 2, 0.5, 12.0)
    whole = head + struct.pack("<3if", 0, 0, 0, 1.0) + struct.pack("<3if", 0, 0, 0, 4.0)
    assert legacy.decode(whole)[0].tolist() == [[4, 4], [4, 4]]
    with pytest.raises(ValueError):
        legacy.decode(head[:-1])


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400))
def test_bytes(data):
    assert bits.unrle(bits.rle(data), len(data)) == data
    s = [0xFFFF, 0xFFFF]
    for i in range(0, len(data), 2):
        s[0] = (s[0] + (data[i] << 8) + (data[i + 1] if i + 1 < len(data) else 0)) % 65535 or 65535
        s[1] = (s[1] + s[0]) % 65535 or 65535
    assert bits.fletcher32(data) == s[1] << 16 | s[0]
    if data:
        a = np.frombuffer(data, np.uint8)
        assert (planes.expand(planes.compress(a), len(a)) == a).all()
        for level in range(6):
            assert (planes.level_restore(planes.level_delta(a, level), level) == a).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**31 - 1), max_size=80), st.integers(0, 31))
def test_blocks(values, shift):
    q = np.array(values, np.uint32) >> np.uint32(shift)
    got, end = bits.read_block(block := bits.write_block(q), 0, len(q), 3)
    assert end == len(block) and (got == q).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=2, max_size=300))
def test_huffman(values):
    a = np.array(values, np.int64)
    data = huffman.encode(a)
    if len(set(values)) < 2:
        assert data is None
    else:
        got, end = huffman.decode(data, 0, len(a), 6)
        assert (got == a).all() and end == len(data)


def test_rare_symbols_have_long_codes():
    a = np.repeat(np.arange(24), [2**k for k in range(24)][::-1])[: 1 << 16]
    a = np.r_[a, np.arange(24)]
    lengths = huffman.code_lengths(np.array([2**k for k in range(24)]))
    assert lengths.max() == 23
    codes = huffman.canonical(lengths)
    data = huffman.write_table(lengths, codes) + huffman._high_first(codes[np.arange(24)], lengths[np.arange(24)]) + b"\0" * 4
    assert huffman.decode(data, 0, 24, 6)[0].tolist() == list(range(24))


def test_sample_blocks():
    """Evenly spaced, from the first to the last, and never past the end."""
    for n, unit in ((1, 1), (5, 400), (8192, 1), (8193, 1), (100_000, 1), (512, 512), (3, 100_000)):
        blocks = planes.sample_blocks(n, unit)
        assert blocks[0].start == 0 and blocks[-1].stop == n and all(0 <= s.start < s.stop <= n for s in blocks)
        gaps = [b.start - a.start for a, b in zip(blocks, blocks[1:])]
        assert not gaps or max(gaps) - min(gaps) <= 1


def test_predictor_is_told_from_all_parts():
    """A band that is noise in its middle and smooth elsewhere is predicted all the same."""
    r, c = np.mgrid[0:400, 0:300]
    v = (r * 1.0 + c * 0.5).astype(np.float32)
    v[180:220] = np.random.default_rng(1).normal(0, 1e3, (40, 300))
    data = planes.encode_slice(v)
    assert data[0] != planes.NONE and (planes.decode_slice(data, 0, v.shape, False)[0] == v).all()


@pytest.mark.parametrize("make", ["one_sweep", "version_2", "older"])
@pytest.mark.parametrize("share", [1.0, 0.7])
def test_forms_laid_out_by_hand(make, share):
    from rastrum.codec import samples

    rng = np.random.default_rng(4)
    v = rng.integers(0, 60, (21, 37)).astype(np.uint8)
    v[:8, :8] = 0
    m = rng.random(v.shape) < share
    m[8:16, 8:16] = share == 1.0  # a tile without a valid place
    if make == "older":
        values, valid = legacy.decode(samples.older(v.astype(np.float32), m, 0.5))
        assert (valid == m).all() and (values[m] == v[m]).all()
        return
    for version in (3, 4, 5, 6) if make == "one_sweep" else (2,):
        for deep in (v[:, :, None], np.stack([v, v + 3], 2)) if version > 3 else (v[:, :, None],):
            data = samples.one_sweep(deep, m, version) if make == "one_sweep" else samples.version_2(deep, m)
            got = codec.decode(data)[0]
            assert got.header.version == version and (got.valid == m).all() and (got.values[m] == deep[m]).all()
