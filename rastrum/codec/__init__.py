"""Raster blobs: limited-error encoding and decoding of typed rasters, in NumPy and without Spark."""

from rastrum.codec.bits import BadBlob
from rastrum.codec.blob import Band, Header, decode, decode_band, encode, encode_band, read_header, scan, split_bands
from rastrum.codec.legacy import is_legacy

__all__ = ["BadBlob", "Band", "Header", "decode", "decode_band", "encode", "encode_band", "is_legacy", "read_header", "scan", "split_bands"]
