"""Byte-level BPE encoding and decoding.

Texts of more than CHUNK code points are cut into chunks that overlap their successors. The chunks are pre-tokenised in
parallel, as rows of their own. A pre-token depends only on the text from its start on, so as soon as two neighbouring
chunks share a boundary they agree on every later one: there they are stitched, and each chunk's pieces up to the next
stitch are encoded. Boundaries within the last few code points of a chunk may change with the text that follows and
are not trusted. Where an overlap holds no common boundary, as in a word longer than it, scanning goes on from the last
good boundary until it meets a later chunk's. Shorter texts are one chunk and are encoded where they are read, by
tiktoken's own scanner, and once where rows of the same text follow each other, as a mix's copies do. Decoding
concatenates the tokens' raw bytes.

Cases: a null text counts as empty; an empty text has no tokens. Very long texts are chunks of bounded size until they
are stitched, one text to a task. Every row gives one row, repeats included: long texts alike in all kept columns are
encoded once. An empty table gives no rows. Other columns may have any names: those kept go along in one struct, and
only two results of one name are refused, with a ValueError.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rastrum.llm.common import as_row, table

CHUNK, OVERLAP = 32768, 1024
#: Code points before a chunk's end at which a match may still change: the longest contraction is 3 long.
MARGIN = 3
#: Pieces of at most so many code points are remembered, and so many of them.
SHORT_PIECE, REMEMBERED = 32, 200_000
BATCH_CHARS = 1 << 20


class _Pieces(dict):
    def __init__(self, encode: Callable[[bytes], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode(piece.encode()))
        if len(piece) <= SHORT_PIECE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for a file of ranks, a base64 token and its rank on each line."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.core = core._core_bpe
        self.pattern = regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.digits = {v: str(v) for v in ranks.values()}
        self.pieces = _Pieces(core._encode_single_piece)

    def ends(self, text: str) -> list[int]:
        """Where the pre-tokens of a text end."""
        return [m.end() for m in self.pattern.finditer(text)]

    def encode_pieces(self, pieces: Iterable[str]) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        """As encode_pieces() of all that the pattern finds, which a test holds it to."""
        return self.core.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.core.decode_bytes(ids)

    def joined(self, ids: Iterable[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))


@functools.lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    return [text[i : i + chunk + overlap] for i in range(0, max(1, len(text)), chunk)]


def trusted(c: Codec, part: str, last: bool) -> list[int]:
    ends = c.ends(part)
    if not last:
        while ends and ends[-1] > len(part) - MARGIN - 1:
            ends.pop()
    return ends


def stitch(c: Codec, parts: list[str], ends: list[list[int]], chunk: int = CHUNK) -> list[int]:
    """The ids of a text from its chunks and their trusted boundaries, which count from each chunk's start."""
    ids: list[int] = []
    last = len(parts) - 1
    k, at = 0, 0  # the chunk that holds the position, and the position in the text
    while True:
        base = k * chunk
        own = [e for e in (base + e for e in ends[k]) if e > at]
        if k == last:
            stop, following = base + len(parts[k]), None
        else:
            theirs = {(k + 1) * chunk + e for e in ends[k + 1]}
            stop = next((e for e in [at, *own] if e in theirs), None)
            following = k + 1
            if stop is None:  # no common boundary: go on, piece by piece
                stop = own[-1] if own else at
                following = None
        text, begin = parts[k], at - base
        pieces = []
        for e in own:
            if e > stop:
                break
            pieces.append(text[begin : e - base])
            begin = e - base
        ids += c.encode_pieces(pieces)
        at = stop
        if k == last:
            return ids
        if following is None:
            k, at, more = _walk(c, parts, ends, chunk, k, at)
            ids += more
            if k > last:
                return ids
        else:
            k = following


def _walk(c: Codec, parts: list[str], ends: list[list[int]], chunk: int, k: int, at: int) -> tuple[int, int, list[int]]:
    """Scan on from a boundary until it is one of a later chunk; the chunk, the boundary and the ids up to it."""
    rest = "".join(p[:chunk] for p in parts[k:-1]) + parts[-1]
    base, known = k * chunk, [{j * chunk + e for e in ends[j]} for j in range(k + 1, len(parts))]
    pieces = []
    for m in c.pattern.finditer(rest, at - base):
        pieces.append(m[0])
        end = base + m.end()
        j = min(end // chunk, len(parts) - 1)
        for i in (j - 1, j):
            if i > k and end in known[i - k - 1]:
                return i, end, c.encode_pieces(pieces)
    return len(parts), base + len(rest), c.encode_pieces(pieces)


#: What encode() can return of a document beside the kept columns.
OUTPUTS: dict[str, tuple[str, Callable[[Codec, list[int]], object]]] = {
    "n_tokens": ("bigint", lambda c, ids: len(ids)),
    "ids": ("array<int>", lambda c, ids: ids),
    "ids_sha256": ("string", lambda c, ids: hashlib.sha256(c.joined(ids).encode()).hexdigest()),
    "decoded": ("binary", lambda c, ids: c.decode(ids)),
    "decoded_sha256": ("string", lambda c, ids: hashlib.sha256(c.decode(ids)).hexdigest()),
}


def _batches(rows: Iterable[tuple[int, list]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_CHARS code points of input, from (code points, values)."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), schema)], schema=schema)


def encoded(c: Codec, rows: Iterable[list], make: list[Callable[[Codec, list[int]], object]]) -> Iterator[tuple[int, list]]:
    """For _batches(), of rows (kept, text); a text that is the one before it is not encoded again."""
    before, made = None, []
    for kept, text in rows:
        if (text := text or "") != before:
            ids = c.encode(text)
            before, made = text, [f(c, ids) for f in make]
        yield len(text) + 64, [kept, *made]


def encode(docs: DataFrame, ranks: str, pattern: str, keep: list[str], outputs: list[str], text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The kept columns of every document and the named OUTPUTS of its ids; none of both may have the same name."""
    if clash := {k.lower() for k in keep} & {o.lower() for o in outputs}:
        raise ValueError(f"columns {sorted(clash)} would appear twice")
    docs = docs.select(as_row(docs.select(*keep)).alias("row"), F.col(text_col).alias("text"))
    row = docs.schema["row"]
    field = lambda name, kind: T.StructField(name, T._parse_datatype_string(kind))
    out = T.StructType([row, *[field(o, OUTPUTS[o][0]) for o in outputs]])
    out_arrow = to_arrow_schema(out)
    make = [OUTPUTS[o][1] for o in outputs]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            for i in range(b.num_rows):
                yield [x[i].as_py() for x in b.columns]

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(encoded(codec(ranks, pattern), rows(batches), make), out_arrow)

    short = docs.where(F.col("text").isNull() | (F.length("text") <= chunk)).mapInArrow(whole, out)

    # Of rows alike in all kept columns and text one is encoded, `times` tells how often; a chunk is a row of its own.
    cut_type = T.StructType([row, field("times", "bigint"), field("key", "binary"), field("k", "int"), field("n", "int"), field("part", "string")])
    cut_arrow = to_arrow_schema(cut_type)
    scan_type = T.StructType([*cut_type, field("ends", "array<int>")])
    scan_arrow = to_arrow_schema(scan_type)

    def pieces_of(batches):
        def each():
            for kept, text, key, times in rows(batches):
                parts = cut(text, chunk, overlap)
                for k, p in enumerate(parts):
                    yield len(p), [kept, times, key, k, len(parts), p]

        yield from _batches(each(), cut_arrow)

    def scan(batches):
        c = codec(ranks, pattern)
        yield from _batches(((2 * len(r[-1]), [*r, trusted(c, r[-1], r[-3] == r[-2] - 1)]) for r in rows(batches)), scan_arrow)

    def join(group: pa.Table) -> pa.Table:
        c = codec(ranks, pattern)
        order = np.argsort(group.column("k").to_numpy(), kind="stable").tolist()
        ends, parts = group.column("ends"), group.column("part")
        ids = stitch(c, [parts[i].as_py() for i in order], [ends[i].as_py() for i in order], chunk)
        values = [group.column("row")[0].as_py(), group.column("times")[0].as_py(), *[f(c, ids) for f in make]]
        return pa.Table.from_arrays([pa.array([v], t.type) for v, t in zip(values, done_arrow)], schema=done_arrow)

    done = T.StructType([row, field("times", "bigint"), *out.fields[1:]])
    done_arrow = to_arrow_schema(done)
    long_ = docs.where(F.length("text") > chunk).withColumn("key", F.unhex(F.sha2("text", 256)))
    long_ = long_.groupBy("row", "key").agg(F.first("text").alias("text"), F.count("*").alias("times")).select("row", "text", "key", "times")
    pieces = long_.mapInArrow(pieces_of, cut_type)
    stitched = pieces.repartition("row", "key", "k").mapInArrow(scan, scan_type).groupBy("row", "key").applyInArrow(lambda g: join(g), done)
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))
    stitched = stitched.withColumn("copy", again).select("row", *outputs)
    return short.unionByName(stitched).select("row.*", *outputs)


def decode(frame: DataFrame, ranks: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """frame with `bytes`, the raw bytes of the ids; null ids give null."""
    @F.pandas_udf("binary")
    def to_bytes(ids):
        c = codec(ranks, pattern)
        return ids.map(lambda x: None if x is None else c.decode(x.tolist()))

    return frame.withColumn("bytes", to_bytes(F.col(ids_col)))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        keep=["doc_id"],
        outputs=["n_tokens", "ids_sha256", "decoded_sha256"],
    )


QUERIES = {"op1_bpe": op1_bpe}
ORACLES: dict[str, str] = {}
