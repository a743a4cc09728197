"""Document fingerprints by locally consistent parsing.

A text's code points are the names of level 0. At each level runs of one name become one name; deterministic coin
tossing then gives every position a label below 6 that differs from its neighbours': a label is the place and the value
of the lowest bit in which a name differs from the one before, and labels of labels shrink at once. A phrase begins
wherever a label is a local maximum, which takes a few neighbours to decide and nothing else, so equal substrings
have equal phrases inside, whatever their offsets. A phrase's hash is its name at the next level. The names of levels 2
and 3 (of short texts also of level 1) are sketched into a fingerprint of BINS bins with 16 bits of each bin's least
hash; likeness is the share of equal bins among those that are not empty in both, an estimate of the Jaccard index.

The next document, for edited texts, is taken in ranges of ids: each range is sorted within a partition and ends with a
copy of the next range's first document, so texts move once and no order over all rows is needed in one place.

Cases: a null text counts as empty; fingerprints of empty texts are all empty, and like each other with 1. Null ids come
last in descending order. Of repeated ids the one with the smaller text hash comes first. The only document of a table
is its own next one. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.common import table, text_key

BINS, LEVELS, SHORT = 128, 3, 64
BATCH_CHARS = 400_000
_U = np.uint64
_CTZ = np.array([8] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)
_NONE = np.iinfo(np.uint64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def parse(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: phrase names and the document of each. Positions of a document stand together."""
    n = len(names)
    if not n:
        return names, doc
    first = np.r_[True, doc[1:] != doc[:-1]]
    begins = np.flatnonzero(first | np.r_[True, names[1:] != names[:-1]])
    runs = np.diff(np.r_[begins, n])
    names, doc, first = names[begins], doc[begins], first[begins]
    if (runs > 1).any():
        names = names ^ ((runs - 1).astype(_U) * _U(0xD6E8FEB86659FD93))

    before = np.r_[~names[:1], names[:-1]]
    before[first] = ~names[first]  # a document's first name differs from what is before it in the lowest bit
    x = names ^ before
    place = np.bitwise_count((x & (~x + _U(1))) - _U(1))
    label = (2 * place + ((names >> np.minimum(place, 63).astype(_U)) & _U(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        before = np.r_[label[:1], label[:-1]]
        before[first] = label[first] ^ 1
        place = _CTZ[label ^ before]
        label = 2 * place + ((label >> np.minimum(place, 7)) & 1)

    last = np.r_[first[1:], True]
    left, right = np.r_[label[:1], label[:-1]], np.r_[label[1:], label[-1:]]
    starts = np.flatnonzero(first | (((label > left) | first) & ((label > right) | last)))
    at = np.arange(len(names)) - np.repeat(starts, np.diff(np.r_[starts, len(names)]))
    return _mix(np.add.reduceat(_mix(names + at.astype(_U) * _U(0xA0761D6478BD642F)), starts)), doc[starts]


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, BINS) of 16 bits each; 0 is an empty bin."""
    sizes = np.array([len(t) for t in texts], np.int64)
    least = np.full(len(texts) * BINS, _NONE)
    names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(_U) + _U(1)
    doc = np.repeat(np.arange(len(texts)), sizes)
    short = sizes < SHORT
    for level in range(1, LEVELS + 1):
        names, doc = parse(names, doc)
        own, of = (names, doc) if level > 1 else (names[short[doc]], doc[short[doc]])
        h = _mix(own ^ _U(level * 0x632BE59BD9B4E019 % (1 << 64)))
        np.minimum.at(least, of * BINS + (h & _U(BINS - 1)).astype(np.int64), h >> _U(7))
    out = np.maximum((_mix(least) >> _U(48)).astype(np.uint16), 1)
    out[least == _NONE] = 0
    return out.reshape(len(texts), BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a to the row of b."""
    some = ((a | b) != 0).sum(axis=1)
    return np.where(some, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(some, 1), 1.0)


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _hex(fp: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in fp.astype(">u2")]


def fingerprint_documents(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and the fingerprint of every document."""
    schema = docs.select(*keep, F.lit("").alias("fingerprint")).schema

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(b.num_columns - 1).to_pylist()]
            prints: list[str] = []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                    size += len(texts[end])
                    end += 1
                prints += _hex(fingerprints(texts[at:end]))
                at = end
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints, pa.string())], names=[*keep, "fingerprint"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(each, schema)


COMPARED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: last, doc_id, text, in order; a row with `last` only ends the rows before it."""
    held: list[tuple[bool, int | None, str]] = []

    def done(rows: list[tuple[bool, int | None, str]]) -> pa.RecordBatch:
        texts = [t for *_, t in rows]
        use = [i for i in range(len(rows) - 1) if not rows[i][0]]
        new = [edited(texts[i], texts[i + 1]) for i in use]
        fp, ep = fingerprints(texts), fingerprints(new)
        own, after = fp[use], fp[[i + 1 for i in use]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in use], pa.int64()),
                pa.array([len(texts[i]) for i in use], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()),
                pa.array(_hex(own), pa.string()),
                pa.array(_hex(ep), pa.string()),
                pa.array(likeness(own, ep)),
                pa.array(likeness(own, after)),
            ],
            names=[x.split()[0] for x in COMPARED.split(", ")],
        )

    size = 0
    for b in batches:
        for i in range(b.num_rows):
            text = b.column(2)[i].as_py() or ""
            held.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), text))
            size += len(text)
            if size >= BATCH_CHARS and len(held) > 1:
                yield done(held)
                held, size = held[-1:], len(text)
    if len(held) > 1:
        yield done(held)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COMPARED for every document, by descending id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.lit(len(cuts) + 1)
    if cuts:
        above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col("doc_id")))
        part = F.when(F.col("doc_id").isNotNull(), above).otherwise(part)
    docs = docs.withColumn("part", part.cast("int")).withColumn("order", text_key())
    # The first document of each range ends the range before it; the very first one ends the last.
    heads = {r["part"]: r["id"] for r in docs.groupBy("part").agg(F.max("doc_id").alias("id")).collect()}
    used = sorted(heads)
    if not used:
        return spark.createDataFrame([], COMPARED)
    ends = F.create_map(*[F.lit(x) for i, p in enumerate(used) for x in (p, used[i - 1])])
    ids = [v for v in heads.values() if v is not None]
    is_head = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if None in heads.values():
        is_head = is_head | F.col("doc_id").isNull()
    last = docs.where(is_head).groupBy("part").agg(F.min(F.struct("order", "text")).alias("x"))
    last = last.select(ends[F.col("part")].alias("part"), F.lit(True).alias("last"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("order"), F.col("x.text").alias("text"))
    rows = docs.select("part", F.lit(False).alias("last"), "doc_id", "order", "text").unionByName(last)
    rows = rows.repartitionById(len(cuts) + 2, "part").sortWithinPartitions("part", "last", F.desc_nulls_last("doc_id"), "order")
    return rows.select("last", "doc_id", "text").mapInArrow(_compare, COMPARED)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprint": op3_fingerprint}
ORACLES: dict[str, str] = {}
