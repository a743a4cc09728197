"""SimHash near-deduplication with bit-sliced comparison.

A text's ASCII letters are lower-cased and its words (runs without ASCII spaces) taken in shingles of three; a text of
fewer words is one shingle, one without words has fingerprint zero. A bit is set if it is in over half of the shingles'
XXH64 hashes, repeats counted. Fingerprints link at `radius` differing bits or fewer.

Documents are reduced to distinct fingerprints. Those cut into radius + j blocks agree on j of them if they are within
the radius, so every choice of j blocks is a table of buckets; j grows with the number of fingerprints, which keeps
buckets small. A bucket of more than TILE fingerprints is split into tiles, and pairs of tiles are compared by tasks of
their own. Within a bucket the bits stand vertically, one plane of words for each bit; all pairs at one distance in the
bucket are compared at once, with a carry-save counter of differing bits in each lane. Words are left as soon as all
their lanes exceed the radius. Pairs that are already connected are not compared again, so a bucket of near copies
costs little more than its size, and it returns a forest, never all its pairs.

Cases: a null text counts as empty. Very long texts are hashed whole, HASHES_AT_ONCE shingles at a time. Repeated rows
share a fingerprint and a component. component_id is the smallest doc_id reachable, null only if no document of the
component has an id. An empty table gives no rows. Other columns may have any names: those kept go along in one struct.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.common import as_row, checkpoint, table
from rastrum.llm.components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of a bucket that are compared in one group; more are split. Fingerprints that a bucket should hold.
TILE, WANTED = 2048, 256
#: Rows that are compared together, in groups that are not split between batches.
BATCH_ROWS = 1 << 16
HASHES_AT_ONCE = 1 << 16
HOT_SHARE = 1000


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # for bytes both mean ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        parts = [b" ".join(words)]
    else:
        parts = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    digest = xxhash.xxh64_digest
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(parts), HASHES_AT_ONCE):
        h = np.frombuffer(b"".join([digest(p, SEED) for p in parts[i : i + HASHES_AT_ONCE]]), np.uint8)
        count += np.unpackbits(h.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(parts)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """(row, fp): the kept columns of docs' rows, each as one struct, and the fingerprint as a signed 64-bit number."""
    rows = docs.select(as_row(docs.select(*keep)).alias("row"), F.col(text_col).alias("text"))
    schema = rows.select("row", F.lit(0).cast("bigint").alias("fp")).schema

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(x.as_py())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["row", "fp"])

    return rows.mapInArrow(each, schema)


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the tables: those of the least j with which buckets of n fingerprints hold about WANTED or fewer."""
    for j in (1, 2, 3, 4):
        m = radius + j
        edges = [round(i * BITS / m) for i in range(m + 1)]
        blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(m)]
        masks = [sum(x) for x in combinations(blocks, j)]
        if n / 2.0 ** min(bin(x).count("1") for x in masks) <= WANTED:
            break
    return masks


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane p is bit p of fingerprint 64 w + i; two words of zeros at the end."""
    n = len(fp)
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    wide = np.zeros((BITS, (n + 63) // 64 * 8 + 16), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def _words(flags: np.ndarray) -> np.ndarray:
    packed = np.packbits(flags, bitorder="little")
    out = np.zeros((len(flags) + 63) // 64 * 8, np.uint8)
    out[: len(packed)] = packed
    return out.view(np.uint64)


def near_pairs(planes: np.ndarray, wanted: np.ndarray, d: int, radius: int = RADIUS) -> np.ndarray:
    """Those rows i of the wanted ones (flags) whose fingerprint is within the radius of row i + d."""
    lanes = _words(wanted)
    at = np.flatnonzero(lanes)
    lanes = lanes[at]
    q, r = d >> 6, np.uint64(d & 63)
    up = np.uint64(64) - r
    counter = [np.zeros(len(at), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(at), np.uint64)
    # the counter's start makes it overflow at radius + 1
    start = (1 << len(counter)) - 1 - radius
    for i, c in enumerate(counter):
        if start >> i & 1:
            c[:] = ~np.uint64(0)
    for p in range(BITS):
        plane = planes[p]
        other = plane[at + q]
        if r:
            other = (other >> r) | (plane[at + q + 1] << up)
        carry = plane[at] ^ other
        for i, c in enumerate(counter):
            counter[i], carry = c ^ carry, c & carry
        over |= carry
        if p & 7 == 7:
            live = (lanes & ~over) != 0
            if not live.all():
                at, lanes, over = at[live], lanes[live], over[live]
                counter = [c[live] for c in counter]
                if not len(at):
                    return at
    hits = np.unpackbits((lanes & ~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, bit = np.nonzero(hits)
    return at[w] * 64 + bit


def forest(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the first row of its connected set within its group; rows of a group stand together."""
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    order = np.argsort(-sizes, kind="stable")  # large groups first: those larger than d are then a prefix
    rows = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in order]) if n else np.zeros(0, int)
    fp, size = fp[rows], np.repeat(sizes[order], sizes[order])
    gid = np.repeat(np.arange(len(order)), sizes[order])
    planes, root = bit_planes(fp), np.arange(n)
    for d in range(1, int(size[0]) if n else 0):
        m = int(np.searchsorted(-size, -d, side="left"))  # rows of groups larger than d
        wanted = (gid[: m - d] == gid[d:m]) & (root[: m - d] != root[d:m])
        if not wanted.any():
            continue
        hits = near_pairs(planes, wanted, d, radius)
        if not len(hits):
            continue
        for i in hits.tolist():
            a, b = i, i + d
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
        while not np.array_equal(root, up := root[root]):
            root = up
    out = np.empty(n, np.int64)
    out[rows] = rows[root]
    return out


def _link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links of a spanning forest. In: fp, then the group's columns, sorted by these."""
    held: list[np.ndarray] = []

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.r_[True, (rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)])
        fp = np.ascontiguousarray(rows[:, 0])
        root = forest(fp.view(np.uint64), group)
        own = np.flatnonzero(root != np.arange(len(root)))
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], names=["a", "b"])

    size = 0
    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1))
        size += b.num_rows
        if size >= BATCH_ROWS:
            rows = np.concatenate(held)
            changes = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)) + 1
            if len(changes):
                yield from done(rows[: changes[-1]])
                rows = rows[changes[-1] :]
            held, size = [rows], len(rows)
    if size:
        yield from done(np.concatenate(held))


def near_links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect what is within the radius. fps: distinct `fp`, n of them."""
    masks = block_masks(n, radius)
    tables = F.array(*[F.struct(F.lit(i).cast("bigint").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    large = rows.groupBy("t", "key").count().where(F.col("count") > TILE).select("t", "key", F.ceil(F.col("count") / TILE).alias("tiles"))
    rows = rows.join(large, ["t", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tile = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("tiles"))
    rows = rows.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    rows = rows.select("fp", "t", "key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    keys = ["t", "key", "lo", "hi"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link, "a bigint, b bigint")


def simhash_components(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(row, fp, component_id) of every document: the kept columns (the id among them) as one struct, fingerprint and component."""
    rows = checkpoint(with_fingerprints(docs, keep, text_col))
    fps = checkpoint(rows.groupBy("fp").agg(F.min(F.col("row").getField(id_col)).alias("first"), F.count("*").alias("n")))
    totals = fps.agg(F.count("*").alias("fps"), F.sum("n").alias("rows")).first()
    roots = connected_components(near_links(fps.select("fp"), totals["fps"], radius), "a", "b")
    classes = checkpoint(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root")))
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = checkpoint(classes.join(ids, "root").select("fp", "n", "component_id"))
    # Fingerprints of more than one row in HOT_SHARE, of which there are fewer than HOT_SHARE, are broadcast.
    hot = F.col("n") > (totals["rows"] or 0) / HOT_SHARE
    out = rows.join(F.broadcast(classes.where(hot).select("fp", F.struct("component_id").alias("of"))), "fp", "left")
    few = out.where("of IS NULL").drop("of").join(classes.where(~hot).select("fp", F.struct("component_id").alias("of")), "fp")
    return out.where("of IS NOT NULL").unionByName(few).select("row", "fp", "of.component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
