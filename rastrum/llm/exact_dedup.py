"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are equal when they are identical after all ASCII spaces are deleted. Three passes refine the groups: rows are
grouped by the length of what is left; those whose length another row has, by a hash of their first characters too; and
only those that still share a group are hashed in full. Between the passes the surviving groups are bit maps of bounded
size, so no text moves: only ids, counts and hashes are shuffled. A group that holds more than one in HOT_SHARE of all
rows is not dealt by its hash: there are fewer than HOT_SHARE of them, and their verdicts are broadcast.

Cases: a null text counts as empty, and all empty texts are equal. Very long texts are hashed where they are read. Of
equal texts the one with the most code points before the deletion stays, then the one with the smallest doc_id; a null
doc_id is larger than any other. Rows that repeat a doc_id count one by one in group_size and share a verdict. An empty
table gives no rows. Other columns may have any names: only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.common import BitMap, checkpoint, no_spaces, table

PREFIX_CHARS = 64
HOT_SHARE = 1000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, and the columns of `carry`, functions of the text without spaces."""
    carry = carry or {}
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("id", F.length("text").cast("bigint").alias("chars"), no_spaces(F.col("text")).alias("norm"))
    size, head = F.length("norm"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS))

    def shared(rows: DataFrame, *keys: Column) -> tuple[BitMap, Column]:
        """A bit map of the groups of more than one row, and the column to hold against it."""
        names = [f"k{i}" for i in range(len(keys))]
        groups = rows.groupBy(*(k.alias(n) for k, n in zip(keys, names))).count().where("count > 1")
        left = checkpoint(groups.select(F.xxhash64(*names).alias("group")))
        return BitMap(left, "group", left.count()), F.xxhash64(*keys)

    lengths, by_length = shared(base, size)
    heads, by_head = shared(lengths.flag(base, by_length, "more").where("more"), size, head)

    # Full hash, of survivors only; every row goes on with its id, its length and what is carried.
    rows = heads.flag(base, by_head, "more")
    full = F.when(F.col("more"), F.unhex(F.sha2("norm", 256))).alias("full")
    rows = checkpoint(rows.select("id", "chars", full, F.struct(F.lit(0).alias("none"), *[e(F.col("norm")).alias(k) for k, e in carry.items()]).alias("carried")))
    # ~id falls as id rises, without overflow; whether there is an id makes a null one the last choice.
    best = F.max(F.struct("chars", F.col("id").isNotNull().alias("has"), F.bitwise_not("id").alias("rev")))
    found = rows.where("full IS NOT NULL").groupBy("full").agg(best.alias("best"), F.count("*").alias("n"))
    found = checkpoint(found.where("n > 1").select("full", F.bitwise_not("best.rev").alias("keep"), "n"))
    hot = found.where(F.col("n") > rows.count() / HOT_SHARE).select("full", F.struct("keep", "n").alias("of"))
    rows = rows.join(F.broadcast(hot), "full", "left")
    dealt = rows.where("of IS NULL AND full IS NOT NULL").drop("of").join(found.select("full", F.struct("keep", "n").alias("of")), "full", "left")
    out = rows.where("of IS NOT NULL OR full IS NULL").unionByName(dealt)
    keep = F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("of.keep"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("of.n", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        *[F.col("carried").getField(k).alias(k) for k in carry],
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": lambda norm: F.sha2(norm, 256)})


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
       text_sha256
FROM n
"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {"op7_exact_dedup": ORACLE}
