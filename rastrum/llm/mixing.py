"""Mixing sources to target weights, in DataFrame functions only.

One aggregate sums words by source. Targets come from weighted water-filling: a source gets its weight's share of the
budget, at most `cap` times its own size, and what is above goes to the others by weight. With rate = target / size a
document is emitted floor(rate) times, and once more if its hash-seeded draw falls below the rate's fraction, so with a
probability equal to it. A document's hash holds SEEDS such draws; a source takes the seed whose words come nearest to
its target, as words vary too much between documents for any one draw to hold a small source to it. Seed and limit
depend on the source alone, so texts are copied where they are read and never shuffled.

Cases: a null or blank text has size 0 and takes nothing; a source without words has target 0. A null source is a
source of its own, last in order. Rows that repeat a doc_id share its draws. The table of sources, one row each, is
ordered in one task; its rows number as many as there are sources. Very long texts are counted where they are read. An
empty table gives no rows. Other columns may have any names: they go along in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastrum.llm.common import WORD, as_row, checkpoint, table

WEIGHTS = (5, 2, 1)
#: Draws in a document's hash, each one of DRAWS values.
SEEDS, DRAWS = 16, 1 << 16
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def id_hash(id_col: str = "doc_id") -> Column:
    """64 hexadecimal digits from the seed and the id, four for each draw."""
    return F.sha2(F.concat(F.lit(SEED + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)


def draw(seed: int | Column) -> Column:
    """The draw with this seed, 0 to DRAWS - 1, from a column `hash`."""
    at = F.lit(seed) if isinstance(seed, int) else seed
    return F.conv(F.substring("hash", 4 * at + 1, F.lit(4)), 16, 10).cast("int")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target from rows (source, size)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    per = per.withColumn("weight", weight.cast("bigint"))
    # In the order of size over weight the sources that reach their caps come first. The level rises while sources
    # are capped and falls after, so its largest value is the level of the water.
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    spare = 3 * F.sum("source_size").over(whole) - 4 * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", spare.cast("double") / (2 * rest).cast("double"))
    per = per.withColumn("level", F.max("level").over(whole))
    return per.select("source", "source_size", F.least(2.0 * F.col("source_size"), F.col("level") * F.col("weight")).alias("target"))


#: Sources of which a table may be broadcast: one row of a few numbers each.
FEW_SOURCES = 10_000


def with_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows with the columns of their `source` in per, which has `source` too."""
    per = checkpoint(per.withColumnRenamed("source", "of"))
    side = F.broadcast(per) if per.count() <= FEW_SOURCES else per
    return rows.join(side, rows["source"].eqNullSafe(side["of"])).drop("of")


def mix_plan(sized: DataFrame) -> DataFrame:
    """Per source: source_size, target, base (copies of every document), limit (draws below it get one more) and seed.

    sized: source, size, hash.
    """
    targets = source_targets(sized)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = checkpoint(targets.withColumn("base", F.floor(rate)).withColumn("limit", (rate - F.col("base")) * DRAWS))
    rows = with_source(sized, targets)
    sums = [F.sum(F.when(draw(s) < F.col("limit"), F.col("size")).otherwise(0)).alias(f"more{s}") for s in range(SEEDS)]
    columns = ["source", "source_size", "target", "base", "limit"]
    rows = rows.groupBy(*columns).agg(*sums)
    off = F.array(*[F.struct(F.abs(F.col("base") * F.col("source_size") + F.col(f"more{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)])
    return rows.select(*columns, F.array_min(off)["seed"].alias("seed"))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(row, size, source_size, target, copies): the kept columns, by default all, of docs' rows, each as one struct, and how often the mix takes it."""
    row = as_row(docs if keep is None else docs.select(*keep)).alias("row")
    rows = docs.select(row, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(id_col).alias("hash"))
    # Sizes and hashes are few bytes of a row, and are counted in texts once for both passes over them.
    joined = with_source(rows, mix_plan(checkpoint(rows.select("source", "size", "hash"))))
    copies = F.col("base") + F.when(draw(F.col("seed")) < F.col("limit"), 1).otherwise(0)
    return joined.select("row", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: the columns of docs, each document as often as the mix takes it."""
    rows = with_copies(docs, id_col, text_col, source_col).where("copies > 0 AND size > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_copies(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         sha256('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')) AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER o, 0))::DOUBLE
            / (2 * (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)))::DOUBLE AS level
  FROM s WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, floor(rate)::BIGINT AS base, (rate - base) * {DRAWS} AS lim FROM t
), e AS (
  SELECT doc_id, d.source, size, source_size, target, base, lim, seed, ('0x' || substr(hash, 4 * seed + 1, 4))::INT AS draw
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, range({SEEDS}) x(seed)
), c AS (
  SELECT source, seed, abs(any_value(base) * any_value(source_size) + sum(CASE WHEN draw < lim THEN size ELSE 0 END) - any_value(target)) AS off FROM e GROUP BY source, seed
), best AS (
  SELECT source, seed FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, seed) = 1
)
SELECT e.doc_id, e.size, e.source_size, e.target, (e.size * (e.base + CASE WHEN e.draw < e.lim THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e JOIN best ON e.source IS NOT DISTINCT FROM best.source AND e.seed = best.seed
"""

QUERIES = {"op8_mix_sources": op8_mix_sources}
ORACLES = {"op8_mix_sources": ORACLE}
