"""A corpus pipeline of five text operators; each stage takes and returns a DataFrame of documents.

Cases, for all stages: null texts are documents without a letter, so language ID takes them out; later stages keep them
as they are until mixing, which takes nothing of texts without words. Very long texts are worked on whole. Rows that
repeat an id and text are treated alike, and near-dedup keeps one of them. Columns beside those of documents go along,
whatever their names, up to the last stage. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm import bpe, langid, line_dedup, mixing, simhash
from rastrum.llm.common import Tables, as_row, checkpoint, table, text_key

#: Documents whose language is told with less confidence than this, or not at all, go.
LEAST_CONFIDENCE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language known with confidence, go. Learned from the labels of docs."""
    model = langid.train(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CONFIDENCE)).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go, and documents that keep none; n_chars follows the text."""
    rows = line_dedup.dedup_lines(docs).select(as_row(docs).alias("row"))
    new = F.col("row").withField("n_chars", F.length("row.text").cast("bigint"))
    return rows.select(new.alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of rows that repeat its id and text, one."""
    classes = simhash.simhash_components(docs, ["doc_id"]).select(F.col("row.doc_id").alias("id"), "component_id")
    stays = checkpoint(classes.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id").agg(F.count("*").alias("n")))
    rows = docs.select(as_row(docs).alias("row"), F.col("doc_id").alias("own"), text_key().alias("key"))
    rows = rows.join(stays, F.col("own").eqNullSafe(F.col("id"))).select("row", "own", "key", (F.col("n") > 1).alias("repeated"))
    once = rows.where("repeated").groupBy("own", "key").agg(F.first("row").alias("row"))
    return rows.where("NOT repeated").select("row").unionByName(once.select("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hash of the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], outputs=["n_tokens", "ids", "decoded_sha256"])


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Language scores, SimHash and BPE are not SQL; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written to the shared folder and read again, and goes when the next one is written."""
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.write(docs, str(k))
            tables.drop(*[str(k - 1)] * bool(k))
    return docs
