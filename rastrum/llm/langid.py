"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else between them becomes one space, and n-grams of one to three characters are
hashed into BUCKETS features. Document frequencies are counted over all rows that may be learned from. The weights are
trained by follow-the-regularised-leader with elastic-net penalties on a sample of at most about MAX_ROWS of these
rows (LEAST_ROWS a language, if there are very many), shared evenly among all languages and chosen by a hash of their
ids and texts; a fifth of the sample is kept back, and on it the temperature that divides the logits is fitted.
Documents are scored where they are read. The model holds BUCKETS weights for each language, which all are learned, so
it is made for the thousand or so languages there are.

Cases: a null text, or one without a letter, is `und` with score 0; so is every text if nothing can be learned. Very
long texts are counted whole. Rows with a null id, null language or null text are not learned from; a row with a null
id is not held out. Rows that repeat an id and text are learned from once, and scored one by one. Of equally likely
languages the first by code point wins. An empty table gives no rows. Other columns may have any names: they go along
in one struct.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.common import as_row, table

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: The bound of the training sample, shared among the languages, and the rows of each that are taken in any case.
MAX_ROWS, LEAST_ROWS = 4000, 8
EPOCHS, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 0.02, 1e-4
UNKNOWN = "und"
HOLD_OUT = (4, 2)


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The n-gram features of a text and their counts; None if it has no letter."""
    a = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[a]
    if not letter.any():
        return None
    a = np.where(letter, a, np.uint32(32))
    keep = np.r_[True, letter[1:] | letter[:-1]]
    a = np.r_[np.uint32(32), a[keep], np.uint32(32)]
    shift = np.uint32(32 - BUCKET_BITS)
    h = a * np.uint32(0x9E3779B1)
    grams = [h >> shift]
    for n in (1, 2):
        if len(a) > n:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + a[n:] * np.uint32(0xC2B2AE3D)
            grams.append(((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> shift)
    counts = np.bincount(np.concatenate(grams), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1, languages), the last row the intercepts
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / (np.sqrt(x @ x) or 1.0)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.weights[BUCKETS]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = ngram_counts(text) if self.langs else None
        if found is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*found) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(min(1.0, p[k]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(langs: list[str], idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """FTRL-proximal over the rows (features, counts, language), then the temperature on every fifth of them."""
    model = Model(langs, idf, np.zeros((BUCKETS + 1, len(langs))))
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    held = [r for i, r in enumerate(rows) if i % 5 == 4 and len(rows) >= 20]
    train = [r for i, r in enumerate(rows) if not (i % 5 == 4 and len(rows) >= 20)]
    l1 = np.full((BUCKETS + 1, 1), L1)
    l1[BUCKETS] = 0
    ready = [(np.r_[at, BUCKETS], np.r_[model.vector(at, c), 1.0], y) for at, c, y in train]
    for _ in range(EPOCHS):
        for at, x, y in ready:
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= l1[at], 0.0, -(za - np.sign(za) * l1[at]) / ((BETA + np.sqrt(na)) / ALPHA + L2))
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[at] += g - (np.sqrt(na + g2) - np.sqrt(na)) / ALPHA * w
            n[at] += g2
    model.weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    if held:
        logits, ys = np.array([model.logits(at, c) for at, c, _ in held]), np.array([y for *_, y in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(ys)), ys], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _document_frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS + 1, np.int64), 0
    for b in batches:
        for x in b.column(0):
            if (found := ngram_counts(x.as_py())) is not None:
                df[found[0]] += 1
                n += 1
    df[BUCKETS] = n
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "df"])


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            if (found := ngram_counts(b.column(0)[i].as_py())) is not None:
                at, c = found
                yield pa.RecordBatch.from_pylist([{"at": at.astype(np.uint16).tobytes(), "counts": c.astype(np.uint32).tobytes(), "lang": b.column(1)[i].as_py(), "draw": b.column(2)[i].as_py()}])


def train(rows: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """rows: id, text, lang, of which all may be learned from."""
    rows = rows.select("id", "text", "lang").where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts, key=lambda s: s.encode())
    df = rows.select("text").mapInArrow(_document_frequencies, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    seen = np.zeros(BUCKETS + 1)
    for r in df:
        seen[r["bucket"]] = r["df"]
    idf = np.log((1 + seen[BUCKETS]) / (1 + seen[:BUCKETS])) + 1
    if not langs:
        return Model([], idf, np.zeros((BUCKETS + 1, 0)))
    share = max(LEAST_ROWS, max_rows / len(langs))
    limits = _limits(rows.sparkSession, {k: min(1.0, share / n) for k, n in counts.items()})
    # The draw is of id and text, so rows that repeat an id do not come together; repeats of a row are one.
    draw = F.xxhash64("id", "text")
    drawn = rows.withColumn("draw", draw).join(limits, "lang").where(F.pmod(F.xxhash64(F.lit("langid"), "draw"), F.lit(1 << 30)) < F.col("limit"))
    sample = drawn.select("text", "lang", "draw").dropDuplicates(["draw", "lang"])
    got = sample.mapInArrow(_features, "at binary, counts binary, lang string, draw bigint").collect()
    got.sort(key=lambda r: (r["draw"], r["lang"]))
    index = {k: i for i, k in enumerate(langs)}
    return fit(langs, idf, [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.uint32).astype(np.float64), index[r["lang"]]) for r in got])


def _limits(spark: SparkSession, shares: dict[str, float]) -> DataFrame:
    """The draws below which a language's rows are in the sample; one row a language."""
    return F.broadcast(spark.createDataFrame([(k, int(v * (1 << 30))) for k, v in shares.items()], "lang string, limit bigint"))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score): the kept columns, by default all, of docs' rows, each as one struct, and what is told of their text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(as_row(docs if keep is None else docs.select(*keep)).alias("row"), F.col(text_col).alias("text"))
    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(x.as_py()) for x in b.column(1)]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(each, schema)


def remainder(id_col: str, mod: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mod, held = HOLD_OUT
    r = remainder("doc_id", mod)
    model = train(docs.where(r != held).select(F.col("doc_id").alias("id"), "text", "lang"))
    rows = docs.select("doc_id", F.coalesce(r == held, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model, keep=["doc_id", "held_out"]).select("row.*", "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
