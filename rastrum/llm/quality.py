"""Quality classifier: a generalised additive model with pairwise interactions.

Plain measures of a text are cut into bins. Boosting goes through the measures in turn, again and again; each turn fits
a shallow tree of one measure to the gradient and adds it, shrunk, to that measure's lookup table. The pairs of
measures whose joint bins explain most of what is left are boosted in the same way on grids. A score is the logistic
function of an intercept and the looked-up entries, summed for whole batches at once.

The model is fitted on a sample of at most about MAX_ROWS labelled rows, chosen by a hash of their ids; every document
is scored where it is read.

Cases: a null text counts as empty, and an empty text is scored as any other. Very long texts are measured whole.
Labels that are null, or of ids without a document, are not learned from; repeats of an id's text and label count once.
A row with a null id is not held out. Without labelled rows of both kinds the score is the share of ones (0.5 without
any). Repeated rows are scored one by one. An empty table gives no rows. Other columns may have any names: they go
along in one struct.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.common import as_row, table
from rastrum.llm.langid import remainder

#: The bound of the training sample.
MAX_ROWS = 20_000
BINS, GRID = 64, 8
ROUNDS, RATE, LEAVES, PAIR_ROUNDS, PAIRS = 60, 0.15, 3, 20, 6
SMOOTH = 5.0
HOLD_OUT = (3, 1)
FEATURES = (
    "chars", "words", "word_length", "lines", "line_words", "upper", "digits", "marks", "end_marks", "distinct_words",
    "repeats", "top_word", "distinct_lines", "pipes", "odd_ends", "sentence_words", "symbols",
)
_SYMBOL = re.compile(r"[#%&$*|<>{}\[\]=~^\\/_@+]")
_END = re.compile(r"[.!?](?=\s|$)")
_ODD_END = re.compile(r"[^\w\s.,;:!?)\"'»]+(?=\s|$)|!!(?=\s|$)")


def measures(text: str | None) -> list[float]:
    """The FEATURES of a text; shares are of its characters, words or lines, and 0 without any."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, w, m = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    letters = "".join(words)
    upper = sum(1 for x in words if x.isupper())
    digits = sum(1 for x in words if any("0" <= c <= "9" for c in x))
    counts = Counter(words)
    ends = len(_END.findall(text))
    return [
        float(len(text)),
        float(len(words)),
        len(letters) / w,
        float(len(lines)),
        len(words) / m,
        upper / w,
        digits / w,
        sum(map(text.count, ",.;:!?'\"")) / n,
        ends / w,
        len(counts) / w,
        sum(1 for a, b in zip(words, words[1:]) if a == b) / w,
        max(counts.values(), default=0) / w,
        len(set(lines)) / m,
        text.count("|") / w,
        len(_ODD_END.findall(text)) / w,
        len(words) / max(1, ends),
        len(_SYMBOL.findall(text)) / n,
    ]


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grid_edges: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            z += t[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for (i, j), g in zip(self.pairs, self.grids):
            z += g[np.searchsorted(self.grid_edges[i], x[:, i], side="right"), np.searchsorted(self.grid_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Of a shallow tree over ordered bins with gradient and curvature sums: each bin's leaf value."""
    cuts = [0, len(g)]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + SMOOTH)
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                s = np.arange(a + 1, b)
                gain = value(a, s) + value(s, b) - value(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, at = gain[k], int(s[k])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + SMOOTH)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    n = len(y)
    if not n or y.min() == y.max():
        p = (y.sum() + 0.5) / (n + 1) if n else 0.5
        return Model(float(np.log(p / (1 - p))))
    m = Model(float(np.log(y.mean() / (1 - y.mean()))))
    k = x.shape[1]
    m.edges = [_edges(x[:, f], BINS) for f in range(k)]
    m.grid_edges = [_edges(x[:, f], GRID) for f in range(k)]
    fine = [np.searchsorted(m.edges[f], x[:, f], side="right") for f in range(k)]
    coarse = [np.searchsorted(m.grid_edges[f], x[:, f], side="right") for f in range(k)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    z = np.full(n, m.intercept)

    def sums(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(cells, y - p, size), np.bincount(cells, p * (1 - p), size)

    for _ in range(ROUNDS):
        for f in range(k):
            step = RATE * _tree(*sums(fine[f], len(m.tables[f])), LEAVES)
            m.tables[f] += step
            z += step[fine[f]]
    width = [len(e) + 1 for e in m.grid_edges]
    gains = []
    for i, j in combinations(range(k), 2):
        g, h = sums(coarse[i] * width[j] + coarse[j], width[i] * width[j])
        gains.append((float((g * g / (h + SMOOTH)).sum()), i, j))
    m.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    m.grids = [np.zeros((width[i], width[j])) for i, j in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), grid in zip(m.pairs, m.grids):
            g, h = (s.reshape(grid.shape) for s in sums(coarse[i] * width[j] + coarse[j], grid.size))
            # a tree of depth two: one cut of the first measure, and on each side one of the second
            cut = _tree(g.sum(axis=1), h.sum(axis=1), 2)
            side = cut != cut[0]
            step = np.zeros_like(grid)
            for rows in (~side, side):
                if rows.any():
                    step[rows] = RATE * _tree(g[rows].sum(axis=0), h[rows].sum(axis=0), 2)
            grid += step
            z += step[coarse[i], coarse[j]]
    return m


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """docs: id, text; labels: id, label (0 or 1), all of which may be learned from."""
    # Labels of one id are one row, however often they are repeated.
    labels = labels.where(F.col("id").isNotNull() & F.col("label").isNotNull()).select("id", "label").distinct()
    total = labels.count()
    limit = int(min(1.0, max_rows / max(1, total)) * (1 << 30))
    sample = labels.where(F.pmod(F.xxhash64(F.lit("quality"), F.col("id")), F.lit(1 << 30)) < limit)
    # At most about MAX_ROWS rows of two numbers, by the limit above.
    rows = docs.join(F.broadcast(sample.select("id", F.col("label").cast("double").alias("label"))), "id")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [measures(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "label", "draw"])

    rows = rows.select("text", "label", F.xxhash64("id", "text").alias("draw")).dropDuplicates(["draw", "label"])
    got = rows.mapInArrow(each, "x array<double>, label double, draw bigint").collect()
    got.sort(key=lambda r: (r["draw"], r["label"]))
    return fit(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in got]))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, score): the kept columns, by default all, of docs' rows, each as one struct, and the score of their text."""
    rows = docs.select(as_row(docs if keep is None else docs.select(*keep)).alias("row"), F.col(text_col).alias("text"))
    schema = rows.select("row", F.lit(0.0).alias("score")).schema

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([measures(t.as_py()) for t in b.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["row", "score"])

    return rows.mapInArrow(each, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mod, held = HOLD_OUT
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", mod) != held)
    model = train(docs.select(F.col("doc_id").alias("id"), "text"), labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")))
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "text")
    return score(rows, model, keep=["doc_id", "held_out"]).select("row.*", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
