import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A frame of documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, partitions=3):
        full = [(r + (None, None))[:4] if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full], SCHEMA)
        # Columns with names that operators might use themselves.
        return df.repartition(partitions).withColumns({"fp": F.lit(1), "key": F.lit("x"), "size": F.lit(2), "score": F.lit(0.5), "k": F.lit(3)})

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    long_ = "word " * 30_000 + "x" * 50_000
    return docs_of(
        [
            (1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t ", None, "b"), (4, "One two three four five six.\nThe end.", "en", "a"),
            (5, "One two three four five six.\nThe end.", "en", "a"), (5, "One two three four five six.\nThe end.", "en", "a"), (6, long_, "de", "a"), (None, "No id here at all, none.", "en", "c"),
            (7, "été 😀 naïve 中文", "fr", "b"), (8, "1234 5678", "en", "b"), (9, "a", "en", "b"), (10, "One two three four five six. \nThe end.", None, "b"),
        ]
    )
