import random

import pytest

WORDS = [f"w{i}" for i in range(60)]
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture
def make(spark):
    """A documents table of (doc_id, text) rows, with columns that clash with inner names."""

    def run(rows, extra=("_doc", "tid", "size", "key", "rep", "words", "label", "score")):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id BIGINT, text STRING")
        return df.withColumns({c: F.lit("x") for c in extra})

    return run


@pytest.fixture
def odd_rows():
    """Nulls, empty, blank, tied, repeated and long texts."""
    long = " ".join(random.Random(1).choices(WORDS, k=30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Same text here twice over"), (6, "Same text here twice over"),
            (7, long), (7, long), (None, "a row without an id of its own"), (8, "... !!! ???"), (9, "é ß ñ 你 🙂")]
