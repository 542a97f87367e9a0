import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

ODD_TEXTS = [
    None, "", " \n\t ", "one", "a b", "a b c", "Ein Test, noch einer!", "It's 3.5% of l'été…",
    "<|endoftext|> plain", "x" * 70_000, "wide　space\x1cand more", "same words here " * 30, "same words here " * 30,
]


@pytest.fixture
def odd(spark):
    """Nulls, empties, a very long word, repeated rows and ids, and columns with clashing names."""
    rows = [(i, t, "en", "s", len(t) if t else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (None, "no id at all", None, None, None), (3, "another text of id three", None, None, 1)]
    made = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for clash in ("part", "nth", "rank", "n", "k", "length", "shard", "kept", "start", "n_words", "_row", "node", "other"):
        made = made.withColumn(clash, F.lit("x"))
    return made.repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
