import pytest

CLASHING = ("id", "sha", "half", "again", "n", "node", "label", "rank", "cell", "epoch", "bucket", "host",
            "domain", "maybe", "language", "evidence", "words", "draw", "whole", "tokens", "share")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang, source) rows."""

    def make(rows, extra=False):
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            df = df.select("*", *(F.lit(f"x-{c}").alias(c) for c in CLASHING))
        return df.repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    """NULLs in every column, empty and very long texts, ties and repeated rows, clashing names."""
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "one", "en", None),
        (5, "One", "fr", "a"), (6, "one", "en", "b"), (7, long, "en", "b"), (8, long + " end", "de", "b"),
        (9, "the cat and the dog sat on the mat in the sun", "en", "a"),
        (9, "the cat and the dog sat on the mat in the sun", "en", "a"),
        (None, "the cat and the dog sat on the mat in the sun", "en", "a"), (None, None, None, None),
        (10, "Ünïcode é 漢字 \x00 <|endoftext|> x", "fr", "c"), (11, "a b c", "fr", "c"), (11, "a b d", "fr", "c"),
    ]
    return docs_of(rows, extra=True)


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])
