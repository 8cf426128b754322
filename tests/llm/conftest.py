import pytest

#: (doc_id, text, lang, source): nulls, empty and long texts, repeats, ties, accents.
LONG = " ".join(f"word{i % 977} item{i % 13}" for i in range(20_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly examine forty purple boxes under a dim lamp near the old stone bridge"
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE + " today", "en", "b"),
    (4, BASE.upper(), "fr", None),
    (5, None, None, None),
    (6, "", "en", "c"),
    (7, " \n\t ", "de", "c"),
    (8, "one two", "en", "c"),
    (9, "One TWO", "en", "c"),
    (10, LONG, "en", "a"),
    (11, LONG + " end", "en", "b"),
    (12, "dup line here\ndup line here\nother ##$$ line\n", "es", "b"),
    (13, "Éa é́ naïve ß 漢字 テスト 😀 <|endoftext|> don't we'll", "fr", "c"),
    (14, "a b c d e a b c d e a b c d e x", "en", "b"),
    (14, "a b c d e a b c d e a b c d e x", "en", "b"),
    (None, "no key at all but some words here", "en", "a"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows, with extra columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return d.withColumns({"key": F.lit("x"), "n": F.lit(1), "rank": F.lit(2), "c1": F.lit(3), "word": F.lit("w")}).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
