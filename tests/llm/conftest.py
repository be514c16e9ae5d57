import pytest

NASTY = [
    (1, None, "en", None),
    (2, "", "en", "a"),
    (3, " \n\t ", None, "a"),
    (None, "the words of a document without an id, mail x.y@a.example or call +1 (202) 555-0143", "en", "b"),
    (4, "Tschüß 😀 naïve 4539 1488 0343 6467 end 10.0.0.256 and 10.0.0.255", "de", None),
    (5, "dup text here again and again and again", "en", "c"),
    (5, "dup text here again and again and again", "en", "c"),
    (6, "dup text here again and again and again", "fr", "c"),
    (7, "lorem ipsum dolor " * 40_000, "la", "long"),
    (8, "<|endoftext|>  two  blanks\n\n ", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["n_chars", "score", "fingerprint", "shard", "component_id", "piece", "labels"]
    return spark.createDataFrame(NASTY, SCHEMA).withColumns({n: F.lit(1).cast("long") for n in names}).repartition(3)


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.where("false").coalesce(1)
