"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 20_000

EDGE = [
    (1, None, "en", "web", None), (2, "", None, None, 0), (3, " \t\n\x0b\x0c\r ", "en", "web", 7), (4, "one", "de", None, 3), (5, "one two", "de", "web", 7),
    (6, LONG, "en", "books", len(LONG)), (7, "Mail JANE.doe+x@mail.example.org or +49 (30) 1234-5678, 10.0.0.300, 192.168.001.7; card 4111 1111-1111 1111.", "en", "web", 9),
    (8, "same text for a tie " * 20, "en", "web", 9), (9, "same text for a tie " * 20, "en", "web", 9), (9, "same text for a tie " * 20, "en", "web", 9),
    (None, "no id at all, but text enough to count as a document here", "fr", "web", 1), (10, "Ünïcode ΣΑΣ 日本語 🙂 <|endoftext|> a<|startoftext|>b  two  spaces \n\n\x1c odd\x85white　space", None, "web", 1),
    (11, "line\nline\nline\n\n  \nother # * $ % & | < >", "en", "aé", 1), (12, "12345 67890 !!! ...", "en", "web", 1), (13, "one", "de", None, 3), (-5, "ONE", "de", "web", 3),
    (14, "퟿�\U0010ffff \U0001f468‍\U0001f469 é İstanbul", "tr", "web", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Extra columns have names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("_g", "_h", "_s", "fp", "node", "root", "term", "_doc", "_id", "_spans", "_all", "_clean", "_size", "size", "repeats", "held_out", "score", "n_words", "kept", "_d2", "_x0")
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit(c) for c in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()
