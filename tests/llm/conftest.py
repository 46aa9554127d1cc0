import public_tokenizers
import pytest

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Nulls, empty and odd texts, ties and repeated rows; the other columns clash with names that operators use.
TEXTS = [
    (1, "Plain words, and a few more of them."), (2, None), (3, ""), (4, "  \n\n\n x  y \t z "), (5, "Plain words, and a few more of them."),
    (1, "Plain words, and a few more of them."), (None, "No id here"), (7, "naïve – “quotes” 日本語 \U0001f600 <|endoftext|> it's"),
    (8, "word " * 3000 + "end"), (9, "x" * 5000), (10, "\x01 a\x01b \x1c c\x85d e"), (None, None), (2, None),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "id", 7, 1.5, "blob", 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, node int, score double, blob string, n_tokens int").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
