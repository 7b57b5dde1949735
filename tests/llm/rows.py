"""Tables that the tests of this folder share."""
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, rank int"

#: Nulls in each column, empty, blank and long texts, ties, repeated rows, spaces in runs, special strings; extra
#: columns carry names that the operators use themselves.
HARD = [
    (1, "The quick brown fox jumps over the lazy dog. " * 4, "en", "a"), (2, None, "en", "a"), (3, "", None, None),
    (4, "  two  spaces \n and\ttabs ", "en", "b"), (5, "x" * 300, "en", "b"), (6, "word " * 30_000, "en", "a"),
    (7, "The quick brown fox jumps over the lazy dog. " * 4, "en", None), (8, "<|endoftext|> <s>▁a▁▁b</s> é 漢字 🙂", "xx", "c"),
    (9, "one", "en", "c"), (9, "one", "en", "c"), (10, "THE QUICK brown fox jumps over the lazy dog. " * 4, "en", "a"),
    (None, "no id here", "en", "a"), (11, "\x00\x0b\x0c\r\n", "en", "d"), (12, "ab" * 400, None, "d"),
]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame([(*r, 0, "d", 5, 1) for r in HARD], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
