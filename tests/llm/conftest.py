import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, ids string, kept int"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, control characters, and columns whose names operators use too."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = [None, "", "   \n\t ", "one", "one two", "one two three four", "A b C\nA b C\nx", "🙂 é ß ½", long, long, "same text here", "same text here", None, "123 456", "x" * 5000, "l1\nl2\nl3\nl4", "l1\nl2\nl3\nl5"]
    rows = [(i, t, "en" if i % 2 else None, None, None, 1, "z", 0) for i, t in enumerate(texts)]
    rows.append(rows[10])  # a row that repeats with its id
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
