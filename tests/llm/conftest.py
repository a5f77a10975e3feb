import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, row string, kept_text string, n_words int, target int, component string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long_text = "\n".join(f"word{i % 977} and other{i % 31} things you idiot, number {i}" for i in range(4000))
    same = "a line that three documents share\nand their own line"
    texts = [None, "", " \t\n", "one", "two words", long_text, long_text, same, same, same + " x", "ÀÉ ünïcode ß İ Σ 漢字", "!!! ???", "a\r\nb\x0bc\x0cd", "x" * 30000]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", None, 0.5, i, "r", "k", 1, 2, "c") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id here", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
