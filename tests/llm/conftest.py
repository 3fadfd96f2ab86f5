import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test data")
    return DATA


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with results."""
    long = " ".join(f"word{i % 997} the" for i in range(30_000))
    rows = [(1, "one two three four five six seven", 0), (1, "one two three four five six seven", 0), (2, None, 1), (3, "", 2),
            (None, "no id at all", 3), (4, long, 4), (5, "日本語 text, with 😀 marks!\n\n  two   spaces", 5), (6, "12345 !!! ???", 6),
            (7, long + " end", 7), (8, "ONE two three four five six seven", 8), (9, " \n\t ", 9), (5, "another text of five", 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int").withColumnRenamed("score", "n_tokens")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, label int, embedding array<float>")
