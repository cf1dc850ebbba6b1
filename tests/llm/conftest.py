import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return FOLDER


@pytest.fixture(scope="session")
def texts(spark, folder):
    """(doc_id, text) of the smallest documents table."""
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, long and repeated texts, repeated rows, and columns whose names clash."""
    same = "a line that several of the documents share word for word and that is long enough to count as a repeat " * 2
    rows = [
        (1, "", "en", "s", 0),
        (2, None, None, None, None),
        (3, same, "en", "s", 7),
        (4, same, "en", "t", 7),
        (4, same, "en", "t", 7),
        (None, same, None, "t", 1),
        (None, None, None, None, None),
        (5, "é" * 70_000, "fr", "t", 1),
        (6, "one", "en", "s", 3),
        (7, "word " * 30_000, "en", "\U0001f600", 3),
        (8, "one", "en", "", 3),
        (9, " \t\n ", "en", "s", 3),
    ]
    clash = "component_id long, text_ string, slot int, `range` int, sequence_id long, copies int, `__id` int, n int, row int, size int"
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for column in clash.split(", "):
        name, kind = column.rsplit(" ", 1)
        frame = frame.withColumn(name.strip("`"), F.lit(1).cast(kind))
    return frame
