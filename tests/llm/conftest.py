import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int"


@pytest.fixture()
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    text = " ".join(f"word{k % 97} turn{k % 13}" for k in range(400))
    rows = [
        (1, text, "en", "a", len(text), "x", 1), (2, text + " end", "en", "a", 1, "x", 1), (2, text + " end", "en", "a", 1, "x", 1), (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "", 0), (None, "some words of no id", None, "b", None, None, None), (5, "long " * 50_000, "en", "b", 250_000, "", 0), (6, "two words", "", "", 9, "", 0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
