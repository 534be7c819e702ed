import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(9000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("no", T.StringType()), T.StructField("score", T.StringType())])
    extra = ("a", "b", "c", "d", "e")
    same = "The same few words stand here twice over, and that is all there is to it."
    rows = [(1, None, None, None, None, *extra), (2, "", "en", "s", 0, *extra), (3, " \n\t ", "en", "s", 4, *extra), (4, same, "en", "s", 9, *extra), (4, same, "en", "s", 9, *extra), (None, same, None, "s", 9, *extra), (5, LONG, "en", None, None, *extra), (6, LONG + " tail", "en", None, None, *extra), (7, "x" * 5000, "de", "s", 5000, *extra), (8, "漢字 é ▁ 🎉\x00", "de", "s", 9, *extra)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
