"""Small tables with the awkward rows that every operator must take."""

import pyarrow.parquet as pq
from pyspark.sql import types as T

CLASHING = ("__t", "__id", "__sha", "__row", "__chars", "__none", "__salt")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators may use inside
    T.StructField("size", T.StringType()), T.StructField("kept", T.LongType()), T.StructField("n_words", T.StringType()),
    *(T.StructField(n, T.StringType()) for n in CLASHING),
])


def words(t):
    return (t or "").encode().split()


def odd_rows():
    long = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    texts = [
        None, "", " \n\t ", "one", "two words", "a b c", "A b C", "ÀB c d", "x\u0085y z\u001ct", long, long, long + " tail",
        "The line. again\nThe line. again\nThe line. again\n" * 20, "mail bob.smith@mail.example.com or 10.0.0.1 now " * 3,
        "퟿ end \U0001f600\U0001f600  two  spaces \n\n tabs\t\tx ", "###!!! $$$", "'s 're don't I'll 12345 x²³",
    ]
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "a", "b", "ä", ""][i % 5], None, "s", i, "n") for i, t in enumerate(texts)]
    rows += [rows[3], rows[9], (3, "other text of the same id", None, "a", 1, None, None, None), (None, "one", "en", None, 3, None, None, None), (None, None, None, None, None, None, None, None)]
    return [(*r, *CLASHING) for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def small_rows():
    return pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
