"""Small tables with the awkward rows that every operator has to take."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("ids", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("score", T.StringType()), T.StructField("key", T.StringType()),
])
LONG = " ".join(f"word{i % 7919}" for i in range(30_000))
UNSPLIT = "aé漢z9'" * 15_000


def docs(spark, texts, first=0):
    """Documents with the given texts, and columns whose names operators use themselves."""
    return spark.createDataFrame([(first + i, t, "en", "src0", len(t or ""), "x", None, "y", "k") for i, t in enumerate(texts)], DOCS)


def odd_docs(spark):
    """Nulls in every column, empty, very long and unsplit texts, ties and repeated rows."""
    same = "the same short text of a few words"
    rows = [(1, same), (1, same), (2, same), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, UNSPLIT), (8, "one"), (None, "no id here"), (None, None), (9, "two words"), (10, "two words")]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    """Words between ASCII white space, as bytes-free strings."""
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})
