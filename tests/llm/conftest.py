import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("found", T.StringType()),
        T.StructField("n_dropped", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("toxicity", T.StringType()),
    ]
)


def make_docs(spark, rows, parts=3):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, None, None)[:4] if len(row) == 2 else row
        full.append((doc_id, text, lang, source, len(text or ""), "x", "y", "z", "t"))
    return spark.createDataFrame(full, DOCS).repartition(parts)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows, parts=3: make_docs(spark, rows, parts)


@pytest.fixture(scope="session")
def real(spark):
    """Rows (doc_id, text, lang, source) of the smallest table."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return [tuple(r) for r in table.select("doc_id", "text", "lang", "source").collect()]


def awkward(text="The quick brown fox jumps over the lazy dog near the old river bank today"):
    """Null, empty, repeated, very long and odd texts."""
    return [
        (1, None),
        (2, ""),
        (3, text),
        (4, text),
        (4, text),
        (None, text),
        (5, " \n\t "),
        (6, "é" * 300),
        (7, "\n".join([text] * 400)),
        (8, "x"),
        (9, text.upper()),
        (10, "".join(chr(97 + i % 23) for i in range(1_200_000))),
        (11, "漢字 кириллица ﬁ Σας it's <|endoftext|> 12.5%"),
    ]
