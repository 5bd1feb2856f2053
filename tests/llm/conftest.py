import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang]); with a column whose name operators use inside."""
    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None) for r in rows]
        return spark.createDataFrame(full, DOCS).withColumn("_size", F.lit(1)).withColumn("shard", F.lit("x"))
    return build


ODD_TEXTS = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (4, "one"), (5, "one"), (None, "no id"), (6, "x" * 300_000),
             (7, "word " * 40_000), (8, "é日本 🙂"), (9, "!!! 123")]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD_TEXTS)
