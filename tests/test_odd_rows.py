"""Queries over tables with odd rows, against their SQL on the same rows."""

import duckdb
import pytest
from compare import duck_rows, spark_rows

from quire.plans import tree_queries

TEXTS = [None, "", " ", "\n \t\r\f", "\x0b", "a", " a  b\n", "a\x0bb c", "a b c d", "x\ty\fz\r\n"]


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_words_of_blank_texts(spark, odd_documents):
    """n04_words: a text without words has no last one, and white space is what SQL takes for it."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd_documents}/documents.parquet/*.parquet'")
    cols, got = spark_rows(tree_queries.queries()["n04_words"](spark, odd_documents))
    assert (cols, got) == duck_rows(con, tree_queries.oracle_sql()["n04_words"])
