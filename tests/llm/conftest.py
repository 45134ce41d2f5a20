from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, other string, fp string"


@pytest.fixture(scope="session")
def docs(spark, smallest):
    return spark.read.parquet(f"{smallest}/documents.parquet").where("doc_id < 120").repartition(3).cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and extra columns with clashing names."""
    long = " ".join(f"word{i % 977} le{i}" for i in range(20_000))
    rows = [(1, None, None, None, None, None, None), (None, "nobody has this id", "en", "a", 18, "x", "y"), (2, "", "en", "a", 0, "x", "y"), (3, "the same text for both of them", "en", "a", 30, "x", "y"), (4, "the same text for both of them", "en", None, 30, "x", "y"), (4, "the same text for both of them", "en", None, 30, "x", "y"), (5, long, "en", "b", len(long), "x", "y"), (6, "... --- 123", None, "b", 11, "x", "y"), (7, "é日本 \U0001f600 a\x1cb", "fr", "b", 9, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, docs, odd, none, tmp_path_factory):
    """Folders with a documents table: normal, odd and empty."""
    base = tmp_path_factory.mktemp("tables")
    for name, df in (("docs", docs), ("odd", odd), ("none", none)):
        df.write.parquet(f"{base}/{name}/documents.parquet")
        ids = df.where("doc_id IS NOT NULL").select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
        ids.write.parquet(f"{base}/{name}/labels.parquet")
        df.selectExpr("doc_id AS vec_id", "array(CAST(doc_id AS FLOAT), CAST(1 AS FLOAT)) AS embedding").write.parquet(f"{base}/{name}/embeddings.parquet")
    return base
