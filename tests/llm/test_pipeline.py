"""The stages of the pipeline on tables with clashing names, doubled ids and copies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ladderlens.llm.common import staged

#: Names that operators give to columns of their own.
CLASHES = ["score", "lang_pred", "bits_per_byte", "row", "carried", "flagged", "weight", "probability", "tokens", "topic", "id", "fp", "h", "component_id", "lettered", "__text", "cell_source"]


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.where("doc_id < 60").select("*", *[F.lit(f"kept {c}").alias(c) for c in CLASHES])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_of_any_name(spark, clashing, name, stage):
    out = stage(spark, clashing, "")
    assert out.columns == clashing.columns and [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema]
    rows = out.collect()
    assert 0 < len(rows) <= 60 and all(r[c] == f"kept {c}" for r in rows for c in CLASHES)


def test_unlike_texts_of_one_id_stay(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(3)]
    rows = [(1, words[0]), (1, words[1]), (1, words[0]), (2, words[1]), (3, words[2]), (None, words[2]), (None, words[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    got = sorted(((r["doc_id"], words.index(r["text"])) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=repr)
    assert got == [(1, 0), (1, 1), (3, 2), (None, 2), (None, 2)]


def test_pipeline_equals_its_stages(spark, folder):
    """run() gives what the stages give one after the other."""
    docs = spark.read.parquet(f"{folder}/docs/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, ""), name)
    assert sorted(map(tuple, corpus_pipeline.run(spark, f"{folder}/docs").collect())) == sorted(map(tuple, docs.collect()))
