"""Every registered query on odd and empty tables, and the SQL one against DuckDB."""

from __future__ import annotations

import math

import pytest

import __spark_entry__
from ladderlens.llm import registry


ROWS = {name: 9 for name in registry.QUERIES} | {"op2_source_mixing": None, "op9_packing": None}
#: These return no row per document; test_words_vectors has their values.
OTHER = {"op11_filter_audit": 600 * 3, "op12_exact_topk": 0, "op13_spelling_variants": None}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_and_empty_tables(spark, folder, name):
    """Nulls, an empty and a long text, equal ids, repeated rows and clashing names: a row for each row."""
    assert registry.QUERIES[name](spark, f"{folder}/none").count() == 0
    rows = registry.QUERIES[name](spark, f"{folder}/odd").collect()
    if name in OTHER:
        assert OTHER[name] in (None, len(rows))
        return
    ids = sorted((r["doc_id"] for r in rows), key=repr)
    every = [1, 2, 3, 4, 4, 5, 6, 7, None]
    if ROWS[name]:
        assert ids == sorted(every, key=repr)
    elif name == "op9_packing":
        assert set(ids) == set(every) and sum(r["length"] for r in rows if r["doc_id"] == 5) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 5)
        assert all(sum(r["length"] for r in rows if r["doc_id"] == i) == 1 for i in (1, 2))
    else:
        assert set(ids) <= set(every) and all(0 < r["probability"] <= 1 for r in rows)


def test_pipeline_on_odd_and_empty_tables(spark, folder):
    run = __spark_entry__.queries()["pipeline"]
    assert run(spark, f"{folder}/none").count() == 0
    assert run(spark, f"{folder}/odd").count() > 0


def test_mixing_matches_duckdb(spark, smallest):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{smallest}/documents.parquet'")
    theirs = con.sql(registry.ORACLES["op2_source_mixing"])
    mine = registry.QUERIES["op2_source_mixing"](spark, smallest)
    a = sorted(tuple(r[c] for c in theirs.columns) for r in mine.collect())
    b = sorted(theirs.fetchall())
    assert len(a) == len(b) and all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-9)) for p, q in zip(a, b) for x, y in zip(p, q))
