"""The registered llm queries: those with SQL against DuckDB, the others for their columns and distinct rows."""

import duckdb
import pytest

from leafmill.llm import queries as lq

COLUMNS = {
    "p1_found": ["row_id", "chunk_idx", "char_from", "char_to"],
    "p2_found": ["name_a", "name_b"],
    "p4_found": ["row_id", "line_no"],
    "p5_found": ["vec_a", "vec_b"],
    "p6_ids": ["doc_id", "ids"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(lq.oracle_sql()))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW store_docs AS SELECT * FROM '{data}/store_docs.parquet'")
    ours = lq.queries()[name](spark, data)
    theirs = con.execute(lq.oracle_sql()[name])
    order = [ours.columns.index(c[0]) for c in theirs.description]
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(r[i] for i in order) for r in ours.collect()), key=key) == sorted(theirs.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, data, name):
    found = lq.queries()[name](spark, data)
    assert found.columns == COLUMNS[name]
    rows = [str(tuple(r)) for r in found.collect()]
    assert rows and len(rows) == len(set(rows))
