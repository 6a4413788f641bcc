"""Every registered core query that has SQL, against DuckDB on the same tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from leafmill.queries import metadata, registry


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, data, name):
    ours = entry.queries()[name](spark, data)
    theirs = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows_of(ours.columns, ours.collect()) == rows_of(columns, theirs.fetchall())


def test_every_query_is_made_by_a_callable():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_llm():
    code = "import sys; sys.modules['leafmill.llm'] = None; import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and not [n for n in e.queries() if n.startswith('p1_')]"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_extracted_values_keep_every_type_and_validity(spark, tmp_path):
    body = "IBAN CH93 0076 2011 6238 5295 7 statt CH93 0076 2011 6238 5295 8, Betrag CHF 1'234.50 an Anna@Example.org"
    spark.createDataFrame([(1, body), (2, None), (3, "")], "row_id long, body string").write.parquet(f"file://{tmp_path}/store_docs.parquet")
    got = {(r.row_id, r.type, r.value, r.valid) for r in metadata.extracted_values(spark, f"file://{tmp_path}").collect()}
    expected = {(1, "iban", "CH93 0076 2011 6238 5295 7", True), (1, "iban", "CH93 0076 2011 6238 5295 8", False), (1, "amount", "CHF 1'234.50", None), (1, "email", "Anna@Example.org", None)}
    assert expected <= got and {g[0] for g in got} == {1} and "extracted_values" in metadata.queries()


def test_retractable_claims_against_brute_force(spark, data, monkeypatch):
    schema = "doc long, emitted_by string, emitted_at string, amend_id long, mode string, doc_key struct<message_id: string, sha256: string, path: string>, fields struct<tags: array<string>, entities: array<struct<scope: string, type: string, value: string, canonical: string, standard: string, unit: string, valid: boolean>>>"
    entity = lambda v: (None, "person", v, None, None, None, None)
    records = [
        (1, "p", "2024-01-01", 1, ["a", "b"], ["x", "y"]), (1, "p", "2024-01-02", 2, ["a"], ["y"]), (1, "q", "2024-01-01", 3, ["b"], ["z"]),
        (2, "p", "2024-01-01", 4, ["a"], ["x"]), (2, "p", "2024-01-03", 5, ["c"], ["w"]), (2, "q", "2024-01-01", 6, None, ["x"]),
    ]
    rows = [(d, p, t, i, "set", (str(d), None, None), (tags, [entity(v) for v in ents])) for d, p, t, i, tags, ents in records]
    df = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(metadata, "_resolved", lambda spark, sf: df)
    claims = lambda rs: {(d, p, f, v) for d, p, _, _, tags, ents in rs for f, vs in (("tags", tags or []), ("entities", [f"body\u001fperson\u001f{e}" for e in ents])) for v in vs}
    last = {}
    for r in records:
        if (r[0], r[1]) not in last or r[2:4] > last[r[0], r[1]][2:4]:
            last[r[0], r[1]] = r
    now = claims(last.values())
    expected = {c for c in claims(records) - now if any(c[:3] == n[:3] for n in now) and not any((c[0], c[2], c[3]) == (n[0], n[2], n[3]) for n in now)}
    got = {tuple(r) for r in metadata.retractable_claims(spark, data).collect()}
    assert got == expected and {r[2] for r in got} == {"tags", "entities"}
