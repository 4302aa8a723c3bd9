"""Registered queries against DuckDB on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from attestry.plans.inputs import BASE

FOLDER = "/root/testdata/sf0.001"
#: ``ATTESTRY_ALL_QUERIES=1`` compares every query that has SQL.
SAMPLE = [
    "journal_stream", "digest_changes", "reobserve", "journal_format", "journal_headers", "journal_integrity", "merge_journals", "drop_waived", "global_imports", "resolve_owner", "attachments", "mapping_overlap", "boundary_report", "waived_ranges", "journal_split", "classify_closest", "code_dependencies",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ATTESTRY_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def _text(rows, columns, wanted):
    return sorted(tuple(str(r[columns.index(c)]) for c in wanted) for r in rows)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert _text([tuple(r) for r in df.collect()], df.columns, sorted(columns)) == _text(cursor.fetchall(), columns, sorted(columns))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_journals_of_the_query_have_every_fault(spark):
    reasons = {r.reason for r in entry.queries()["journal_format"](spark, FOLDER).select("reason").distinct().collect()}
    assert reasons == {
        "invalid_start", "invalid_header", "invalid_datetime", "level2_header_in_body", "out_of_order", "duplicate_datetime", "unclosed_code_fence",
    }
