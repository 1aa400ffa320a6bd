"""Each query against its SQL in DuckDB on the smallest tables; the entry point without the optional subpackage."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from locusflow.plans import queries as plans
from tests.conftest import ROOT

SF = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    show = lambda v: "null" if v is None or v != v else repr(round(float(v), 7) + 0.0) if isinstance(v, (int, float)) else str(v)
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = plans.queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
    cursor = con.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); assert 'pipeline' not in e.queries() and len(e.queries()) > 40"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
