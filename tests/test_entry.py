import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import normal

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# One or two of each kind; check_oracle.py runs them all.
SAMPLE = [
    "url13_hostpathquery_key", "prj3_summary_document", "agg34_host", "agg12_host_language_stats", "agg10_host_edges_all",
    "agg48_value_counts", "agg17_term_language_month", "agg50_family", "tsr5_cooccurrence_trend", "txt01_lemmas",
    "txt11_boolean_match", "top2_search_rank", "win1_outcomes", "agg47_outcome_percent", "snk2_insert_if_absent",
    "src06_block_slices", "src09_byte_ranges", "str2_incremental_rollup", "qlt1_constraints", "set1_union_of_lists",
]


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_flagship(spark, small):
    df = entry.entry(spark)
    assert df.columns == ["host", "id_source", "url", "hostpathquery", "hostpath"] and df.count() > 0


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(small, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, small, con, name):
    got = normal(entry.queries()[name](spark, small).toPandas())
    want = normal(con.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_no_machine_local_shortcuts():
    banned = ["localCheckpoint", "crossJoin(", ".collect()", ".toPandas()", "rdd."]
    for path in glob.glob(os.path.join(ROOT, "presstide", "**", "*.py"), recursive=True):
        text = open(path).read()
        assert not [b for b in banned if b in text], path
