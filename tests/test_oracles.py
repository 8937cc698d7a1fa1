"""A sample of the registered queries against DuckDB on the smallest tables, and the contract of the entry module."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
SAMPLE = ("a7_read_source_files", "b1_top_memories", "c11_other_tools", "d3_supersede_decisions", "d8_link_recall", "e11_global_retrieve", "i1_every_kind", "l2_classes_imports_calls", "n4_rolling_activity", "c1_redact_secrets", "c13_write_memories", "d1_auto_link", "e3_bm25_search", "e4_vector_search", "g1_project_state", "h3_apply_corrections", "j2_similar_projects", "k4_project_breakdown", "l4_call_edges", "m4_score_packs", "n4_stream_activity")


def rounded(value):
    return "" if value is None else repr(round(float(value), 6)) if isinstance(value, float | int) and not isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
    want = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = contract.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    mine = sorted(tuple(rounded(r[c]) for c in columns) for r in got.collect())
    assert mine == sorted(tuple(map(rounded, r)) for r in want.fetchall()) and mine


def test_entry_runs_where_no_setting_names_a_shared_folder(tmp_path):
    code = "from pyspark.sql import SparkSession as S; import __spark_entry__ as e; s = S.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate(); assert s.conf.get('spark.checkpoint.dir', None) is None; print('ROWS', e.entry(s).count())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    said = subprocess.run([sys.executable, "-c", code], env=env, cwd=root, capture_output=True, text=True, timeout=300)
    assert "ROWS " in said.stdout, said.stderr[-2000:]


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
