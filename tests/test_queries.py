"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from tools.compare import rows_of

FOLDER = "/root/testdata/sf0.001"
QUICK = ["flagship_segment_summary", "T1_clean_cells", "T7_where", "T11_search_text", "J1_join_left", "J2_join_full", "A2_group_summary", "A10_list_overlap", "W3_average_rank", "U3_pivot_wider",
         "X5_mann_whitney", "X12_correlation_matrix", "P5_manhattan", "I1_intersect", "I2_subtract", "I3_merge", "I4_nearest", "G5_genotype_filter", "G10_coverage_summary", "G15_per_base_profile",
         "Q9_find_orfs", "Q14_scan_mismatches", "Q16_pcr_products_circular", "J7_shared_word_pairs", "J7_shared_word_pairs_hot", "Q20_off_target_census", "Q22_exact_blocks", "S6_read_fastq", "R1_stream_filter"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    got = frame.collect()
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, got) == rows_of(columns, cursor.fetchall())
