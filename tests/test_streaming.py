"""Counters over landing files."""

import os

import pytest

from assayloom.operators import reads as rd
from assayloom.sources import sequences as se
from assayloom.streaming import incremental as inc


def test_landing_fastq_counters_with_folded_parts(spark, tmp_path):
    landing, target, state = (str(tmp_path / name) for name in ("landing", "target", "state"))
    os.makedirs(landing)

    def land(i):
        with open(f"{landing}/{i}.fastq", "w") as f:
            f.write("".join(f"@{i}.{j}\n{'ACGTN'[j % 5] * (j + 1)}\n+\n{'@5I!'[(i + j) % 4] * (j + 1)}\n" for j in range(i + 2)))

    for i in range(11):
        land(i)
        if i in (3, 4, 10):  # stopped and taken up again
            inc.stream_fastq_summary(inc.stream_fastq(spark, landing, files_per_trigger=1), target, state, fold_every=3)
            whole = {r["metric"]: tuple(r) for r in rd.fastq_summary(se.read_fastq(spark, landing)).collect()}
            parts = {r["metric"]: tuple(r) for r in inc.merged_fastq_summary(spark, target).collect()}
            assert parts == {m: r for m, r in whole.items() if m not in rd.NOT_MERGEABLE} and len(parts) == 13
    kept = sorted(int(name.split("=")[1]) for name in os.listdir(target) if name.startswith("batch="))
    assert kept == [5, 6, 7, 8, 9, 10]


def test_a_fold_that_runs_again_counts_once(spark, tmp_path):
    landing, target, state = (str(tmp_path / name) for name in ("landing", "target", "state"))
    os.makedirs(landing)
    for i in range(4):
        with open(f"{landing}/{i}.fastq", "w") as f:
            f.write(f"@{i}\nACGT\n+\nIIII\n")
    run = lambda: inc.stream_fastq_summary(inc.stream_fastq(spark, landing, files_per_trigger=1), target, state, fold_every=2)
    run()
    os.remove(f"{state}/commits/3")  # as if the last batch, a fold, had been written but not committed
    if os.path.exists(f"{state}/commits/.3.crc"):
        os.remove(f"{state}/commits/.3.crc")
    run()
    rows = {r["metric"]: r["value"] for r in inc.merged_fastq_summary(spark, target).collect()}
    assert rows["read_count"] == "4" and rows["total_bases"] == "16"


def test_fold_needs_two_batches(spark, tmp_path):
    with pytest.raises(ValueError):
        inc.run_summary(None, [], {}, "t", "c", fold_every=1)


def test_landing_files_and_gzip_lines_are_as_many_as_shuffle_tasks(spark, monkeypatch):
    """With three or four files whatever the size, one task read a quarter of the table."""
    from assayloom.plans import io_queries
    from assayloom.plans.registry import QUERIES

    folders = []
    keep = io_queries.shared_folder
    monkeypatch.setattr(io_queries, "shared_folder", lambda session, purpose: folders.append(keep(session, purpose)) or folders[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for name in ("R1_stream_vcf_filter", "R2_stream_reference_stats"):
            QUERIES[name](spark, "/root/testdata/sf0.001")
            landed = [f for f in folders if "landing" in f][-1]
            assert spark.read.text(landed).inputFiles().__len__() >= 7
        lines = QUERIES["S3_read_gzip_lines"](spark, "/root/testdata/sf0.001")
        assert lines.rdd.getNumPartitions() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
