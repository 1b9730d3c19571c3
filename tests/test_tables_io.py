"""Table rules, text search and files."""

import gzip
import os
import random

import pytest

from pyspark.sql import functions as F

from assayloom.operators import cleaning as cl
from assayloom.operators import joins as jo
from assayloom.operators import reads as rd
from assayloom.operators import reshape as rs
from assayloom.operators import text as tx
from assayloom.sources import genomics as ge
from assayloom.sources import sequences as se
from assayloom.sources import tables as ta
from assayloom.sources.lines import numbered_lines


def test_blank_keys_never_match(spark):
    left = spark.createDataFrame([("A ", 1), ("", 2), (None, 3), ("b", 4)], "k string, x int")
    right = spark.createDataFrame([("a", 10), ("", 20), (None, 30), ("c", 40)], "k string, x int")
    rows = lambda how: sorted(tuple(str(v) for v in r) for r in jo.join_tables(left, right, ["k"], how=how).collect())
    assert rows("inner") == [("A ", "1", "10")]
    assert len(rows("left")) == 4
    full = jo.join_tables(left, right, ["k"], how="full")
    assert full.columns == ["k", "x", "x_right"] and full.count() == 7
    assert full.filter("k = 'c'").first()["x_right"] == 40


def test_like_drops_percent_signs(spark):
    df = spark.createDataFrame([("alpha",), ("ALP",), ("beta",)], "v string")
    assert cl.where(df, [("v", "like", "al%p")]).count() == 2
    assert cl.where(df, [("v", "like", "al%a")], like_mode="sql").count() == 1


def test_where_orders_text_naturally(spark):
    df = spark.createDataFrame([("s2",), ("s10",), ("s9",)], "v string")
    assert sorted(r["v"] for r in cl.where(df, [("v", ">", "s9")]).collect()) == ["s10"]


def test_pivot_round_trip(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3"), ("b", "y", "4")], "id string, name string, value string").withColumn("o", F.monotonically_increasing_id())
    wide = rs.pivot_wider(df, ["id"], "name", "value", order="o")
    assert wide.columns == ["id", "x", "y"]
    back = rs.pivot_longer(wide, ["id"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select("id", "name", "value").collect()))


def test_search_regex_offsets(spark):
    df = spark.createDataFrame([(1, "aXbX\n\nXX")], "id int, t string")
    got = [(r["match"], r["line"], r["start"], r["end"], r["replacement"]) for r in tx.search_text(df, "t", "(X+)", "<$1>", keys=["id"], mode="regex").collect()]
    assert got == [(1, 1, 2, 2, "<X>"), (2, 1, 4, 4, "<X>"), (3, 3, 1, 2, "<XX>")]


def test_sniffing_and_header_ids(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write('Sample ID;;Value;Value\n"a;1";x;1;2\nb;y;3\n')
    df = ta.read_delimited(spark, path)
    assert df.columns == ["sample_id", "column_2", "value", "value_2"] and df.schema["column_2"].metadata["label"] == "Column 2"
    assert [tuple(r) for r in df.orderBy("sample_id").collect()] == [("a;1", "x", "1", "2"), ("b", "y", "3", None)]


def test_json_shapes(spark, tmp_path):
    for i, text in enumerate(['[{"a":1,"b":{"c":2}},{"a":3}]', '{"data":[{"a":1,"b":{"c":2}},{"a":3}]}', '[["a","b"],["1","x"],["3",null]]']):
        path = str(tmp_path / f"{i}.json")
        with open(path, "w") as f:
            f.write(text)
        df = ta.read_json_table(spark, path)
        assert df.columns == ["a", "b"] and sorted(r["a"] for r in df.collect()) == ["1", "3"]


def test_fastq_quality_may_begin_with_at_sign(spark, tmp_path):
    path = str(tmp_path / "r.fastq")
    with open(path, "w") as f:
        for i in range(400):
            f.write(f"@r{i}\nACGT\n+\n@@@@\n")
        f.write("@cut\nAC\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        lines = numbered_lines(spark, path)
        assert lines.select("n").distinct().count() == 1602
        reads = se.read_fastq(spark, path)
        assert reads.count() == 401 and reads.filter("title = 'cut' AND issue = 'incomplete record'").count() == 1 and reads.filter("title = concat('r', read) AND quality = '@@@@' AND issue = ''").count() == 400
        fasta = str(tmp_path / "f.fa")
        with open(fasta, "w") as f:
            f.write("".join(f">s{i} d\nACGTAC\nGT\n" for i in range(300)))
        assert se.read_fasta(spark, fasta).filter("sequence = 'ACGTACGT' AND length = 8").select("id").distinct().count() == 300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("block", [23, 300])
def test_fastq_blocks_cut_anywhere(spark, tmp_path, block):
    """Block borders inside records, lines longer than several blocks, runs of empty lines: as a plain reading by four lines."""
    rng = random.Random(block)
    expected = []
    for name in ("a", "b", "empty"):
        lines = []
        for i in range(0 if name == "empty" else 25):
            n = rng.choice([0, 1, 3, 20, 150])
            record = [f"@{name}{i}", "A" * n or "N", "+", "@" * n or "!"]
            lines += [x for line in record for x in [""] * rng.choice([0, 0, 3]) + [line]]
        lines += {"a": [], "b": ["@last", "AC", "+"], "empty": [""]}[name]
        end = "\r\n" if name == "b" else "\n"
        (tmp_path / f"{name}.fastq").write_bytes(end.join(lines).encode())
        kept = [x for x in lines if x]
        for k in range(0, len(kept), 4):
            four = kept[k : k + 4] + [""] * 4
            expected.append((name, k // 4, four[0][1:], four[1], four[3], "" if len(kept) >= k + 4 else "incomplete record"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        reads = se.read_fastq(spark, str(tmp_path))
        found = reads.select(F.regexp_extract("file", r"(\w+)\.fastq$", 1), "read", "title", "sequence", "quality", "issue").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, found)) == sorted(expected)


def test_gzipped_fastq(spark, tmp_path):
    path = str(tmp_path / "r.fastq.gz")
    with gzip.open(path, "wt") as f:
        f.write("@a\r\nACGTN\r\n+\r\nIIII!\r\n@b\r\nAC\r\n-\r\nI\r\n")
    rows = {r["title"]: r for r in se.read_fastq(spark, path).collect()}
    assert rows["a"]["issue"] == "" and rows["b"]["issue"] == "third line without +; length mismatch" and rows["b"]["sequence"] == "A"


def test_tail_trim_and_filter(spark):
    reads = spark.createDataFrame([("r", "ACGTACGTAC", "+", "IIIIIIII!!")], "title string, sequence string, plus string, quality string")
    assert rd.trim_tail(reads, 20, 4).first()["sequence"] == "ACGTACGTAC"
    assert rd.trim_tail(reads, 35, 4).first()["sequence"] == "ACGTACGT"
    assert rd.filter_reads(reads, minimum_length=11, keep_failed=True).first()["reason"] == "too_short"


def test_interval_format_by_line(spark):
    lines = {
        "c\tl\texon\t1\t5\t.\t+\t.\tID=a": "gff", "c\tl\texon\t1\t5\t.\t+\t.\tgene_id \"g\";": "gtf", "c\t10\t20": "bed", "c\t10\trs1\tA\tG\t.\tPASS\tDP=1": "vcf",
        "##gff-version 3": None, "  ": None, "c\t10\t20\tx\t0\t+\t10\t20\t0": "bed", "1\t100\t12345\tA\tG\t.\tPASS\tDP=1": "vcf", "1\t100\t12345\tac\t<DEL>,T\t3.5\t.\tEND=120": "vcf",
        "1\t100\t200\tA\t.\t.\t100\t200\t0": "bed", "1\t100\t200\tA\t960\t+\t100\t200": "bed",
    }
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r["line"]: r["kind"] for r in frame.select("line", ge.line_format(F.col("line")).alias("kind")).collect()} == lines



def test_checkpoint_folder_comes_from_the_session(spark):
    from assayloom.session import ensure_checkpoint_dir, shared_folder

    ensure_checkpoint_dir(spark)
    assert shared_folder(spark, "x").startswith(spark.sparkContext.getCheckpointDir())
    assert not os.path.exists(shared_folder(spark, "x"))


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "".join(line for line in plan.splitlines() if "PushedFilters" in line)


def test_filters_reach_the_reader(spark):
    from assayloom.operators import cleaning

    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert "GreaterThan(l_quantity,40.0)" in pushed(cleaning.filter_rows(items, [("l_quantity", "gt", 40), ("l_returnflag", "equals", "A")]))
    assert "EqualTo(l_returnflag,A)" in pushed(cleaning.where(items, [("l_returnflag", "=", "A")]))
    assert "LessThan(l_linenumber,3)" in pushed(cleaning.where(items, [("l_linenumber", "<", 2.5)]))
    assert "GreaterThanOrEqual(l_linenumber,3)" in pushed(cleaning.filter_stream(items, "l_linenumber", ">=", 2.5))


def test_plain_tests_keep_odd_numbers_right(spark):
    from assayloom.operators import cleaning

    rows = [(1, 1.5, 3), (2, None, None), (3, float("nan"), 0), (4, float("inf"), -3), (5, -2.0, 2), (6, 1e12, 1)]
    typed = spark.createDataFrame(rows, "id int, x double, n int")
    wide = typed.withColumn("x", typed["x"] + 0).selectExpr("id", "x", "cast(n as string) AS n")
    for column, limit in (("x", 1.5), ("n", 2), ("n", 1.5), ("n", 1e12), ("n", -3)):
        for sign in ("gt", "gte", "lt", "lte"):
            ids = lambda df: sorted(r["id"] for r in cleaning.filter_rows(df, [(column, sign, limit)]).collect())
            assert ids(typed) == ids(wide)
        for sign in ("=", "<", "<=", ">", ">="):
            ids = lambda df: sorted(r["id"] for r in cleaning.where(df, [(column, sign, limit)]).collect())
            assert ids(typed) == ids(wide)


def test_fastq_with_empty_lines_and_a_cut_end(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("\n@r1\nACGT\n\n+\nIIII\n\n\n@r2\nAC\n+\n@I\n@r3\nACG\n")
    rows = [tuple(r) for r in se.read_fastq(spark, str(tmp_path)).orderBy("read").drop("file", "plus").collect()]
    assert rows == [(0, "r1", "ACGT", "IIII", ""), (1, "r2", "AC", "@I", ""), (2, "r3", "ACG", "", "incomplete record")]


def test_asked_bins_and_floors_are_obeyed(spark):
    from assayloom.operators import kmers, plotdata, variants

    numbers = spark.range(2000).selectExpr("cast(id as double) AS v")
    assert plotdata.histogram(numbers, "v", bins=500).count() == 500
    pair = spark.createDataFrame([(1, 2, "ACGTACGTAC", "ACCATTCATG")], "a_record int, b_record int, a string, b string")
    assert kmers.window_identity(pair, window=10, min_identity=10).count() == 1 and kmers.window_identity(pair, window=10).count() == 0
    lines = spark.createDataFrame([("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts2",)], "line string")
    with pytest.raises(ValueError):
        variants.header_samples(lines)


def test_shared_and_repeated_exons(spark):
    from assayloom.operators import intervals

    seqs = spark.createDataFrame([("c", "AACCGGTTACGT")], "record string, sequence string")
    features = spark.createDataFrame(
        [("c", "exon", 1, 4, "+", None, "t1,t2"), ("c", "exon", 1, 4, "+", None, "t1,t2"), ("c", "exon", 7, 8, "+", None, "t1"), ("c", "mRNA", 1, 9, "+", "t1", None), ("c", "mRNA", 1, 9, "+", "t3", None)],
        "record string, feature string, start bigint, end bigint, strand string, id string, parent string",
    ).selectExpr("*", "cast(null as string) AS transcript_id")
    got = {r["transcript"]: r["sequence"] for r in intervals.splice_transcripts(intervals.transcript_parts(features), seqs).collect()}
    assert got == {"t1": "AACCTT", "t2": "AACC", "t3": "AACCGGTTA"}


def test_census_rows_carry_one_digest(spark):
    from assayloom.operators.aggregates import duplicate_census

    rows = [("r1", "a", "ACGG", 1), ("r2", "b", "CCGT", 1), ("r3", "b", "ACGT", 1), ("r4", "c", "", 1), ("r5", "d", "acgg", 1)]
    out = duplicate_census(spark.createDataFrame(rows, "record string, title string, sequence string, sequence_lines int"), check_reverse_complement=True)
    assert {r["record"]: (r["sequence_count"], r["issues"]) for r in out.collect()} == {
        "r1": (2, "duplicate sequence; reverse-complement duplicate"), "r2": (1, "duplicate title; reverse-complement duplicate"),
        "r3": (1, "duplicate title"), "r4": (0, ""), "r5": (2, "duplicate sequence; reverse-complement duplicate"),
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "title#" in line and "__rc#" in line]


def test_numbered_lines_query_writes_a_file_per_task(spark):
    from assayloom.plans.catalog import QUERIES

    out = QUERIES["S3_numbered_lines"](spark, "/root/testdata/sf0.001")
    assert out.select("supplier").distinct().count() > 4 >= len(out.inputFiles())
