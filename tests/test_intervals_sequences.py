"""Intervals and sequences against brute force on small tables."""

import itertools
import random
import re

from pyspark.sql import functions as F

from assayloom.operators import alignments as al
from assayloom.operators import intervals as iv
from assayloom.operators import kmers as km
from assayloom.operators import scans as sc
from assayloom.operators import sequences as sq

SCHEMA = "record string, start long, end long, name string, strand string"


def _random_intervals(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randint(1, 200_000)
        out.append((f"c{rng.randint(1, 2)}", start, start + rng.choice([0, 3, 90, 500, longest]), f"i{seed}_{i}", "+"))
    return out


def test_overlap_pairs_of_mixed_lengths(spark):
    a, b = _random_intervals(1, 120, 90_000), _random_intervals(2, 120, 20_000)
    got = iv.range_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).select("a_name", "b_name").collect()
    want = {(x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_overlap_plan_has_no_nested_loop(spark):
    a = spark.createDataFrame(_random_intervals(1, 20, 900), SCHEMA)
    plan = iv.range_join(a, a)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_merge_touching_and_nested(spark):
    rows = [("c", 1, 10, "a", "+"), ("c", 11, 20, "b", "+"), ("c", 12, 13, "n", "+"), ("c", 22, 30, "d", "+"), ("c", 70_000, 140_000, "e", "+"), ("c", 140_001, 140_002, "f", "+")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r["start"], r["end"], r["name"], r["interval_count"]) for r in iv.merge(df).orderBy("start").collect()]
    assert got == [(1, 20, "a", 3), (22, 30, "d", 1), (70_000, 140_002, "e", 2)]
    again = iv.merge(iv.merge(df).withColumn("strand", F.lit("+")))
    assert [(r["start"], r["end"]) for r in again.orderBy("start").collect()] == [(g[0], g[1]) for g in got]
    assert iv.merge_members(df).count() == len(rows)


def test_subtract_leaves_no_overlap(spark):
    a, b = spark.createDataFrame(_random_intervals(3, 60, 30_000), SCHEMA), spark.createDataFrame(_random_intervals(4, 40, 9_000), SCHEMA)
    left = iv.subtract(a, b).select("record", "start", "end", "name", "strand")
    assert iv.range_join(left, b).count() == 0
    covered = sum(r["overlap"] for r in iv.range_join(a, iv.merged_runs(b)).select(iv.overlap_bp().alias("overlap")).collect())
    total = a.agg(F.sum(F.col("end") - F.col("start") + 1)).first()[0]
    assert left.agg(F.sum(F.col("end") - F.col("start") + 1)).first()[0] == total - covered


def test_nearest_ties_and_touching(spark):
    query = spark.createDataFrame([("c", 100, 110, "q1", "+"), ("c", 100_000, 100_001, "q2", "+"), ("x", 1, 2, "q3", "+")], SCHEMA)
    reference = spark.createDataFrame([("c", 111, 120, "right", "+"), ("c", 90, 99, "left", "+"), ("c", 20, 30, "far", "+")], SCHEMA).withColumn(
        "row_id", F.when(F.col("name") == "right", 1).when(F.col("name") == "left", 0).otherwise(2))
    got = {r["name"]: (r["partner_name"], r["distance_bp"]) for r in iv.nearest(query, reference, query_id="name", order="row_id").collect()}
    assert got == {"q1": ("left", 1), "q2": ("right", 99_880)}


def test_nearest_equals_plain_search(spark):
    a, b = _random_intervals(21, 80, 2_000), _random_intervals(22, 50, 2_000)
    reference = spark.createDataFrame([(*r, i) for i, r in enumerate(b)], SCHEMA + ", row_id bigint")
    rows = [(r[0], r[1], r[2], f"q{i}", r[4]) for i, r in enumerate(a)]
    got = {r["name"]: (r["distance_bp"], r["partner_start"], r["partner_end"], r["partner_name"]) for r in iv.nearest(spark.createDataFrame(rows, SCHEMA), reference, query_id="name", order="row_id").collect()}
    want = {}
    for record, start, end, name, _ in rows:
        found = [(max(s - end, start - e, 0), i, s, e, n) for i, (r, s, e, n, _) in enumerate(b) if r == record]
        if found:
            best = min(found)
            want[name] = (best[0], *best[2:])
    assert got == want and any(d == 0 for d, *_ in want.values())


def test_pile_ups_are_joined_once(spark):
    pile = spark.range(100_000).selectExpr("'c' AS record", "10L AS start", "20L AS end", "concat('n', id) AS name", "'+' AS strand", "id AS row_id")
    assert iv.nearest(pile, pile, query_id="name", order="row_id").groupBy("partner_name", "distance_bp").count().collect() == [("n0", 0, 100_000)]


def test_joins_run_nothing_before_they_are_asked(spark):
    a, b = spark.createDataFrame(_random_intervals(23, 30, 9_000), SCHEMA), spark.createDataFrame(_random_intervals(24, 30, 9_000), SCHEMA)
    next_job = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    before = next_job()
    joined = iv.intersect(a, b, min_overlap_bp=2)
    assert next_job() == before and joined.count() > 0


def test_regions_across_chunks(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("ACGT") for _ in range(200_000))
    seqs = spark.createDataFrame([("s", text)], "record string, sequence string")
    regions = spark.createDataFrame([("a", "s", 65_530, 65_545, "+"), ("b", "s", 10, 199_999, "+"), ("c", "s", -5, 3, "-")], "name string, record string, start long, end long, strand string")
    got = {r["name"]: r["sequence"] for r in iv.extract_regions(regions, seqs, key=["name"]).collect()}
    turn = str.maketrans("ACGT", "TGCA")
    assert got == {"a": text[65_529:65_545], "b": text[9:199_999], "c": text[:3].translate(turn)[::-1]}


def test_scans_across_tiles(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("ACGT") for _ in range(30_000))
    seqs = spark.createDataFrame([("s", text)], "record string, sequence string")
    hits = sc.scan_motifs(seqs, [{"id": "m", "pattern": "AANTT"}], both_strands=False, flank=3)
    want = {i + 1 for i in range(len(text) - 4) if text[i:i + 2] == "AA" and text[i + 3:i + 5] == "TT"}
    rows = hits.collect()
    assert {r["start"] for r in rows} == want and len(rows) == len(want)
    assert all(r["left_context"] == text[max(0, r["start"] - 4):r["start"] - 1] and r["right_context"] == text[r["end"]:r["end"] + 3] for r in rows)
    near = sc.scan_mismatches(seqs, [{"id": "p", "pattern": "ACGTACGT"}], max_mismatches=2, both_strands=False)
    close = {i + 1 for i in range(len(text) - 7) if sum(x != y for x, y in zip(text[i:i + 8], "ACGTACGT")) <= 2}
    assert {r["start"] for r in near.collect()} == close


def test_overlapping_motif_and_palindrome(spark):
    seqs = spark.createDataFrame([("s", "AATAATAAT")], "record string, sequence string")
    assert sorted(r["start"] for r in sc.scan_motifs(seqs, [{"id": "m", "pattern": "AATAAT", "syntax": "plain"}], both_strands=False).collect()) == [1, 4]
    sites = sc.restriction_sites(spark.createDataFrame([("s", "TTGATCTT")], "record string, sequence string"), [{"name": "X", "recognition": "GATC", "cut_top": 0, "cut_bottom": 4}])
    assert [(r["strand"], r["cut_after"]) for r in sites.collect()] == [("+", 2)]


def test_orf_across_tiles(spark):
    body = "GCC" * 9000
    seqs = spark.createDataFrame([("s", "CC" + "ATG" + body + "TAA" + "CC")], "record string, sequence string")
    best = sq.find_orfs(seqs, min_aa=5000, strands="forward").filter("complete").first()
    assert (best["start"], best["aa_length"], best["stop_codon"], best["frame"]) == (3, 9001, "TAA", "+3")
    protein = sq.orf_proteins(sq.find_orfs(seqs, min_aa=5000, strands="forward").filter("complete"), seqs).first()["protein"]
    assert protein == "M" + "A" * 9000


def test_exact_runs_of_identical_records(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("ACGT") for _ in range(20_000))
    a = spark.createDataFrame([("a", text)], "record string, sequence string")
    b = spark.createDataFrame([("b", text[:9000] + "N" + text[9001:])], "record string, sequence string")
    runs = km.exact_runs(a, b, 14, reverse=False).filter("diagonal = 0").orderBy("a_start").collect()
    assert [(r["a_start"], r["a_end"]) for r in runs] == [(1, 9000), (9002, 20_000)]


def test_greedy_keep_follows_chains(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "better long, worse long")
    assert sorted(r["id"] for r in km.greedy_keep(rows, "id", chain).collect()) == [1, 3, 5]


def test_contamination_finds_planted_piece(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    vector = make(120)
    planted = vector[20:80]
    turned = planted.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    queries = spark.createDataFrame([("q1", make(100) + planted + make(50)), ("q2", make(30) + turned + make(10)), ("q3", make(200))], "record string, sequence string")
    hits = km.contamination_hits(queries, spark.createDataFrame([("v", vector)], "record string, sequence string"), k=14).filter("aligned_length >= 50").collect()
    got = {r["record"]: (r["query_start"], r["query_end"], r["strand"], r["confidence"]) for r in hits}
    assert set(got) == {"q1", "q2"} and got["q2"][2] == "-"
    assert got["q1"][0] <= 101 and got["q1"][1] >= 160 and got["q1"][3] == "strong"


def test_coverage_adds_up(spark):
    sam = spark.createDataFrame(
        [("r1", 0, "c", 5, 60, "4M2D3M", ""), ("r2", 16, "c", 6, 60, "3S5M", ""), ("r3", 4, "c", 6, 60, "5M", ""), ("r4", 0, "c", 65_534, 60, "6M", "")],
        "qname string, flag int, rname string, pos long, mapq int, cigar string, tags string")
    lengths = spark.createDataFrame([("c", 70_000)], "reference string, length long")
    row = al.coverage_summary(sam, lengths).first()
    assert (row["covered_bases"], row["total_depth"], row["max_depth"], row["zero_coverage_region_count"]) == (15, 18, 2, 3)
    windows = al.window_coverage(sam, lengths, 1000).collect()
    assert sum(round(w["mean_depth"] * w["window_size"]) for w in windows) == 18 and len(windows) == 70


def test_exploded_rows_are_not_broadcast(spark):
    """Sides that grow by explode are far larger than the file they are sized by."""
    from assayloom.operators import joins, kmers, sequences

    letters = F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    seqs = spark.range(40).select(F.col("id").alias("record"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.concat(letters, letters).alias("sequence"))
    ids = seqs.select(F.col("title").alias("query"))
    frames = [
        sequences.codon_usage(seqs), sequences.find_orfs(seqs, min_aa=2), joins.id_match_report(seqs, ids, mode="title_contains"), kmers.candidate_pairs(seqs, seqs, k=6),
        kmers.dot_table(seqs, seqs, 6), kmers.exact_blocks(seqs, seqs, seed=6, min_length=8, deduplicate=False),
    ]
    for frame in frames:
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
        assert frame.count() > 0


def test_best_matches_are_not_broadcast(spark):
    """ranked pairs and the records without one gather neither words nor pairs on the driver."""
    from assayloom.operators import kmers

    letters = F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    a = spark.range(40).select(F.col("id").alias("record"), letters.alias("sequence"))
    b = spark.range(30, 70).select(F.col("id").alias("record"), letters.alias("sequence"))
    best = kmers.reciprocal_best(kmers.candidate_pairs(a, b, k=6, min_shared=20, alphabet=kmers.DNA_WORD), top=2)
    alone = kmers.unmatched(a, b, best)
    for frame in (best, alone):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    assert {(r["a_record"], r["b_record"], r["classification"]) for r in best.collect()} == {(i, i, "reciprocal_best") for i in range(30, 40)}
    assert {tuple(r) for r in alone.collect()} == {("A", i, "no_candidate") for i in range(30)} | {("B", i, "no_candidate") for i in range(40, 70)}


def test_part_rows_meet_all_tasks(spark, tmp_path):
    """One file split of keys becomes long sequences in as many tasks as a shuffle has."""
    from assayloom.plans import fixtures
    from assayloom.plans.registry import Tables

    spark.range(1000).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_name")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    tables = Tables(spark, str(tmp_path))
    for frame in (fixtures.sequences(tables), fixtures.proteins(tables)):
        assert frame.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_runs_of_one_word_and_longer_ones(spark):
    """A run of exactly the word length comes straight from the word join, a longer one from its two ends."""
    from assayloom.operators import kmers

    a = spark.createDataFrame([("a", "AACGTACCGGA")], "record string, sequence string")
    b = spark.createDataFrame([("b", "TTCGTACTTTT"), ("c", "GACGTACCGTT")], "record string, sequence string")
    got = {tuple(r) for r in kmers.exact_runs(a, b, 5, reverse=False).collect()}
    assert got == {("a", "b", "+", 0, 3, 7), ("a", "c", "+", 0, 2, 9)}


def test_nearest_moves_its_rows_once(spark):
    from assayloom.operators import intervals as iv

    ref = spark.createDataFrame([("c", 10, 20, "x", 2), ("c", 10, 20, "w", 1), ("c", 40, 50, "y", 3), ("d", 5, 6, "z", 4)], "record string, start bigint, end bigint, name string, o int")
    rows = [("c", 15, 16), ("c", 15, 16), ("c", 25, 30), ("c", 30, 35), ("c", 60, 61), ("c", 20, 40), ("d", 1, 2), ("e", 1, 2), ("c", 29, 31)]
    q = spark.createDataFrame([(*r, f"q{i}") for i, r in enumerate(rows)], "record string, start bigint, end bigint, payload string")
    out = iv.nearest(q, ref, query_id="payload", order="o")
    got = {r["payload"]: (r["partner_name"], r["distance_bp"], r["overlap_bp"]) for r in out.collect()}
    assert got == {"q0": ("w", 0, 2), "q1": ("w", 0, 2), "q2": ("w", 5, 0), "q3": ("y", 5, 0), "q4": ("y", 10, 0), "q5": ("w", 0, 1), "q6": ("z", 3, 0), "q8": ("w", 9, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Project [" in line and "payload#" in line for line in plan) <= 2


def test_runs_left_out_have_no_neighbour(spark):
    """Runs agree with a plain count on texts with ambiguous bases; with ``within`` only runs that lie alone go."""
    from assayloom.operators import kmers

    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core, k, gap, least = make(70), 5, 4, 9
    spoiled = "".join(rng.choice("ACGTN") if rng.random() < 0.12 else c for c in core)
    texts_a, texts_b = {"a": make(20) + core, "c": core[10:30] + make(30)}, {"b": make(7) + spoiled + make(9), "d": core[:50] + "NNA", "e": "ACG"}
    want = set()
    for (na, x), (nb, y) in itertools.product(texts_a.items(), texts_b.items()):
        for diagonal in range(-len(y), len(x)):
            same = "".join("1" if 0 <= i - diagonal < len(y) and x[i] == y[i - diagonal] and x[i] in "ACGT" else "0" for i in range(len(x)))
            want |= {(na, nb, "+", diagonal, m.start() + 1, m.end()) for m in re.finditer(f"1{{{k},}}", same)}
    frame = lambda texts: spark.createDataFrame(list(texts.items()), "record string, sequence string")
    rows = lambda df: {tuple(r) for r in df.select("a_record", "b_record", "strand", "diagonal", "a_start", "a_end").collect()}
    assert rows(kmers.exact_runs(frame(texts_a), frame(texts_b), k, reverse=False)) == want
    near = {r for r in want if r[5] - r[4] + 1 >= least or any(o != r and o[:4] == r[:4] and max(o[4], r[4]) - min(o[5], r[5]) - 1 <= gap for o in want)}
    some = rows(kmers.exact_runs(frame(texts_a), frame(texts_b), k, reverse=False, within=gap, alone=least))
    assert near <= some <= want and len(some - near) < len(want - near) / 4


def test_depth_is_not_exchanged_by_reference(spark):
    """no join deals blocks or stretches out by reference, which would put a chromosome in one task."""
    sam = spark.range(300).selectExpr("concat('r', id) AS qname", "0 AS flag", "'c' AS rname", "id * 7 + 1 AS pos", "60 AS mapq", "'9M' AS cigar", "'' AS tags")
    lengths = sam.groupBy(F.col("rname").alias("reference")).agg((F.max("pos") + 100).alias("length"))
    scope = lengths.select(F.col("reference").alias("record"), F.lit(1).alias("scope_start"), F.col("length").alias("scope_end"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all were large
    try:
        for frame in (al.depth_segments(al.blocks(sam), scope), al.window_coverage(sam, lengths, 500, min_mapq=10)):
            assert "BroadcastHashJoin [record#" in frame._jdf.queryExecution().executedPlan().toString()
            assert frame.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
