"""Operators chained with plain functions, as a user would: three small pipelines end to end."""

from pyspark.sql import functions as F

from assayloom.operators import aggregates as ag
from assayloom.operators import cleaning as cl
from assayloom.operators import reshape as rs
from assayloom.operators import sequences as sq


def test_reading_frames_to_codon_usage(spark):
    seqs = spark.createDataFrame([("a", "CCATGAAATTTAAATAGCC"), ("b", "TTTT")], "record string, sequence string")
    frames = sq.find_orfs(seqs, min_aa=3, strands="plus", partial=False).select("record", "start", "end")
    coding = frames.join(seqs, "record").select("record", F.expr("substring(sequence, start, end - start + 1)").alias("sequence"))
    counts = {r["codon"]: r["count"] for r in sq.codon_counts(coding, merged=True).collect()}
    assert counts == {"ATG": 1, "AAA": 2, "TTT": 1, "TAG": 1}


def test_filter_map_gather(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}", float(i)) for i in range(30)], "id bigint, sample string, value double")
    kept = cl.filter_rows(rows, [("value", "gte", 10)])
    doubled = cl.add_calculated_column(kept, "value", "multiply", constant=2.0, name="twice")
    gathered = ag.group_by(doubled, ["sample"], [("count", "twice", "n"), ("sum", "twice", "total")])
    longer = rs.pivot_longer(gathered, ["sample"], ["n", "total"])
    assert {(r["sample"], r["name"], float(r["value"])) for r in longer.collect()} == {
        (f"s{s}", name, value) for s in range(3) for name, value in (
            ("n", float(len([i for i in range(10, 30) if i % 3 == s]))), ("total", float(sum(2 * i for i in range(10, 30) if i % 3 == s))))
    }


def test_statistics_then_gc_filter(spark):
    seqs = spark.createDataFrame([("a", "GGCC"), ("b", "AATT"), ("c", "ACGT")], "title string, sequence string")
    rich = cl.filter_rows(sq.dna_stats(seqs, total=False), [("gc_percent", "gte", 50)])
    assert {r["title"] for r in rich.collect()} == {"a", "c"}


def test_genotype_census_counts_in_one_scan(spark):
    from assayloom.operators import variants as va
    from assayloom.plans.catalog import QUERIES

    rows = [("GT:DP", ["0/0:3", "0/1:9"]), ("GT:DP", ["./.:0", "1/1:8"]), ("GT:DP", ["0/0:1", "0/0:2"]), ("GT:DP", [])]
    v = spark.createDataFrame(rows, "format string, sample_values array<string>")
    rules = {"called": {"site": "all-called"}, "missing": {"site": "any-missing"}, "ref": {"site": "all-hom-ref"}, "b alt": {"genotype": "homozygous-alt", "sample_names": ["b"]},
             "rate": {"max_missing_rate": 0.4}, "deep": {"genotype": "heterozygous", "min_depth": 5}, "any": {}}
    got = {r["mode"]: r["sites"] for r in va.genotype_census(v, ["a", "b"], rules).collect()}
    assert got == {name: va.filter_genotypes(v, ["a", "b"], **rule).count() for name, rule in rules.items()}
    assert got == {"called": 2, "missing": 1, "ref": 1, "b alt": 1, "rate": 2, "deep": 1, "any": 3}
    plan = QUERIES["G5_site_modes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
