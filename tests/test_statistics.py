"""Closed forms against published values, and small tables worked by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.functions import distributions as di
from assayloom.operators import ladder, statistics as st
from assayloom.operators.aggregates import describe_numeric
from assayloom.operators.ordering import sample_rows


def test_distribution_functions():
    assert di.t_quantile(0.95, 10) == pytest.approx(2.228139, abs=1e-6)
    assert di.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert di.f_upper(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert di.chi_square_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert di.chi_square_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert di.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)


def test_fisher_tea_tasting():
    assert st.fisher_p_value(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-6)
    assert st.fisher_p_value(3, 1, 1, 3, "greater") == pytest.approx(0.242857, abs=1e-6)
    assert st.fisher_p_value(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-6)


@pytest.mark.parametrize("table", [(0, 5, 7, 2), (10, 0, 0, 10), (3, 3, 3, 3), (1, 9, 11, 3), (2, 30, 9, 14)])
def test_fisher_equals_full_sum(table):
    a, b, c, d = table
    r1, r2, c1 = a + b, c + d, a + c
    p = {x: math.comb(r1, x) * math.comb(r2, c1 - x) / math.comb(r1 + r2, c1) for x in range(max(0, c1 - r2), min(r1, c1) + 1)}
    assert st.fisher_p_value(a, b, c, d) == pytest.approx(sum(v for v in p.values() if v <= p[a] + 1e-12), abs=1e-9)
    assert st.fisher_p_value(a, b, c, d, "less") == pytest.approx(sum(v for x, v in p.items() if x <= a), abs=1e-9)


def test_ranks_with_ties_and_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), (None, 3.0), (None, 3.0)], "g string, v double")
    got = {(r["g"], r["v"]): r["rank"] for r in ladder.average_ranks(df, "v", ["g"]).collect()}
    assert got == {("a", 1.0): 1.0, ("a", 2.0): 2.5, ("a", 5.0): 4.0, (None, 3.0): 1.5}


def test_hot_value_quantiles(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1.0).alias("v"))
    values = sorted(7.0 if i % 3 == 0 else float(i) for i in range(9000))
    row = ladder.quantiles(df, "v", {"a": 0.1, "m": 0.5, "z": 0.97}).first()
    for name, p in (("a", 0.1), ("m", 0.5), ("z", 0.97)):
        place = (len(values) - 1) * p
        low = int(place)
        assert row[name] == pytest.approx(values[low] + (values[min(low + 1, 8999)] - values[low]) * (place - low))


def test_welch_and_paired_p_values(spark):
    rows = [("a", v) for v in (27.5, 21.0, 19.0, 23.6, 17.0, 17.9)] + [("b", v) for v in (27.1, 22.0, 20.8, 23.4, 23.4, 23.5)]
    out = st.two_sample_t(spark.createDataFrame(rows, "g string, v double"), "v", "g", "a", "b").first()
    assert out["p_value"] == pytest.approx(di.t_two_sided(out["statistic"], out["df"]), abs=1e-6)
    assert 0 < out["p_value"] < 1 and out["n_a"] == 6


def test_holm_adjustment(spark):
    rows = [(g, float(v)) for g, base in (("a", 0), ("b", 1), ("c", 10)) for v in (base, base + 1, base + 2, base + 1)]
    got = st.pairwise_t(spark.createDataFrame(rows, "g string, v double"), "v", "g").orderBy("p_value").collect()
    raw = [r["p_value"] for r in got]
    expected, top = [], 0.0
    for i, p in enumerate(raw):
        top = max(top, min(1.0, p * (3 - i)))
        expected.append(top)
    assert [r["p_adjusted"] for r in got] == pytest.approx(expected, abs=1e-7)


def test_kendall_against_pairs(spark):
    data = [(float((i * 7) % 11), float((i * 5 + i // 3) % 9)) for i in range(60)]
    c = d = tx = ty = 0
    for i in range(60):
        for j in range(i + 1, 60):
            x, y = data[i][0] - data[j][0], data[i][1] - data[j][1]
            if x == 0 and y == 0:
                continue
            if x == 0:
                tx += 1
            elif y == 0:
                ty += 1
            elif x * y > 0:
                c += 1
            else:
                d += 1
    tau = (c - d) / math.sqrt((c + d + tx) * (c + d + ty))
    got = st.correlation_matrix(spark.createDataFrame(data, "x double, y double"), ["x", "y"], methods=("kendall",)).filter("row_column = 'x' AND column = 'y'").first()
    assert got["kendall"] == pytest.approx(tau, abs=1e-6)


def test_exact_permutation(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 8.0), (4, "b", 9.0)], "id int, g string, v double")
    result, null = st.permutation_test(df, "v", "g", "a", "b", key=["id"], method="exact")
    row = result.first()
    assert (row["method"], row["runs"], row["extreme"]) == ("exact", 6, 2) and row["p_value"] == pytest.approx(1 / 3)
    assert null.count() == 6


def test_random_permutation_is_stable(spark):
    df = spark.range(80).select("id", F.when(F.col("id") < 40, "a").otherwise("b").alias("g"), (F.col("id") % 17).cast("double").alias("v"))
    run = lambda: st.permutation_test(df, "v", "g", "a", "b", key=["id"], permutations=40)[0].first()
    assert run() == run()


def test_confidence_interval(spark):
    row = describe_numeric(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "v double"), ["v"]).first()
    assert row["mean"] == 4 and row["skewness"] == pytest.approx(1.697056, abs=1e-5) and row["excess_kurtosis"] == pytest.approx(3.152, abs=1e-3)
    assert row["mean_ci_95_high"] - row["mean"] == pytest.approx(2.776445 * row["se"], abs=1e-4)


def test_sample_size_and_seed(spark):
    df = spark.range(5000)
    a = {r["id"] for r in sample_rows(df, 137, 3, ["id"]).collect()}
    assert len(a) == 137 and a == {r["id"] for r in sample_rows(df, 137, 3, ["id"]).collect()}
    assert a != {r["id"] for r in sample_rows(df, 137, 4, ["id"]).collect()}
    assert sample_rows(df, 200, 3, ["id"], replacement=True).count() == 200


def test_fisher_tails_add_up_and_end_soon():
    for a, b, c, d in ((3, 7, 9, 2), (50, 40, 45, 60), (8, 1, 1, 9)):
        less, greater = (st.fisher_p_value(a, b, c, d, side) for side in ("less", "greater"))
        here = math.exp(st._log_hypergeometric(a, a + b, c + d, a + c))
        assert less + greater - here == pytest.approx(1, abs=1e-9)
    assert st.fisher_p_value(600_000_000, 400_000_000, 400_000_000, 600_000_000, "less") == pytest.approx(1)


def test_holm_over_many_groups(spark):
    rows = [(f"g{i % 40}", float((i * 7919) % 101 + (i % 40) // 10)) for i in range(1200)]
    out = st.pairwise_t(spark.createDataFrame(rows, "g string, v double"), "v", "g").select("p_value", "p_adjusted").toPandas().sort_values("p_value")
    assert len(out) == 40 * 39 // 2
    want = np.maximum.accumulate(np.minimum(1, out["p_value"].to_numpy() * (len(out) - np.arange(len(out)))))
    assert np.allclose(out["p_adjusted"], want, atol=1e-4)


def test_permutation_orders_only_draws_at_the_border(spark, monkeypatch):
    """only draws whose hash begins like the border's are ordered; the means are those of ordering all."""
    import hashlib

    from assayloom.operators import statistics as st

    rows = [(i, "a" if i % 3 else "b", float(i * i % 101)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    seen, keep = [], st.numbered
    monkeypatch.setattr(st, "numbered", lambda frame, *rest: seen.append(frame.count()) or keep(frame, *rest))
    monkeypatch.setattr(st, "HASH_DIGITS", 1)
    _, null = st.permutation_test(df, "v", "g", "a", "b", key=["id"], permutations=20)
    got = {r["permutation"]: r["difference"] for r in null.collect()}
    assert sum(seen) < 20 * 600 / 8
    n_a = sum(g == "a" for _, g, _ in rows)
    for p in range(20):
        order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}|{p}|1".encode()).hexdigest(), r[0]))
        first, rest = [r[2] for r in order[:n_a]], [r[2] for r in order[n_a:]]
        assert abs(got[p] - (sum(first) / len(first) - sum(rest) / len(rest))) < 1e-9


def test_component_means_keep_their_digits(spark):
    rows = spark.range(0, 300000, numPartitions=4).select((F.lit(0.1) + F.col("id") % 2 * 0.2).alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    n, means, cov = st._centred(rows, ["x", "y"])
    assert n == 300000 and abs(means[0] - 0.2) <= 1e-16 * 3 and means[1] == 1.0


def test_sample_reads_its_table_no_more_than_needed(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id % 7 AS v").write.parquet(str(tmp_path / "rows"))
    out = sample_rows(spark.read.parquet(str(tmp_path / "rows")), 40, 3, ["id"])
    want = sorted((r["id"] for r in spark.range(5000).select("id", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit("3"))).alias("h")).orderBy("h").limit(40).collect()))
    assert sorted(r["id"] for r in out.collect()) == want
    assert "Relation [" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_described_values_are_not_exchanged_by_column(spark):
    """the values of a column stay in many tasks; what is known of a column is one row and goes to them."""
    from assayloom.operators import aggregates

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all were large
    try:
        out = aggregates.describe_numeric(spark.range(500).selectExpr("id AS a", "id * 2 AS b"), ["a", "b"])
        assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 3
        assert {r["column"]: (r["median"], r["mad"]) for r in out.collect()} == {"a": (249.5, 125.0), "b": (499.0, 250.0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
