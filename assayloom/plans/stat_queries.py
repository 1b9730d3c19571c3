"""Queries for statistics and plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators import plotdata as pd_
from assayloom.operators import statistics as st
from assayloom.plans import fixtures as fx
from assayloom.plans.registry import Tables, query
from assayloom.plans.table_queries import NATURAL


def _moments(column: str, group: str, a: str, b: str, table: str) -> str:
    out = []
    for side, name in (("a", a), ("b", b)):
        f = f"FILTER ({group} = '{name}')"
        out += [f"count({column}) {f} AS n_{side}", f"avg({column}) {f} AS m_{side}", f"var_samp({column}) {f} AS v_{side}"]
    return f"m AS (SELECT {', '.join(out)} FROM {table})"


@query(
    "X1_two_sample_t",
    f"""WITH {_moments("value", "event_type", "view", "click", "events")}
    SELECT n_a, n_b, round(m_a, 6) AS mean_a, round(m_b, 6) AS mean_b, round(m_a - m_b, 6) AS difference,
      round((m_a - m_b) / sqrt(v_a / n_a + v_b / n_b), 6) AS statistic,
      round(power(v_a / n_a + v_b / n_b, 2) / (power(v_a / n_a, 2) / (n_a - 1) + power(v_b / n_b, 2) / (n_b - 1)), 4) AS df,
      round(greatest(v_a, v_b) / least(v_a, v_b), 6) AS variance_ratio FROM m""",
)
def _x1(t: Tables) -> DataFrame:
    out = st.two_sample_t(t.events, "value", "event_type", "view", "click")
    return out.select("n_a", "n_b", "mean_a", "mean_b", "difference", "statistic", F.round("df", 4).alias("df"), "variance_ratio")


@query(
    "X1_student_t",
    f"""WITH {_moments("value", "event_type", "view", "click", "events")}
    SELECT n_a, n_b, round((m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)), 6) AS statistic,
      cast(n_a + n_b - 2 as double) AS df FROM m""",
)
def _x1b(t: Tables) -> DataFrame:
    return st.two_sample_t(t.events, "value", "event_type", "view", "click", test="student").select("n_a", "n_b", "statistic", "df")


@query(
    "X2_pairwise_t",
    """WITH g AS (SELECT event_type AS g, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1)
    SELECT a.g || ' vs ' || b.g AS comparison, a.n AS n_a, b.n AS n_b, round(a.m - b.m, 6) AS difference, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS statistic
    FROM g a JOIN g b ON a.g < b.g""",
)
def _x2(t: Tables) -> DataFrame:
    return st.pairwise_t(t.events, "value", "event_type").select("comparison", "n_a", "n_b", "difference", "statistic")


@query(
    "X3_one_way_anova",
    """WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
    s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * power(m - (SELECT avg(value) FROM events), 2)) AS ssb, sum((n - 1) * v) AS ssw FROM g)
    SELECT k AS group_count, cast(n as bigint) AS observation_count, k - 1 AS df_between, cast(n - k as bigint) AS df_within, round(ssb / (k - 1), 6) AS ms_between,
      round(ssw / (n - k), 6) AS ms_within, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS statistic FROM s""",
)
def _x3(t: Tables) -> DataFrame:
    return st.one_way_anova(t.events, "value", "event_type").select(
        "group_count", "observation_count", "df_between", "df_within", "ms_between", "ms_within", "statistic")


RANKED = """d AS (SELECT v, count(*) AS t FROM x GROUP BY 1),
r AS (SELECT v, t, coalesce(sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rank FROM d),
ties AS (SELECT sum(power(cast(t as double), 3) - t) AS ts, sum(t) AS n FROM d)"""


@query(
    "X4_kruskal_wallis",
    f"""WITH x AS (SELECT event_type AS g, value AS v FROM events), {RANKED},
    s AS (SELECT sum(q) AS q, count(*) AS k FROM (SELECT power(sum(rank), 2) / count(*) AS q FROM x JOIN r USING (v) GROUP BY g)),
    h AS (SELECT k, cast(n as double) AS n, 12 / (cast(n as double) * (n + 1)) * q - 3 * (n + 1) AS raw, 1 - ts / (power(cast(n as double), 3) - n) AS c FROM s, ties)
    SELECT k AS group_count, cast(n as bigint) AS observation_count, k - 1 AS df, round(raw / c, 5) AS statistic FROM h""",
)
def _x4(t: Tables) -> DataFrame:
    out = st.kruskal_wallis(t.events, "value", "event_type")
    return out.select("group_count", "observation_count", "df", F.round("statistic", 5).alias("statistic"))


@query(
    "X5_mann_whitney",
    f"""WITH x AS (SELECT event_type AS g, value AS v FROM events WHERE event_type IN ('view', 'click')), {RANKED},
    s AS (SELECT cast(count(*) FILTER (g = 'view') as double) AS a, cast(count(*) FILTER (g = 'click') as double) AS b, sum(rank) FILTER (g = 'view') AS ra FROM x JOIN r USING (v)),
    u AS (SELECT *, ra - a * (a + 1) / 2 AS ua FROM s, ties)
    SELECT cast(a as bigint) AS n_a, cast(b as bigint) AS n_b, ra AS rank_sum_a, ua AS u_a, a * b - ua AS u_b,
      round((ua - a * b / 2 - sign(ua - a * b / 2) * 0.5) / sqrt(a * b / 12 * (n + 1 - ts / (cast(n as double) * (n - 1)))), 6) AS z FROM u""",
)
def _x5(t: Tables) -> DataFrame:
    return st.mann_whitney(t.events, "value", "event_type", "view", "click").select("n_a", "n_b", "rank_sum_a", "u_a", "u_b", "z")


@query(
    "X6_wilcoxon",
    f"""WITH p AS (SELECT l_quantity * 1000 - l_extendedprice AS d FROM lineitem WHERE l_quantity * 1000 <> l_extendedprice), x AS (SELECT abs(d) AS v, d FROM p), {RANKED},
    s AS (SELECT sum(rank) FILTER (d > 0) AS w, coalesce(sum(rank) FILTER (d < 0), 0) AS l FROM x JOIN r USING (v)), u AS (SELECT *, cast(n as double) AS m FROM s, ties)
    SELECT cast(n as bigint) AS n_pairs, w AS positive_rank_sum, l AS negative_rank_sum,
      round((w - m * (m + 1) / 4 - sign(w - m * (m + 1) / 4) * 0.5) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ts / 48), 6) AS z FROM u""",
)
def _x6(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_extendedprice", (F.col("l_quantity") * 1000).alias("scaled"))
    return st.wilcoxon_signed_rank(df, "l_extendedprice", "scaled").select("n_pairs", "positive_rank_sum", "negative_rank_sum", "z")


@query(
    "X7_paired_t",
    """SELECT count(*) AS n_pairs, round(avg(l_extendedprice), 4) AS mean_first, round(avg(l_quantity * 1000), 4) AS mean_second,
      round(avg(l_quantity * 1000 - l_extendedprice), 4) AS mean_difference, round(stddev_samp(l_quantity * 1000 - l_extendedprice), 4) AS sd_difference,
      round(avg(l_quantity * 1000 - l_extendedprice) / (stddev_samp(l_quantity * 1000 - l_extendedprice) / sqrt(count(*))), 4) AS statistic, cast(count(*) - 1 as double) AS df FROM lineitem""",
)
def _x7(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_extendedprice", (F.col("l_quantity") * 1000).alias("scaled"))
    out = st.paired_t(df, "l_extendedprice", "scaled")
    return out.select("n_pairs", *[F.round(c, 4).alias(c) for c in ("mean_first", "mean_second", "mean_difference", "sd_difference", "statistic")], "df")


@query(
    "X8_two_way_anova",
    """WITH x AS (SELECT l_returnflag AS a, l_linestatus AS b, cast(l_linestatus = 'F' as double) AS i, l_quantity AS v FROM lineitem),
    t AS (SELECT sum(power(v - (SELECT avg(v) FROM x), 2)) AS total, count(*) AS n FROM x),
    ca AS (SELECT a, avg(v) AS mv, avg(i) AS mi, count(DISTINCT a) AS k FROM x GROUP BY a),
    wa AS (SELECT sum(power(v - mv, 2)) AS rss_a, sum((i - mi) * (v - mv)) AS sxy, sum(power(i - mi, 2)) AS sxx FROM x JOIN ca USING (a)),
    cc AS (SELECT a, b, avg(v) AS m FROM x GROUP BY 1, 2), w AS (SELECT sum(power(v - m, 2)) AS rss_f FROM x JOIN cc USING (a, b)),
    k AS (SELECT (SELECT count(*) FROM ca) AS ka, (SELECT count(*) FROM cc) AS cells),
    r AS (SELECT 'l_returnflag' AS source, ka - 1 AS df, total - rss_a AS ss FROM t, wa, k UNION ALL SELECT 'l_linestatus', 1, sxy * sxy / sxx FROM wa
      UNION ALL SELECT 'l_returnflag x l_linestatus', cells - ka - 1, rss_a - sxy * sxy / sxx - rss_f FROM wa, w, k UNION ALL SELECT 'Residual', n - cells, rss_f FROM t, w, k)
    SELECT source, df, round(ss, 3) AS ss, round(ss / df, 3) AS ms, CASE WHEN source <> 'Residual' THEN round(ss / df / (SELECT ss / df FROM r WHERE source = 'Residual'), 4) END AS statistic FROM r""",
)
def _x8(t: Tables) -> DataFrame:
    out = st.two_way_anova(t.lineitem, "l_quantity", "l_returnflag", "l_linestatus")
    return out.select("source", "df", F.round("ss", 3).alias("ss"), F.round("ms", 3).alias("ms"), F.round("statistic", 4).alias("statistic"))


@query(
    "X9_repeated_measures_anova",
    """WITH c AS (SELECT l_suppkey AS s, l_returnflag AS c, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
    f AS (SELECT * FROM c WHERE s IN (SELECT s FROM c GROUP BY s HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem))),
    g AS (SELECT avg(v) AS m, var_pop(v) * count(*) AS st, count(DISTINCT s) AS n, count(DISTINCT c) AS k FROM f),
    ss AS (SELECT sum(power(v - m, 2)) AS x FROM (SELECT avg(v) AS v FROM f GROUP BY s), g), cs AS (SELECT sum(power(v - m, 2)) AS x FROM (SELECT avg(v) AS v FROM f GROUP BY c), g),
    r AS (SELECT n, k, st, k * ss.x AS s_s, n * cs.x AS s_c, st - k * ss.x - n * cs.x AS s_e FROM g, ss, cs)
    SELECT n AS subjects, k AS conditions, k - 1 AS df_condition, n - 1 AS df_subjects, (k - 1) * (n - 1) AS df_error, round(s_c, 6) AS ss_condition, round(s_s, 6) AS ss_subjects,
      round(s_e, 6) AS ss_error, round((s_c / (k - 1)) / (s_e / ((k - 1) * (n - 1))), 6) AS statistic FROM r""",
)
def _x9(t: Tables) -> DataFrame:
    df = t.lineitem.withColumn("subject", F.col("l_suppkey").cast("string"))
    return st.repeated_measures_anova(df, "l_quantity", "subject", "l_returnflag").drop("test", "p_value")


CONTINGENCY = """c AS (SELECT o_orderpriority AS r, o_orderstatus AS c, cast(count(*) as double) AS n FROM orders GROUP BY 1, 2),
e AS (SELECT *, sum(n) OVER (PARTITION BY r) AS rt, sum(n) OVER (PARTITION BY c) AS ct, sum(n) OVER () AS t FROM c)"""


@query(
    "X10_chi_square",
    f"""WITH {CONTINGENCY} SELECT count(DISTINCT r) AS "rows", count(DISTINCT c) AS columns, max(t) AS total, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS df,
      round(sum(power(n - rt * ct / t, 2) / (rt * ct / t)), 6) AS statistic, round(min(rt * ct / t), 6) AS minimum_expected FROM e""",
)
def _x10(t: Tables) -> DataFrame:
    return st.chi_square_independence(t.orders, "o_orderpriority", "o_orderstatus").drop("test", "p_value")


@query(
    "X10_expected_counts",
    f"""WITH {CONTINGENCY} SELECT r AS row_label, c AS column_label, n AS observed, rt AS row_total, ct AS column_total, round(rt * ct / t, 6) AS expected FROM e""",
)
def _x10b(t: Tables) -> DataFrame:
    return st.contingency(t.orders, "o_orderpriority", "o_orderstatus").withColumn("expected", F.round("expected", 6))


@query(
    "X11_fisher_exact",
    """WITH s AS (SELECT count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS a, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS b,
      count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS c, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS d FROM lineitem)
    SELECT a, b, c, d, round(cast(a as double) * d / (cast(b as double) * c), 6) AS odds_ratio FROM s""",
)
def _x11(t: Tables) -> DataFrame:
    return st.fisher_exact(t.lineitem, "l_returnflag", "l_linestatus", ("A", "R"), ("F", "O")).drop("test", "p_value")


def _correlation_sql() -> str:
    columns = ["l_quantity", "l_discount", "l_tax"]
    parts = []
    for a in columns:
        for b in columns:
            ranks = f"(SELECT corr(ra, rb) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb FROM lineitem))"
            tau = f"""(WITH g AS (SELECT {a} AS x, {b} AS y, cast(count(*) as double) AS n FROM lineitem GROUP BY ALL),
              p AS (SELECT sum(p.n * q.n * sign(p.x - q.x) * sign(p.y - q.y)) / 2 AS s FROM g p, g q), n0 AS (SELECT sum(n) * (sum(n) - 1) / 2 AS v FROM g),
              n1 AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM g GROUP BY x)), n2 AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM g GROUP BY y))
              SELECT p.s / sqrt((n0.v - n1.v) * (n0.v - n2.v)) FROM p, n0, n1, n2)"""
            parts.append(f"SELECT '{a}' AS row_column, '{b}' AS \"column\", count(*) AS n, round(corr({a}, {b}), 6) AS correlation, round({ranks}, 6) AS spearman, round({tau}, 6) AS kendall, round(covar_samp({a}, {b}), 6) AS covariance FROM lineitem")
    return " UNION ALL ".join(parts)


@query("X12_correlation_matrix", _correlation_sql())
def _x12(t: Tables) -> DataFrame:
    return st.correlation_matrix(t.lineitem, ["l_quantity", "l_discount", "l_tax"])


@query(
    "X12_rank_correlation_continuous",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS ra, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rb FROM lineitem),
    c AS (SELECT round(corr(ra, rb), 6) AS spearman FROM r), s AS (SELECT count(*) AS n, round(corr(l_extendedprice, l_quantity), 6) AS correlation FROM lineitem)
    SELECT 'l_extendedprice' AS row_column, 'l_quantity' AS "column", n, correlation, spearman FROM s, c UNION ALL SELECT 'l_quantity', 'l_extendedprice', n, correlation, spearman FROM s, c
    UNION ALL SELECT 'l_quantity', 'l_quantity', n, 1, 1 FROM s UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', n, 1, 1 FROM s""",
)
def _x12b(t: Tables) -> DataFrame:
    return st.correlation_matrix(t.lineitem, ["l_extendedprice", "l_quantity"], methods=("pearson", "spearman")).drop("covariance")


@query(
    "X13_simple_regression",
    """WITH m AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2,
      regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxx(l_extendedprice, l_quantity) AS sxx, avg(l_quantity) AS mx FROM lineitem), s AS (SELECT *, syy * (1 - r2) / (n - 2) AS s2 FROM m)
    SELECT n, round(b, 4) AS slope, round(a, 4) AS intercept, round(r2, 6) AS r_squared, round(sqrt(s2), 4) AS residual_se, round(sqrt(s2 / sxx), 4) AS slope_se,
      round(sqrt(s2 * (1 / n + mx * mx / sxx)), 4) AS intercept_se, round(b / sqrt(s2 / sxx), 4) AS slope_t, cast(n - 2 as double) AS df FROM s""",
)
def _x13(t: Tables) -> DataFrame:
    out = st.simple_regression(t.lineitem, "l_quantity", "l_extendedprice")
    four = ["slope", "intercept", "residual_se", "slope_se", "intercept_se", "slope_t"]
    return out.select("n", "r_squared", "df", *[F.round(c, 4).alias(c) for c in four])


@query(
    "X13_regression_rows",
    """WITH m AS (SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a FROM orders)
    SELECT o_orderkey, cast(o_custkey as double) AS x, o_totalprice AS y, round(a + b * o_custkey, 3) AS fitted, round(o_totalprice - (a + b * o_custkey), 3) AS residual FROM orders, m""",
)
def _x13b(t: Tables) -> DataFrame:
    return st.simple_regression_rows(t.orders, "o_custkey", "o_totalprice", ["o_orderkey"], digits=3)


OLS = """m AS (SELECT cast(count(*) as double) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_tax) AS m2, covar_samp(l_quantity, l_quantity) AS s11, covar_samp(l_tax, l_tax) AS s22,
  covar_samp(l_quantity, l_tax) AS s12, covar_samp(l_quantity, l_extendedprice) AS s1y, covar_samp(l_tax, l_extendedprice) AS s2y, var_samp(l_extendedprice) AS syy FROM lineitem),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m),
o AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (n - 1) * (syy - b1 * s1y - b2 * s2y) / (n - 3) AS s2, (b1 * s1y + b2 * s2y) / syy AS r2 FROM b)"""


@query(
    "X14_ols_model",
    f"""WITH {OLS} SELECT cast(n as bigint) AS n, round(r2, 6) AS r_squared, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adjusted_r_squared, round(sqrt(s2), 3) AS residual_se,
      round((r2 * syy * (n - 1) / 2) / s2, 2) AS f_statistic FROM o""",
)
def _x14(t: Tables) -> DataFrame:
    model, _ = st.multiple_regression(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"])
    return model.select("n", "r_squared", "adjusted_r_squared", F.round("residual_se", 3).alias("residual_se"), F.round("f_statistic", 2).alias("f_statistic"))


@query(
    "X14_ols_coefficients",
    f"""WITH {OLS}, c AS (SELECT '(Intercept)' AS term, b0 AS e, sqrt(s2 * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det / (n - 1))) AS se FROM o
      UNION ALL SELECT 'l_quantity', b1, sqrt(s2 * s22 / det / (n - 1)) FROM o UNION ALL SELECT 'l_tax', b2, sqrt(s2 * s11 / det / (n - 1)) FROM o)
    SELECT term, round(e, 3) AS estimate, round(se, 3) AS standard_error, round(e / se, 3) AS t_statistic FROM c""",
)
def _x14b(t: Tables) -> DataFrame:
    _, coefficients = st.multiple_regression(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"])
    return coefficients.select("term", *[F.round(c, 3).alias(c) for c in ("estimate", "standard_error", "t_statistic")])


OUTLIERS = """q AS (SELECT event_type AS g, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS sd, mad(value) AS mad FROM events GROUP BY 1),
o AS (SELECT event_id, g, value AS v, (value - m) / sd AS z, 0.6745 * (value - md) / mad AS mz, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q1, md, q3, m, sd, mad FROM events JOIN q ON event_type = g),
f AS (SELECT *, v < lo OR v > hi AS fi, abs(z) >= 3 AS fz, abs(mz) >= 3.5 AS fm FROM o)"""


@query(
    "X15_outlier_rows",
    f"""WITH {OUTLIERS} SELECT event_id, g AS "group", v AS value, round(z, 6) AS z_score, round(mz, 6) AS modified_z_score, round(lo, 6) AS lower_fence, round(hi, 6) AS upper_fence,
      CASE WHEN fi THEN 'yes' ELSE 'no' END AS iqr_outlier, CASE WHEN fz THEN 'yes' ELSE 'no' END AS z_outlier, CASE WHEN fm THEN 'yes' ELSE 'no' END AS modified_z_outlier,
      concat_ws(',', CASE WHEN fi THEN 'IQR' END, CASE WHEN fz THEN 'z-score' END, CASE WHEN fm THEN 'modified-z' END) AS methods_flagged FROM f""",
)
def _x15(t: Tables) -> DataFrame:
    return st.outlier_diagnostics(t.events, "value", "event_type", keys=["event_id"])[0]


@query(
    "X15_outlier_summary",
    f"""WITH {OUTLIERS} SELECT g AS "group", count(*) AS count, cast(0 as bigint) AS missing, round(any_value(m), 6) AS mean, round(any_value(sd), 6) AS sd, round(any_value(md), 6) AS median, round(any_value(mad), 6) AS mad,
      round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(q3 - q1), 6) AS iqr, round(any_value(lo), 6) AS lower_fence, round(any_value(hi), 6) AS upper_fence,
      count(*) FILTER (fi) AS iqr_outliers, count(*) FILTER (fz) AS z_outliers, count(*) FILTER (fm) AS modified_z_outliers, count(*) FILTER (fi OR fz OR fm) AS any_outliers FROM f GROUP BY 1""",
)
def _x15b(t: Tables) -> DataFrame:
    return st.outlier_diagnostics(t.events, "value", "event_type", keys=["event_id"])[1]


@query(
    "X16_permutation_test",
    """WITH e AS (SELECT event_id, event_type AS g, value AS v FROM events WHERE event_type IN ('view', 'click') AND value IS NOT NULL),
    n AS (SELECT count(*) FILTER (g = 'view') AS na, count(*) FILTER (g = 'click') AS nb, avg(v) FILTER (g = 'view') - avg(v) FILTER (g = 'click') AS d FROM e),
    r AS (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY md5(event_id || '|' || i || '|1'), event_id) AS k FROM e, (SELECT unnest(range(100)) AS i)),
    p AS (SELECT i, avg(v) FILTER (k <= na) - avg(v) FILTER (k > na) AS d FROM r, n GROUP BY i)
    SELECT 'random' AS method, na AS n_a, nb AS n_b, round(any_value(n.d), 6) AS difference, count(*) AS runs, count(*) FILTER (abs(p.d) >= abs(n.d) - 1e-12 * greatest(1, abs(n.d))) AS extreme,
      round((count(*) FILTER (abs(p.d) >= abs(n.d) - 1e-12 * greatest(1, abs(n.d))) + 1) / (count(*) + 1), 8) AS p_value FROM p, n GROUP BY na, nb""",
)
def _x16(t: Tables) -> DataFrame:
    return st.permutation_test(t.events, "value", "event_type", "view", "click", key=["event_id"], permutations=100)[0]


PCA_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("X17_pca_scores")
def _x17(t: Tables) -> DataFrame:
    return st.principal_components(t.lineitem, PCA_COLUMNS, components=2, keys=["l_orderkey", "l_linenumber"])[0]


@query(
    "X17_pca_first_scores",
    # Of two positively correlated columns the first component is their scaled sum.
    """WITH m AS (SELECT avg(l_quantity) AS ma, stddev_samp(l_quantity) AS sa, avg(l_extendedprice) AS mb, stddev_samp(l_extendedprice) AS sb FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(((l_quantity - ma) / sa + (l_extendedprice - mb) / sb) / sqrt(2), 6) AS score FROM lineitem, m""",
)
def _x17c(t: Tables) -> DataFrame:
    scores = st.principal_components(t.lineitem, ["l_quantity", "l_extendedprice"], components=1, keys=["l_orderkey", "l_linenumber"])[0]
    return scores.select("l_orderkey", "l_linenumber", F.col("PC1").alias("score"))


@query(
    "X17_pca_two_columns",
    """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
    SELECT 'PC1' AS component, round(1 + abs(r), 6) AS variance, round((1 + abs(r)) / 2 * 100, 4) AS variance_percent, round((1 + abs(r)) / 2 * 100, 4) AS cumulative_percent FROM c
    UNION ALL SELECT 'PC2', round(1 - abs(r), 6), round((1 - abs(r)) / 2 * 100, 4), 100 FROM c""",
)
def _x17b(t: Tables) -> DataFrame:
    out = st.principal_components(t.lineitem, ["l_quantity", "l_extendedprice"])[2]
    return out.select("component", "variance", *[F.round(c, 4).alias(c) for c in ("variance_percent", "cumulative_percent")])


# --- plot data ---------------------------------------------------------------------------------

@query(
    "P1_histogram",
    """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders),
    k AS (SELECT *, greatest(1, ceil((hi - lo) / (2 * iqr / cbrt(n)))) AS bins FROM s), w AS (SELECT *, (hi - lo) / bins AS w FROM k),
    f AS (SELECT least(bins - 1, greatest(0, floor((o_totalprice - lo) / w))) AS b, count(*) AS c FROM orders, w GROUP BY 1)
    SELECT round(lo + i * w, 6) AS bin_start, round(lo + (i + 1) * w, 6) AS bin_end, coalesce(c, 0) AS count FROM w, (SELECT unnest(range(10000)) AS i) LEFT JOIN f ON b = i WHERE i < bins""",
)
def _p1(t: Tables) -> DataFrame:
    return pd_.histogram(t.orders, "o_totalprice")


BOXES = """q AS (SELECT event_type AS g, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
j AS (SELECT event_id, g, value AS v, q1, md, q3, value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS inside FROM events JOIN q ON event_type = g)"""


@query(
    "P2_box_summary",
    f"""WITH {BOXES} SELECT g AS "group", count(*) AS count, min(v) AS min, round(any_value(q1), 6) AS q1, round(any_value(md), 6) AS median, round(any_value(q3), 6) AS q3, max(v) AS max,
      min(v) FILTER (inside) AS whisker_low, max(v) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outlier_count FROM j GROUP BY 1""",
)
def _p2(t: Tables) -> DataFrame:
    return pd_.box_summary(t.events, "value", "event_type")[0]


@query("P2_box_outliers", f'WITH {BOXES} SELECT event_id, g AS "group", v AS value FROM j WHERE NOT inside')
def _p2b(t: Tables) -> DataFrame:
    return pd_.box_summary(t.events, "value", "event_type", keys=["event_id"])[1]


VIOLIN = """e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
q AS (SELECT event_type AS g, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx FROM events GROUP BY 1),
h AS (SELECT *, 0.9 * least(sd, (q3 - q1) / 1.34) * power(n, -0.2) AS bw FROM q)"""


@query(
    "P3_violin_summary",
    f'WITH {VIOLIN} SELECT g AS "group", n AS count, mn AS min, round(q1, 6) AS q1, round(md, 6) AS median, round(m, 6) AS mean, round(q3, 6) AS q3, mx AS max, round(bw, 6) AS bandwidth FROM h',
)
def _p3(t: Tables) -> DataFrame:
    return pd_.violin_density(t.events, "value", "event_type", grid_points=40)[0]


@query(
    "P3_violin_density",
    f"""WITH {VIOLIN}, grid AS (SELECT i, lo + i * ((hi - lo) / 39) AS x FROM e, (SELECT unnest(range(40)) AS i)),
    d AS (SELECT g, i, x, sum(exp(-0.5 * power((x - value) / bw, 2))) / any_value(n * bw * sqrt(2 * pi())) AS y FROM events JOIN h ON event_type = g, grid GROUP BY 1, 2, 3)
    SELECT g AS "group", round(x, 6) AS value, round(y, 9) AS density, round(y / max(y) OVER (), 6) AS scaled_width FROM d""",
)
def _p3b(t: Tables) -> DataFrame:
    return pd_.violin_density(t.events, "value", "event_type", grid_points=40)[1]


def _gwas(t: Tables) -> DataFrame:
    price = F.floor(F.col("l_extendedprice"))
    return t.lineitem.select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("chr"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("bp"), fx.line_name().alias("snp"),
        ((price % 1000 + 1) / 1001).alias("p"), (F.col("l_quantity") / 10 - 2.5).alias("beta"),
    )


GWAS = f"""gwas AS (SELECT 'chr' || (l_suppkey % 22 + 1) AS chr, l_partkey * 10 + l_linenumber AS bp, {fx.LINE_NAME} AS snp,
  (floor(l_extendedprice) % 1000 + 1) / 1001 AS p, l_quantity / 10 - 2.5 AS beta FROM lineitem)"""


@query(
    "P4_volcano",
    f"""WITH {GWAS} SELECT snp AS label, round(beta, 6) AS log2_fold_change, round(p, 10) AS p_value, round(-log10(p), 6) AS neg_log10_p,
      CASE WHEN p <= 0.05 AND beta >= 1 THEN 'up' WHEN p <= 0.05 AND beta <= -1 THEN 'down' ELSE 'not significant' END AS class FROM gwas""",
)
def _p4(t: Tables) -> DataFrame:
    return pd_.volcano(_gwas(t), "beta", "p", "snp")


@query(
    "P5_manhattan",
    f"""WITH {GWAS}, n AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY bp, snp) AS i, row_number() OVER (ORDER BY {NATURAL.format("chr")}, bp, snp) AS pos,
      row_number() OVER (PARTITION BY chr ORDER BY round(-log10(p), 6) DESC, bp, snp) AS best FROM gwas)
    SELECT snp AS marker, chr AS chromosome, bp AS position, round(p, 12) AS p_value, round(-log10(p), 6) AS neg_log10_p, pos AS plot_position,
      (min(pos) OVER (PARTITION BY chr) + max(pos) OVER (PARTITION BY chr)) / 2 AS chromosome_center, CASE WHEN best = 1 THEN 'yes' ELSE 'no' END AS top_marker FROM n""",
)
def _p5(t: Tables) -> DataFrame:
    return pd_.manhattan(_gwas(t), "chr", "bp", "p", "snp")


@query("P6_point_frame", "SELECT cast(o_orderkey as varchar) AS label, o_orderstatus AS series, cast(o_custkey as double) AS x, o_totalprice AS y FROM orders")
def _p6(t: Tables) -> DataFrame:
    return pd_.point_frame(t.orders, "o_custkey", "o_totalprice", series="o_orderstatus", label="o_orderkey")


@query(
    "P7_draw_limit_even",
    """WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders),
    s AS (SELECT DISTINCT floor(i * ((n - 1) / 699) + 0.5) AS r FROM (SELECT unnest(range(700)) AS i), (SELECT count(*) AS n FROM orders))
    SELECT o_orderkey, o_totalprice FROM n WHERE r IN (SELECT r FROM s)""",
)
def _p7(t: Tables) -> DataFrame:
    return pd_.draw_limit(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], 700)


@query("P7_draw_limit_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 700")
def _p7b(t: Tables) -> DataFrame:
    return pd_.draw_limit(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], 700, mode="first")


@query(
    "P8_density_track",
    f"""WITH {fx.INTERVALS}, l AS (SELECT record, max("end") AS length FROM a GROUP BY 1),
    bins AS (SELECT record, length, bin, cast(floor(bin * length / 64) as bigint) AS s, CASE WHEN bin = 63 THEN length ELSE cast(floor((bin + 1) * length / 64) as bigint) END AS e FROM l, (SELECT unnest(range(64)) AS bin)),
    o AS (SELECT b.record, bin, least(a."end", e) - greatest(a."start" - 1, s) AS ov FROM bins b JOIN a ON a.record = b.record AND a."start" - 1 < e AND a."end" > s
      AND bin BETWEEN floor((a."start" - 1) / length * 64) AND floor((a."end" - 1) / length * 64))
    SELECT record, bin, s AS "start", e AS "end", count(ov) AS count, cast(coalesce(sum(ov), 0) as bigint) AS bases FROM bins LEFT JOIN o USING (record, bin) GROUP BY 1, 2, 3, 4""",
)
def _p8(t: Tables) -> DataFrame:
    a = fx.intervals_a(t)
    return pd_.density_track(a, a.groupBy("record").agg(F.max("end").alias("length")), 64)


@query(
    "P8_point_density",
    f"""WITH {fx.INTERVALS}, l AS (SELECT record, max("end") AS length FROM a GROUP BY 1)
    SELECT record, least(63, cast(floor((least(length, "start") - 1) / length * 64) as bigint)) AS bin, count(*) AS count FROM a JOIN l USING (record) GROUP BY 1, 2""",
)
def _p8b(t: Tables) -> DataFrame:
    a = fx.intervals_a(t)
    return pd_.point_density(a.withColumnRenamed("start", "position"), a.groupBy("record").agg(F.max("end").alias("length")), 64)
