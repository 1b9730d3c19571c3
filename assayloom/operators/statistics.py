"""Tests, correlation, regression and diagnostics on data of any size.

Every function reduces the table to sufficient statistics with Spark aggregates; the closed
forms then work on one or a few rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.functions.cells import number_of, text_of
from assayloom.functions.distributions import (
    chi_square_p_value,
    f_p_value,
    f_upper,
    normal_p_value,
    t_p_value,
    t_two_sided,
)
from assayloom.operators.ladder import null_safe_join, numbered, quantiles, running_max, running_total, value_ladder
from assayloom.session import settle


def _group(df: DataFrame, name: str) -> Column:
    text = F.trim(text_of(df, name))
    return F.when(text != "", text)


def grouped_values(df: DataFrame, value: str, group: str) -> DataFrame:
    """``(g, v)`` rows with a group label and a finite number."""
    out = df.select(_group(df, group).alias("g"), number_of(df, value).alias("v"))
    return out.filter(F.col("g").isNotNull() & F.col("v").isNotNull())


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s2"))


def _two_groups(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the moments of both groups."""
    picks = []
    for side, name in (("a", a), ("b", b)):
        only = F.when(F.col("g") == name, F.col("v"))
        picks += [F.count(only).alias(f"n_{side}"), F.avg(only).alias(f"m_{side}"), F.var_samp(only).alias(f"v_{side}")]
    return rows.filter(F.col("g").isin(a, b)).agg(*picks)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(F.least(a, b) > 0, F.greatest(a, b) / F.least(a, b))


def _welch(n_a: Column, n_b: Column, m_a: Column, m_b: Column, v_a: Column, v_b: Column) -> tuple[Column, Column]:
    se_a, se_b = v_a / n_a, v_b / n_b
    spread = se_a + se_b
    t = F.when(spread > 0, (m_a - m_b) / F.sqrt(spread)).when(m_a == m_b, 0.0)
    df = F.when(
        spread > 0, spread * spread / (se_a * se_a / (n_a - 1) + se_b * se_b / (n_b - 1))
    ).otherwise((n_a + n_b - 2).cast("double"))
    return t, df


def two_sample_t(df: DataFrame, value: str, group: str, group_a: str, group_b: str, *, test: str = "welch") -> DataFrame:
    one = _two_groups(grouped_values(df, value, group), group_a, group_b)
    c = {x: F.col(x) for x in one.columns}
    if test == "student":
        pooled = ((c["n_a"] - 1) * c["v_a"] + (c["n_b"] - 1) * c["v_b"]) / (c["n_a"] + c["n_b"] - 2)
        t = (c["m_a"] - c["m_b"]) / F.sqrt(pooled * (1 / c["n_a"] + 1 / c["n_b"]))
        dof = (c["n_a"] + c["n_b"] - 2).cast("double")
        label = "Student two-sample t-test"
    else:
        t, dof = _welch(c["n_a"], c["n_b"], c["m_a"], c["m_b"], c["v_a"], c["v_b"])
        label = "Welch two-sample t-test"
    return one.filter((c["n_a"] >= 2) & (c["n_b"] >= 2)).select(
        F.lit(label).alias("test"), F.lit(value).alias("value_column"), F.lit(group).alias("group_column"),
        F.lit(group_a).alias("group_a"), F.lit(group_b).alias("group_b"), "n_a", "n_b",
        F.round("m_a", 6).alias("mean_a"), F.round("m_b", 6).alias("mean_b"), F.round(c["m_a"] - c["m_b"], 6).alias("difference"),
        F.round(t, 6).alias("statistic"), F.round(dof, 6).alias("df"), F.round(t_p_value(t, dof), 8).alias("p_value"),
        F.round(_ratio(c["v_a"], c["v_b"]), 6).alias("variance_ratio"),
    )


#: Groups meet in so many buckets a side, so that their pairs are dealt over the square of it.
PAIR_BUCKETS = 16


def pairwise_t(df: DataFrame, value: str, group: str, *, adjustment: str = "holm") -> DataFrame:
    """Welch tests of all group pairs with adjusted p values."""
    moments = settle(_moments(grouped_values(df, value, group)).filter("n >= 2").select(F.struct("g", "n", "m", "s2").alias("x")))
    bucket, every = F.pmod(F.xxhash64("x.g"), F.lit(PAIR_BUCKETS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(PAIR_BUCKETS - 1)))
    left = moments.select(F.col("x").alias("a"), bucket.alias("i"), every.alias("j"))
    right = moments.select(F.col("x").alias("b"), bucket.alias("j"), every.alias("i"))
    t, dof = _welch(*[F.col(x) for x in ("a.n", "b.n", "a.m", "b.m", "a.s2", "b.s2")])
    pairs = left.join(right, ["i", "j"]).filter(F.col("a.g") < F.col("b.g"))
    tested = pairs.select("a", "b", t.alias("t"), dof.alias("dof")).withColumn("p", t_p_value(F.col("t"), F.col("dof")))
    tested = settle(tested).withColumn("ga", F.col("a.g")).withColumn("gb", F.col("b.g"))
    total = tested.agg(F.count(F.lit(1)).alias("n")).scalar()
    if adjustment == "holm":
        order = [F.col("p"), F.col("ga"), F.col("gb")]
        step = F.least(F.lit(1.0), F.col("p") * (F.col("total") - F.col("k") + 1))
        adjusted = running_max(numbered(tested, order, "k").withColumn("total", total), order, step, "p_adj")
    else:
        factor = total if adjustment == "bonferroni" else F.lit(1)
        adjusted = tested.withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * factor))
    return adjusted.select(
        F.concat(F.col("a.g"), F.lit(" vs "), F.col("b.g")).alias("comparison"), F.lit("Pairwise Welch t-test").alias("test"),
        F.lit(value).alias("value_column"), F.lit(group).alias("group_column"),
        F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"),
        F.round("a.m", 6).alias("mean_a"), F.round("b.m", 6).alias("mean_b"), F.round(F.col("a.m") - F.col("b.m"), 6).alias("difference"),
        F.round("t", 6).alias("statistic"), F.round("dof", 6).alias("df"), F.round("p", 8).alias("p_value"),
        F.round("p_adj", 8).alias("p_adjusted"), F.lit(adjustment).alias("adjustment"),
        F.round(_ratio(F.col("a.s2"), F.col("b.s2")), 6).alias("variance_ratio"),
    )


def one_way_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    rows = grouped_values(df, value, group)
    grand = rows.agg(F.avg("v").alias("m")).scalar()
    parts = _moments(rows).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("m") - grand) * (F.col("m") - grand)).alias("ssb"),
        F.sum(F.coalesce(F.col("s2"), F.lit(0.0)) * (F.col("n") - 1)).alias("ssw"),
        F.max("s2").alias("hi"), F.min("s2").alias("lo"),
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    msb, msw = F.col("ssb") / d1, F.col("ssw") / d2
    f = F.when(msw > 0, msb / msw)
    return parts.select(
        F.lit("One-way ANOVA").alias("test"), F.lit(value).alias("value_column"), F.lit(group).alias("group_column"),
        F.col("k").alias("group_count"), F.col("n").alias("observation_count"), d1.alias("df_between"), d2.alias("df_within"),
        F.round(msb, 6).alias("ms_between"), F.round(msw, 6).alias("ms_within"), F.round(f, 6).alias("statistic"),
        F.round(f_p_value(f, d1.cast("double"), d2.cast("double")), 8).alias("p_value"),
        F.round(F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")), 6).alias("variance_ratio"),
    )


def _rank_counts(rows: DataFrame) -> DataFrame:
    """``(g, v, c)`` counts with the shared rank of ``v`` over all groups and its tie size ``n``."""
    counts = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    ladder = value_ladder(counts, "v", weight="c").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    return counts.join(ladder, "v")


def _tie_sum(ranked: DataFrame) -> Column:
    # A value with tie size n spreads over the groups that hold it: c / n of its tie term each.
    n = F.col("n").cast("double")
    return F.sum(F.col("c") * (n * n - 1))


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    ranked = _rank_counts(grouped_values(df, value, group))
    per_group = ranked.groupBy("g").agg(
        F.sum("c").cast("double").alias("n"), F.sum(F.col("rank") * F.col("c")).alias("r"), _tie_sum(ranked).alias("ties")
    )
    one = per_group.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("ties").alias("ties")
    )
    n = F.col("n")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    correction = F.when(n > 1, 1 - F.col("ties") / (n * n * n - n)).otherwise(1.0)
    h = F.when(correction > 0, raw / correction)
    dof = F.col("k") - 1
    return one.select(
        F.lit("Kruskal-Wallis").alias("test"), F.lit(value).alias("value_column"), F.lit(group).alias("group_column"),
        F.col("k").alias("group_count"), n.cast("bigint").alias("observation_count"), dof.alias("df"),
        F.round(h, 6).alias("statistic"), F.round(correction, 6).alias("tie_correction"),
        F.round(chi_square_p_value(h, dof.cast("double")), 8).alias("p_value"),
    )


def _continuity(distance: Column, on: bool) -> Column:
    return distance - F.signum(distance) * 0.5 if on else distance


def mann_whitney(df: DataFrame, value: str, group: str, group_a: str, group_b: str, *, continuity: bool = True) -> DataFrame:
    rows = grouped_values(df, value, group).filter(F.col("g").isin(group_a, group_b))
    ranked = _rank_counts(rows)
    of = lambda name, column: F.sum(F.when(F.col("g") == name, column)).cast("double")
    one = ranked.agg(
        of(group_a, F.col("c")).alias("a"), of(group_b, F.col("c")).alias("b"), of(group_a, F.col("rank") * F.col("c")).alias("ra"),
        _tie_sum(ranked).alias("ties"),
    )
    a, b = F.col("a"), F.col("b")
    n = a + b
    u_a = F.col("ra") - a * (a + 1) / 2
    variance = a * b * (n + 1 - F.col("ties") / (n * (n - 1))) / 12
    z = F.when(variance > 0, _continuity(u_a - a * b / 2, continuity) / F.sqrt(variance))
    return one.select(
        F.lit("Mann-Whitney U").alias("test"), F.lit(value).alias("value_column"), F.lit(group).alias("group_column"),
        F.lit(group_a).alias("group_a"), F.lit(group_b).alias("group_b"), a.cast("bigint").alias("n_a"), b.cast("bigint").alias("n_b"),
        F.round("ra", 6).alias("rank_sum_a"), F.round(u_a, 6).alias("u_a"), F.round(a * b - u_a, 6).alias("u_b"),
        F.round(z, 6).alias("z"), F.round(normal_p_value(z), 8).alias("p_value"),
    )


def _differences(df: DataFrame, first: str, second: str) -> DataFrame:
    pairs = df.select(number_of(df, first).alias("x"), number_of(df, second).alias("y"))
    return pairs.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("d", F.col("y") - F.col("x"))


def wilcoxon_signed_rank(df: DataFrame, first: str, second: str, *, continuity: bool = True) -> DataFrame:
    signed = _differences(df, first, second).filter("d <> 0").select(
        F.abs("d").alias("v"), F.when(F.col("d") > 0, "+").otherwise("-").alias("g")
    )
    ranked = _rank_counts(signed)
    one = ranked.agg(
        F.sum("c").cast("double").alias("n"), F.sum(F.when(F.col("g") == "+", F.col("rank") * F.col("c")).otherwise(0.0)).alias("w"),
        F.sum(F.when(F.col("g") == "-", F.col("rank") * F.col("c")).otherwise(0.0)).alias("l"), _tie_sum(ranked).alias("ties"),
    )
    n = F.col("n")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.when(variance > 0, _continuity(F.col("w") - n * (n + 1) / 4, continuity) / F.sqrt(variance))
    return one.select(
        F.lit("Wilcoxon signed-rank").alias("test"), F.lit(first).alias("first_column"), F.lit(second).alias("second_column"),
        n.cast("bigint").alias("n_pairs"), F.round("w", 6).alias("positive_rank_sum"), F.round("l", 6).alias("negative_rank_sum"),
        F.round(z, 6).alias("z"), F.round(normal_p_value(z), 8).alias("p_value"),
    )


def paired_t(df: DataFrame, first: str, second: str) -> DataFrame:
    one = _differences(df, first, second).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("d").alias("md"), F.stddev_samp("d").alias("sd")
    )
    t = F.when(F.col("sd") > 0, F.col("md") / (F.col("sd") / F.sqrt(F.col("n"))))
    dof = (F.col("n") - 1).cast("double")
    return one.select(
        F.lit("Paired t-test").alias("test"), F.lit(first).alias("first_column"), F.lit(second).alias("second_column"),
        F.col("n").alias("n_pairs"), F.round("mx", 6).alias("mean_first"), F.round("my", 6).alias("mean_second"),
        F.round("md", 6).alias("mean_difference"), F.round("sd", 6).alias("sd_difference"),
        F.round(t, 6).alias("statistic"), dof.alias("df"), F.round(t_p_value(t, dof), 8).alias("p_value"),
    )


def two_way_anova(df: DataFrame, value: str, factor_a: str, factor_b: str, *, max_cells: int = 100_000) -> DataFrame:
    """Sequential sums of squares A, B, A x B. Count, mean and variance of each cell are sufficient."""
    rows = df.select(_group(df, factor_a).alias("a"), _group(df, factor_b).alias("b"), number_of(df, value).alias("v")).dropna()
    cells = rows.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count(F.lit(1))).alias("ss")
    ).limit(max_cells + 1).toPandas()
    if len(cells) > max_cells:
        raise ValueError(f"more than {max_cells} factor combinations")
    cells = cells.sort_values(["a", "b"])
    weight = np.sqrt(cells["n"].to_numpy(float))
    target = cells["m"].to_numpy(float)
    within = float(cells["ss"].sum())
    dummy = lambda s: pd.get_dummies(s, drop_first=True).to_numpy(float)
    one, a, b = np.ones((len(cells), 1)), dummy(cells["a"]), dummy(cells["b"])

    def fit(*blocks: np.ndarray) -> tuple[float, int]:
        design = np.hstack(blocks) * weight[:, None]
        solution, _, rank, _ = np.linalg.lstsq(design, target * weight, rcond=None)
        gap = target * weight - design @ solution
        return float(gap @ gap) + within, int(rank)

    total, additive = fit(one), fit(one, a, b)
    only_a, full = fit(one, a), (within, len(cells))
    n = int(cells["n"].sum())
    residual_df = n - len(cells)
    residual = within / residual_df if residual_df > 0 else float("nan")
    out = []
    for source, before, after in ((factor_a, total, only_a), (factor_b, only_a, additive), (f"{factor_a} x {factor_b}", additive, full)):
        ss, dof = max(0.0, before[0] - after[0]), after[1] - before[1]
        ms = ss / dof if dof > 0 else None
        f = ms / residual if ms is not None and residual > 0 else None
        out.append((source, dof, ss, ms, f, f_upper(f, dof, residual_df) if f is not None else None))
    out.append(("Residual", residual_df, within, residual, None, None))
    table = df.sparkSession.createDataFrame(out, "source string, df bigint, ss double, ms double, statistic double, p_value double")
    return table.select(
        F.lit("Two-way ANOVA").alias("test"), "source", "df", *[F.round(c, 6).alias(c) for c in ("ss", "ms", "statistic")],
        F.round("p_value", 8).alias("p_value"),
    )


def repeated_measures_anova(df: DataFrame, value: str, subject: str, condition: str) -> DataFrame:
    """Subjects with every condition only; repeated cells are averaged."""
    rows = df.select(_group(df, subject).alias("s"), _group(df, condition).alias("c"), number_of(df, value).alias("v")).dropna()
    cells = rows.groupBy("s", "c").agg(F.avg("v").alias("v"))
    k = rows.agg(F.count_distinct("c").alias("k")).scalar()
    whole = cells.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("s")
    kept = cells.join(whole, "s", "left_semi")
    grand = kept.agg(F.avg("v").alias("m"), (F.var_pop("v") * F.count(F.lit(1))).alias("ss_total"), F.count(F.lit(1)).alias("cells"))
    subjects = kept.groupBy("s").agg(F.avg("v").alias("m")).agg(F.var_pop("m").alias("v"), F.count(F.lit(1)).alias("n"))
    conditions = kept.groupBy("c").agg(F.avg("v").alias("m")).agg(F.var_pop("m").alias("v"), F.count(F.lit(1)).alias("n"))
    one = grand.select(
        "ss_total",
        subjects.select(F.struct("v", "n")).scalar().alias("s"), conditions.select(F.struct("v", "n")).scalar().alias("c"),
    )
    n, k = F.col("s.n"), F.col("c.n")
    ss_s, ss_c = k * n * F.col("s.v"), n * k * F.col("c.v")
    ss_e = F.greatest(F.lit(0.0), F.col("ss_total") - ss_s - ss_c)
    d_c, d_e = k - 1, (k - 1) * (n - 1)
    f = F.when(ss_e > 0, (ss_c / d_c) / (ss_e / d_e))
    return one.select(
        F.lit("Repeated-measures ANOVA").alias("test"), n.alias("subjects"), k.alias("conditions"), d_c.alias("df_condition"),
        (n - 1).alias("df_subjects"), d_e.alias("df_error"), F.round(ss_c, 6).alias("ss_condition"), F.round(ss_s, 6).alias("ss_subjects"),
        F.round(ss_e, 6).alias("ss_error"), F.round(f, 6).alias("statistic"),
        F.round(f_p_value(f, d_c.cast("double"), d_e.cast("double")), 8).alias("p_value"),
    )


def contingency(df: DataFrame, row: str, column: str, count: str | None = None) -> DataFrame:
    """Observed and expected counts of each filled cell, from raw rows or from a count column."""
    cells = df.select(_group(df, row).alias("r"), _group(df, column).alias("c"), (number_of(df, count) if count else F.lit(1.0)).alias("n")).dropna()
    cells = cells.groupBy("r", "c").agg(F.sum("n").alias("observed"))
    rows = cells.groupBy("r").agg(F.sum("observed").alias("row_total"))
    columns = cells.groupBy("c").agg(F.sum("observed").alias("column_total"))
    total = cells.agg(F.sum("observed").alias("t")).scalar()
    return cells.join(rows, "r").join(columns, "c").select(
        F.col("r").alias("row_label"), F.col("c").alias("column_label"), "observed", "row_total", "column_total",
        (F.col("row_total") * F.col("column_total") / total).alias("expected"),
    )


def chi_square_independence(df: DataFrame, row: str, column: str, count: str | None = None) -> DataFrame:
    """Empty cells add their expected count each: all of those together are the total minus the expected sum of filled cells."""
    cells = contingency(df, row, column, count)
    one = cells.agg(
        F.count_distinct("row_label").alias("rows"), F.count_distinct("column_label").alias("columns"), F.sum("observed").alias("total"),
        F.sum("expected").alias("covered"), F.min("expected").alias("minimum_expected"),
        F.sum((F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected")) / F.col("expected")).alias("filled"),
    )
    x2 = F.col("filled") + F.col("total") - F.col("covered")
    dof = (F.col("rows") - 1) * (F.col("columns") - 1)
    return one.select(
        F.lit("Chi-square independence").alias("test"), "rows", "columns", F.round("total", 6).alias("total"), dof.alias("df"),
        F.round(x2, 6).alias("statistic"), F.round(chi_square_p_value(x2, dof.cast("double")), 8).alias("p_value"),
        F.round("minimum_expected", 6).alias("minimum_expected"),
    )


def _log_hypergeometric(x: int, r1: int, r2: int, c1: int) -> float:
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    return choose(r1, x) + choose(r2, c1 - x) - choose(r1 + r2, c1)


def fisher_p_value(a: int, b: int, c: int, d: int, alternative: str = "two-sided") -> float:
    """Exact 2x2 p value. Probabilities fall off on both sides of the mode, so each tail is
    summed outward until its terms no longer count."""
    r1, r2, c1 = a + b, c + d, a + c
    low, high = max(0, c1 - r2), min(r1, c1)
    log_p = lambda x: _log_hypergeometric(x, r1, r2, c1)
    mode = min(high, max(low, (r1 + 1) * (c1 + 1) // (r1 + r2 + 2)))

    def tail(start: int, step: int) -> float:
        total, x, peak = 0.0, start, 0.0
        while low <= x <= high:
            term = math.exp(log_p(x))
            total += term
            peak = max(peak, term)
            past_mode = x <= mode if step < 0 else x >= mode
            if past_mode and term <= peak * 1e-18:
                break
            x += step
        return total

    # From beyond the mode a tail would be summed over the whole distribution: then its complement is.
    if alternative == "less":
        return min(1.0, tail(a, -1) if a <= mode else max(0.0, 1.0 - tail(a + 1, 1)))
    if alternative == "greater":
        return min(1.0, tail(a, 1) if a >= mode else max(0.0, 1.0 - tail(a - 1, -1)))
    limit = math.log(math.exp(log_p(a)) + 1e-12)

    def boundary(inner: int, outer: int) -> int | None:
        """The value nearest to the mode, between it and ``outer``, whose probability is within the limit."""
        if log_p(outer) > limit:
            return None
        near, far = inner, outer
        if log_p(near) <= limit:
            return near
        while abs(far - near) > 1:
            mid = (near + far) // 2
            near, far = (near, mid) if log_p(mid) <= limit else (mid, far)
        return far

    left, right = boundary(mode, low), boundary(mode, high)
    total = (tail(left, -1) if left is not None else 0.0) + (tail(right, 1) if right is not None else 0.0)
    if left is not None and left == right:
        total -= math.exp(log_p(left))
    return min(1.0, total)


def fisher_exact(df: DataFrame, row: str, column: str, rows: tuple[str, str], columns: tuple[str, str],
                 alternative: str = "two-sided") -> DataFrame:
    r, c = _group(df, row), _group(df, column)
    cell = lambda i, j: F.count(F.when((r == rows[i]) & (c == columns[j]), 1))
    one = df.agg(cell(0, 0).alias("a"), cell(0, 1).alias("b"), cell(1, 0).alias("c"), cell(1, 1).alias("d"))

    @F.pandas_udf(T.DoubleType())
    def p_value(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_p_value(*map(int, v), alternative) for v in zip(a, b, c, d)])

    a, b, c_, d = (F.col(x) for x in "abcd")
    return one.select(
        F.lit("Fisher exact").alias("test"), "a", "b", "c", "d",
        F.round(F.when(b * c_ > 0, a * d / (b * c_)), 6).alias("odds_ratio"), F.round(p_value(a, b, c_, d), 8).alias("p_value"),
    )


# --- correlation -------------------------------------------------------------------------------

def _pair_frame(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Complete (x, y) values per column pair, counted, so later joins see each value pair once."""
    numbers = df.select(*[number_of(df, c).alias(c) for c in dict.fromkeys(itertools.chain(*pairs))])
    cells = [F.struct(F.lit(i).alias("pair"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for i, (a, b) in enumerate(pairs)]
    long = numbers.select(F.explode(F.array(*cells)).alias("p")).select("p.*").dropna()
    return long.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("c"))


def _spearman(counted: DataFrame) -> DataFrame:
    ranks = {}
    for side in ("x", "y"):
        ladder = value_ladder(counted, side, ["pair"], "c")
        ranks[side] = ladder.select("pair", side, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{side}"))
    sizes = counted.groupBy("pair").agg(((F.sum("c") + 1) / 2).alias("mid"))
    rx, ry, c = F.col("rx") - F.col("mid"), F.col("ry") - F.col("mid"), F.col("c")
    sums = counted.join(ranks["x"], ["pair", "x"]).join(ranks["y"], ["pair", "y"]).join(sizes, "pair").groupBy("pair").agg(
        F.sum(c * rx * ry).alias("xy"), F.sum(c * rx * rx).alias("xx"), F.sum(c * ry * ry).alias("yy")
    )
    scale = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select("pair", F.when(scale > 0, F.col("xy") / scale).alias("spearman"))


def _kendall(counted: DataFrame) -> DataFrame:
    """Tau-b by counting inversions bit by bit, never pair by pair.

    Two values of y first differ in one bit of their place codes. Within all rows that agree
    above that bit, ordered by x, each 0 after a 1 is one discordant pair; a running sum of the
    1s counts them. A row takes part once per bit.
    """
    codes = value_ladder(counted, "y", ["pair"], "c").select("pair", "y", F.col("before").alias("code"))
    coded = counted.join(codes, ["pair", "y"])
    top = coded.agg(F.max("code")).first()[0] or 0
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(0, int(top).bit_length() - 1))))
    bits = coded.select("pair", "x", "y", F.col("c").cast("double").alias("c"), "code", levels.alias("level"))
    bits = bits.select(
        "pair", "x", "y", "c", "level", F.expr("shiftright(code, level + 1)").alias("prefix"),
        F.expr("shiftright(code, level) & 1").alias("bit"),
    )
    ones = F.when(F.col("bit") == 1, F.col("c")).otherwise(F.lit(0.0))
    counted_ones = running_total(bits, [F.col("x"), F.col("y")], ones, "ones", ["pair", "level", "prefix"])
    discordant = counted_ones.filter("bit = 0").groupBy("pair").agg(F.sum(F.col("c") * F.col("ones")).alias("d"))

    def tied(*keys: str) -> DataFrame:
        groups = counted.groupBy("pair", *keys).agg(F.sum("c").cast("double").alias("n"))
        return groups.groupBy("pair").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("t_" + "".join(keys)))

    joined = tied("x").join(tied("y"), "pair").join(tied("x", "y"), "pair").join(tied(), "pair").join(discordant, "pair", "left")
    d = F.coalesce("d", F.lit(0.0))
    concordant = F.col("t_") - F.col("t_x") - F.col("t_y") + F.col("t_xy") - d
    scale = F.sqrt((F.col("t_") - F.col("t_x")) * (F.col("t_") - F.col("t_y")))
    return joined.select("pair", F.when(scale > 0, (concordant - d) / scale).alias("kendall"))


def correlation_matrix(df: DataFrame, columns: Sequence[str], *, methods: Sequence[str] = ("pearson", "spearman", "kendall")) -> DataFrame:
    """The full matrix, pairwise complete. Each unordered pair is worked out once."""
    pairs = list(itertools.combinations(columns, 2))
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        x, y = number_of(df, a), number_of(df, b)
        aggregates += [
            F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias(f"n{i}"), F.corr(x, y).alias(f"r{i}"), F.covar_samp(x, y).alias(f"c{i}")
        ]
    for i, a in enumerate(columns):
        aggregates += [F.count(number_of(df, a)).alias(f"dn{i}"), F.var_samp(number_of(df, a)).alias(f"dv{i}")]
    wide = df.agg(*aggregates)

    def cell(pair: int, a: str, b: str, n: Column, r: Column, c: Column) -> Column:
        return F.struct(
            F.lit(pair).alias("pair"), F.lit(a).alias("row_column"), F.lit(b).alias("column"), n.alias("n"),
            r.cast("double").alias("correlation"), c.alias("covariance"),
        )

    cells = []
    for i, (a, b) in enumerate(pairs):
        cells += [cell(i, p, q, F.col(f"n{i}"), F.col(f"r{i}"), F.col(f"c{i}")) for p, q in ((a, b), (b, a))]
    for i, a in enumerate(columns):
        cells.append(cell(-1, a, a, F.col(f"dn{i}"), F.when(F.col(f"dv{i}") > 0, 1.0), F.col(f"dv{i}")))
    out = wide.select(F.explode(F.array(*cells)).alias("p")).select("p.*")
    counted = _pair_frame(df, pairs)
    for method, build in (("spearman", _spearman), ("kendall", _kendall)):
        if method in methods:
            out = out.join(build(counted), "pair", "left").withColumn(
                method, F.when(F.col("pair") < 0, F.col("correlation")).otherwise(F.col(method))
            )
    values = [c for c in ("correlation", "spearman", "kendall", "covariance") if c in out.columns]
    return out.select("row_column", "column", "n", *[F.round(c, 6).alias(c) for c in values])


# --- regression and projection -----------------------------------------------------------------

def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Model row of ``y ~ x``."""
    pairs = df.select(number_of(df, x).alias("x"), number_of(df, y).alias("y")).dropna()
    one = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.avg("x").alias("mx"),
    )
    n = F.col("n")
    explained = F.col("slope") * F.col("sxy")
    rss = F.greatest(F.lit(0.0), F.col("syy") - explained)
    dof = (n - 2).cast("double")
    sigma2 = rss / dof
    se = F.sqrt(sigma2 / F.col("sxx"))
    se0 = F.sqrt(sigma2 * (1 / n + F.col("mx") * F.col("mx") / F.col("sxx")))
    t = F.when(se > 0, F.col("slope") / se)
    return one.select(
        F.lit(x).alias("x_column"), F.lit(y).alias("y_column"), n.alias("n"), F.round("slope", 6).alias("slope"),
        F.round("intercept", 6).alias("intercept"), F.round(F.when(F.col("syy") > 0, explained / F.col("syy")), 6).alias("r_squared"),
        F.round(F.sqrt(sigma2), 6).alias("residual_se"), F.round(se, 6).alias("slope_se"), F.round(se0, 6).alias("intercept_se"),
        F.round(t, 6).alias("slope_t"), dof.alias("df"), F.round(t_p_value(t, dof), 8).alias("slope_p_value"),
    )


def simple_regression_rows(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), *, digits: int = 6) -> DataFrame:
    """Fitted value and residual of every complete row."""
    pairs = df.select(*keys, number_of(df, x).alias("x"), number_of(df, y).alias("y")).dropna(subset=["x", "y"])
    model = pairs.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a")).select(F.struct("a", "b")).scalar()
    fitted = model["a"] + model["b"] * F.col("x")
    return pairs.select(*keys, "x", "y", F.round(fitted, digits).alias("fitted"), F.round(F.col("y") - fitted, digits).alias("residual"))


def _centred(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and covariance matrix of the complete rows.

    The second pass sums what is left beside the first one's means: sums of many rows lose digits that later rounding shows.
    """
    rows = df.select(*[number_of(df, c).alias(f"v{i}") for i, c in enumerate(columns)]).dropna()
    pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    near = rows.agg(*[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(columns))]).first()
    about = [0.0 if m is None else float(m) for m in near]
    rest = rows.select(*[(F.col(f"v{i}") - F.lit(m)).alias(f"v{i}") for i, m in enumerate(about)])
    one = rest.agg(
        F.count(F.lit(1)).alias("n"), *[(F.avg(f"v{i}") + F.lit(m)).alias(f"m{i}") for i, m in enumerate(about)],
        *[F.covar_samp(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    matrix = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = one[f"c{i}_{j}"] if one[f"c{i}_{j}"] is not None else np.nan
    return one["n"], np.array([one[f"m{i}"] for i in range(len(columns))], float), matrix


def multiple_regression(df: DataFrame, y: str, predictors: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Ordinary least squares: ``(model row, coefficient rows)``."""
    n, means, cov = _centred(df, [*predictors, y])
    p = len(predictors)
    sxx, sxy, syy = cov[:p, :p] * (n - 1), cov[:p, p] * (n - 1), cov[p, p] * (n - 1)
    inverse = np.linalg.inv(sxx)
    beta = inverse @ sxy
    intercept = means[p] - beta @ means[:p]
    explained = float(beta @ sxy)
    rss = max(0.0, float(syy) - explained)
    dof = n - p - 1
    sigma2 = rss / dof
    se = [math.sqrt(sigma2 * (1.0 / n + means[:p] @ inverse @ means[:p])), *np.sqrt(sigma2 * np.diag(inverse))]
    r2 = explained / float(syy)
    f = (explained / p) / sigma2
    spark = df.sparkSession
    model = spark.createDataFrame(
        [(y, n, p, r2, 1 - (1 - r2) * (n - 1) / dof, math.sqrt(sigma2), f, p, dof, f_upper(f, p, dof))],
        "y_column string, n bigint, predictors bigint, r_squared double, adjusted_r_squared double, residual_se double, "
        "f_statistic double, df_model bigint, df_residual bigint, p_value double",
    )
    rows = []
    for term, estimate, error in zip(["(Intercept)", *predictors], [intercept, *beta], se):
        t = float(estimate) / float(error)
        rows.append((term, float(estimate), float(error), t, t_two_sided(t, dof)))
    coefficients = spark.createDataFrame(rows, "term string, estimate double, standard_error double, t_statistic double, p_value double")
    digits = lambda frame: frame.select(
        *[F.round(c, 8 if c == "p_value" else 6).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes]
    )
    return digits(model), digits(coefficients)


def multiple_regression_rows(df: DataFrame, y: str, predictors: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    _, means, cov = _centred(df, [*predictors, y])
    p = len(predictors)
    beta = np.linalg.solve(cov[:p, :p], cov[:p, p])
    fitted = F.lit(float(means[p] - beta @ means[:p]))
    for c, b in zip(predictors, beta):
        fitted = fitted + F.lit(float(b)) * number_of(df, c)
    actual = number_of(df, y)
    return df.select(*keys, actual.alias("y"), F.round(fitted, 6).alias("fitted"), F.round(actual - fitted, 6).alias("residual")).dropna(
        subset=["residual"]
    )


def principal_components(df: DataFrame, columns: Sequence[str], *, scale: bool = True, components: int | None = None,
                         keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(scores, loadings, variance)``; the largest loading of each component is positive."""
    n, means, cov = _centred(df, columns)
    sd = np.sqrt(np.diag(cov))
    divisor = np.where(sd > 0, sd, 1.0) if scale else np.ones(len(columns))
    scaled = cov / np.outer(divisor, divisor)
    if scale:
        np.fill_diagonal(scaled, np.where(sd > 0, 1.0, scaled.diagonal()))
    values, vectors = np.linalg.eigh(scaled)
    order = np.argsort(values)[::-1][: components or len(columns)]
    total = float(values.sum())
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(order))])
    complete = df
    for c in columns:
        complete = complete.filter(number_of(df, c).isNotNull())
    scores = []
    for k in range(len(order)):
        score = F.lit(0.0)
        for i, c in enumerate(columns):
            score = score + (number_of(df, c) - F.lit(float(means[i]))) * F.lit(float(vectors[i, k] / divisor[i]))
        scores.append(F.round(score, 6).alias(f"PC{k + 1}"))
    spark = df.sparkSession
    loadings = spark.createDataFrame(
        [(c, f"PC{k + 1}", round(float(vectors[i, k]), 6)) for i, c in enumerate(columns) for k in range(len(order))],
        "column string, component string, loading double",
    )
    cumulative = np.cumsum(values)
    variance = spark.createDataFrame(
        [(f"PC{k + 1}", round(float(v), 6), round(float(v) / total * 100, 6), round(float(c) / total * 100, 6)) for k, (v, c) in enumerate(zip(values, cumulative))],
        "component string, variance double, variance_percent double, cumulative_percent double",
    )
    return complete.select(*keys, *scores), loadings, variance


# --- outliers and permutation ------------------------------------------------------------------

def outlier_diagnostics(
    df: DataFrame, value: str, group: str | None = None, *, keys: Sequence[str] = (), iqr_multiplier: float = 1.5,
    z_cutoff: float = 3.0, modified_z_cutoff: float = 3.5,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, group summary)`` with IQR, z-score and modified z-score flags."""
    label = F.coalesce(_group(df, group), F.lit("(blank)")) if group else F.lit("All rows")
    rows = df.select(*keys, label.alias("group"), number_of(df, value).alias("value"))
    valid = rows.filter(F.col("value").isNotNull())
    quarters = quantiles(valid, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["group"])
    moments = rows.groupBy("group").agg(
        F.count("value").alias("count"), F.count(F.when(F.col("value").isNull(), 1)).alias("missing"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
    )
    gaps = null_safe_join(valid.groupBy("group", "value").agg(F.count(F.lit(1)).alias("n")), quarters, ["group"]).select(
        "group", F.abs(F.col("value") - F.col("median")).alias("gap"), "n"
    )
    mads = quantiles(gaps, "gap", {"mad": 0.5}, ["group"], "n")
    limits = moments.join(quarters, "group", "left").join(mads, "group", "left").withColumn("iqr", F.col("q3") - F.col("q1"))
    limits = limits.withColumn("lower_fence", F.col("q1") - F.col("iqr") * iqr_multiplier).withColumn(
        "upper_fence", F.col("q3") + F.col("iqr") * iqr_multiplier
    )
    v = F.col("value")
    z = F.when(F.col("sd") > 0, (v - F.col("mean")) / F.col("sd"))
    mz = F.when(F.col("mad") > 0, (v - F.col("median")) * 0.6745 / F.col("mad"))
    flagged = valid.join(limits, "group").select(
        *keys, "group", "value", z.alias("z"), mz.alias("mz"), "lower_fence", "upper_fence",
        ((v < F.col("lower_fence")) | (v > F.col("upper_fence"))).alias("i"),
        F.coalesce(F.abs(z) >= z_cutoff, F.lit(False)).alias("s"), F.coalesce(F.abs(mz) >= modified_z_cutoff, F.lit(False)).alias("m"),
    )
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    methods = F.concat_ws(",", F.when(F.col("i"), "IQR"), F.when(F.col("s"), "z-score"), F.when(F.col("m"), "modified-z"))
    detail = flagged.select(
        *keys, "group", F.round("value", 6).alias("value"), F.round("z", 6).alias("z_score"), F.round("mz", 6).alias("modified_z_score"),
        F.round("lower_fence", 6).alias("lower_fence"), F.round("upper_fence", 6).alias("upper_fence"), yes("i").alias("iqr_outlier"),
        yes("s").alias("z_outlier"), yes("m").alias("modified_z_outlier"), methods.alias("methods_flagged"),
    )
    tallies = flagged.groupBy("group").agg(
        F.count(F.when(F.col("i"), 1)).alias("iqr_outliers"), F.count(F.when(F.col("s"), 1)).alias("z_outliers"),
        F.count(F.when(F.col("m"), 1)).alias("modified_z_outliers"), F.count(F.when(F.col("i") | F.col("s") | F.col("m"), 1)).alias("any_outliers"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    summary = limits.join(tallies, "group", "left").select(
        "group", "count", "missing",
        *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median", "mad", "q1", "q3", "iqr", "lower_fence", "upper_fence")],
        *[zero(c) for c in ("iqr_outliers", "z_outliers", "modified_z_outliers", "any_outliers")],
    )
    return detail, summary


#: Leading hex digits of a draw's hash by which draws are counted before any is ordered.
HASH_DIGITS = 3


def _mean_sides(draws: DataFrame, order: Sequence[Column], n_a: int) -> DataFrame:
    """Means of the first ``n_a`` draws in ``order`` and of the rest, per permutation.

    Draws are summed per beginning of their hash; only those that share the beginning of the ``n_a``-th are ordered.
    """
    begun = draws.withColumn("part", F.substring("h", 1, HASH_DIGITS))
    counts = settle(begun.groupBy("permutation", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")))
    along = Window.partitionBy("permutation").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    split = (F.col("before") < n_a) & (F.col("before") + F.col("n") > n_a)
    whole = placed.filter(~split).select("permutation", (F.col("before") < n_a).alias("in_a"), "n", "total")
    # At most one row per permutation.
    edges = placed.filter(split).select("permutation", "part", "before")
    close = numbered(begun.join(F.broadcast(edges), ["permutation", "part"]), order, "place", ["permutation"])
    ordered = close.select("permutation", (F.col("before") + F.col("place") <= n_a).alias("in_a"), F.lit(1).cast("bigint").alias("n"), F.col("v").alias("total"))
    return whole.unionByName(ordered).groupBy(F.col("permutation").cast("bigint").alias("permutation"), "in_a").agg(
        (F.sum("total") / F.sum("n")).alias("centre")
    )


def permutation_test(
    df: DataFrame, value: str, group: str, group_a: str, group_b: str, *, key: Sequence[str], permutations: int = 5000,
    seed: int = 1, method: str = "random", statistic: str = "mean",
) -> tuple[DataFrame, DataFrame]:
    """Two-sided permutation test of the mean or median difference: ``(result, null distribution)``.

    Every relabelling keeps the group sizes: in each permutation the rows with the smallest
    seeded hashes form group A. ``method="exact"`` lists all relabellings instead, on the driver: it is
    meant for a few dozen rows.
    """
    base = df.select(*key, _group(df, group).alias("g"), number_of(df, value).alias("v"))
    rows = base.filter(F.col("g").isin(group_a, group_b) & F.col("v").isNotNull())
    one = _two_groups(rows, group_a, group_b).first()
    n_a, n_b = one["n_a"], one["n_b"]
    if n_a == 0 or n_b == 0:
        raise ValueError("both groups need at least one number")
    spark = df.sparkSession
    if statistic == "median":
        middle = {r["g"]: r["median"] for r in quantiles(rows, "v", {"median": 0.5}, ["g"]).collect()}
        observed = middle[group_a] - middle[group_b]
    else:
        observed = one["m_a"] - one["m_b"]
    if method not in ("exact", "random"):
        raise ValueError(f"unknown method {method!r}")
    exact = method == "exact"
    if exact:
        centre = np.median if statistic == "median" else np.mean
        values = np.array([r["v"] for r in rows.select("v").collect()])
        everyone = set(range(len(values)))
        splits = []
        for i, chosen in enumerate(itertools.combinations(range(len(values)), n_a)):
            rest = sorted(everyone.difference(chosen))
            splits.append((i, float(centre(values[list(chosen)]) - centre(values[rest]))))
        null = spark.createDataFrame(splits, "permutation bigint, difference double")
    else:
        draws = rows.select(*key, "v", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("permutation"))
        draws = draws.withColumn("h", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.col("permutation").cast("string"), F.lit(str(seed)))))
        order = [F.col("h"), *[F.col(k) for k in key]]
        if statistic == "median":
            placed = numbered(draws, order, "place", ["permutation"])
            sides = placed.select(F.col("permutation").cast("bigint").alias("permutation"), (F.col("place") <= n_a).alias("in_a"), "v")
            centres = quantiles(sides, "v", {"centre": 0.5}, ["permutation", "in_a"])
        else:
            centres = _mean_sides(draws, order, n_a)
        null = centres.groupBy("permutation").agg(
            F.sum(F.when(F.col("in_a"), F.col("centre")).otherwise(-F.col("centre"))).alias("difference")
        )
    tolerance = 1e-12 * max(1.0, abs(observed))
    extreme = F.count(F.when(F.abs("difference") >= abs(observed) - tolerance, 1))
    tally = null.agg(extreme.alias("extreme"), F.count(F.lit(1)).alias("runs"))
    p = F.col("extreme") / F.col("runs") if exact else (F.col("extreme") + 1) / (F.col("runs") + 1)
    result = tally.select(
        F.lit("exact" if exact else "random").alias("method"), F.lit(n_a).cast("bigint").alias("n_a"), F.lit(n_b).cast("bigint").alias("n_b"),
        F.round(F.lit(observed), 6).alias("difference"), "runs", "extreme", F.round(p, 8).alias("p_value"),
    )
    return result, null


