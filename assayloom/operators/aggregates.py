"""Group summaries, column profiles, flows, cross tables and list overlaps."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.cells import (
    MISSING_TOKENS,
    is_blank,
    natural_key,
    number_of,
    resolve,
    safe_div,
    text_of,
    value_text,
)
from assayloom.functions.distributions import t_critical
from assayloom.functions.sequence import reverse_complement
from assayloom.operators.ladder import ladder_quantiles, null_safe_join, quantiles, value_ladder
from assayloom.session import settle


def group_by(df: DataFrame, keys: Sequence[str], aggregates: Sequence[tuple[str, str | None, str]]) -> DataFrame:
    """``(function, column, alias)`` aggregates; no aggregate means the distinct keys."""
    if not aggregates:
        return df.select(*keys).distinct()
    out: list[Column] = []
    for function, column, alias in aggregates:
        if function == "count":
            out.append((F.count(F.lit(1)) if column is None else F.count(F.when(~is_blank(text_of(df, column)), 1))).alias(alias))
            continue
        out.append({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[function](number_of(df, column)).alias(alias))
    return df.groupBy(*keys).agg(*out)


def group_summary(
    df: DataFrame, group_columns: Sequence[str], value_columns: Sequence[str],
    operations: Sequence[str] = ("count", "mean", "median", "sd"), *, missing: Iterable[str] = MISSING_TOKENS,
    digits: int = 6,
) -> DataFrame:
    """``row_count`` and one column per value column and operation, for each group."""
    tokens = tuple(missing)
    groups = [resolve(df, c) for c in group_columns]
    values = [resolve(df, c) for c in value_columns]
    base = df.select(
        *groups,
        *[value_text(df, c, tokens).alias(f"__t_{c}") for c in values],
        *[F.when(value_text(df, c, tokens).isNotNull(), number_of(df, c)).alias(f"__n_{c}") for c in values],
    )
    makers = {
        "count": lambda c: F.count(f"__t_{c}"),
        "distinct": lambda c: F.count_distinct(F.col(f"__t_{c}")),
        "sum": lambda c: F.round(F.sum(f"__n_{c}"), digits),
        "mean": lambda c: F.round(F.avg(f"__n_{c}"), digits),
        "min": lambda c: F.round(F.min(f"__n_{c}"), digits),
        "max": lambda c: F.round(F.max(f"__n_{c}"), digits),
        "sd": lambda c: F.round(F.stddev_samp(f"__n_{c}"), digits),
    }
    plain = [makers[op](c).alias(f"{c}_{op}") for c in values for op in operations if op != "median"]
    out = base.groupBy(*groups).agg(F.count(F.lit(1)).alias("row_count"), *plain)
    if "median" in operations:
        long = base.select(
            *groups,
            F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"__n_{c}").alias("v")) for c in values])).alias("cell"),
        ).select(*groups, F.col("cell.c").alias("__column"), F.col("cell.v").alias("__value"))
        medians = quantiles(long, "__value", {"median": 0.5}, [*groups, "__column"])
        wide = medians.groupBy(*groups).agg(
            *[F.max(F.when(F.col("__column") == c, F.round("median", digits))).alias(f"{c}_median") for c in values]
        )
        out = null_safe_join(out, wide, groups, "left") if groups else out.select(
            "*", *[wide.select(f"{c}_median").scalar().alias(f"{c}_median") for c in values]
        )
    return out.select(*groups, "row_count", *[f"{c}_{op}" for c in values for op in operations])


def _long_cells(df: DataFrame, columns: Sequence[str], tokens: Iterable[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("column"), value_text(df, c, tokens).alias("text"), number_of(df, c).alias("number"))
        for c in columns
    ]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def profile_table(
    df: DataFrame, columns: Sequence[str] | None = None, *, missing: Iterable[str] = MISSING_TOKENS, top_k: int = 5,
    approximate: bool = False,
) -> DataFrame:
    """Type, completeness, distinct values, quartiles or lengths and top values of each column."""
    tokens = tuple(missing)
    names = [resolve(df, c) for c in (columns or df.columns)]
    cells = _long_cells(df, names, tokens)
    text = F.col("text")
    # Spellings read as booleans.
    boolean = F.lower(text).isin("true", "false", "yes", "no")
    integer = text.rlike(r"^[+-]?\d+$")
    date = text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull()
    # Written once: all parts of the profile but approximate quartiles read the distinct values only.
    counts = settle(cells.groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("number")))
    n = F.when(text.isNotNull(), F.col("n")).otherwise(0)
    shape = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(n).alias("non_missing_count"),
        F.count("text").alias("distinct_count"),
        F.bool_and(boolean).alias("b"),
        F.bool_and(integer).alias("i"),
        F.bool_and(F.when(text.isNotNull(), F.col("number").isNotNull())).alias("f"),
        F.bool_and(date).alias("d"),
        F.min("text").alias("min_text"),
        F.max("text").alias("max_text"),
        F.min(F.length("text")).cast("bigint").alias("min_length"),
        (F.sum(F.when(text.isNotNull(), F.length("text") * F.col("n"))) / F.sum(n)).alias("mean_length"),
        F.max(F.length("text")).cast("bigint").alias("max_length"),
    )
    numbers = counts.filter(F.col("number").isNotNull())
    means = numbers.groupBy("column").agg((F.sum(F.col("number") * F.col("n")) / F.sum("n")).alias("mean"))
    off = F.col("number") - F.col("mean")
    spread = F.sqrt(F.sum(off * off * F.col("n")) / F.nullif(F.sum("n") - 1, F.lit(0)))
    moments = numbers.join(means, "column").groupBy("column").agg(F.max("mean").alias("mean"), spread.alias("sd"))
    if approximate:
        sketch = cells.groupBy("column").agg(F.percentile_approx("number", [0.25, 0.5, 0.75], 10000).alias("__q"))
        quarters = sketch.select("column", *[F.col("__q")[i].alias(q) for i, q in enumerate(("q1", "median", "q3"))])
    else:
        quarters = quantiles(
            counts.filter(F.col("number").isNotNull()), "number", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["column"], "n"
        )
    extremes = counts.groupBy("column").agg(F.min("number").alias("min_number"), F.max("number").alias("max_number"))
    place = Window.partitionBy("column").orderBy(F.desc("n"), natural_key(text), text)
    top = (
        counts.filter(text.isNotNull())
        .withColumn("r", F.row_number().over(place))
        .filter(F.col("r") <= top_k)
        .groupBy("column")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("r", "text", "n"))),
                    lambda v: F.concat(v["text"], F.lit(" ("), v["n"].cast("string"), F.lit(")")),
                ),
                "; ",
            ).alias("top_values")
        )
    )
    kind = (
        F.when(F.col("non_missing_count") == 0, "empty").when(F.col("b"), "boolean").when(F.col("i"), "integer")
        .when(F.col("f"), "number").when(F.col("d"), "date").otherwise("text")
    )
    numeric = F.col("inferred_type").isin("integer", "number")
    wordy = F.col("inferred_type").isin("text", "boolean")
    edge = lambda number, word: F.when(numeric, F.round(number, 6).cast("string")).when(
        F.col("inferred_type") == "date", F.col(word)
    )
    missing_count = F.col("rows") - F.col("non_missing_count")
    return (
        shape.withColumn("inferred_type", kind)
        .join(moments, "column", "left").join(extremes, "column").join(quarters, "column", "left").join(top, "column", "left")
        .select(
            "column", "inferred_type", "non_missing_count", missing_count.alias("missing_count"),
            F.round(missing_count / F.col("rows") * 100, 2).alias("missing_percent"),
            "distinct_count",
            F.round(safe_div(F.col("distinct_count"), F.col("non_missing_count")) * 100, 2).alias("distinct_percent"),
            *[F.when(numeric, F.round(c, 6)).alias(c) for c in ("mean", "sd")],
            edge(F.col("min_number"), "min_text").alias("min"),
            *[F.when(numeric, F.round(c, 6)).alias(c) for c in ("q1", "median", "q3")],
            edge(F.col("max_number"), "max_text").alias("max"),
            F.when(wordy, F.col("min_length")).alias("min_length"),
            F.when(wordy, F.round("mean_length", 6)).alias("mean_length"),
            F.when(wordy, F.col("max_length")).alias("max_length"),
            F.coalesce("top_values", F.lit("")).alias("top_values"),
        )
    )


def describe_numeric(
    df: DataFrame, columns: Sequence[str], *, trim_percent: float = 10.0, missing: Iterable[str] = MISSING_TOKENS
) -> DataFrame:
    """Twenty-two statistics per numeric column; skewness and kurtosis are the sample-adjusted forms."""
    names = [resolve(df, c) for c in columns]
    cells = _long_cells(df, names, tuple(missing))
    # One row per column: worked out once and broadcast, since an exchange by column would put all its values in one task.
    moments = settle(cells.groupBy("column").agg(
        F.count("number").alias("count"),
        F.count(F.when(F.col("number").isNull(), 1)).alias("missing"),
        F.sum("number").alias("sum"), F.avg("number").alias("mean"), F.stddev_samp("number").alias("sd"),
        F.skewness("number").alias("g1"), F.kurtosis("number").alias("g2"),
        F.min("number").alias("min"), F.max("number").alias("max"),
    ))

    ladder = settle(value_ladder(cells.select("column", "number"), "number", ["column"]))
    quarters = ladder_quantiles(ladder, "number", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["column"], few=True)
    sized = ladder.join(F.broadcast(quarters), "column").join(F.broadcast(moments.select("column", F.col("count").alias("total"))), "column")
    cut = F.floor(F.col("total") * F.lit(trim_percent / 100))
    kept = F.greatest(
        F.lit(0),
        F.least(F.col("before") + F.col("n"), F.col("total") - cut) - F.greatest(F.col("before"), cut),
    )
    fence = (F.col("q3") - F.col("q1")) * 1.5
    outside = (F.col("number") < F.col("q1") - fence) | (F.col("number") > F.col("q3") + fence)
    second = sized.groupBy("column").agg(
        (F.sum(kept * F.col("number")) / F.sum(kept)).alias("trimmed_mean"),
        F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outlier_count_iqr"),
    )
    spread = sized.select("column", F.abs(F.col("number") - F.col("median")).alias("gap"), "n")
    mads = quantiles(spread, "gap", {"mad": 0.5}, ["column"], "n", few=True)
    n = F.col("count")
    se = F.col("sd") / F.sqrt(n)
    half = t_critical(n - 1, 0.95) * se
    skew = F.when((n >= 3) & (F.col("sd") > 0), F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(
        (n >= 4) & (F.col("sd") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    )
    r6 = lambda c: F.round(c, 6)
    return moments.join(quarters, "column").join(second, "column").join(mads, "column").select(
        "column", "count", "missing", r6("sum").alias("sum"), r6("mean").alias("mean"),
        F.lit(float(trim_percent)).alias("trim_percent"), r6("trimmed_mean").alias("trimmed_mean"),
        r6(F.col("mean") - half).alias("mean_ci_95_low"), r6(F.col("mean") + half).alias("mean_ci_95_high"),
        r6("median").alias("median"), r6("sd").alias("sd"), r6(se).alias("se"),
        r6(skew).alias("skewness"), r6(kurt).alias("excess_kurtosis"),
        r6(safe_div(F.col("sd"), F.abs(F.col("mean"))) * 100).alias("cv_percent"),
        r6("min").alias("min"), r6("q1").alias("q1"), r6("q3").alias("q3"), r6("max").alias("max"),
        r6(F.col("max") - F.col("min")).alias("range"), r6(F.col("q3") - F.col("q1")).alias("iqr"),
        r6("mad").alias("mad"), "outlier_count_iqr",
    )


def flow_totals(df: DataFrame, source: str, target: str, value: str, *, top_n: int | None = None) -> DataFrame:
    """Summed positive flow per (source, target), largest first."""
    flows = (
        df.select(F.trim(text_of(df, source)).alias("source"), F.trim(text_of(df, target)).alias("target"), number_of(df, value).alias("value"))
        .filter((F.col("source") != "") & (F.col("target") != "") & (F.col("value") > 0))
        .groupBy("source", "target").agg(F.round(F.sum("value"), 6).alias("value"))
    )
    ordered = flows.orderBy(F.desc("value"), "source", "target")
    return ordered.limit(top_n) if top_n else ordered


def flow_nodes(flows: DataFrame) -> DataFrame:
    """Incoming, outgoing and larger total of each node."""
    zero = F.lit(0.0)
    ends = flows.select(F.col("source").alias("label"), zero.alias("i"), F.col("value").alias("o")).unionByName(
        flows.select(F.col("target").alias("label"), F.col("value").alias("i"), zero.alias("o"))
    )
    return ends.groupBy("label").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing")).withColumn(
        "total", F.greatest("incoming", "outgoing")
    )


def crosstab_means(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Mean and count of ``value`` per (x, y) cell."""
    name = lambda c: F.when(is_blank(text_of(df, c)), "(blank)").otherwise(F.trim(text_of(df, c)))
    return (
        df.select(name(x).alias("x"), name(y).alias("y"), number_of(df, value).alias("v"))
        .filter(F.col("v").isNotNull()).groupBy("x", "y")
        .agg(F.round(F.avg("v"), 6).alias("value"), F.count(F.lit(1)).alias("count"))
    )


#: Buckets of each side of a grid; the grid is dealt over their square.
GRID_BUCKETS = 16


def crosstab_missing(cells: DataFrame) -> DataFrame:
    """The (x, y) cells of the heat map grid that hold no value.

    The grid is the drawn plot itself. Its sides meet in buckets, so that no task or row holds a whole side.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(GRID_BUCKETS - 1)))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(GRID_BUCKETS)).cast("int")
    xs = cells.select("x").distinct().select("x", bucket("x").alias("i"), every.alias("j"))
    ys = cells.select("y").distinct().select("y", bucket("y").alias("j"), every.alias("i"))
    grid = xs.join(ys, ["i", "j"]).select("x", "y")
    return grid.join(cells, ["x", "y"], "left_anti")


def _top_levels(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), natural_key(F.col("level")), "level").limit(k)


def column_comparison(df: DataFrame, a: str, b: str, *, max_categories: int = 12) -> DataFrame:
    """Missingness of a column pair, then the statistics that fit their types."""
    text = df.select(
        value_text(df, a).alias("a"), value_text(df, b).alias("b"), number_of(df, a).alias("an"), number_of(df, b).alias("bn")
    )
    kinds = text.agg(
        F.coalesce(F.bool_and(F.when(F.col("a").isNotNull(), F.col("an").isNotNull())), F.lit(False)).alias("a"),
        F.coalesce(F.bool_and(F.when(F.col("b").isNotNull(), F.col("bn").isNotNull())), F.lit(False)).alias("b"),
    ).first()
    columns = ["analysis", "level_a", "level_b", "count", "percent", "statistic", "value", "mean", "sd", "min", "q1",
               "median", "q3", "max", "row_percent", "column_percent"]
    doubles = set(columns) - {"analysis", "level_a", "level_b", "count", "statistic"}

    def shaped(frame: DataFrame) -> DataFrame:
        def kind(c: str) -> str:
            return "bigint" if c == "count" else "double" if c in doubles else "string"
        return frame.select(*[(F.col(c) if c in frame.columns else F.lit(None)).cast(kind(c)).alias(c) for c in columns])

    am, bm = F.col("a").isNull(), F.col("b").isNull()
    state = {
        "complete pair": ~am & ~bm, "column a missing": am & ~bm, "column b missing": ~am & bm, "both missing": am & bm,
    }
    missing = text.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(k) for k, c in state.items()]).select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("level_a"), F.col(f"`{k}`").alias("count"), F.col("rows")) for k in state])).alias("m")
    ).select(
        F.lit("missingness").alias("analysis"), "m.level_a", "m.count",
        F.coalesce(F.round(safe_div(F.col("m.count"), F.col("m.rows")) * 100, 2), F.lit(0.0)).alias("percent"),
    )
    complete = text.filter(~am & ~bm)
    if kinds["a"] and kinds["b"]:
        m = complete.agg(
            F.count(F.lit(1)).alias("n"), F.corr("an", "bn").alias("pearson_r"), F.covar_samp("an", "bn").alias("sample_covariance"),
            F.regr_slope("bn", "an").alias("linear_slope"), F.regr_intercept("bn", "an").alias("linear_intercept"),
            F.avg("an").alias("column_a_mean"), F.stddev_samp("an").alias("column_a_sd"),
            F.avg("bn").alias("column_b_mean"), F.stddev_samp("bn").alias("column_b_sd"),
        ).withColumn("r_squared", F.col("pearson_r") * F.col("pearson_r"))
        stats = ["pearson_r", "r_squared", "sample_covariance", "linear_slope", "linear_intercept", "column_a_mean",
                 "column_a_sd", "column_b_mean", "column_b_sd"]
        parts = [F.struct(F.lit("paired_n").alias("statistic"), F.lit(None).cast("double").alias("value"), F.col("n").alias("count"))]
        parts += [
            F.struct(F.lit(s).alias("statistic"), F.round(s, 6).alias("value"), F.lit(None).cast("bigint").alias("count")) for s in stats
        ]
        detail = m.select(F.explode(F.array(*parts)).alias("s")).select(F.lit("numeric vs numeric").alias("analysis"), "s.*")
    elif kinds["a"] or kinds["b"]:
        number, level = ("an", "b") if kinds["a"] else ("bn", "a")
        rows = complete.select(F.col(number).alias("v"), F.col(level).alias("level"))
        top = [r["level"] for r in _top_levels(rows.groupBy("level").agg(F.count(F.lit(1)).alias("n")), max_categories).collect()]
        grouped = rows.withColumn("level_a", F.when(F.col("level").isin(top), F.col("level")).otherwise("Other"))
        quarters = quantiles(grouped, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["level_a"])
        total = rows.agg(F.count(F.lit(1)).alias("t")).scalar()
        detail = (
            grouped.groupBy("level_a").agg(
                F.count(F.lit(1)).alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
                F.min("v").alias("min"), F.max("v").alias("max"),
            ).join(quarters, "level_a").select(
                F.lit("numeric vs category").alias("analysis"), "level_a", "count",
                F.round(F.col("count") / total * 100, 2).alias("percent"),
                *[F.round(c, 6).alias(c) for c in ("mean", "sd", "min", "q1", "median", "q3", "max")],
            )
        )
    else:
        keep = {}
        for side in ("a", "b"):
            counted = complete.groupBy(F.col(side).alias("level")).agg(F.count(F.lit(1)).alias("n"))
            keep[side] = [r["level"] for r in _top_levels(counted, max_categories).collect()]
        cells = complete.select(
            *[F.when(F.col(s).isin(keep[s]), F.col(s)).otherwise("Other").alias(f"level_{s}") for s in ("a", "b")]
        ).groupBy("level_a", "level_b").agg(F.count(F.lit(1)).alias("count"))
        # At most (max_categories + 1) squared cells from here on.
        row = F.sum("count").over(Window.partitionBy("level_a"))
        column = F.sum("count").over(Window.partitionBy("level_b"))
        total = cells.agg(F.sum("count").alias("t")).scalar()
        detail = cells.select(
            F.lit("category vs category").alias("analysis"), "level_a", "level_b", "count",
            F.round(F.col("count") / total * 100, 2).alias("percent"), F.lit("cell_count").alias("statistic"),
            F.col("count").cast("double").alias("value"),
            F.round(F.col("count") / row * 100, 2).alias("row_percent"),
            F.round(F.col("count") / column * 100, 2).alias("column_percent"),
        )
    return shaped(missing).unionByName(shaped(detail))


def _letters(i: int) -> str:
    """A to Z, then AA, AB and so on."""
    return (_letters(i // 26 - 1) if i >= 26 else "") + chr(ord("A") + i % 26)


def list_overlap(lists: Sequence[DataFrame], item: str = "item", order: str | None = None, *, case_sensitive: bool = False) -> DataFrame:
    """Counts of every item in each list, with a membership key such as ``AB-`` and a category."""
    letters = [_letters(i) for i in range(len(lists))]
    tagged = []
    for i, frame in enumerate(lists):
        text = F.trim(F.col(item))
        tagged.append(
            frame.filter(~is_blank(F.col(item)) & ~text.startswith("#")).select(
                F.lit(i).alias("list"), text.alias("item"), (F.col(order) if order else text).alias("o"),
                (text if case_sensitive else F.lower(text)).alias("key"),
            )
        )
    merged = reduce(lambda a, b: a.unionByName(b), tagged)
    counts = merged.groupBy("key").agg(
        F.min_by("item", F.struct("list", "o")).alias("item"),
        *[F.count(F.when(F.col("list") == i, 1)).alias(f"n{i}") for i in range(len(lists))],
    )
    has = [F.col(f"n{i}") > 0 for i in range(len(lists))]
    names = F.array_compact(F.array(*[F.when(h, F.lit(x)) for h, x in zip(has, letters)]))
    listed = F.array_join(names, ",")
    number = F.size(names).cast("bigint")
    category = (
        F.when(number == len(lists), "shared_all")
        .when(number == 1, F.concat(F.lower(listed), F.lit("_only")))
        .otherwise(F.concat(F.lit("shared_"), F.lower(F.array_join(names, ""))))
    )
    return counts.select(
        "item", number.alias("list_count"), listed.alias("lists"),
        F.concat_ws("; ", *[F.concat(F.lit(f"{x}:"), F.col(f"n{i}").cast("string")) for i, x in enumerate(letters)]).alias("counts_by_list"),
        reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(len(lists))]).alias("total_count"),
        F.concat(*[F.when(h, F.lit(x)).otherwise("-") for h, x in zip(has, letters)]).alias("membership_key"),
        category.alias("category"),
    )


def overlap_categories(overlap: DataFrame) -> DataFrame:
    return overlap.groupBy("membership_key", "lists", "list_count").agg(
        F.count(F.lit(1)).alias("item_count"), F.sum("total_count").alias("total_count")
    )


def duplicate_census(records: DataFrame, *, check_reverse_complement: bool = False) -> DataFrame:
    """Title and sequence copy counts per record; issues found on reading (``format_issues``) come first.

    Sequences are grouped by their SHA-256 digest. Whether the reverse complement occurs is found once per distinct
    sequence, so rows meet two counts and carry one digest.
    """
    found = F.col("format_issues") if "format_issues" in records.columns else F.array().cast("array<string>")
    upper = F.upper(F.col("sequence"))
    digest = lambda text: F.unhex(F.sha2(text, 256))
    held = F.length("sequence") > 0
    rows = records.select(
        "record", "title", F.length("sequence").cast("bigint").alias("length"), "sequence_lines", found.alias("__found"), F.when(held, digest(upper)).alias("__d"),
    )
    titles = rows.groupBy("title").agg(F.count(F.lit(1)).alias("title_count"))
    if check_reverse_complement:
        both = records.filter(held).select(digest(upper).alias("__d"), digest(reverse_complement(upper)).alias("__rc"))
        counted = both.groupBy("__d", "__rc").agg(F.count(F.lit(1)).alias("sequence_count"))
        other = counted.select(F.col("__d").alias("__rc"), F.lit(True).alias("__has_rc"))
        copies = counted.join(other, "__rc", "left").select("__d", "sequence_count", (F.col("__has_rc") & (F.col("__rc") != F.col("__d"))).alias("__has_rc"))
    else:
        copies = rows.filter(F.col("__d").isNotNull()).groupBy("__d").agg(F.count(F.lit(1)).alias("sequence_count"))
    out = rows.join(titles, "title").join(copies, "__d", "left")
    notes = [
        F.when(F.col("title_count") > 1, "duplicate title"),
        F.when(F.col("sequence_count") > 1, "duplicate sequence"),
    ]
    if check_reverse_complement:
        notes.append(F.when(F.col("__has_rc"), "reverse-complement duplicate"))
    issues = F.concat_ws("; ", "__found", *notes)
    return out.select(
        "record", "title", "length", "sequence_lines", "title_count",
        F.coalesce("sequence_count", F.lit(0).cast("bigint")).alias("sequence_count"),
        F.when(issues == "", "ok").otherwise("warning").alias("status"), issues.alias("issues"),
    )
