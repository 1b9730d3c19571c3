"""Distributed ordering: positions, running sums, ranks and exact quantiles without a one-task window.

Rows are range-partitioned on the order, each range is summed, and the sums of the
earlier ranges are added to the positions inside a range. Values are counted before the
ranges are cut, so a value that fills a third of the table is one row here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.session import settle, shuffle_width

SLICE = "__slice"


def _sliced(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    keys = [F.col(name) for name in by] + list(order)
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *keys)
    return settle(ranged.withColumn(SLICE, F.spark_partition_id()))


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    amount: Column,
    name: str = "before",
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all earlier rows in ``order`` (inside each ``by`` group).

    ``order`` must be a total order inside a group, so that equal keys do not pile up in one range.
    """
    sliced = _sliced(df.withColumn("__amount", amount), by, order)
    group = [F.col(n) for n in by]
    sums = sliced.groupBy(*group, SLICE).agg(F.sum("__amount").alias("__sum"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and group: the window below is as wide as the number of ranges.
    offsets = sums.select(
        *[F.col(n).alias(f"__g_{n}") for n in by],
        F.col(SLICE).alias("__s"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"),
    )
    match = F.col(SLICE) == F.col("__s")
    for n in by:
        match = match & F.col(n).eqNullSafe(F.col(f"__g_{n}"))
    inside = Window.partitionBy(SLICE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("__local", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
        .join(offsets, match)
        .withColumn(name, F.col("__offset") + F.col("__local"))
        .drop("__s", "__offset", "__local", "__amount", SLICE, *[f"__g_{n}" for n in by])
    )


def running_max(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the largest ``value`` among the rows up to this one in a total ``order``."""
    sliced = _sliced(df.withColumn("__value", value), (), order)
    tops = sliced.groupBy(SLICE).agg(F.max("__value").alias("__top"))
    # One row per range: the window below is as wide as the number of ranges.
    earlier = Window.partitionBy(F.lit(0)).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(F.col(SLICE).alias("__s"), F.max("__top").over(earlier).alias("__before"))
    inside = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("__local", F.max("__value").over(inside)).join(before, F.col(SLICE) == F.col("__s"))
    return local.withColumn(name, F.greatest("__before", "__local")).drop("__s", "__before", "__local", "__value", SLICE)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """Add the 1-based position of each row in a total order."""
    return running_total(df, order, F.lit(1).cast("bigint"), name, by).withColumn(name, F.col(name) + 1)


def value_ladder(
    df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Distinct values per group with their count ``n`` and the number of rows ``before`` them."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(amount.alias("n"))
    return running_total(counts, [F.col(value)], F.col("n"), "before", by)


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values per group with count ``n`` (the tie size), ``before`` and the shared ``rank``."""
    return value_ladder(df, value, by).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)


def with_average_rank(df: DataFrame, value: str, name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Join the shared rank of its value to every row."""
    ranks = average_ranks(df, value, by)
    renamed = ranks.select(
        *[F.col(n).alias(f"__r_{n}") for n in by], F.col(value).alias("__r_value"), F.col("rank").alias(name)
    )
    match = F.col(value) == F.col("__r_value")
    for n in by:
        match = match & F.col(n).eqNullSafe(F.col(f"__r_{n}"))
    return df.join(renamed, match, "left").drop("__r_value", *[f"__r_{n}" for n in by])


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: Sequence[str] = (),
    weight: str | None = None,
    *,
    few: bool = False,
) -> DataFrame:
    """Exact interpolated quantiles (position ``(n-1)*p``) per group, one column per entry."""
    ladder = value_ladder(df, value, by, weight)
    return ladder_quantiles(ladder, value, probabilities, by, few=few)


def ladder_quantiles(
    ladder: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = (), *, few: bool = False
) -> DataFrame:
    """``few`` groups (the columns of a table, say) have their totals broadcast, so that a group's values stay in many tasks."""
    group = [F.col(n) for n in by]
    totals = ladder.groupBy(*group).agg(F.sum("n").alias("__total"))
    totals = F.broadcast(totals) if few else totals
    if by:
        sized = _null_safe_join(ladder, totals, by)
    else:
        sized = ladder.withColumn("__total", totals.select("__total").scalar())
    picks = []
    for name, p in probabilities.items():
        place = (F.col("__total") - 1) * F.lit(float(p))
        for label, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"__{name}_{label}"))
    picked = sized.groupBy(*group).agg(F.max("__total").alias("__total"), *picks)
    out = []
    for name, p in probabilities.items():
        place = (F.col("__total") - 1) * F.lit(float(p))
        low, high = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return picked.select(*group, *out)


def _null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.select(
        *[F.col(n).alias(f"__k_{n}") for n in by], *[F.col(c) for c in right.columns if c not in by]
    )
    match = None
    for n in by:
        part = F.col(n).eqNullSafe(F.col(f"__k_{n}"))
        match = part if match is None else match & part
    return left.join(renamed, match, how).drop(*[f"__k_{n}" for n in by])


null_safe_join = _null_safe_join
