"""Sorting, top rows, positions within keys and exact-size samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.functions.cells import dtype_of, natural_key, resolve
from assayloom.functions.distributions import normal_quantile
from assayloom.operators.ladder import numbered, running_total
from assayloom.session import settle


def sort_columns(df: DataFrame, rules: Sequence[tuple[str, str] | str], row_id: Sequence[str] = ()) -> list[Column]:
    """Sort expressions: typed columns by value, text in natural order, ties by ``row_id``."""
    out: list[Column] = []
    for rule in rules:
        name, direction = rule if isinstance(rule, tuple) else (rule, "asc")
        column = F.col(f"`{resolve(df, name)}`")
        key = natural_key(column) if isinstance(dtype_of(df, name), T.StringType) else column
        out.append(key.desc() if direction == "desc" else key.asc())
    return out + [F.col(c).asc() for c in row_id]


def sort_rows(df: DataFrame, rules: Sequence, row_id: Sequence[str] = (), *, position: str | None = None) -> DataFrame:
    """Stable sort; with ``position`` the place in the order becomes a column instead of a global sort."""
    order = sort_columns(df, rules, row_id)
    return numbered(df, order, position) if position else df.orderBy(*order)


def top_rows(df: DataFrame, rules: Sequence, k: int, row_id: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*sort_columns(df, rules, row_id)).limit(k)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, name: str = "best_rank") -> DataFrame:
    """Rows ranked inside each key; only the first ``k`` leave the map side (window group limit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def sequential_positions(
    df: DataFrame, key: str, order: Sequence[str], *, index: str = "marker_index", plot: str = "plot_position"
) -> DataFrame:
    """Place of each row within its key, and along all keys laid end to end in natural order."""
    placed = numbered(df, [F.col(c) for c in order], index, [key])
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    laid = running_total(sizes, [natural_key(F.col(key)), F.col(key)], F.col("__n"), "__along")
    offsets = laid.select(F.col(key).alias("__key"), F.col("__along").alias("__offset"))
    return (
        placed.join(offsets, F.col(key) == F.col("__key"))
        .withColumn(plot, F.col("__offset") + F.col(index))
        .drop("__key", "__offset")
    )


def quantile_pairs(df: DataFrame, value: str, row_id: Sequence[str]) -> DataFrame:
    """Q-Q points: sample quantile against the normal quantile of ``(i - 0.5) / n``."""
    valid = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("sample_quantile"), *row_id)
    placed = numbered(valid, [F.col("sample_quantile"), *[F.col(c) for c in row_id]], "i")
    n = valid.agg(F.count(F.lit(1)).alias("n")).scalar()
    p = (F.col("i") - 0.5) / n
    return placed.select(
        *row_id, "i", p.alias("probability"), normal_quantile(p).alias("theoretical_quantile"), "sample_quantile"
    )


def _draw_hash(*parts: str | Column | int) -> Column:
    """A hash of keys and seed that any engine can repeat: MD5 of their texts, set apart by ``|``."""
    return F.md5(F.concat_ws("|", *[(F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def _hash_number(digits: Column, size: int) -> Column:
    return F.conv(F.substring(digits, 1, size), 16, 10).cast("bigint")


def sample_rows(df: DataFrame, n: int, seed: int, key: Sequence[str], *, replacement: bool = False) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), the same for the same seed. ``key`` names each row.

    Without replacement the ``n`` smallest seeded hashes win. A histogram of the first hash digits
    finds the one bucket in which the cut lies; only that bucket is ordered. With replacement only keys
    are numbered, in hash order, and each draw is a place in it.
    """
    if replacement:
        keys = df.select(*key).withColumn("__hash", _draw_hash(*key, seed))
        placed = numbered(keys, [F.col("__hash"), *[F.col(c) for c in key]], "__place")
        total = df.count()
        draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (_hash_number(_draw_hash("id", seed), 15) % max(total, 1) + 1).alias("__pick"))
        chosen = draws.join(placed, F.col("__pick") == F.col("__place")).select("draw", *[F.col(c).alias(f"__k_{c}") for c in key])
        match = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in key]
        return chosen.join(df, reduce(lambda x, y: x & y, match)).select("draw", *df.columns)
    bucketed = df.withColumn("__hash", _draw_hash(*key, seed)).withColumn("__bucket", F.substring("__hash", 1, 4))
    counts = bucketed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("c"))
    # At most 65,536 bucket rows take part in this window.
    reach = counts.withColumn("upto", F.sum("c").over(Window.orderBy("__bucket")))
    cut = reach.filter(F.col("upto") >= n).orderBy("__bucket").first()
    if cut is None:
        return df
    need = n - (cut["upto"] - cut["c"])
    # Written once: little more than the sample itself.
    near = settle(bucketed.filter(F.col("__bucket") <= cut["__bucket"]))
    below = near.filter(F.col("__bucket") < cut["__bucket"])
    edge = numbered(
        near.filter(F.col("__bucket") == cut["__bucket"]), [F.col("__hash"), *[F.col(c) for c in key]], "__place"
    ).filter(F.col("__place") <= need)
    return below.unionByName(edge.drop("__place")).drop("__hash", "__bucket")
