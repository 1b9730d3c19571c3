"""Set operations and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.functions.cells import number_of, resolve, text_of


def gather(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL; the columns of the first frame win."""
    first = frames[0]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.select(*first.columns)


def split_records(df: DataFrame, items: str, name: str) -> DataFrame:
    """One row per item of an array column, with its place in ``item_index``."""
    others = [c for c in df.columns if c != items]
    return df.select(*others, F.posexplode(items).alias("item_index", name))


def pivot_wider(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: str, *, duplicate: str = "first",
    order: str | None = None, max_columns: int = 10_000,
) -> DataFrame:
    """Spread ``values_from`` over one column per name, in first-seen order when ``order`` is given."""
    name = F.trim(text_of(df, names_from))
    base = df.select(
        *[F.col(f"`{resolve(df, c)}`") for c in ids],
        name.alias("__name"),
        (number_of(df, values_from) if duplicate in ("sum", "mean") else text_of(df, values_from)).alias("__value"),
        (F.col(order) if order else F.lit(0)).alias("__order"),
    ).filter(F.col("__name") != "")
    seen = base.groupBy("__name").agg(F.min("__order").alias("o")).orderBy("o", "__name").limit(max_columns + 1)
    names = [r["__name"] for r in seen.collect()]
    if len(names) > max_columns:
        raise ValueError(f"more than {max_columns} names to spread; raise max_columns to go on")
    aggregate = {
        "first": F.min_by("__value", "__order"),
        "last": F.max_by("__value", "__order"),
        "sum": F.round(F.sum("__value"), 6),
        "mean": F.round(F.avg("__value"), 6),
    }[duplicate]
    keys = [resolve(df, c) for c in ids]
    return base.groupBy(*[F.col(f"`{k}`") for k in keys]).pivot("__name", names).agg(aggregate)


def pivot_longer(
    df: DataFrame, ids: Sequence[str], value_columns: Sequence[str] | None = None, *, names_to: str = "name",
    values_to: str = "value",
) -> DataFrame:
    """One row per value column; blanks are kept."""
    keys = [resolve(df, c) for c in ids]
    values = [resolve(df, c) for c in (value_columns or [c for c in df.columns if c not in keys])]
    texts = df.select(*keys, *[text_of(df, c).alias(c) for c in values])
    return texts.unpivot(keys, values, names_to, values_to)


def shared_items(overlap: DataFrame) -> DataFrame:
    return overlap.filter(F.col("category") == "shared_all")


def unique_items(overlap: DataFrame) -> DataFrame:
    return overlap.filter(F.col("list_count") == 1)


def only_in(overlap: DataFrame, letter: str) -> DataFrame:
    return overlap.filter(F.col("category") == f"{letter.lower()}_only")
