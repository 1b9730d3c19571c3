"""Keep a costly expression from being copied into every filter and column that uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns behind a one-row generator.

    Filters on them are not pushed below it, so each expression runs once per row. (The outer form
    of the generator also keeps the optimizer from testing the array for emptiness first.)
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def plain(df: DataFrame) -> DataFrame:
    """A join side that is exchanged, not broadcast.

    The optimizer sizes exploded, joined and checkpointed rows by the files they came from, often a hundred times
    too low, and would gather them on the driver.
    """
    return df.hint("merge")


def explode_once(df: DataFrame, items: Column, name: str, *keep: str | Column) -> DataFrame:
    """``explode`` for a costly array: one row per item, with the array worked out once per row."""
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())
