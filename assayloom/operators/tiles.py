"""Running values along a coordinate, in fixed tiles.

Rows are first reduced to one per (record, position), so a tile of ``TILE`` positions never holds
more than ``TILE`` rows, however many intervals pile up there. Values run inside each tile; one
summary row per tile carries them on to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.operators.once import plain
from assayloom.session import settle

TILE = 1 << 16


def _tile(position: Column) -> Column:
    return F.floor(position / TILE).cast("bigint")


def running_depth(deltas: DataFrame) -> DataFrame:
    """``(record, position, delta)`` events to ``(record, position, delta, depth, next_position)``.

    ``depth`` holds from ``position`` up to, not including, ``next_position``.
    """
    # Written once: the sums of the tiles and the values inside them both read the events.
    events = settle(deltas.groupBy("record", "position").agg(F.sum("delta").alias("delta")).withColumn("tile", _tile(F.col("position"))))
    tiles = events.groupBy("record", "tile").agg(F.sum("delta").alias("total"), F.min("position").alias("first"))
    along = Window.partitionBy("record").orderBy("tile")
    carried = tiles.select(
        "record", "tile",
        F.coalesce(F.sum("total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"),
        F.lead("first").over(along).alias("next_first"),
    )
    inside = Window.partitionBy("record", "tile").orderBy("position")
    return (
        events.withColumn("local", F.sum("delta").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next_local", F.lead("position").over(inside))
        .join(plain(carried), ["record", "tile"])
        .select(
            "record", "position", "delta", (F.col("carry") + F.col("local")).alias("depth"),
            F.coalesce("next_local", "next_first").alias("next_position"),
        )
    )


def next_position(rows: DataFrame, name: str = "next_position") -> DataFrame:
    """The following position of the same record, for rows with distinct positions."""
    tiled = settle(rows.withColumn("tile", _tile(F.col("position"))))
    along = Window.partitionBy("record").orderBy("tile")
    firsts = tiled.groupBy("record", "tile").agg(F.min("position").alias("first")).select(
        "record", "tile", F.lead("first").over(along).alias("next_first")
    )
    inside = Window.partitionBy("record", "tile").orderBy("position")
    return (
        tiled.withColumn("next_local", F.lead("position").over(inside)).join(plain(firsts), ["record", "tile"])
        .withColumn(name, F.coalesce("next_local", "next_first")).drop("tile", "next_local", "next_first")
    )


def last_known(points: DataFrame, known: DataFrame, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """For each ``(record, position)`` in ``points`` the ``value`` of the last ``known`` position strictly before it.

    Both frames hold distinct positions per record. To look the other way, pass negated positions.
    ``keep`` names columns of ``points`` that come along.
    """
    marks = known.select(
        "record", "position", F.struct(F.col("position").alias("at"), F.col(value).alias("value")).alias("mark"), F.lit(1).alias("kind"),
        *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in keep],
    )
    asks = points.select("record", "position", F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), F.lit(0).alias("kind"), *keep)
    merged = settle(asks.unionByName(marks).withColumn("tile", _tile(F.col("position"))))
    along = Window.partitionBy("record").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = merged.groupBy("record", "tile").agg(F.max_by("mark", F.when(F.col("kind") == 1, F.col("position"))).alias("end_mark")).select(
        "record", "tile", F.last("end_mark", ignorenulls=True).over(along).alias("carry")
    )
    # A question at the same place as a mark comes first, so "strictly before" holds.
    inside = Window.partitionBy("record", "tile").orderBy("position", "kind").rowsBetween(Window.unboundedPreceding, -1)
    return (
        merged.withColumn("local", F.last("mark", ignorenulls=True).over(inside)).filter("kind = 0").join(plain(carried), ["record", "tile"])
        .select("record", "position", *keep, F.coalesce("local", "carry").alias("mark"))
    )
