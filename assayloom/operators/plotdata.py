"""The data frames behind plots: bins, boxes, densities, volcano and Manhattan coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.cells import natural_key, number_of, safe_div, text_of
from assayloom.operators.ladder import null_safe_join, numbered, quantiles, running_total


def _bin_count(valid: DataFrame, low: float, high: float, n: int) -> int:
    """Freedman-Diaconis, or Sturges when the quartiles coincide."""
    if n <= 1 or low == high:
        return 1
    q = quantiles(valid, "value", {"q1": 0.25, "q3": 0.75}).first()
    width = 2 * (q["q3"] - q["q1"]) / n ** (1 / 3)
    return math.ceil((high - low) / width) if width > 0 else math.ceil(math.log2(n) + 1)


def histogram(df: DataFrame, value: str, *, bins: int | None = None) -> DataFrame:
    """Equal-width bins, empty ones included; the last bin is closed."""
    valid = df.select(number_of(df, value).alias("value")).filter(F.col("value").isNotNull())
    edge = valid.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n")).first()
    low, high = (edge["low"], edge["high"]) if edge["n"] else (0.0, 1.0)
    if low == high:
        low, high = low - 0.5, high + 0.5
        bins = bins or 1
    count = max(1, bins or _bin_count(valid, low, high, edge["n"]))
    width = (high - low) / count
    place = F.least(F.lit(count - 1), F.greatest(F.lit(0), F.floor((F.col("value") - low) / width))).cast("bigint")
    filled = valid.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(count).withColumnRenamed("id", "bin")
    return grid.join(filled, "bin", "left").select(
        F.round(F.lit(low) + F.col("bin") * width, 6).alias("bin_start"),
        F.round(F.lit(low) + (F.col("bin") + 1) * width, 6).alias("bin_end"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    )


def _labelled(df: DataFrame, value: str, group: str | None, keys: Sequence[str] = ()) -> DataFrame:
    text = F.trim(text_of(df, group)) if group else F.lit("All rows")
    label = F.when(text != "", text).otherwise("(blank)")
    return df.select(*keys, label.alias("group"), number_of(df, value).alias("value")).filter(F.col("value").isNotNull())


def box_summary(df: DataFrame, value: str, group: str | None = None, *, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(boxes, outlier rows)`` with whiskers at the last values inside 1.5 IQR."""
    rows = _labelled(df, value, group, keys)
    quarters = quantiles(rows, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["group"])
    fence = (F.col("q3") - F.col("q1")) * 1.5
    v = F.col("value")
    inside = (v >= F.col("q1") - fence) & (v <= F.col("q3") + fence)
    joined = rows.join(quarters, "group")
    boxes = joined.groupBy("group").agg(
        F.count(F.lit(1)).alias("count"), F.min(v).alias("min"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.max(v).alias("max"), F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"), F.count(F.when(~inside, 1)).alias("outlier_count"),
    )
    r6 = lambda c: F.round(c, 6).alias(c)
    outliers = joined.filter(~inside).select(*keys, "group", F.round(v, 6).alias("value"))
    return boxes.select(
        "group", "count", *[r6(c) for c in ("min", "q1", "median", "q3", "max", "whisker_low", "whisker_high")], "outlier_count"
    ), outliers


def violin_density(
    df: DataFrame, value: str, group: str | None = None, *, grid_points: int = 64, bandwidth: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(group summary, density rows)``: a Gaussian kernel density on one shared grid.

    Equal values are counted first; each distinct value then adds to every grid point.
    """
    rows = _labelled(df, value, group)
    edge = rows.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    low, high = (edge["low"], edge["high"]) if edge["low"] is not None else (0.0, 0.0)
    counts = rows.groupBy("group", "value").agg(F.count(F.lit(1)).alias("n"))
    quarters = quantiles(counts, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["group"], "n")
    moments = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
    )
    # The normal reference rule (1.34, 0.9, -0.2) and the widths where it has nothing to go by.
    spread = high - low
    iqr = F.col("q3") - F.col("q1")
    robust = F.when(iqr > 0, F.least(F.when(F.col("sd") > 0, F.col("sd")).otherwise(iqr / 1.34), iqr / 1.34)).otherwise(F.col("sd"))
    scale = F.when(robust > 0, robust).otherwise(F.lit(max(spread / 8, 1.0)))
    auto = F.when(F.col("count") < 2, F.lit(max(spread / 12, 1.0))).otherwise(
        F.greatest(F.lit(1e-9), scale * 0.9 * F.pow(F.col("count").cast("double"), F.lit(-0.2)))
    )
    width = F.lit(float(bandwidth)) if bandwidth else auto
    summary = moments.join(quarters, "group").withColumn("bandwidth", width)
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(grid_points - 1)), lambda i: F.lit(low) + i * F.lit(spread / max(1, grid_points - 1))
    )
    z = (F.col("at") - F.col("value")) / F.col("bandwidth")
    density = (
        null_safe_join(counts, summary.select("group", "bandwidth", "count"), ["group"])
        .select("group", "value", "n", "bandwidth", "count", F.posexplode(grid).alias("i", "at"))
        .groupBy("group", "i").agg(
            F.max("at").alias("value"),
            (F.sum(F.exp(z * z * -0.5) * F.col("n")) / F.max(F.col("count") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"),
        )
    )
    top = density.agg(F.max("density").alias("top")).scalar()
    r6 = lambda c: F.round(c, 6).alias(c)
    return (
        summary.select("group", "count", *[r6(c) for c in ("min", "q1", "median", "mean", "q3", "max", "bandwidth")]),
        density.select("group", r6("value"), F.round("density", 9).alias("density"), F.round(safe_div(F.col("density"), top), 6).alias("scaled_width")),
    )


def volcano(df: DataFrame, fold_change: str, p_value: str, label: str, *, fold_cutoff: float = 1.0, p_cutoff: float = 0.05) -> DataFrame:
    fc, p = number_of(df, fold_change), number_of(df, p_value)
    rows = df.select(text_of(df, label).alias("label"), fc.alias("fc"), p.alias("p")).filter(
        F.col("fc").isNotNull() & (F.col("p") > 0) & (F.col("p") <= 1)
    )
    significant = (F.col("p") <= p_cutoff) & (F.abs("fc") >= fold_cutoff)
    return rows.select(
        "label", F.round("fc", 6).alias("log2_fold_change"), F.round("p", 10).alias("p_value"),
        F.round(-F.log10("p"), 6).alias("neg_log10_p"),
        F.when(~significant, "not significant").when(F.col("fc") > 0, "up").otherwise("down").alias("class"),
    )


def manhattan(
    df: DataFrame, chromosome: str, position: str, p_value: str, marker: str, *, label_top: bool = True
) -> DataFrame:
    """Markers laid end to end along the chromosomes, with the centre of each and its top marker."""
    rows = df.select(
        text_of(df, marker).alias("marker"), F.trim(text_of(df, chromosome)).alias("chromosome"),
        number_of(df, position).cast("bigint").alias("position"), number_of(df, p_value).alias("p"),
    ).filter((F.col("chromosome") != "") & (F.col("p") > 0) & (F.col("p") <= 1) & (F.col("position") >= 0))
    placed = numbered(rows, [F.col("position"), F.col("marker")], "i", ["chromosome"])
    score = F.round(-F.log10("p"), 6)
    stats = placed.groupBy("chromosome").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("i", F.struct(score.alias("s"), (-F.col("i")).alias("first"))).alias("top_i")
    )
    stats = running_total(stats, [natural_key(F.col("chromosome")), F.col("chromosome")], F.col("n"), "offset")
    return placed.join(stats, "chromosome").select(
        "marker", "chromosome", "position", F.round("p", 12).alias("p_value"), score.alias("neg_log10_p"),
        (F.col("offset") + F.col("i")).alias("plot_position"), (F.col("offset") + (F.col("n") + 1) / 2).alias("chromosome_center"),
        F.when(F.lit(label_top) & (F.col("i") == F.col("top_i")), "yes").otherwise("no").alias("top_marker"),
    )


def point_frame(df: DataFrame, x: str, y: str, *, series: str | None = None, label: str | None = None, numeric_x: bool = True) -> DataFrame:
    """Complete points of a scatter, line or bar plot, sorted by series and x."""
    xs = number_of(df, x) if numeric_x else F.trim(text_of(df, x))
    out = df.select(
        (text_of(df, label) if label else F.lit("")).alias("label"), (text_of(df, series) if series else F.lit("Data")).alias("series"),
        xs.alias("x"), number_of(df, y).alias("y"),
    ).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return out.orderBy(natural_key(F.col("series")), F.col("x") if numeric_x else natural_key(F.col("x")), "label")


def draw_limit(df: DataFrame, order: Sequence[Column], limit: int, *, mode: str = "even", keep: Column | None = None) -> DataFrame:
    """Rows to draw: the first ``limit``, or evenly spaced ones, plus those that meet ``keep``."""
    if mode == "first" and keep is None:
        return df.orderBy(*order).limit(limit)
    placed = numbered(df, order, "__place")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    place = F.col("__place") - 1
    if mode == "first":
        chosen = place < limit
    else:
        # Row r is drawn when some step s has round(s * (n - 1) / (limit - 1)) = r; only the nearest step can.
        step = (total - 1) / F.lit(max(1, limit - 1))
        near = F.floor(place / step + 0.5)
        hit = F.lit(False)
        for s in (near - 1, near, near + 1):
            hit = hit | ((F.floor(s * step + 0.5) == place) & (s >= 0) & (s < limit))
        chosen = (total <= limit) | hit
    if keep is not None:
        chosen = chosen | keep
    return placed.filter(chosen).drop("__place")


def density_track(intervals: DataFrame, lengths: DataFrame, bins: int) -> DataFrame:
    """Item count and overlapping bases per bin of each record ``lengths(record, length)``; empty bins included.

    ``start`` and ``end`` are 1-based inclusive. An item reaches only the bins it overlaps.
    """
    edge = lambda i: F.floor(i * F.col("length") / bins)
    part = intervals.join(lengths, "record").select(
        "record", "length", F.greatest(F.lit(0), F.col("start") - 1).alias("s"), F.least(F.col("length"), F.col("end")).alias("e")
    ).filter("e > s")
    index = lambda p: F.least(F.lit(bins - 1), F.floor(p / F.col("length") * bins))
    spread = part.select(
        "record", "length", "s", "e", F.explode(F.sequence(index(F.col("s")), index(F.col("e") - 1))).alias("bin")
    )
    end = F.when(F.col("bin") == bins - 1, F.col("length")).otherwise(edge(F.col("bin") + 1))
    overlap = F.least(F.col("e"), end) - F.greatest(F.col("s"), edge(F.col("bin")))
    filled = spread.select("record", "bin", overlap.alias("overlap")).filter("overlap > 0").groupBy("record", "bin").agg(
        F.count(F.lit(1)).alias("count"), F.sum("overlap").alias("bases")
    )
    grid = lengths.select("record", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    zero = F.lit(0).cast("bigint")
    return grid.join(filled, ["record", "bin"], "left").select(
        "record", "bin", edge(F.col("bin")).alias("start"), end.alias("end"),
        F.coalesce("count", zero).alias("count"), F.coalesce("bases", zero).alias("bases"),
    )


def point_density(points: DataFrame, lengths: DataFrame, bins: int) -> DataFrame:
    """Points per bin of each record, for 1-based ``position``."""
    clamped = F.greatest(F.lit(1), F.least(F.col("length"), F.col("position"))) - 1
    place = F.least(F.lit(bins - 1), F.floor(clamped / F.col("length") * bins))
    return points.join(lengths, "record").groupBy("record", place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
