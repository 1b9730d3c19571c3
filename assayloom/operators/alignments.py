"""Alignment (SAM) rows: reference and flag statistics, coverage, windows, regions, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.cells import safe_div
from assayloom.functions.hts import SAM_FLAGS, aligned_blocks, cigar_ops, has_flag, ops_length, sam_tag
from assayloom.operators.once import compute_once, explode_once
from assayloom.operators.tiles import running_depth
from assayloom.session import settle


def is_mapped() -> Column:
    return ~has_flag(F.col("flag"), 4) & (F.col("rname") != "*") & (F.col("pos") > 0) & (F.col("cigar") != "*")


def typed_alignments(sam: DataFrame) -> DataFrame:
    """Add the parsed CIGAR, the reference ``end`` and ``mapped``."""
    out = sam.withColumn("mapped", is_mapped()).withColumn("ops", cigar_ops(F.col("cigar")))
    return out.withColumn("end", F.when(F.col("mapped"), F.col("pos") + ops_length(F.col("ops"), "M=XDN") - 1))


def reference_stats(sam: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Alignments per reference; references of ``lengths(reference, length)`` without any are listed too."""
    rows = typed_alignments(sam).filter((F.col("rname") != "*") & (F.col("rname") != ""))
    only = lambda c: F.when(F.col("mapped"), F.col(c))
    stats = rows.groupBy(F.col("rname").alias("reference")).agg(
        F.count(F.lit(1)).alias("alignments"), F.count(only("pos")).alias("mapped_alignments"),
        F.round(F.avg(only("mapq")), 3).alias("mean_mapq"), F.min(only("pos")).alias("covered_min"), F.max(only("end")).alias("covered_max"),
    )
    if lengths is None:
        return stats.select("reference", F.lit(None).cast("bigint").alias("length"), *stats.columns[1:])
    zero = F.lit(0).cast("bigint")
    joined = lengths.select("reference", "length").join(stats, "reference", "full")
    return joined.select(
        "reference", "length", F.coalesce("alignments", zero).alias("alignments"), F.coalesce("mapped_alignments", zero).alias("mapped_alignments"),
        "mean_mapq", "covered_min", "covered_max",
    )


def flag_census(sam: DataFrame) -> DataFrame:
    """Count and share of each flag bit, from the counts of distinct flags."""
    flags = sam.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    one = flags.agg(
        F.sum("n").alias("total"), *[F.sum(F.when(has_flag(F.col("flag"), bit), F.col("n")).otherwise(0)).alias(f"b{bit}") for bit in SAM_FLAGS]
    )
    rows = [F.struct(F.lit(bit).alias("flag"), F.lit(label).alias("label"), F.col(f"b{bit}").alias("count"), F.col("total")) for bit, label in SAM_FLAGS.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select(
        "r.flag", "r.label", F.coalesce("r.count", F.lit(0).cast("bigint")).alias("count"),
        F.round(F.coalesce(safe_div(F.col("r.count"), F.col("r.total")) * 100, F.lit(0.0)), 3).alias("percent"),
    )


def blocks(sam: DataFrame) -> DataFrame:
    """Aligned reference ranges ``(record, start, end)`` of mapped rows."""
    mapped = sam.filter(is_mapped())
    parsed = compute_once(mapped.select("rname", "pos", "cigar"), ops=cigar_ops(F.col("cigar")))
    return explode_once(parsed, aligned_blocks(F.col("pos"), F.col("ops")), "b", F.col("rname").alias("record")).select("record", "b.*")


def depth_segments(ranges: DataFrame, scope: DataFrame) -> DataFrame:
    """Stretches of equal depth ``(record, start, end, depth)`` that fill ``scope(record, scope_start, scope_end)``.

    The scope has one row per reference and is worked out once; it is broadcast, since exchanging the stretches by their reference
    would put each chromosome in one task.
    """
    scope = settle(scope)
    event = lambda position, delta: F.struct(position.cast("bigint").alias("position"), F.lit(delta).cast("bigint").alias("delta"))
    steps = ranges.select("record", F.explode(F.array(event(F.col("start"), 1), event(F.col("end") + 1, -1))).alias("e")).select("record", "e.*")
    frame = scope.select("record", F.explode(F.array(event(F.col("scope_start"), 0), event(F.col("scope_end") + 1, 0))).alias("e")).select("record", "e.*")
    segments = running_depth(steps.unionByName(frame)).filter("next_position IS NOT NULL")
    return segments.join(F.broadcast(scope), "record").select(
        "record", F.greatest("position", "scope_start").alias("start"), F.least(F.col("next_position") - 1, F.col("scope_end")).alias("end"), "depth"
    ).filter("start <= end")


def coverage_scope(sam: DataFrame, lengths: DataFrame | None = None, *, ranges: DataFrame | None = None) -> DataFrame:
    """The whole reference where its length is known, else the observed span; ``ranges`` are the aligned blocks if at hand."""
    spans = (blocks(sam) if ranges is None else ranges).groupBy("record").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    if lengths is None:
        known = spans.withColumn("length", F.lit(None).cast("bigint"))
    else:
        known = spans.join(lengths.select(F.col("reference").alias("record"), "length"), "record", "full")
    full = F.col("length").isNotNull()
    return known.select(
        "record", F.when(full, "reference length").otherwise("observed span").alias("scope"), F.when(full, F.lit(1)).otherwise(F.col("lo")).cast("bigint").alias("scope_start"),
        F.when(full, F.col("length")).otherwise(F.col("hi")).cast("bigint").alias("scope_end"),
    )


def zero_regions(segments: DataFrame) -> DataFrame:
    """Uncovered stretches, one per row."""
    return segments.filter("depth = 0").select("record", "start", "end", (F.col("end") - F.col("start") + 1).alias("length"))


def coverage_summary(sam: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    # The CIGAR texts are read once; scope and depth take the narrow blocks.
    ranges = settle(blocks(sam))
    scope = settle(coverage_scope(sam, lengths, ranges=ranges))
    segments = depth_segments(ranges, scope.select("record", "scope_start", "scope_end"))
    size = F.col("end") - F.col("start") + 1
    zero = F.lit(0).cast("bigint")
    sums = segments.groupBy("record").agg(
        F.sum(F.when(F.col("depth") > 0, size).otherwise(zero)).alias("covered_bases"), F.sum(size * F.col("depth")).alias("total_depth"),
        F.max("depth").alias("max_depth"), F.count(F.when(F.col("depth") == 0, 1)).alias("zero_coverage_region_count"),
        F.coalesce(F.max(F.when(F.col("depth") == 0, size)), zero).alias("largest_zero_coverage_region"),
    )
    mapped = sam.filter(is_mapped()).groupBy(F.col("rname").alias("record")).agg(F.count(F.lit(1)).alias("mapped_alignments"))
    length = F.col("scope_end") - F.col("scope_start") + 1
    return scope.join(sums, "record").join(mapped, "record", "left").select(
        F.col("record").alias("reference"), "scope", "scope_start", "scope_end", length.alias("scope_length"),
        F.coalesce("mapped_alignments", zero).alias("mapped_alignments"), "covered_bases",
        F.round(F.col("covered_bases") / length * 100, 3).alias("breadth_percent"), F.round(F.col("total_depth") / length, 3).alias("mean_depth"),
        "max_depth", "total_depth", "zero_coverage_region_count", "largest_zero_coverage_region",
    )


def window_coverage(sam: DataFrame, lengths: DataFrame, window: int, *, min_mapq: int = 0, min_aligned_bases: int = 0) -> DataFrame:
    """Depth and breadth per fixed window of each reference in ``lengths(reference, length)``."""
    kept = sam.filter(is_mapped() & (F.col("mapq") >= min_mapq) & (ops_length(cigar_ops(F.col("cigar")), "M=X") >= min_aligned_bases))
    scope = settle(lengths.select(F.col("reference").alias("record"), F.lit(1).cast("bigint").alias("scope_start"), F.col("length").cast("bigint").alias("scope_end")))
    ranges = blocks(kept).join(F.broadcast(scope), "record").select(
        "record", F.least(F.greatest("start", "scope_start"), "scope_end").alias("start"), F.least(F.greatest("end", "scope_start"), "scope_end").alias("end")
    )
    cut = depth_segments(ranges, scope).withColumn(
        "bin", F.explode(F.sequence(F.floor((F.col("start") - 1) / window), F.floor((F.col("end") - 1) / window)))
    )
    low, high = F.greatest(F.col("start"), F.col("bin") * window + 1), F.least(F.col("end"), (F.col("bin") + 1) * window)
    size = high - low + 1
    sums = cut.groupBy("record", "bin").agg(
        F.min(low).alias("start"), F.max(high).alias("end"), F.sum(size * F.col("depth")).alias("total"), F.max("depth").alias("max_depth"),
        F.sum(F.when(F.col("depth") > 0, size).otherwise(0)).alias("covered_bases"),
    )
    width = F.col("end") - F.col("start") + 1
    return sums.select(
        F.col("record").alias("reference"), "start", "end", width.alias("window_size"), F.round(F.col("total") / width, 3).alias("mean_depth"),
        "max_depth", "covered_bases", F.round(F.col("covered_bases") / width * 100, 2).alias("covered_percent"),
    )


def region_query(sam: DataFrame, reference: str, start: int, end: int) -> DataFrame:
    rows = sam.filter((F.col("rname") == reference) & (F.col("pos") <= end))
    return typed_alignments(rows).filter(F.col("mapped") & (F.col("end") >= start))


def alignment_metrics(sam: DataFrame) -> DataFrame:
    rows = typed_alignments(sam)
    mapped, flag = F.col("mapped"), F.col("flag")
    aligned = F.when(mapped, ops_length(F.col("ops"), "M=X")).otherwise(0).cast("bigint")
    mismatches = sam_tag(F.col("tags"), "NM").try_cast("int")
    identity = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (aligned - mismatches) / aligned * 100))
    pair = (
        F.when(~has_flag(flag, 1), "not paired").when(~mapped, "read unmapped").when(has_flag(flag, 8), "mate unmapped")
        .when(has_flag(flag, 2), "proper pair").otherwise("paired")
    )
    return rows.select(
        F.col("qname").alias("read"), F.when(mapped, F.col("rname")).alias("reference"), F.when(mapped, F.col("pos")).alias("start"), "end",
        F.when(mapped, F.when(has_flag(flag, 16), "-").otherwise("+")).alias("strand"), aligned.alias("aligned_bases"),
        ops_length(F.col("ops"), "M=XIS").alias("read_length"), F.when(aligned > 0, F.round(identity, 2)).alias("identity_percent"),
        mismatches.alias("mismatches"), pair.alias("pair_status"), F.when(mapped, "mapped").otherwise("unmapped").alias("status"),
    )
