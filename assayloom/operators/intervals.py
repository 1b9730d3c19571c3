"""Interval joins and interval arithmetic on 1-based inclusive ``(record, start, end)`` rows.

The range join works on bins of several widths. An interval belongs to the level whose bins are
just wide enough for it, so it touches at most two bins there and at most two on every coarser
level. A pair meets once, on the coarser of its two levels, in the first bin both touch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.sequence import reverse_complement
from assayloom.operators.once import explode_once, plain
from assayloom.operators.tiles import last_known, next_position, running_depth
from assayloom.session import settle

BASE_BITS = 7
BASE_WIDTH = 1 << BASE_BITS
LEVEL_BITS = 3


def _level(length: Column) -> Column:
    """0 up to ``BASE_WIDTH`` positions, then one more for every ``LEVEL_BITS`` bits of length."""
    bits = F.length(F.bin(length.cast("bigint") - 1))
    return F.greatest(F.lit(0), F.ceil((bits - BASE_BITS) / LEVEL_BITS)).cast("int")


def _width(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(BASE_WIDTH).cast("bigint"), level * LEVEL_BITS)


def _levels_of(side: DataFrame) -> Column:
    """The levels (a dozen at most) that occur on a side: a subquery of the join, so nothing runs before it."""
    return side.select(_level(F.col("end") - F.col("start") + 1).alias("k")).agg(F.collect_set("k").alias("ks")).scalar()


def _binned(df: DataFrame, start: str, end: str, other_levels: Column, prefix: str) -> DataFrame:
    own = _level(F.col(end) - F.col(start) + 1)
    kept = [*df.columns, f"{prefix}_level"]
    own_level = df.withColumn(f"{prefix}_level", own).withColumn("__others", other_levels)
    coarser = F.filter("__others", lambda k: k > F.col(f"{prefix}_level"))
    levelled = explode_once(own_level, F.concat(F.array(f"{prefix}_level"), coarser), "__k", *kept)
    width = _width(F.col("__k"))
    return explode_once(levelled, F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)), "__bin", *levelled.columns)


def range_join(left: DataFrame, right: DataFrame, *, prefixes: tuple[str, str] = ("a", "b")) -> DataFrame:
    """All pairs on the same record whose ranges overlap. Columns come back as ``a_*`` and ``b_*``."""
    pa, pb = prefixes
    a = left.select(*[F.col(c).alias(f"{pa}_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"{pb}_{c}") for c in right.columns])
    levels_a, levels_b = _levels_of(left), _levels_of(right)
    ab = _binned(a, f"{pa}_start", f"{pa}_end", levels_b, f"__{pa}").withColumnRenamed("__k", "__ka").withColumnRenamed("__bin", "__bina")
    bb = _binned(b, f"{pb}_start", f"{pb}_end", levels_a, f"__{pb}").withColumnRenamed("__k", "__kb").withColumnRenamed("__bin", "__binb")
    first_shared = F.floor(F.greatest(f"{pa}_start", f"{pb}_start") / _width(F.col("__ka")))
    match = (
        (F.col(f"{pa}_record") == F.col(f"{pb}_record")) & (F.col("__ka") == F.col("__kb")) & (F.col("__bina") == F.col("__binb"))
        & (F.col("__ka") == F.greatest(f"__{pa}_level", f"__{pb}_level"))
        & (F.col(f"{pa}_start") <= F.col(f"{pb}_end")) & (F.col(f"{pb}_start") <= F.col(f"{pa}_end"))
        & (F.col("__bina") == first_shared)
    )
    return ab.join(bb, match).select(*a.columns, *b.columns)


def overlap_bp(pa: str = "a", pb: str = "b") -> Column:
    return F.least(f"{pa}_end", f"{pb}_end") - F.greatest(f"{pa}_start", f"{pb}_start") + 1


def intersect(query: DataFrame, reference: DataFrame, *, min_overlap_bp: int = 1, min_reciprocal_percent: float = 0.0) -> DataFrame:
    """Overlapping pairs with at least ``min_overlap_bp`` shared, and the share of both lengths when asked."""
    pairs = range_join(query, reference).withColumn("overlap_bp", overlap_bp()).filter(F.col("overlap_bp") >= min_overlap_bp)
    if min_reciprocal_percent > 0:
        share = lambda p: F.col("overlap_bp") / (F.col(f"{p}_end") - F.col(f"{p}_start") + 1) >= min_reciprocal_percent / 100
        pairs = pairs.filter(share("a") & share("b"))
    return pairs.select(
        F.col("a_record").alias("record"), F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("a_name").alias("name"),
        F.lit("intersect").alias("operation"), F.col("b_start").alias("partner_start"), F.col("b_end").alias("partner_end"),
        F.col("b_name").alias("partner_name"), "overlap_bp", F.col("a_strand").alias("strand"),
    )


def merged_runs(intervals: DataFrame, gap: int = 0) -> DataFrame:
    """Maximal runs of intervals that overlap, touch or lie at most ``gap`` apart.

    Each interval covers ``start .. end + gap``; a run is where the depth stays above zero.
    """
    deltas = intervals.select(
        "record", F.explode(F.array(
            F.struct(F.col("start").cast("bigint").alias("position"), F.lit(1).cast("bigint").alias("delta")),
            F.struct((F.col("end") + gap + 1).cast("bigint").alias("position"), F.lit(-1).cast("bigint").alias("delta")),
        )).alias("d"),
    ).select("record", "d.*")
    edges = running_depth(deltas).select(
        "record", "position", (F.col("depth") > 0).alias("opens"), (F.col("depth") - F.col("delta") > 0).alias("was_open")
    ).filter("opens <> was_open")
    return next_position(edges, "__next").filter("opens").select(
        "record", F.col("position").alias("start"), (F.col("__next") - 1 - gap).alias("end")
    )


def merge_members(intervals: DataFrame, gap: int = 0) -> DataFrame:
    """Every interval with the merged run it belongs to (the names of a run, one per row)."""
    runs = merged_runs(intervals, gap)
    return range_join(intervals, runs, prefixes=("a", "r")).select(
        F.col("a_record").alias("record"), F.col("r_start").alias("run_start"), F.col("r_end").alias("run_end"),
        F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("a_name").alias("name"),
    )


def merge(intervals: DataFrame, gap: int = 0) -> DataFrame:
    """Merged runs with the number of intervals in each and the name of the first.

    A run can hold any number of names, so they are not packed into one cell: see ``merge_members``.
    """
    starts = intervals.groupBy("record", F.col("start").cast("bigint").alias("start")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("end", "name")).alias("who")
    )
    # A start belongs to the last run that opened at or before it.
    asked = starts.select("record", (F.col("start") + 1).alias("position"), "n", F.struct(F.col("start"), F.col("who.end"), F.col("who.name")).alias("who"))
    runs = merged_runs(intervals, gap).withColumnRenamed("start", "position")
    placed = last_known(asked, runs, "end", ["n", "who"])
    return placed.groupBy("record", F.col("mark.at").alias("start"), F.col("mark.value").alias("end")).agg(
        F.min("who").alias("who"), F.sum("n").alias("interval_count")
    ).select("record", "start", "end", F.col("who.name").alias("name"), F.lit("merge").alias("operation"), "interval_count")


def union_length(intervals: DataFrame) -> DataFrame:
    return merged_runs(intervals).groupBy("record").agg(F.sum(F.col("end") - F.col("start") + 1).alias("union_bp"), F.count(F.lit(1)).alias("runs"))


def subtract(query: DataFrame, reference: DataFrame) -> DataFrame:
    """Parts of each query not covered by any reference interval.

    The holes between merged reference runs are intervals too: a query keeps its overlap with each
    hole, plus what lies before the first and after the last run of its record.
    """
    runs = merged_runs(reference.select("record", "start", "end"))
    holes = next_position(runs.select("record", F.col("start").alias("position"), "end"), "__next").filter("__next IS NOT NULL").select(
        "record", (F.col("end") + 1).alias("start"), (F.col("__next") - 1).alias("end")
    )
    inner = range_join(query, holes).select(
        *[F.col(f"a_{c}").alias(c) for c in query.columns if c not in ("start", "end")],
        F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"),
    )
    ends = runs.groupBy("record").agg(F.min("start").alias("__first"), F.max("end").alias("__last"))
    outside = query.join(ends, "record", "left")
    piece = lambda low, high: F.struct(low.cast("bigint").alias("start"), high.cast("bigint").alias("end"))
    pieces = F.when(F.col("__first").isNull(), F.array(piece(F.col("start"), F.col("end")))).otherwise(
        F.array(
            piece(F.col("start"), F.least(F.col("end"), F.col("__first") - 1)), piece(F.greatest(F.col("start"), F.col("__last") + 1), F.col("end"))
        )
    )
    rest = [c for c in query.columns if c not in ("start", "end")]
    outer = outside.select(*rest, F.explode(pieces).alias("p")).filter("p.start <= p.end").select(*rest, "p.start", "p.end")
    return outer.unionByName(inner).withColumn("operation", F.lit("subtract"))


def nearest(query: DataFrame, reference: DataFrame, *, query_id: str, order: str) -> DataFrame:
    """The closest reference interval of each query on its record; ties go to the lowest ``order``.

    Overlap is distance 0 and touching is 1. Every distinct range is looked up once: first for overlaps, and only where there
    is none for its neighbours, so the rows themselves are exchanged once. Of equal reference ranges only the lowest ``order``
    can be an answer, so pile-ups are one row each.
    """
    ref = reference.select("record", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "name", order)
    who = F.struct(F.col(order).alias("order"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("name").alias("name"))
    asked = query.select("record", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).distinct()
    lowest = ref.groupBy("record", "start", "end").agg(F.min(who).alias("who"))
    keys = ["record", "__s", "__e"]
    hits = range_join(asked, lowest).groupBy(F.col("a_record").alias("record"), F.col("a_start").alias("__s"), (-F.col("a_end")).alias("__e")).agg(F.min("b_who").alias("hit"))
    # Written once: both neighbour searches and the answers read it.
    ranges = settle(asked.select("record", F.col("start").alias("__s"), (-F.col("end")).alias("__e")).join(hits, keys, "left"))
    alone = ranges.filter("hit IS NULL").select(*keys)
    ends = ref.withColumn("who", who).groupBy("record", F.col("end").alias("position")).agg(F.min("who").alias("who"))
    starts = ref.withColumn("who", who).groupBy("record", (-F.col("start")).alias("position")).agg(F.min("who").alias("who"))
    before = last_known(alone.select("record", F.col("__s").alias("position")).distinct(), ends, "who").select(
        "record", F.col("position").alias("__s"), F.col("mark.value").alias("__before")
    )
    after = last_known(alone.select("record", F.col("__e").alias("position")).distinct(), starts, "who").select(
        "record", F.col("position").alias("__e"), F.col("mark.value").alias("__after")
    )
    choice = lambda distance, found: F.when(
        found.isNotNull(), F.struct(distance.cast("bigint").alias("distance"), found["order"].alias("order"), found["start"].alias("start"), found["end"].alias("end"), found["name"].alias("name"))
    )
    beside = F.array_min(F.array_compact(F.array(
        choice(F.col("__s") - F.col("__before.end"), F.col("__before")), choice(F.col("__after.start") + F.col("__e"), F.col("__after"))
    )))
    answers = ranges.filter("hit IS NOT NULL").select(*keys, choice(F.lit(0), F.col("hit")).alias("__best")).unionByName(
        alone.join(plain(before), ["record", "__s"], "left").join(plain(after), ["record", "__e"], "left").select(*keys, beside.alias("__best")).filter("__best IS NOT NULL")
    )
    q = query.withColumn("__s", F.col("start").cast("bigint")).withColumn("__e", -F.col("end").cast("bigint"))
    found = q.join(plain(answers), keys)
    overlap = F.least("end", "__best.end") - F.greatest("start", "__best.start") + 1
    return found.select(
        *query.columns, F.lit("nearest").alias("operation"), F.col("__best.start").alias("partner_start"), F.col("__best.end").alias("partner_end"),
        F.col("__best.name").alias("partner_name"), F.greatest(F.lit(0), overlap).cast("bigint").alias("overlap_bp"), F.col("__best.distance").alias("distance_bp"),
    )


# --- alignment blocks --------------------------------------------------------------------------

def filter_blocks(blocks: DataFrame, *, min_identity: float = 0.0, min_length: int = 0, min_mapq: int = 0, include_reverse: bool = True) -> DataFrame:
    out = blocks.filter((F.col("identity") >= min_identity) & (F.col("block_length") >= min_length))
    out = out.filter(F.col("mapq").isNull() | (F.col("mapq") >= min_mapq))
    return out if include_reverse else out.filter("strand <> '-'")


def block_summary(blocks: DataFrame, comparison_lengths: DataFrame, reference_length: int) -> DataFrame:
    """Coverage of both sides (half-open block coordinates) and length-weighted identity per comparison."""
    def covered(start: str, end: str, name: str) -> DataFrame:
        closed = blocks.filter(F.col(end) > F.col(start)).select(
            F.col("comparison").alias("record"), (F.greatest(F.lit(0), F.col(start)) + 1).alias("start"), F.col(end).alias("end")
        )
        return union_length(closed).select(F.col("record").alias("comparison"), F.col("union_bp").alias(name))

    weights = blocks.groupBy("comparison").agg(
        F.count(F.lit(1)).alias("block_count"), (F.sum(F.col("identity") * F.col("block_length")) / F.sum("block_length")).alias("mean_identity")
    )
    zero = F.lit(0).cast("bigint")
    joined = (
        comparison_lengths.join(weights, "comparison", "left").join(covered("reference_start", "reference_end", "r"), "comparison", "left")
        .join(covered("comparison_start", "comparison_end", "c"), "comparison", "left")
    )
    r, c = F.coalesce("r", zero), F.coalesce("c", zero)
    return joined.select(
        "comparison", "comparison_length", F.coalesce("block_count", zero).alias("block_count"), r.alias("aligned_reference_bp"),
        F.round(r / max(1, reference_length) * 100, 2).alias("reference_coverage_percent"), c.alias("aligned_comparison_bp"),
        F.round(c / F.greatest(F.lit(1), F.col("comparison_length")) * 100, 2).alias("comparison_coverage_percent"),
        F.round("mean_identity", 2).alias("mean_identity_percent"),
    )


# --- features ----------------------------------------------------------------------------------

def features_at(positions: DataFrame, features: DataFrame) -> DataFrame:
    """Features that contain each ``(record, position)``."""
    points = positions.withColumn("start", F.col("position")).withColumn("end", F.col("position"))
    joined = range_join(points, features, prefixes=("p", "f"))
    return joined.select(
        *[F.col(f"p_{c}").alias(c) for c in positions.columns],
        *[F.col(f"f_{c}").alias(f"feature_{c}") for c in features.columns if c != "record"],
    )


def match_layers(features: DataFrame, records: DataFrame) -> DataFrame:
    """Features of a layer against the records they belong to: ``ok``, ``out_of_bounds`` or ``no_record``."""
    joined = features.join(records.select("record", F.col("length").alias("__length")), "record", "left")
    inside = (F.col("start") >= 1) & (F.col("end") <= F.col("__length")) & (F.col("start") <= F.col("end"))
    return joined.withColumn(
        "layer_status", F.when(F.col("__length").isNull(), "no_record").when(inside, "ok").otherwise("out_of_bounds")
    ).drop("__length")


def filter_features(
    features: DataFrame, *, types: Sequence[str] = (), strand: str | None = None, start: int | None = None, end: int | None = None,
    qualifier: str | None = None, qualifier_value: str | None = None, text: str | None = None,
) -> DataFrame:
    """Filter rows with ``type``, ``strand``, ``start``, ``end`` and an ``attributes`` map; text compares without case."""
    out = features
    if types:
        out = out.filter(F.lower("type").isin([t.lower() for t in types]))
    if strand:
        out = out.filter(F.col("strand") == strand)
    if start is not None:
        out = out.filter(F.col("end") >= start)
    if end is not None:
        out = out.filter(F.col("start") <= end)
    folded = F.map_from_entries(F.transform(F.map_entries("attributes"), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.lower(e["value"]).alias("value"))))
    if qualifier:
        value = F.element_at(folded, qualifier.lower())
        out = out.filter(value.isNotNull() if qualifier_value is None else value.contains(qualifier_value.lower()))
    elif qualifier_value is not None:
        out = out.filter(F.exists(F.map_values(folded), lambda v: v.contains(qualifier_value.lower())))
    if text:
        wanted = text.lower()
        out = out.filter(
            F.lower("type").contains(wanted) | F.exists(F.map_values(folded), lambda v: v.contains(wanted)) | F.lower("record").contains(wanted)
        )
    return out


# --- sequence slices ---------------------------------------------------------------------------

CHUNK = 1 << 16


def sequence_chunks(sequences: DataFrame) -> DataFrame:
    """Sequences cut into chunks of ``CHUNK`` symbols, so no slice drags a whole chromosome along."""
    count = F.ceil(F.length("sequence") / CHUNK).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(i.cast("bigint").alias("chunk"), F.col("sequence").substr(i * CHUNK + 1, F.lit(CHUNK)).alias("text")),
    )
    return explode_once(sequences.filter(F.length("sequence") > 0), pieces, "c", "record").select("record", "c.*")


def extract_regions(regions: DataFrame, sequences: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Sequence of each region, clipped to its record and reverse-complemented on the minus strand; equal regions give one row."""
    lengths = sequences.select("record", F.length("sequence").cast("bigint").alias("__length"))
    keys = list(dict.fromkeys([*key, "record", "start", "end", "strand"]))
    clipped = regions.select(*keys).distinct().join(lengths, "record").withColumn("start", F.greatest(F.lit(1), F.col("start")).cast("bigint")).withColumn(
        "end", F.least(F.col("end"), F.col("__length")).cast("bigint")
    ).filter("start <= end").drop("__length").distinct()
    wanted = clipped.withColumn(
        "chunk", F.explode(F.sequence(F.floor((F.col("start") - 1) / CHUNK), F.floor((F.col("end") - 1) / CHUNK)))
    )
    offset = F.greatest(F.lit(0), F.col("start") - 1 - F.col("chunk") * CHUNK)
    size = F.least(F.lit(CHUNK), F.col("end") - F.col("chunk") * CHUNK) - offset
    pieces = wanted.join(sequence_chunks(sequences), ["record", "chunk"]).withColumn(
        "piece", F.col("text").substr((offset + 1).cast("int"), size.cast("int"))
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda p: p["piece"]), "")
    out = pieces.groupBy(*keys).agg(whole.alias("sequence"))
    return out.withColumn("sequence", F.when(F.col("strand") == "-", reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")))


def selected_regions(regions: DataFrame, lengths: DataFrame, *, complement: bool = False) -> DataFrame:
    """Regions clipped to ``lengths(record, length)`` with touching ones merged, or what lies between them."""
    clipped = regions.join(lengths, "record").select(
        "record", F.greatest(F.lit(1), F.col("start")).cast("bigint").alias("start"), F.least("end", "length").cast("bigint").alias("end")
    ).filter("start <= end")
    if not complement:
        return merged_runs(clipped)
    whole = lengths.select("record", F.lit(1).cast("bigint").alias("start"), F.col("length").cast("bigint").alias("end"))
    return subtract(whole, clipped).select("record", "start", "end")


def splice_transcripts(parts: DataFrame, sequences: DataFrame) -> DataFrame:
    """Exon (or CDS) slices of each ``transcript`` joined in reading order.

    ``parts(transcript, record, start, end, strand)`` may repeat; slices are cut on the plus strand
    and the joined text is turned round once.
    """
    forward = parts.select("transcript", "record", "start", "end", F.lit("+").alias("strand"), F.col("strand").alias("direction"))
    slices = extract_regions(forward, sequences, key=["transcript", "direction"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "sequence"))), lambda p: p["sequence"]), "")
    out = slices.groupBy("transcript", "record", F.col("direction").alias("strand")).agg(
        joined.alias("sequence"), F.count(F.lit(1)).alias("parts"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    turned = F.when(F.col("strand") == "-", reverse_complement(F.col("sequence"))).otherwise(F.col("sequence"))
    return out.withColumn("sequence", turned).withColumn("length", F.length("sequence").cast("bigint"))


def transcript_parts(features: DataFrame, part_type: str = "exon") -> DataFrame:
    """Parts of each transcript; a part may name several, and a transcript without any uses its own row."""
    exons = features.filter(F.col("feature") == part_type).select(
        F.explode(F.split(F.coalesce("transcript_id", "parent"), r"\s*,\s*")).alias("transcript"), "record", "start", "end", "strand"
    ).filter("transcript <> ''")
    whole = features.filter(F.col("feature").isin("mRNA", "transcript")).select(
        F.coalesce("id", "transcript_id").alias("transcript"), "record", "start", "end", "strand"
    )
    return exons.unionByName(whole.join(exons.select("transcript").distinct(), "transcript", "left_anti"))
