"""FASTQ reads: summaries, per-base profiles, distributions, filters and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.hts import quality_scores, sum_scores
from assayloom.functions.sequence import count_any, count_symbol
from assayloom.operators.once import compute_once
from assayloom.operators.ladder import ladder_quantiles, quantiles, value_ladder
from assayloom.operators.ordering import sample_rows


def read_metrics(reads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Length, GC, N and quality of each read."""
    upper = F.upper("sequence")
    scores = quality_scores(F.col("quality"))
    known, gc, n = count_any(upper, "ACGTU"), count_any(upper, "GC"), count_symbol(upper, "N")
    length = F.length("sequence").cast("bigint")
    base = compute_once(reads, scores=scores).select(
        *keys, "sequence", length.alias("length"), gc.alias("gc"), n.alias("n"), known.alias("known"), "scores",
        F.length("quality").cast("bigint").alias("q_count"),
    )
    return base.select(
        *keys, "sequence", "length", "gc", "n", "q_count", sum_scores(F.col("scores")).alias("q_sum"),
        F.size(F.filter("scores", lambda s: s >= 20)).cast("bigint").alias("q20"), F.size(F.filter("scores", lambda s: s >= 30)).cast("bigint").alias("q30"),
        F.array_min("scores").alias("q_min"), F.array_max("scores").alias("q_max"),
        F.when(F.col("known") > 0, F.col("gc") / F.col("known") * 100).otherwise(0.0).alias("gc_percent"),
        F.when(F.col("length") > 0, F.col("n") / F.col("length") * 100).otherwise(0.0).alias("n_percent"),
    ).withColumn("mean_quality", F.when(F.col("q_count") > 0, F.col("q_sum") / F.col("q_count")).otherwise(0.0))


def overrepresented(reads: DataFrame) -> DataFrame:
    total = reads.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = reads.groupBy("sequence").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
    return counts.withColumn("percent", F.round(F.col("count") / total * 100, 2)).orderBy(F.desc("count"), "sequence")


#: Counters of a read set and how those of two sets are put together.
READ_COUNTERS = {
    "reads": "sum", "bases": "sum", "shortest": "min", "longest": "max", "gc": "sum", "n": "sum", "with_n": "sum",
    "q_sum": "sum", "q_count": "sum", "q20": "sum", "q30": "sum", "q_min": "min", "q_max": "max",
}


#: Metrics that need the reads themselves.
NOT_MERGEABLE = (
    "median_read_length", "median_read_gc_percent", "median_read_n_percent", "median_read_mean_quality",
    "duplicate_reads", "duplicate_reads_percent", "overrepresented_sequence_count",
)


def read_counters() -> dict[str, Column]:
    """Aggregates over ``read_metrics`` rows, by the names of ``READ_COUNTERS``."""
    return {
        "reads": F.count(F.lit(1)), "bases": F.sum("length"), "shortest": F.min("length"), "longest": F.max("length"),
        "gc": F.sum("gc"), "n": F.sum("n"), "with_n": F.count(F.when(F.col("n") > 0, 1)), "q_sum": F.sum("q_sum"),
        "q_count": F.sum("q_count"), "q20": F.sum("q20"), "q30": F.sum("q30"), "q_min": F.min("q_min"), "q_max": F.max("q_max"),
    }


def fastq_summary(reads: DataFrame) -> DataFrame:
    """``(metric, value, unit, assessment)`` rows; medians and duplicates are exact."""
    m = read_metrics(reads)
    sums = m.agg(*[column.alias(name) for name, column in read_counters().items()])
    values = ("length", "gc_percent", "n_percent", "mean_quality")
    long = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("v")) for c in values])).alias("x")).select("x.*")
    medians = quantiles(long, "v", {"md": 0.5}, ["what"]).agg(*[F.max(F.when(F.col("what") == c, F.col("md"))).alias(f"md_{c}") for c in values])
    copies = reads.groupBy("sequence").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"), F.count(F.lit(1)).alias("repeated")
    )
    one = sums.select(
        "*", medians.select(F.struct(*medians.columns).alias("x")).scalar().alias("__medians"), copies.select(F.struct(*copies.columns).alias("x")).scalar().alias("__copies")
    ).select(*sums.columns, "__medians.*", "__copies.*")
    return summary_rows(one)


def summary_rows(one: DataFrame) -> DataFrame:
    """The metrics of one row of counters. Those of medians and copies come only if it has them; sums of parts do not."""
    share = lambda top, bottom, digits=2: F.round(F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom) * 100).otherwise(0.0), digits)
    ratio = lambda top, bottom: F.round(F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0), 6)

    def judged(value: Column, best: Column, middle: Column, names: tuple[str, str, str]) -> Column:
        return F.when(best, names[0]).when(middle, names[1]).otherwise(names[2])

    whole = "duplicates" in one.columns
    if not whole:
        absent = ("md_length", "md_gc_percent", "md_n_percent", "md_mean_quality", "duplicates", "repeated")
        one = one.select("*", *[F.lit(None).cast("double").alias(c) for c in absent])
    q, q30, dup, n = ratio("q_sum", "q_count"), share("q30", "q_count"), share("duplicates", "reads"), share("with_n", "reads")
    none = F.lit("")
    # Metric names, units, assessments and their limits.
    rows: list[tuple[str, Column, str, Column]] = [
        ("read_count", F.col("reads"), "reads", none), ("total_bases", F.col("bases"), "bases", none),
        ("min_read_length", F.col("shortest"), "bases", none), ("mean_read_length", ratio("bases", "reads"), "bases", none),
        ("median_read_length", F.round("md_length", 6), "bases", none), ("max_read_length", F.col("longest"), "bases", none),
        ("gc_percent", share("gc", "bases"), "%", none), ("median_read_gc_percent", F.round("md_gc_percent", 2), "%", none),
        ("n_count", F.col("n"), "bases", none),
        ("reads_with_n_percent", n, "%", judged(n, n <= 5, n <= 20, ("low", "review", "high"))),
        ("median_read_n_percent", F.round("md_n_percent", 2), "%", none),
        ("mean_phred_quality", q, "Phred+33", judged(q, q >= 30, q >= 20, ("good", "review", "low"))),
        ("median_read_mean_quality", F.round("md_mean_quality", 3), "Phred+33", none),
        ("q20_bases_percent", share("q20", "q_count"), "%", none),
        ("q30_bases_percent", q30, "%", judged(q30, q30 >= 80, q30 >= 50, ("good", "review", "low"))),
        ("duplicate_reads", F.col("duplicates"), "reads", none),
        ("duplicate_reads_percent", dup, "%", judged(dup, dup <= 10, dup <= 30, ("low", "review", "high"))),
        ("overrepresented_sequence_count", F.col("repeated"), "sequences", none),
        ("quality_encoding_assumption", F.lit("Phred+33"), "", F.lit("assumed, as current sequencers write it")),
        ("quality_ascii_range", F.concat_ws("-", (F.col("q_min") + 33).cast("string"), (F.col("q_max") + 33).cast("string")), "ASCII", none),
    ]
    cells = [
        F.struct(F.lit(metric).alias("metric"), value.cast("string").alias("value"), F.lit(unit).alias("unit"), assessment.alias("assessment"))
        for metric, value, unit, assessment in rows
        if whole or metric not in NOT_MERGEABLE
    ]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def per_base_profile(reads: DataFrame) -> DataFrame:
    """Quality quartiles and base shares per cycle, from counts of (cycle, score, base)."""
    length = F.least(F.length("sequence"), F.length("quality"))
    cut = reads.select(F.split(F.upper(F.col("sequence").substr(F.lit(1), length)), "").alias("b"), F.split(F.col("quality").substr(F.lit(1), length), "").alias("q"))
    cells = cut.select(F.posexplode(F.arrays_zip("b", "q")).alias("i", "c")).filter("c.q <> ''")
    base = F.when(F.col("c.b") == "U", "T").when(F.col("c.b").isin(*"ACGTN"), F.col("c.b")).otherwise("other")
    counts = cells.groupBy(
        (F.col("i") + 1).cast("bigint").alias("position"), (F.ascii("c.q") - 33).cast("double").alias("score"), base.alias("base")
    ).agg(F.count(F.lit(1)).alias("w"))
    ladder = value_ladder(counts, "score", ["position"], "w")
    quarters = ladder_quantiles(ladder, "score", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["position"])
    total = F.sum("w")
    share = lambda b: F.round(F.sum(F.when(F.col("base") == b, F.col("w")).otherwise(0)) / total * 100, 2).alias(f"{b.lower()}_percent")
    sums = counts.groupBy("position").agg(
        total.alias("read_count"), F.round(F.sum(F.col("score") * F.col("w")) / total, 3).alias("mean_quality"), *[share(b) for b in ("A", "C", "G", "T", "N", "other")]
    )
    return sums.join(quarters, "position").select(
        "position", "read_count", "mean_quality", F.round("q25", 3).alias("q25_quality"), F.round("q50", 3).alias("median_quality"), F.round("q75", 3).alias("q75_quality"),
        "a_percent", "c_percent", "g_percent", "t_percent", "n_percent", "other_percent",
    )


def length_distribution(reads: DataFrame) -> DataFrame:
    total = reads.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = reads.groupBy(F.length("sequence").cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("percent", F.round(F.col("count") / total * 100, 2))


def binned_distribution(reads: DataFrame, metric: str, *, low: int = 0, high: int = 100, step: int = 10) -> DataFrame:
    """Reads per fixed-width bin of ``gc_percent``, ``n_percent`` or ``mean_quality``; the top bin is closed."""
    bins = -(-(high - low) // step)
    value = F.greatest(F.lit(low), F.least(F.lit(high), F.col(metric)))
    place = F.least(F.lit(bins - 1), F.floor((value - low) / step)).cast("bigint")
    metrics = read_metrics(reads)
    counts = metrics.groupBy(place.alias("i")).agg(F.count(F.lit(1)).alias("count"))
    total = F.greatest(F.lit(1), reads.agg(F.count(F.lit(1)).alias("n")).scalar())
    start, end = F.col("i") * step + low, F.least(F.lit(high), (F.col("i") + 1) * step + low)
    label = F.concat(start.cast("string"), F.lit("-"), F.when(end == high, end).otherwise(end - 1).cast("string"))
    count = F.coalesce("count", F.lit(0).cast("bigint"))
    return reads.sparkSession.range(bins).withColumnRenamed("id", "i").join(counts, "i", "left").select(
        label.alias("bin"), count.alias("count"), F.round(count / total * 100, 2).alias("percent")
    )


def trim_tail(reads: DataFrame, cutoff: int = 20, window: int = 4) -> DataFrame:
    """Cut the 3' tail: the read ends with the last window of ``window`` bases whose mean quality reaches ``cutoff``."""
    scored = compute_once(reads, __q=quality_scores(F.col("quality")))
    length = F.size("__q")
    width = F.least(F.lit(window), length)
    mean_of = lambda e: sum_scores(F.slice("__q", e - width + 1, width)) / width
    ends = F.when(length > 0, F.filter(F.sequence(width, length), lambda e: mean_of(e) >= cutoff)).otherwise(F.array().cast("array<int>"))
    cut = compute_once(scored, __keep=F.coalesce(F.array_max(ends), F.lit(0)))
    short = lambda c: F.col(c).substr(F.lit(1), F.col("__keep"))
    return compute_once(cut, sequence=short("sequence"), quality=short("quality")).select(*reads.columns)


def filter_reads(
    reads: DataFrame, *, quality_cutoff: int = 20, max_low_quality_percent: float = 40.0, minimum_length: int = 30, maximum_n: int = 5,
    trim_tail_low_quality: bool = True, keep_failed: bool = False,
) -> DataFrame:
    """Trim, then keep reads by length, low-quality share and N count; ``reason`` tells why a read failed."""
    out = trim_tail(reads, quality_cutoff) if trim_tail_low_quality else reads
    scores = quality_scores(F.col("quality"))
    low = F.size(F.filter(scores, lambda s: s < quality_cutoff))
    share = F.when(F.length("quality") > 0, low / F.length("quality") * 100).otherwise(0.0)
    reason = (
        F.when(F.length("sequence") < minimum_length, "too_short").when(count_symbol(F.upper("sequence"), "N") > maximum_n, "too_many_n")
        .when(share > max_low_quality_percent, "low_quality").otherwise("passed")
    )
    judged = compute_once(out, reason=reason)
    return judged if keep_failed else judged.filter("reason = 'passed'").drop("reason")


def filter_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Reads, bases, Q30 and GC before and after filtering."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return read_metrics(df).agg(
            F.lit(name).alias("stage"), F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum("length"), F.lit(0).cast("bigint")).alias("bases"),
            F.round(F.sum("q30") / F.sum("q_count") * 100, 3).alias("q30_percent"), F.round(F.sum("gc") / F.sum("length") * 100, 3).alias("gc_percent"),
        )

    return side(before, "before").unionByName(side(after, "after"))


def sample_reads(reads: DataFrame, n: int, seed: int, key: str, mates: DataFrame | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Exactly ``n`` reads (or pairs); mates share ``key`` and stay together."""
    if mates is None:
        return sample_rows(reads, n, seed, [key])
    chosen = sample_rows(reads.select(key).join(mates.select(key), key, "left_semi"), n, seed, [key])
    return reads.join(chosen, key, "left_semi"), mates.join(chosen, key, "left_semi")
