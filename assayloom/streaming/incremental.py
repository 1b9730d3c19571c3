"""Filters and summaries over files as they land, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.operators.alignments import typed_alignments
from assayloom.operators.reads import READ_COUNTERS, read_counters, read_metrics, summary_rows
from assayloom.operators.variants import typed_variants
from assayloom.sources.genomics import sam_rows, vcf_rows
from assayloom.sources.lines import located_lines
from assayloom.sources.sequences import fastq_reads


REFERENCE_COUNTERS = {"alignments": "sum", "mapped_alignments": "sum", "mapq_sum": "sum", "covered_min": "min", "covered_max": "max"}
READ_TOTALS = {"reads": "sum", "bases": "sum", "gc": "sum", "shortest": "min", "longest": "max"}


def stream_lines(spark: SparkSession, folder: str, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select(F.regexp_replace("value", "\r$", "").alias("line"))


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, *, delimiter: str = "\t", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("csv").schema(schema).option("sep", delimiter).option("header", True).option("quote", '"').option("escape", '"')
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def stream_vcf(spark: SparkSession, folder: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Typed variants of the VCF files that land in ``folder``; every variant filter works on them row by row."""
    return typed_variants(vcf_rows(stream_lines(spark, folder, files_per_trigger=files_per_trigger)))


def stream_sam(spark: SparkSession, folder: str, *, files_per_trigger: int | None = None) -> DataFrame:
    return sam_rows(stream_lines(spark, folder, files_per_trigger=files_per_trigger))


def stream_reference_stats(sam: DataFrame, target: str, checkpoint: str) -> None:
    """Keep counts, quality sums and covered ends per reference up to date; ``merged_reference_stats`` reads them."""
    rows = typed_alignments(sam).filter((F.col("rname") != "*") & (F.col("rname") != ""))
    only = lambda c: F.when(F.col("mapped"), F.col(c))
    parts = {
        "alignments": F.count(F.lit(1)), "mapped_alignments": F.count(only("pos")), "mapq_sum": F.sum(only("mapq")), "covered_min": F.min(only("pos")), "covered_max": F.max(only("end")),
    }
    run_summary(rows.withColumnRenamed("rname", "reference"), ["reference"], parts, target, checkpoint, merge=REFERENCE_COUNTERS)


def merged_reference_stats(spark: SparkSession, target: str) -> DataFrame:
    merged = merged_summary(spark, target, ["reference"], REFERENCE_COUNTERS)
    return merged.withColumn("mean_mapq", F.round(F.col("mapq_sum") / F.nullif("mapped_alignments", F.lit(0)), 3)).drop("mapq_sum")


def stream_read_totals(reads: DataFrame, target: str, checkpoint: str) -> None:
    """Keep read counters of landing reads (``sequence``, ``quality``) up to date; ``merged_read_totals`` reads them."""
    gc = F.length(F.regexp_replace("sequence", "[^GCgc]", ""))
    parts = {"reads": F.count(F.lit(1)), "bases": F.sum(F.length("sequence")), "gc": F.sum(gc), "shortest": F.min(F.length("sequence")), "longest": F.max(F.length("sequence"))}
    run_summary(reads.withColumn("all", F.lit("all")), ["all"], parts, target, checkpoint, merge=READ_TOTALS)


def merged_read_totals(spark: SparkSession, target: str) -> DataFrame:
    merged = merged_summary(spark, target, ["all"], READ_TOTALS)
    return merged.withColumn("gc_percent", F.round(F.col("gc") / F.nullif("bases", F.lit(0)) * 100, 3)).drop("all", "gc")


def run_filter(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Apply any row-wise operator to all files that have landed and append the result as parquet. Safe to rerun: files already done are skipped."""
    query = transform(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()


def stream_fastq(spark: SparkSession, folder: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of landing FASTQ files with their places, for ``stream_fastq_summary``. A file has landed whole, so its reads are framed in its batch."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return located_lines(reader.load(folder))


def stream_fastq_summary(lines: DataFrame, target: str, checkpoint: str, *, fold_every: int = 16) -> None:
    """Keep the read counters of landing FASTQ files up to date; ``merged_fastq_summary`` reads them."""
    run_summary(lines, [], read_counters(), target, checkpoint, prepare=lambda batch: read_metrics(fastq_reads(batch)), merge=READ_COUNTERS, fold_every=fold_every)


def merged_fastq_summary(spark: SparkSession, target: str) -> DataFrame:
    """The rows of ``fastq_summary`` that sums of parts can give: all but medians and duplicates."""
    return summary_rows(merged_summary(spark, target, [], READ_COUNTERS))


def run_summary(
    stream: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], target: str, checkpoint: str, *,
    prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch, merge: dict[str, str] | None = None, fold_every: int = 16,
) -> None:
    """Keep mergeable group sums up to date.

    Each batch is aggregated first and appended as partial sums under its batch id; a batch that is run
    again after a failure replaces its own part. ``merged_summary`` adds the parts. With ``merge``, each
    ``fold_every``-th batch also takes up all parts since the last such batch, and parts before that one are
    removed, so that fewer than twice ``fold_every`` parts are ever there; what a rerun of the batch reads stays.
    """
    if fold_every < 2:
        raise ValueError("fold_every must be 2 or more")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        partial = prepare(batch).groupBy(*keys).agg(*[expression.alias(name) for name, expression in aggregates.items()])
        fold = merge is not None and (batch_id + 1) % fold_every == 0
        if fold:
            both = _parts(spark, target, batch_id).select(*partial.columns).unionByName(partial)
            types = {f.name: f.dataType for f in partial.schema}
            partial = _combined(both, keys, merge).select(*[F.col(c).cast(types[c]).alias(c) for c in partial.columns])
        partial.withColumn("folded", F.lit(fold)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if fold:
            path = spark._jvm.org.apache.hadoop.fs.Path
            files = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
            for old in range(max(0, batch_id - 2 * fold_every), batch_id - fold_every):
                files.delete(path(f"{target}/batch={old}"), True)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _parts(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """Parts from the last folded one on; with ``before``, as they were before that batch, which may have left a part already."""
    parts = spark.read.parquet(target)
    if before is not None:
        parts = parts.filter(F.col("batch") < before)
    last = parts.filter("folded").agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("batch"))
    return parts.filter(F.col("batch") >= last.scalar())


def _combined(parts: DataFrame, keys: Sequence[str], merge: dict[str, str]) -> DataFrame:
    combine = {"sum": F.sum, "min": F.min, "max": F.max}
    return parts.groupBy(*keys).agg(*[combine[how](name).alias(name) for name, how in merge.items()])


def merged_summary(spark: SparkSession, target: str, keys: Sequence[str], merge: dict[str, str]) -> DataFrame:
    """Add up the partial sums; ``merge`` maps each column to ``sum``, ``min`` or ``max``."""
    return _combined(_parts(spark, target), keys, merge)
