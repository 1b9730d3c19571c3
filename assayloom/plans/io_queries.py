"""Queries for readers, writers and streams: tables go out as text to the shared folder and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.operators import variants as va
from assayloom.operators.cleaning import filter_rows
from assayloom.plans import fixtures as fx
from assayloom.plans.hts_queries import summary_sql
from assayloom.plans.registry import Tables, query
from assayloom.session import shared_folder, shuffle_width
from assayloom.sources import genomics as ge
from assayloom.sources import sequences as se
from assayloom.sources import tables as ta
from assayloom.sources.lines import numbered_lines, read_lines
from assayloom.streaming import incremental as inc


def _write(df: DataFrame, purpose: str, *, gzip: bool = False) -> str:
    path = shared_folder(df.sparkSession, purpose)
    df.select("line").write.text(path, compression="gzip" if gzip else None)
    return path


MESSY_OUT = """SELECT sample_id, trim(name) AS name, nullif(trim(segment), '') AS segment, nullif(balance, '') AS balance, cast(NULL as varchar) AS notes FROM messy"""


@query("S1_read_delimited", f"WITH {fx.MESSY} {MESSY_OUT}")
def _s1(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "delimited")
    ta.write_delimited(fx.messy_customers(t), path, delimiter=";")
    df = ta.read_delimited(t.spark, path)
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c)).alias(c)
    return df.select(*[blank(c) for c in df.columns])


@query("S2_read_json", "SELECT cast(event_id as varchar) AS event_id, cast(user_id as varchar) AS user_id, event_type, '{\"event\":\"' || event_type || '\",\"user\":' || user_id || '}' AS detail FROM events")
def _s2(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "json")
    nested = t.events.select("event_id", "user_id", "event_type", F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("user")).alias("detail"))
    ta.write_json(nested, path)
    return ta.read_json_table(t.spark, path, json_lines=True).select("event_id", "user_id", "event_type", "detail")


@query("S3_read_gzip_lines", "SELECT unnest(string_split(text, chr(10))) AS line FROM documents")
def _s3(t: Tables) -> DataFrame:
    return read_lines(t.spark, _write(t.documents.select(F.regexp_replace("text", "\n", "\r\n").alias("line")), "gzip", gzip=True), spread=shuffle_width(t.spark))


@query("S3_numbered_lines", "SELECT l_suppkey AS supplier, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS n, l_orderkey || '-' || l_linenumber AS line FROM lineitem")
def _s3b(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "numbered")
    text = F.concat_ws("-", "l_suppkey", "l_orderkey", "l_linenumber").alias("line")
    # Each supplier lies in one file, in one piece: its numbers count on from the first of them. So there are as many files as tasks.
    t.lineitem.repartition("l_suppkey").sortWithinPartitions("l_suppkey", "l_orderkey", "l_linenumber").select(text).write.text(path)
    lines = numbered_lines(t.spark, path).select(
        F.substring_index("line", "-", 1).cast("bigint").alias("supplier"), "n", F.regexp_replace("line", "^[^-]*-", "").alias("line")
    )
    first = F.min("n").over(Window.partitionBy("supplier"))
    return lines.select("supplier", (F.col("n") - first).alias("n"), "line")


@query("S4_read_fasta", f"WITH {fx.SEQS} SELECT title, sequence, string_split(title, ' ')[1] AS id, length(sequence) AS length FROM seqs")
def _s4(t: Tables) -> DataFrame:
    return se.read_fasta(t.spark, _write(se.fasta_lines(fx.sequences(t)), "fasta"))


@query(
    "S5_write_fasta",
    f"""WITH {fx.SEQS}, x AS (SELECT '>' || title || chr(10) || substr(sequence, 1, 50) || chr(10) || substr(sequence, 51, 50) || chr(10) || substr(sequence, 101) AS r FROM seqs) SELECT unnest(string_split(r, chr(10))) AS line FROM x""",
)
def _s5(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "fasta-out")
    se.write_fasta(fx.sequences(t), path, width=50)
    return read_lines(t.spark, path)


@query(
    "S6_read_fastq",
    f"""WITH {fx.READS} SELECT title, sequence, plus, quality, '' AS issue FROM reads
    UNION ALL SELECT 'cut' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'ACGT' ELSE '' END, '', '', 'incomplete record' FROM nation""",
)
def _s6(t: Tables) -> DataFrame:
    """Reads with empty lines around and inside them, and a file per nation that ends early."""
    path = shared_folder(t.spark, "fastq")
    loose = se.fastq_lines(fx.reads(t)).select(F.concat(F.lit("\n"), F.regexp_replace("line", "\n\\+\n", "\n\n+\n"), F.lit("\n")).alias("line"))
    loose.write.text(f"{path}/whole")
    cut = F.concat(F.lit("@cut"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "\nACGT").otherwise(""))
    t.nation.select("n_nationkey", cut.alias("line")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(f"{path}/cut")
    whole, early = se.read_fastq(t.spark, f"{path}/whole"), se.read_fastq(t.spark, f"{path}/cut")
    return whole.unionByName(early).drop("file", "read")


@query("S7_read_vcf", f"""WITH {fx.VARIANTS} SELECT chrom, cast(pos as varchar) AS pos, coalesce(id, '.') AS id, ref, alt, coalesce(cast(cast(qual as int) as varchar), '.') AS qual, "filter", info, 'GT:DP:GQ' AS format, array_to_string(sv, ' ') AS samples FROM vcf""")
def _s7(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "vcf")
    ge.write_vcf(fx.variant_lines(t), path, ["##fileformat=VCFv4.2", "##contig=<ID=chr1>"], fx.VCF_SAMPLES)
    rows = ge.read_vcf(t.spark, path)
    return rows.select(*[c for c in rows.columns if c != "sample_values"], F.array_join("sample_values", " ").alias("samples"))


@query("S8_read_sam", f"WITH {fx.ALIGNMENTS} SELECT qname, cast(flag as int) AS flag, rname, cast(pos as bigint) AS pos, cast(mapq as int) AS mapq, cigar, tags FROM aln")
def _s8(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "sam")
    ta.write_with_header(ge.sam_lines(fx.alignments(t)), ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:30000"], path)
    return ge.read_sam(t.spark, path).select("qname", "flag", "rname", "pos", "mapq", "cigar", "tags")


@query(
    "S9_read_mixed_folder",
    f"""WITH {fx.INTERVALS}, f AS (SELECT *, cast(substr(name, 5) as bigint) AS k FROM b)
    SELECT record, "start", "end", name, strand FROM a UNION ALL SELECT record, "start", "end", CASE WHEN k % 2 = 0 THEN 'name=' || k ELSE 'g' || k END, strand FROM f""",
)
def _s9c(t: Tables) -> DataFrame:
    """BED and GFF3 files in one folder."""
    path = shared_folder(t.spark, "mixed")
    ge.write_bed(fx.intervals_a(t), path)
    ge.write_gff(_features(t), path, mode="append")
    return ge.read_intervals(t.spark, path).drop("attributes", "source_set")


@query("S9_read_bed", f"""WITH {fx.INTERVALS} SELECT record, "start", "end", name, strand, 'a' AS source_set FROM a""")
def _s9(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "bed")
    ge.write_bed(fx.intervals_a(t), path)
    return ge.read_intervals(t.spark, path, source_set="a").drop("attributes")


@query(
    "S9_read_vcf_intervals",
    f"""WITH {fx.VARIANTS} SELECT chrom AS record, pos AS "start", pos + length(ref) - 1 AS "end", coalesce(id, concat_ws(':', chrom, pos, ref, alt)) AS name, '.' AS strand, 'query' AS source_set FROM vcf""",
)
def _s9b(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "vcf-intervals")
    ge.write_vcf(fx.variant_lines(t), path, ["##fileformat=VCFv4.2"], fx.VCF_SAMPLES)
    return ge.read_intervals(t.spark, path).drop("attributes")


def _features(t: Tables) -> DataFrame:
    b = fx.intervals_b(t)
    number = F.substring("name", 5, 20).cast("bigint")
    text = lambda p: F.concat(F.lit(p), number.cast("string"))
    return b.select(
        "record", F.lit("lab").alias("source"), F.when(number % 3 == 0, "gene").when(number % 3 == 1, "mRNA").otherwise("exon").alias("feature"), "start", "end", "strand", F.lit(None).cast("string").alias("phase"),
        text("id").alias("id"), F.when(number % 3 > 0, text("p;")).alias("parent"), F.when(number % 2 == 0, text("name=")).alias("name"), text("g").alias("gene_id"), F.lit(None).cast("string").alias("transcript_id"),
    )


@query(
    "S10_read_gff",
    f"""WITH {fx.INTERVALS}, f AS (SELECT *, cast(substr(name, 5) as bigint) AS k FROM b)
    SELECT record, CASE k % 3 WHEN 0 THEN 'gene' WHEN 1 THEN 'mRNA' ELSE 'exon' END AS feature, "start", "end", strand, '.' AS phase, 'id' || k AS id, CASE WHEN k % 3 > 0 THEN 'p;' || k END AS parent, 'g' || k AS gene_id,
      CASE WHEN k % 3 = 1 THEN 'id' || k END AS transcript_id, CASE WHEN k % 2 = 0 THEN 'name=' || k ELSE 'g' || k END AS name, "end" - "start" + 1 AS length, 'lab' AS source FROM f""",
)
def _s10(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "gff")
    ge.write_gff(_features(t), path)
    return ge.read_features(t.spark, path).drop("attributes")


@query(
    "S10_read_gtf",
    f"""WITH {fx.INTERVALS} SELECT record, 'exon' AS feature, "start", "end", strand, name || '.t1' AS transcript_id, name AS gene_id, name || '.t1' AS parent FROM b""",
)
def _s10b(t: Tables) -> DataFrame:
    b = fx.intervals_b(t)
    attributes = F.concat(F.lit('gene_id "'), "name", F.lit('"; transcript_id "'), "name", F.lit('.t1";'))
    lines = b.select(F.concat_ws("\t", "record", F.lit("lab"), F.lit("exon"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attributes).alias("line"))
    return ge.read_features(t.spark, _write(lines, "gtf"), types=["Exon"]).select("record", "feature", "start", "end", "strand", "transcript_id", "gene_id", "parent")


@query(
    "S11_read_paf",
    """SELECT 'q' || l_orderkey AS comparison, cast(500000 as bigint) AS comparison_length, l_orderkey AS comparison_start, l_orderkey + cast(l_quantity as bigint) AS comparison_end, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, 'r' || l_suppkey AS reference,
      cast(900000 as bigint) AS reference_length, l_partkey AS reference_start, l_partkey + cast(l_quantity as bigint) AS reference_end, cast(l_linenumber as bigint) AS matches, cast(l_quantity as bigint) + 7 AS block_length, round(l_linenumber / (cast(l_quantity as bigint) + 7) * 100, 6) AS identity, l_partkey % 61 AS mapq FROM lineitem""",
)
def _s11(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("bigint")
    cells = [
        F.concat(F.lit("q"), F.col("l_orderkey").cast("string")), F.lit("500000"), F.col("l_orderkey"), F.col("l_orderkey") + q, F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+"),
        F.concat(F.lit("r"), F.col("l_suppkey").cast("string")), F.lit("900000"), F.col("l_partkey"), F.col("l_partkey") + q, F.col("l_linenumber"), q + 7, F.col("l_partkey") % 61,
    ]
    lines = t.lineitem.select(F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("line"))
    return ge.read_paf(t.spark, _write(lines, "paf")).withColumn("identity", F.round("identity", 6))


@query("S12_write_markdown", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation UNION ALL SELECT '| n_nationkey | n_name | n_regionkey |' UNION ALL SELECT '| --- | --- | --- |'")
def _s12(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "markdown")
    ta.write_markdown(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path)
    return read_lines(t.spark, path)


@query("S13_write_bed", f"""WITH {fx.INTERVALS} SELECT concat_ws(chr(9), record, "start" - 1, "end", name, '0', strand) AS line FROM a""")
def _s13(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "bed-out")
    ge.write_bed(fx.intervals_a(t), path)
    return read_lines(t.spark, path)


def _flat_lines(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    text = k.cast("string")
    body = F.concat(
        F.lit("LOCUS       R"), text, F.lit("  900 bp DNA linear\n"), F.when(k % 2 == 0, F.concat(F.lit("VERSION     R"), text, F.lit(".1\n"))).otherwise(""), F.lit("FEATURES             Location/Qualifiers\n     gene            complement("), (k % 50 + 1).cast("string"), F.lit(".."), (k % 50 + 90).cast("string"),
        F.lit(')\n                     /gene="g'), text, F.lit('"\n                     /locus_tag="L'), text, F.lit('"\n     CDS             join(<1..'), (k % 70 + 30).cast("string"), F.lit(",200..\n                     "), (k % 90 + 300).cast("string"),
        F.lit(')\n                     /product="'), F.col("p_name"), F.lit(' protein\n                     long name"\n                     /translation="MKV\n                     LLA"\nORIGIN\n        1 acgt\n//'),
    )
    return t.part.select(body.alias("line"))


@query(
    "S14_read_flatfile",
    """SELECT 'R' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.1' ELSE '' END AS record, 'genbank' AS format, 'gene' AS feature, p_partkey % 50 + 1 AS "start", p_partkey % 50 + 90 AS "end", '-' AS strand, false AS partial, 'complement(' || (p_partkey % 50 + 1) || '..' || (p_partkey % 50 + 90) || ')' AS location,
      'g' || p_partkey AS gene, 'L' || p_partkey AS locus_tag, NULL AS product, cast(NULL as varchar) AS protein_id, cast(NULL as bigint) AS translation_length FROM part
    UNION ALL SELECT 'R' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.1' ELSE '' END, 'genbank', 'CDS', 1, p_partkey % 90 + 300, '+', true, 'join(<1..' || (p_partkey % 70 + 30) || ',200..' || (p_partkey % 90 + 300) || ')', NULL, NULL, p_name || ' protein long name', NULL, 6 FROM part""",
)
def _s14(t: Tables) -> DataFrame:
    return se.read_flatfile(t.spark, _write(_flat_lines(t), "flatfile"))


# --- streams -----------------------------------------------------------------------------------

EVENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("event_id", "user_id", "event_type", "value")])


def _share(t: Tables, batches: int) -> int:
    """Files a batch when as many files land as a shuffle has tasks."""
    return -(-shuffle_width(t.spark) // batches)


def _landed(t: Tables) -> str:
    path = shared_folder(t.spark, "landing")
    ta.write_delimited(t.events.select("event_id", "user_id", "event_type", "value").repartition(shuffle_width(t.spark)), path)
    return path


@query("R1_stream_filter", "SELECT cast(event_id as varchar) AS event_id, cast(user_id as varchar) AS user_id, event_type, cast(value as varchar) AS value FROM events WHERE value > 50 AND contains(event_type, 'i')")
def _r1(t: Tables) -> DataFrame:
    stream = inc.stream_table(t.spark, _landed(t), EVENT_SCHEMA, files_per_trigger=_share(t, 2))
    target = shared_folder(t.spark, "filtered")
    inc.run_filter(stream, lambda df: filter_rows(df, [("value", "gt", 50), ("event_type", "contains", "I")]), target, shared_folder(t.spark, "state"))
    return t.spark.read.schema(EVENT_SCHEMA).parquet(target)


@query(
    "R1_stream_vcf_filter",
    f"""WITH {fx.VARIANTS} SELECT chrom, pos, ref, alt, "filter" FROM vcf WHERE "filter" IN ('PASS', '.') AND qual >= 10 AND length(ref) = 1 AND length(alt) = 1 AND NOT contains(alt, ',')""",
)
def _r1b(t: Tables) -> DataFrame:
    """Site and class filters over VCF files as they land."""
    path, target = shared_folder(t.spark, "landing-vcf"), shared_folder(t.spark, "filtered-vcf")
    ge.write_vcf(fx.variant_lines(t).repartition(shuffle_width(t.spark)), path, ["##fileformat=VCFv4.2"], fx.VCF_SAMPLES)
    keep = lambda df: va.filter_sites(df, filter_status="pass", min_qual=10, variant="snv").select("chrom", "pos", "ref", "alt", "filter")
    inc.run_filter(inc.stream_vcf(t.spark, path, files_per_trigger=_share(t, 2)), keep, target, shared_folder(t.spark, "state"))
    return t.spark.read.parquet(target)


@query(
    "R2_stream_reference_stats",
    f"""WITH {fx.ALIGNMENTS}, m AS (SELECT *, flag & 4 = 0 AND rname <> '*' AND pos > 0 AND cigar <> '*' AS mapped, list_sum(list_transform(regexp_extract_all(cigar, '[0-9]+[M=XDN]'), lambda x: cast(left(x, -1) as bigint))) AS span FROM aln)
    SELECT rname AS reference, count(*) AS alignments, count(*) FILTER (mapped) AS mapped_alignments, round(avg(mapq) FILTER (mapped), 3) AS mean_mapq, cast(min(pos) FILTER (mapped) as bigint) AS covered_min, cast(max(pos + span - 1) FILTER (mapped) as bigint) AS covered_max
    FROM m WHERE rname <> '*' GROUP BY 1""",
)
def _r2b(t: Tables) -> DataFrame:
    """Reference counters over SAM files as they land, a third of them a batch."""
    path, target = shared_folder(t.spark, "landing-sam"), shared_folder(t.spark, "stats")
    ge.sam_lines(fx.alignments(t)).repartition(shuffle_width(t.spark)).write.text(path)
    inc.stream_reference_stats(inc.stream_sam(t.spark, path, files_per_trigger=_share(t, 3)), target, shared_folder(t.spark, "state"))
    return inc.merged_reference_stats(t.spark, target)


@query(
    "R2_stream_read_totals",
    f"""WITH {fx.READS} SELECT count(*) AS reads, cast(sum(length(sequence)) as bigint) AS bases, cast(min(length(sequence)) as bigint) AS shortest, cast(max(length(sequence)) as bigint) AS longest,
      round(sum(length(regexp_replace(sequence, '[^GC]', '', 'g'))) / sum(length(sequence)) * 100, 3) AS gc_percent FROM reads""",
)
def _r2c(t: Tables) -> DataFrame:
    path, target = shared_folder(t.spark, "landing-reads"), shared_folder(t.spark, "totals")
    ta.write_delimited(fx.reads(t).select("sequence", "quality").repartition(shuffle_width(t.spark)), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("sequence", "quality")])
    inc.stream_read_totals(inc.stream_table(t.spark, path, schema, files_per_trigger=_share(t, 3)), target, shared_folder(t.spark, "state"))
    totals = inc.merged_read_totals(t.spark, target)
    return totals.select("reads", "bases", F.col("shortest").cast("bigint").alias("shortest"), F.col("longest").cast("bigint").alias("longest"), "gc_percent")


@query("R2_stream_fastq_summary", f"SELECT * FROM ({summary_sql()}) WHERE metric NOT LIKE 'median%' AND metric NOT LIKE 'duplicate%' AND metric <> 'overrepresented_sequence_count'")
def _r2d(t: Tables) -> DataFrame:
    """Read counters over FASTQ files as they land, a third of them a batch, parts folded in every second batch."""
    path, target = shared_folder(t.spark, "landing-fastq"), shared_folder(t.spark, "counters")
    se.fastq_lines(fx.reads(t)).repartition(shuffle_width(t.spark)).write.text(path)
    inc.stream_fastq_summary(inc.stream_fastq(t.spark, path, files_per_trigger=_share(t, 3)), target, shared_folder(t.spark, "state"), fold_every=2)
    return inc.merged_fastq_summary(t.spark, target)


@query("R2_stream_summary", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def _r2(t: Tables) -> DataFrame:
    stream = inc.stream_table(t.spark, _landed(t), EVENT_SCHEMA, files_per_trigger=_share(t, 4))
    target = shared_folder(t.spark, "summary")
    number = F.col("value").try_cast("double")
    inc.run_summary(stream, ["event_type"], {"n": F.count(F.lit(1)), "total": F.sum(number), "low": F.min(number), "high": F.max(number)}, target, shared_folder(t.spark, "state"))
    merged = inc.merged_summary(t.spark, target, ["event_type"], {"n": "sum", "total": "sum", "low": "min", "high": "max"})
    return merged.withColumn("total", F.round("total", 4))
