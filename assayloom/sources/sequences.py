"""FASTA, FASTQ and annotated flat files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators.once import compute_once, explode_once
from assayloom.sources.lines import line_groups, located_lines


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(title, sequence, id, length)``, one row per record. Records are split at the line breaks before ``>``, so large files are read in parallel."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "\r", "").alias("text"))
    parted = raw.select(F.regexp_replace("text", r"^>", "").alias("text"), F.col("text").startswith(">").alias("marked"))
    title = F.trim(F.substring_index("text", "\n", 1))
    body = F.when(F.instr("text", "\n") > 0, F.col("text").substr(F.instr("text", "\n") + 1, F.length("text"))).otherwise("")
    rows = compute_once(parted.filter(F.trim("text") != ""), title=title, sequence=F.regexp_replace(body, r"\s+", ""))
    return rows.select(
        "title", "sequence", F.regexp_extract("title", r"^(\S+)", 1).alias("id"), F.length("sequence").cast("bigint").alias("length")
    )


def read_fasta_checked(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records as ``read_fasta`` gives them, with ``sequence_lines`` and ``format_issues`` for ``duplicate_census``.

    Issues come in the order of the lines: missing title, blanks after ``>``, then each blank sequence
    line and each with a blank in it, then an empty sequence. A file's last line end is no blank line.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "\r", "").alias("text"))
    parted = raw.filter(F.trim("text") != "").select(F.regexp_replace("text", r"^>", "").alias("text"))
    head = F.substring_index("text", "\n", 1)
    rest = F.when(F.instr("text", "\n") > 0, F.regexp_replace(F.col("text").substr(F.instr("text", "\n") + 1, F.length("text")), r"\n\z", ""))
    held = compute_once(parted, head=head, lines=F.when(F.length(rest) > 0, F.split(rest, "\n")).otherwise(F.array().cast("array<string>")))
    ends_trimmed = F.transform("lines", lambda x: F.regexp_replace(x, r"\s+$", ""))
    by_line = F.transform(ends_trimmed, lambda x: F.when(x == "", "blank sequence line").when(x.rlike(r"\s"), "sequence line contains whitespace"))
    sequence = F.regexp_replace(F.array_join("lines", ""), r"\s+", "")
    rows = compute_once(held.select("head", "lines"), title=F.trim("head"), sequence=sequence, by_line=F.array_compact(by_line), sequence_lines=F.size(F.filter(ends_trimmed, lambda x: x != "")).cast("bigint"))
    issues = F.concat(
        F.array_compact(F.array(F.when(F.col("title") == "", "missing title"), F.when(F.col("head").rlike(r"^\s"), "header has leading whitespace after >"))),
        "by_line", F.array_compact(F.array(F.when(F.col("sequence") == "", "empty sequence"))),
    )
    return rows.select("title", "sequence", "sequence_lines", F.length("sequence").cast("bigint").alias("length"), issues.alias("format_issues"))


def fasta_lines(df: DataFrame, title: str = "title", sequence: str = "sequence", width: int = 60) -> DataFrame:
    wrapped = F.regexp_replace(F.regexp_replace(F.col(sequence), f"(.{{{width}}})", "$1\n"), "\n$", "")
    return df.select(F.concat(F.lit(">"), F.col(title), F.lit("\n"), wrapped).alias("line"))


def write_fasta(df: DataFrame, path: str, *, title: str | None = None, sequence: str | None = None, width: int = 60, mode: str = "errorifexists") -> None:
    """Table to FASTA; the title and sequence columns are found by name when not given."""
    def find(given: str | None, names: tuple[str, ...]) -> str:
        if given:
            return given
        for name in names:
            for column in df.columns:
                if column.lower() == name:
                    return column
        raise ValueError(f"name the column: none of {names} is in {df.columns}")

    columns = find(title, ("title", "name", "id", "header")), find(sequence, ("sequence", "seq", "dna", "protein"))
    fasta_lines(df, *columns, width).write.mode(mode).text(path)


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Strict four-line reads with their place in the file: ``(file, read, title, sequence, plus, quality, issue)``.

    A quality line may begin with ``@``, so records are framed by line number, not by marks; empty lines do
    not count. When bases and qualities differ in number, both are cut to the shorter. A file's last record
    that has fewer than four lines stays, with what it has and the issue ``incomplete record``.
    """
    return fastq_reads(located_lines(spark.read.text(path)))


def fastq_reads(lines: DataFrame) -> DataFrame:
    """``read_fastq`` over ``located_lines``, such as a streaming batch of them."""
    reads = line_groups(lines, 4, skip_empty=True).toDF("file", "read", "head", "sequence", "plus", "quality")
    whole = F.col("quality").isNotNull()
    issue = F.concat_ws(
        "; ", F.when(~whole, "incomplete record"), F.when(~F.col("head").startswith("@"), "title without @"), F.when(~F.col("plus").startswith("+"), "third line without +"),
        F.when(F.length("sequence") != F.length("quality"), "length mismatch"),
    )
    size = F.least(F.length("sequence"), F.length("quality"))
    cut = lambda c: F.coalesce(F.when(whole, F.col(c).substr(F.lit(1), size)).otherwise(F.col(c)), F.lit("")).alias(c)
    return reads.select(
        "file", "read", F.regexp_replace("head", "^@", "").alias("title"), cut("sequence"), F.coalesce("plus", F.lit("")).alias("plus"), cut("quality"), issue.alias("issue")
    )


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat(F.lit("@"), "title", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality").alias("line"))


def write_fastq(reads: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    fastq_lines(reads).write.mode(mode).text(path)


# --- annotated flat files ----------------------------------------------------------------------

# The layout of a feature table (GenBank without, EMBL and UniProt with a leading FT).
FEATURE_BLOCK = r"(?m)^(?:     |FT   )(\S+ +\S[^\n]*(?:\n(?:                     |FT                   )[^\n]*)*)"
CONTINUATION = r"\n(?:FT)? +"


def read_flatfile(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Features of GenBank, EMBL and UniProt records, one row each. Records end at ``//``.

    A record is named by its VERSION, else its ACCESSION, else its LOCUS; by AC, else ID, in the other two.
    """
    records = spark.read.option("lineSep", "\n//").text(path).select(F.regexp_replace("value", "\r", "").alias("text")).filter(F.trim("text") != "")
    text = F.regexp_replace("text", r"^\s+", "")
    genbank = text.startswith("LOCUS")
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    key = lambda *patterns: F.coalesce(*[found(p) for p in patterns], F.lit(""))
    name = F.when(genbank, key(r"(?m)^VERSION\s+(\S+)", r"(?m)^ACCESSION\s+(\S+)", r"^LOCUS\s+(\S+)")).otherwise(key(r"(?m)^AC\s+([^\s;]+)", r"(?m)^ID\s+([^\s;]+)"))
    kind = F.when(genbank, "genbank").when(text.rlike(r"(?m)^ID[^\n]*\bBP\."), "embl").when(text.rlike(r"(?m)^ID[^\n]*\bAA\."), "uniprot").otherwise("unknown")
    named = compute_once(records, record=name, format=kind)
    features = explode_once(named, F.regexp_extract_all(F.col("text"), F.lit(FEATURE_BLOCK), F.lit(1)), "f", "record", "format")
    body = F.regexp_replace(F.regexp_replace("f", r"^\S+ +", ""), CONTINUATION, "\n")
    parts = compute_once(features.filter(~F.col("f").startswith("Location/Qualifiers")), feature=F.regexp_extract("f", r"^(\S+)", 1), body=body)
    located = compute_once(parts, location=F.regexp_replace(F.regexp_extract("body", r"(?s)^(.*?)(?:\n/|\z)", 1), r"\s+", ""))
    places = F.transform(F.regexp_extract_all(F.col("location"), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))

    def qualifier(key: str) -> Column:
        quoted = F.regexp_extract("body", rf'(?s)(?:^|\n)/{key}="((?:[^"]|"")*)"', 1)
        plain = F.regexp_extract("body", rf'(?:^|\n)/{key}=([^"\n]+)', 1)
        found = F.when(quoted != "", F.regexp_replace(quoted, r"\s+", " ")).otherwise(plain)
        return F.when(found != "", found)

    forward = F.regexp_replace("location", r"complement\((?:[^()]|\([^()]*\))*\)", "").rlike(r"\d")
    turned = F.col("location").contains("complement")
    return located.filter(F.size(places) > 0).select(
        "record", "format", "feature", F.array_min(places).alias("start"), F.array_max(places).alias("end"),
        F.when(turned & forward, "mixed").when(turned, "-").otherwise("+").alias("strand"), F.col("location").rlike("[<>]").alias("partial"), "location",
        *[qualifier(q).alias(q) for q in ("gene", "locus_tag", "product", "protein_id")],
        F.length(F.regexp_replace(qualifier("translation"), r"\s", "")).cast("bigint").alias("translation_length"),
    )
