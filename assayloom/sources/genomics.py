"""VCF, SAM, BED, GFF3, GTF and PAF text in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.hts import gff_attributes, gtf_attributes, info_values
from assayloom.operators.once import compute_once
from assayloom.sources.lines import read_lines
from assayloom.sources.tables import write_with_header


def _fields(lines: DataFrame, *keep: str, comment: str = "#") -> DataFrame:
    """Tab-separated data lines as an array ``f``."""
    data = lines.filter((F.trim("line") != "") & ~F.col("line").startswith(comment))
    return data.select(*keep, F.split("line", "\t").alias("f"))


def _field(i: int) -> Column:
    return F.try_element_at("f", F.lit(i))


def _long(i: int) -> Column:
    return _field(i).try_cast("bigint")


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """VCF columns as text, ``sample_values`` as an array. See ``typed_variants`` for typed ones."""
    return vcf_rows(read_lines(spark, path))


def vcf_rows(lines: DataFrame) -> DataFrame:
    rows = _fields(lines).filter((F.size("f") >= 8) & _long(2).isNotNull())
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]
    return rows.select(
        *[_field(i).alias(c) for i, c in enumerate(names, 1)],
        F.when(F.size("f") > 9, F.slice("f", F.lit(10), F.greatest(F.size("f") - 9, F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("sample_values"),
    )


def vcf_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_lines(spark, path).filter(F.col("line").startswith("#"))


def write_vcf(variants: DataFrame, path: str, header: Sequence[str], samples: Sequence[str] = (), *, mode: str = "errorifexists") -> None:
    """Header lines, the column line, then variants with their sample columns."""
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    write_with_header(vcf_lines(variants, bool(samples)), [*header, "\t".join(columns)], path, mode=mode)


def vcf_lines(variants: DataFrame, with_samples: bool = True) -> DataFrame:
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    cells = [F.col("chrom"), F.col("pos").cast("string"), *[dot(c) for c in ("id", "ref", "alt", "qual", "filter", "info")]]
    if with_samples:
        cells += [dot("format"), F.array_join("sample_values", "\t")]
    return variants.select(F.concat_ws("\t", *cells).alias("line"))


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The eleven SAM fields and the optional ones as tab-separated ``tags``."""
    return sam_rows(read_lines(spark, path))


def sam_rows(lines: DataFrame) -> DataFrame:
    rows = _fields(lines, comment="@").filter(F.size("f") >= 11)
    return rows.select(
        _field(1).alias("qname"), F.coalesce(_field(2).try_cast("int"), F.lit(0)).alias("flag"), _field(3).alias("rname"), F.coalesce(_long(4), F.lit(0)).alias("pos"),
        F.coalesce(_field(5).try_cast("int"), F.lit(0)).alias("mapq"), _field(6).alias("cigar"), _field(7).alias("rnext"), _long(8).alias("pnext"), _long(9).alias("tlen"),
        _field(10).alias("seq"), _field(11).alias("qual"), F.array_join(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), "\t").alias("tags"),
    )


def sam_references(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(reference, length)`` of the ``@SQ`` lines."""
    heads = read_lines(spark, path).filter(F.col("line").startswith("@SQ\t"))
    return heads.select(F.regexp_extract("line", r"\tSN:([^\t]+)", 1).alias("reference"), F.regexp_extract("line", r"\tLN:(\d+)", 1).try_cast("bigint").alias("length"))


def sam_lines(alignments: DataFrame) -> DataFrame:
    cells = [F.col("qname"), F.col("flag").cast("string"), F.col("rname"), F.col("pos").cast("string"), F.col("mapq").cast("string"), F.col("cigar"), F.lit("*\t0\t0\t*\t*"), F.col("tags")]
    return alignments.select(F.concat_ws("\t", *cells).alias("line"))


# --- intervals ---------------------------------------------------------------------------------

def line_format(line: Column) -> Column:
    """``vcf``, ``gtf``, ``gff`` or ``bed``, by the fields of the line itself; null for comments and blank lines."""
    f = F.split(line, "\t")
    whole = lambda i: F.coalesce(F.get(f, F.lit(i)).rlike(r"^\d+$"), F.lit(False))
    notes = F.get(f, F.lit(8))
    feature = (F.size(f) >= 9) & whole(3) & whole(4)
    gtf = notes.contains('"') & ~F.substring_index(notes, '"', 1).contains("=")
    # An identifier may be all digits; bases, alleles and a quality then tell a variant from a BED row.
    fits = lambda i, pattern: F.coalesce(F.get(f, F.lit(i)).rlike(pattern), F.lit(False))
    alleles = fits(3, r"(?i)^[ACGTUN]+$") & fits(4, r"(?i)^([ACGTUN*]+|\.|<[^>]+>)(,([ACGTUN*]+|<[^>]+>))*$") & fits(5, r"^(\.|\d+(\.\d+)?([eE][-+]?\d+)?)$") & ~whole(6)
    kind = F.when(feature & gtf, "gtf").when(feature, "gff").when((F.size(f) >= 8) & whole(1) & (~whole(2) | alleles), "vcf").otherwise("bed")
    return F.when((F.trim(line) != "") & ~line.startswith("#"), kind)


def _of_kind(lines: DataFrame, fmt: str, kinds: Sequence[str]) -> DataFrame:
    """Fields of data lines with their ``kind``: ``fmt``, or with ``auto`` what each line's own fields say."""
    if fmt not in ("auto", *kinds):
        raise ValueError(f"unknown format {fmt!r}: auto or one of {', '.join(kinds)}")
    kind = line_format(F.col("line")) if fmt == "auto" else F.lit(fmt)
    return _fields(compute_once(lines, kind=kind).filter(F.col("kind").isin(*kinds)), "kind")


def read_intervals(spark: SparkSession, path: str, *, fmt: str = "auto", source_set: str = "query") -> DataFrame:
    """BED, GFF3, GTF or VCF as 1-based inclusive intervals, in one scan; ``auto`` takes each line for what its own fields say."""
    kind = F.col("kind")
    rows = compute_once(_of_kind(read_lines(spark, path), fmt, ("bed", "gff", "gtf", "vcf")), attributes=_attributes())
    feature = _feature_columns()
    cell = lambda record, start, end, name, strand: F.struct(record.alias("record"), start.alias("start"), end.alias("end"), name.alias("name"), strand.alias("strand"))
    reach = F.coalesce(F.try_element_at(info_values(_field(8), "END"), F.lit(1)).try_cast("bigint"), _long(2) + F.length(_field(4)) - 1)
    variant = F.when(_field(3) != ".", _field(3)).otherwise(F.concat_ws(":", _field(1), _field(2), _field(4), _field(5)))
    named = F.when(_field(4) != "", _field(4)).otherwise(F.concat_ws("_", _field(1), _field(2), _field(3)))
    place = (
        F.when((kind == "vcf") & (F.size("f") >= 8), cell(_field(1), _long(2), reach, variant, F.lit(".")))
        .when((kind == "bed") & (F.size("f") >= 3) & ~_field(1).rlike(r"^(track|browser)\b"), cell(_field(1), _long(2) + 1, _long(3), named, F.coalesce(_field(6), F.lit("."))))
        .when(kind.isin("gff", "gtf") & (F.size("f") >= 9), cell(_field(1), _long(4), _long(5), feature["name"], feature["strand"]))
    )
    out = compute_once(rows, place=place).select("place.record", "place.start", "place.end", "place.name", "place.strand", "attributes")
    return out.filter((F.col("start") >= 1) & (F.col("end") >= F.col("start"))).withColumn("source_set", F.lit(source_set))


def _attributes() -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.when(F.col("kind") == "gff", gff_attributes(_field(9))).when(F.col("kind") == "gtf", gtf_attributes(_field(9))).otherwise(empty)


def _feature_columns() -> dict[str, Column]:
    """Ids, parents and names of GFF3 and GTF rows, from ``f``, ``kind`` and ``attributes``."""
    gff, feature = F.col("kind") == "gff", _field(3)
    get = lambda key: F.try_element_at("attributes", F.lit(key))
    own = F.when(gff, get("ID")).when(feature == "gene", get("gene_id")).when(feature == "transcript", get("transcript_id"))
    parent = F.when(gff, get("Parent")).when(feature == "transcript", get("gene_id")).when(feature != "gene", get("transcript_id"))
    id_ = F.coalesce(own, F.concat_ws("_", feature, _field(1), _field(4), _field(5)))
    return {
        "record": _field(1), "feature": feature, "start": _long(4), "end": _long(5), "strand": F.when(_field(7).isin("+", "-"), _field(7)).otherwise("."),
        "phase": _field(8), "id": id_, "parent": parent, "gene_id": F.coalesce(get("gene_id"), get("gene")),
        "transcript_id": F.coalesce(get("transcript_id"), F.when(feature.isin("mRNA", "transcript"), id_)),
        "name": F.coalesce(get("Name"), get("gene_name"), get("gene"), get("gene_id"), id_), "length": _long(5) - _long(4) + 1, "source": _field(2), "attributes": F.col("attributes"),
    }


def feature_rows(lines: DataFrame, fmt: str = "gff", types: Sequence[str] = ()) -> DataFrame:
    rows = _of_kind(lines, fmt, ("gff", "gtf")).filter((F.size("f") >= 9) & (_long(4) >= 1) & (_long(5) >= _long(4)))
    if types:
        rows = rows.filter(F.lower(_field(3)).isin([t.lower() for t in types]))
    return compute_once(rows, attributes=_attributes()).select(*[column.alias(name) for name, column in _feature_columns().items()])


def read_features(spark: SparkSession, path: str, *, fmt: str = "auto", types: Sequence[str] = ()) -> DataFrame:
    """GFF3 or GTF features with their ids, parents and names resolved, in one scan; ``auto`` decides line by line."""
    return feature_rows(read_lines(spark, path), fmt, types)


def read_paf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignment blocks with identity; the comparison is the first sequence of a line."""
    rows = _fields(read_lines(spark, path)).filter(F.size("f") >= 12)
    numbers = rows.filter(_long(3).isNotNull() & _long(4).isNotNull() & _long(8).isNotNull() & _long(9).isNotNull() & _long(10).isNotNull() & (_long(11) > 0))
    return numbers.select(
        _field(1).alias("comparison"), _long(2).alias("comparison_length"), _long(3).alias("comparison_start"), _long(4).alias("comparison_end"),
        F.when(_field(5) == "-", "-").otherwise("+").alias("strand"), _field(6).alias("reference"), _long(7).alias("reference_length"), _long(8).alias("reference_start"), _long(9).alias("reference_end"),
        _long(10).alias("matches"), _long(11).alias("block_length"), (_long(10) / _long(11) * 100).alias("identity"), _field(12).try_cast("bigint").alias("mapq"),
    )


def bed_lines(intervals: DataFrame) -> DataFrame:
    cells = [F.col("record"), (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.col("name"), F.lit("0"), F.coalesce("strand", F.lit("."))]
    return intervals.select(F.concat_ws("\t", *cells).alias("line"))


def gff_lines(features: DataFrame) -> DataFrame:
    """GFF3 with attributes normalised to ID, Parent, Name, gene_id and transcript_id."""
    quote = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(";"), F.lit("%3B")), F.lit("="), F.lit("%3D"))
    pair = lambda key, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(key + "="), quote(F.col(c))))
    attributes = F.concat_ws(";", pair("ID", "id"), pair("Parent", "parent"), pair("Name", "name"), pair("gene_id", "gene_id"), pair("transcript_id", "transcript_id"))
    cells = [F.col("record"), F.col("source"), F.col("feature"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.col("strand"), F.coalesce("phase", F.lit(".")), attributes]
    return features.select(F.concat_ws("\t", *cells).alias("line"))


def write_bed(intervals: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    bed_lines(intervals).write.mode(mode).text(path)


def write_gff(features: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    write_with_header(gff_lines(features), ["##gff-version 3"], path, mode=mode)
