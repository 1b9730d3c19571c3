"""Column functions for sequencing text: CIGAR, INFO, genotypes, qualities, feature attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of a SAM flag.
SAM_FLAGS = {
    0x1: "paired", 0x2: "proper pair", 0x4: "read unmapped", 0x8: "mate unmapped", 0x10: "reverse strand",
    0x20: "mate reverse strand", 0x40: "first in pair", 0x80: "second in pair", 0x100: "secondary alignment",
    0x200: "QC fail", 0x400: "duplicate", 0x800: "supplementary alignment",
}

# Field orders of ANN and CSQ annotations when the header does not give one.
ANN_FIELDS = ["Allele", "Annotation", "Annotation_Impact", "Gene_Name", "Gene_ID", "Feature_Type", "Feature_ID",
              "Transcript_BioType", "Rank", "HGVS.c", "HGVS.p"]
CSQ_FIELDS = ["Allele", "Consequence", "IMPACT", "SYMBOL", "Gene", "Feature_type", "Feature", "BIOTYPE", "EXON", "INTRON",
              "HGVSc", "HGVSp", "cDNA_position", "CDS_position", "Protein_position", "Amino_acids"]


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def cigar_ops(cigar: Column) -> Column:
    """Array of ``(len, op)``."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(
        parts, lambda p: F.struct(p.substr(F.lit(1), F.length(p) - 1).cast("bigint").alias("len"), F.right(p, F.lit(1)).alias("op"))
    )


def ops_length(ops: Column, kinds: str) -> Column:
    return F.aggregate(
        F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0).cast("bigint"), lambda total, o: total + o["len"]
    )


def aligned_blocks(position: Column, ops: Column) -> Column:
    """Reference ranges covered by M, = and X operations."""
    start = F.struct(position.cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("blocks"))

    def step(acc: Column, o: Column) -> Column:
        block = F.struct(acc["at"].alias("start"), (acc["at"] + o["len"] - 1).alias("end"))
        return F.struct(
            F.when(o["op"].isin(*"M=XDN"), acc["at"] + o["len"]).otherwise(acc["at"]).alias("at"),
            F.when(o["op"].isin(*"M=X"), F.concat(acc["blocks"], F.array(block))).otherwise(acc["blocks"]).alias("blocks"),
        )

    one = F.array(F.struct(position.cast("bigint").alias("start"), (position + ops[0]["len"] - 1).cast("bigint").alias("end")))
    # Most reads are one plain match: those skip the walk.
    plain = (F.size(ops) == 1) & F.coalesce(F.try_element_at(ops, F.lit(1))["op"].isin(*"M=X"), F.lit(False))
    return F.when(plain, one).otherwise(F.aggregate(ops, start, step, lambda acc: acc["blocks"]))


def sam_tag(tags: Column, tag: str) -> Column:
    """Value of an optional SAM tag in tab-separated text."""
    found = F.regexp_extract(tags, rf"(?:^|\t){tag}:[A-Za-z]:([^\t]*)", 1)
    return F.when(found != "", found)


def info_values(info: Column, key: str) -> Column:
    """Values of an INFO key, ``['true']`` for a flag, NULL when absent; the last one wins."""
    entry = F.try_element_at(
        F.filter(F.split(info, ";"), lambda x: (x == key) | x.startswith(key + "=")), F.lit(-1)
    )
    return F.when(entry == key, F.array(F.lit("true"))).when(
        entry.isNotNull(), F.split(entry.substr(F.lit(len(key) + 2), F.length(entry)), ",")
    )


def sample_field(format_text: Column, sample: Column, key: str) -> Column:
    place = F.array_position(F.split(format_text, ":"), key).cast("int")
    return F.when(place > 0, F.try_element_at(F.split(sample, ":"), place))


def gt_alleles(gt: Column) -> Column:
    return F.filter(F.split(F.coalesce(gt, F.lit("")), "[/|]"), lambda a: (a != "") & (a != "."))


def gt_missing(gt: Column) -> Column:
    return F.size(gt_alleles(gt)) == 0


def quality_scores(quality: Column) -> Column:
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def sum_scores(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0).cast("bigint"), lambda a, b: a + b)


def gff_attributes(text: Column) -> Column:
    """``key=value;`` pairs as a map; of repeated keys the first counts."""
    pairs = F.filter(F.split(text, ";"), lambda p: F.instr(p, "=") > 1)
    return _pairs_to_map(F.transform(pairs, lambda p: F.struct(
        F.trim(F.substring_index(p, "=", 1)).alias("key"), F.url_decode(F.replace(p.substr(F.instr(p, "=") + 1, F.length(p)), F.lit("+"), F.lit("%2B"))).alias("value")
    )))


def gtf_attributes(text: Column) -> Column:
    """``key "value";`` pairs as a map; of repeated keys the first counts."""
    pairs = F.regexp_extract_all(text, F.lit(r'(\w+\s+"[^"]*")'), F.lit(1))
    return _pairs_to_map(F.transform(pairs, lambda p: F.struct(
        F.regexp_extract(p, r"^(\w+)", 1).alias("key"), F.regexp_extract(p, r'"([^"]*)"', 1).alias("value")
    )))


def _pairs_to_map(pairs: Column) -> Column:
    """Map from pairs that may repeat a key: the first value stays."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(
        keys, F.transform(keys, lambda k: F.try_element_at(F.filter(pairs, lambda p: p["key"] == k), F.lit(1))["value"])
    )
