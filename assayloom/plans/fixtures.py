"""Input frames derived from the shared tables, each with the same derivation as DuckDB text.

The tables hold no genomic data, so sequences, reads, variants, alignments and intervals are
computed row by row from their keys. Every row of a table gives a row here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.operators.once import compute_once
from assayloom.plans.registry import Tables
from assayloom.session import shuffle_width

HEX = "0123456789abcdef"
DNA = "ACGTACGTACGTACGT"
PROTEIN = "ACDEFGHIKLMNPQRS"
QUALITY = "!#%+5:?@ABCDEFHI"


def dna32(key: Column) -> Column:
    return F.translate(F.md5(key.cast("string")), HEX, DNA)


def dna32_sql(key: str) -> str:
    return f"translate(md5(cast({key} as varchar)), '{HEX}', '{DNA}')"


# --- text table with blanks and missing marks -------------------------------------------------

def messy_customers(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        k.cast("string").alias("sample_id"),
        F.concat(F.lit("  "), F.regexp_replace("c_name", "#", "   "), F.lit(" ")).alias("name"),
        F.when(k % 17 == 0, "").when(k % 23 == 0, "NA").when(k % 29 == 0, " n/a ").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(k % 19 == 0, "").when(k % 31 == 0, "bad").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.lit("").alias("notes"),
    )


MESSY = """messy AS (SELECT cast(c_custkey as varchar) AS sample_id,
  '  ' || replace(c_name, '#', '   ') || ' ' AS name,
  CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 23 = 0 THEN 'NA' WHEN c_custkey % 29 = 0 THEN ' n/a ' ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 31 = 0 THEN 'bad' ELSE cast(c_acctbal as varchar) END AS balance,
  '' AS notes FROM customer)"""


# --- join pair with case, blanks and white space in the key ------------------------------------

def keyed_orders(t: Tables) -> DataFrame:
    k = F.col("o_custkey").cast("string")
    return t.orders.select(
        F.when(F.col("o_orderkey") % 19 == 0, "  ").otherwise(F.concat(F.lit(" Cust-"), k, F.lit(" "))).alias("cust"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
    )


def keyed_customers(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("CUST-"), k.cast("string"))).alias("customer"),
        F.col("c_name").alias("id"),
        F.col("c_mktsegment").alias("status"),
        F.col("c_nationkey").alias("nation"),
    )


JOIN_PAIR = """lo AS (SELECT CASE WHEN o_orderkey % 19 = 0 THEN '  ' ELSE ' Cust-' || o_custkey || ' ' END AS cust,
  cast(o_orderkey as varchar) AS id, o_orderstatus AS status, o_totalprice AS total FROM orders),
rc AS (SELECT CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'CUST-' || c_custkey END AS customer,
  c_name AS id, c_mktsegment AS status, c_nationkey AS nation FROM customer),
l AS (SELECT *, nullif(lower(trim(cust)), '') AS k FROM lo),
r AS (SELECT *, nullif(lower(trim(customer)), '') AS k FROM rc)"""


# --- sequences ---------------------------------------------------------------------------------

def parts(t: Tables) -> DataFrame:
    """The part table over all tasks: its few megabytes are one or two file splits, but each row becomes long sequences."""
    return t.part.repartition(shuffle_width(t.spark), "p_partkey")


def sequences(t: Tables) -> DataFrame:
    """128 bases per part, titled ``seqN description``."""
    k = F.col("p_partkey")
    named = parts(t).select(k.alias("record"), F.concat(F.lit("seq"), k.cast("string"), F.lit(" "), F.col("p_name")).alias("title"))
    # Worked out once, so that filters on sequences stay behind the exchange too.
    return compute_once(named, sequence=F.concat(*[dna32(F.col("record") * 8 + i) for i in range(4)]))


SEQS = f"""seqs AS (SELECT p_partkey AS record, 'seq' || p_partkey || ' ' || p_name AS title,
  {" || ".join(dna32_sql(f"p_partkey * 8 + {i}") for i in range(4))} AS sequence FROM part)"""


def proteins(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    named = parts(t).select(k.alias("record"), F.concat(F.lit("prot"), k.cast("string")).alias("title"))
    return compute_once(named, sequence=F.concat(*[F.translate(F.md5((F.col("record") * 8 + i).cast("string")), HEX, PROTEIN) for i in range(3)]))


PROTEINS = f"""prots AS (SELECT p_partkey AS record, 'prot' || p_partkey AS title,
  {" || ".join(f"translate(md5(cast(p_partkey * 8 + {i} as varchar)), '{HEX}', '{PROTEIN}')" for i in range(3))} AS sequence FROM part)"""


def reads(t: Tables) -> DataFrame:
    """One 32-base read per order with a quality text; customers repeat, so qualities do too."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("read_id"),
        F.concat(F.lit("read"), k.cast("string"), F.lit("/1")).alias("title"),
        F.concat(
            F.substring(dna32(F.col("o_custkey")), 1, 20),
            F.when(k % 7 == 0, "N").otherwise(""),
            F.substring(dna32(F.col("o_custkey") + 1), 1, 11),
        ).alias("sequence"),
        F.lit("+").alias("plus"),
        F.concat(
            F.substring(F.translate(F.md5(k.cast("string")), HEX, QUALITY), 1, 31), F.when(k % 7 == 0, "!").otherwise("")
        ).alias("quality"),
    )


READS = f"""reads AS (SELECT o_orderkey AS read_id, 'read' || o_orderkey || '/1' AS title,
  substr({dna32_sql("o_custkey")}, 1, 20) || CASE WHEN o_orderkey % 7 = 0 THEN 'N' ELSE '' END || substr({dna32_sql("o_custkey + 1")}, 1, 11) AS sequence,
  '+' AS plus,
  substr(translate(md5(cast(o_orderkey as varchar)), '{HEX}', '{QUALITY}'), 1, 31) || CASE WHEN o_orderkey % 7 = 0 THEN '!' ELSE '' END AS quality FROM orders)"""


# --- intervals ---------------------------------------------------------------------------------

def line_name() -> Column:
    return F.concat_ws("_", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))


LINE_NAME = "concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(cast(l_extendedprice as decimal(12,2)) as varchar))"


def intervals_a(t: Tables) -> DataFrame:
    start = F.col("l_partkey") * 10 + F.col("l_linenumber")
    return t.lineitem.select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("record"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("bigint")).alias("end"),
        line_name().alias("name"),
        F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def intervals_b(t: Tables) -> DataFrame:
    start = F.col("p_partkey") * 10 + 1
    return t.part.select(
        F.concat(F.lit("chr"), (F.col("p_partkey") % 22 + 1).cast("string")).alias("record"),
        start.alias("start"),
        (start + F.col("p_size") * 3).cast("bigint").alias("end"),
        F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"),
        F.lit("+").alias("strand"),
    )


INTERVALS = f"""a AS (SELECT 'chr' || (l_suppkey % 22 + 1) AS record, l_partkey * 10 + l_linenumber AS "start",
  l_partkey * 10 + l_linenumber + cast(l_quantity as bigint) AS "end", {LINE_NAME} AS name,
  CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem),
b AS (SELECT 'chr' || (p_partkey % 22 + 1) AS record, p_partkey * 10 + 1 AS "start",
  p_partkey * 10 + 1 + p_size * 3 AS "end", 'part' || p_partkey AS name, '+' AS strand FROM part)"""


# --- alignments --------------------------------------------------------------------------------

def alignments(t: Tables) -> DataFrame:
    """SAM-like rows: plain matches, deletions, skips and soft clips."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    cigar = (
        F.when(n % 4 == 0, F.concat(q.cast("string"), F.lit("M2D"), n.cast("string"), F.lit("M")))
        .when(n % 4 == 1, F.concat(F.lit("3S"), q.cast("string"), F.lit("M")))
        .when(n % 4 == 2, F.concat(q.cast("string"), F.lit("M10N5M1I4M")))
        .otherwise(F.concat(q.cast("string"), F.lit("M")))
    )
    unmapped = F.when(F.col("l_orderkey") % 29 == 0, 4).otherwise(0)
    flag = (n % 2) * 16 + unmapped + F.when(F.col("l_orderkey") % 3 == 0, 1 + 2).otherwise(0)
    return t.lineitem.select(
        line_name().alias("qname"), flag.cast("int").alias("flag"),
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("rname"),
        (F.col("l_partkey") * 10 + n).alias("pos"), (F.col("l_partkey") % 61).cast("int").alias("mapq"),
        cigar.alias("cigar"), F.concat(F.lit("NM:i:"), (n % 3).cast("string")).alias("tags"),
    )


ALIGNMENTS = f"""aln AS (SELECT {LINE_NAME} AS qname,
  (l_linenumber % 2) * 16 + CASE WHEN l_orderkey % 29 = 0 THEN 4 ELSE 0 END + CASE WHEN l_orderkey % 3 = 0 THEN 3 ELSE 0 END AS flag,
  'chr' || (l_suppkey % 22 + 1) AS rname, l_partkey * 10 + l_linenumber AS pos, l_partkey % 61 AS mapq,
  CASE l_linenumber % 4 WHEN 0 THEN cast(l_quantity as int) || 'M2D' || l_linenumber || 'M'
    WHEN 1 THEN '3S' || cast(l_quantity as int) || 'M' WHEN 2 THEN cast(l_quantity as int) || 'M10N5M1I4M'
    ELSE cast(l_quantity as int) || 'M' END AS cigar, 'NM:i:' || (l_linenumber % 3) AS tags FROM lineitem)"""


# --- variants ----------------------------------------------------------------------------------

def variant_lines(t: Tables) -> DataFrame:
    """VCF text columns with three samples and INFO tags, one per line item."""
    n, o, p = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_partkey")
    text = lambda c: c.cast("string")
    ref = F.substring(dna32(p), 1, 1)
    alt = (
        F.when(n % 5 == 0, F.concat(ref, F.lit("AG")))
        .when(n % 5 == 1, F.translate(ref, "ACGT", "CGTA"))
        .when(n % 5 == 2, F.lit("<DEL>"))
        .when(n % 5 == 3, F.concat(F.translate(ref, "ACGT", "GTAC"), F.lit(","), F.translate(ref, "ACGT", "TACG")))
        .otherwise(F.translate(ref, "ACGT", "CGTA"))
    )
    longer = F.when(n % 5 == 4, F.concat(ref, F.lit("TT"))).otherwise(ref)
    info = F.concat(
        F.lit("DP="), text(F.col("l_quantity").cast("int")), F.lit(";AF="), text(F.col("l_discount")),
        F.when(o % 4 == 0, ";DB").otherwise(""),
        F.lit(";ANN="), F.when(n % 2 == 0, F.concat(F.lit("A|missense_variant|MODERATE|G"), text(p % 50), F.lit("|T1|x||||c.1A>G|p.Lys"), text(n), F.lit("Arg")))
        .otherwise(F.concat(F.lit("A|stop_gained|HIGH|G"), text(p % 50), F.lit("|T2|x||||c.2A>G|p.Gln"), text(n), F.lit("Ter"))),
    )
    def sample(i: int) -> Column:
        gt = (
            F.when((o + i) % 13 == 0, "./.").when((o + i) % 3 == 0, "0/0").when((o + i) % 3 == 1, "0/1").otherwise("1/1")
        )
        return F.concat(gt, F.lit(":"), text((p + i) % 40), F.lit(":"), text((o + i) % 99))
    lines = t.lineitem.select(
        F.concat(F.lit("chr"), text(F.col("l_suppkey") % 22 + 1)).alias("chrom"),
        text(p * 10 + n).alias("pos"),
        F.when(o % 5 == 0, ".").otherwise(line_name()).alias("id"), longer.alias("ref"), alt.alias("alt"),
        F.when(n == 7, ".").otherwise(text(F.col("l_quantity").cast("int"))).alias("qual"),
        F.when(F.col("l_returnflag") == "A", "PASS").when(F.col("l_returnflag") == "N", ".").otherwise("q10;s50").alias("filter"),
        info.alias("info"), F.lit("GT:DP:GQ").alias("format"), F.array(sample(1), sample(2), sample(3)).alias("sample_values"),
    )
    return compute_once(lines, ref=F.col("ref"), alt=F.col("alt"), id=F.col("id"), info=F.col("info"), sample_values=F.col("sample_values"))


VCF_SAMPLES = ["S1", "S2", "S3"]


def _sample_sql(i: int) -> str:
    return (
        f"CASE WHEN (l_orderkey + {i}) % 13 = 0 THEN './.' WHEN (l_orderkey + {i}) % 3 = 0 THEN '0/0' "
        f"WHEN (l_orderkey + {i}) % 3 = 1 THEN '0/1' ELSE '1/1' END || ':' || ((l_partkey + {i}) % 40) || ':' || ((l_orderkey + {i}) % 99)"
    )


VARIANTS = f"""raw AS (SELECT *, substr({dna32_sql("l_partkey")}, 1, 1) AS r0 FROM lineitem),
vcf AS (SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_partkey * 10 + l_linenumber AS pos,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE {LINE_NAME} END AS id,
  CASE WHEN l_linenumber % 5 = 4 THEN r0 || 'TT' ELSE r0 END AS ref,
  CASE l_linenumber % 5 WHEN 0 THEN r0 || 'AG' WHEN 1 THEN translate(r0, 'ACGT', 'CGTA') WHEN 2 THEN '<DEL>'
    WHEN 3 THEN translate(r0, 'ACGT', 'GTAC') || ',' || translate(r0, 'ACGT', 'TACG') ELSE translate(r0, 'ACGT', 'CGTA') END AS alt,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(cast(l_quantity as int) as double) END AS qual,
  CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'N' THEN '.' ELSE 'q10;s50' END AS "filter",
  'DP=' || cast(l_quantity as int) || ';AF=' || l_discount || CASE WHEN l_orderkey % 4 = 0 THEN ';DB' ELSE '' END || ';ANN=' ||
  CASE WHEN l_linenumber % 2 = 0 THEN 'A|missense_variant|MODERATE|G' || (l_partkey % 50) || '|T1|x||||c.1A>G|p.Lys' || l_linenumber || 'Arg'
    ELSE 'A|stop_gained|HIGH|G' || (l_partkey % 50) || '|T2|x||||c.2A>G|p.Gln' || l_linenumber || 'Ter' END AS info,
  cast(l_quantity as int) AS dp_info, l_discount AS af_info, l_orderkey % 4 = 0 AS db_info, l_linenumber % 2 = 0 AS missense, 'G' || (l_partkey % 50) AS gene,
  [{", ".join(_sample_sql(i) for i in (1, 2, 3))}] AS sv FROM raw),
geno AS (SELECT vcf.*, i, 'S' || i AS sample, string_split(sv[i], ':') AS p,
  string_split(sv[i], ':')[1] AS gt, cast(string_split(sv[i], ':')[2] as int) AS dp, cast(string_split(sv[i], ':')[3] as int) AS gq
  FROM vcf, (SELECT unnest([1, 2, 3]) AS i))"""
