"""Queries for variants, alignments and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.functions.hts import SAM_FLAGS
from assayloom.operators import alignments as al
from assayloom.operators import reads as rd
from assayloom.operators import variants as va
from assayloom.plans import fixtures as fx
from assayloom.plans.registry import Tables, query

S = fx.VCF_SAMPLES
KIND = """CASE WHEN contains(alt, ',') THEN 'multiallelic' WHEN alt LIKE '<%' THEN 'symbolic' WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' WHEN length(ref) > 1 AND length(alt) = length(ref) THEN 'mnv'
  WHEN length(alt) > length(ref) THEN 'insertion' WHEN length(alt) < length(ref) THEN 'deletion' ELSE 'indel' END"""
SITE = 'chrom, pos, pos + length(ref) - 1 AS "end", id, ref, alt, qual, "filter"'


def _variants(t: Tables) -> DataFrame:
    return va.typed_variants(fx.variant_lines(t))


def _site(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("chrom", "pos", "end", "id", "ref", "alt", "qual", "filter", *extra)


@query(
    "G1_filter_sites",
    f"""WITH {fx.VARIANTS} SELECT {SITE} FROM vcf WHERE chrom = 'chr7' AND pos + length(ref) - 1 >= 300 AND pos <= 18000 AND "filter" IN ('PASS', '.') AND qual >= 10 AND id IS NOT NULL""",
)
def _g1(t: Tables) -> DataFrame:
    return _site(va.filter_sites(_variants(t), chromosome="chr7", region_start=300, region_end=18000, filter_status="pass", min_qual=10, id_mode="has-id"))


@query("G1_filter_named", f"""WITH {fx.VARIANTS} SELECT {SITE} FROM vcf WHERE "filter" LIKE '%s50%' AND {KIND} IN ('insertion', 'deletion', 'indel')""")
def _g1b(t: Tables) -> DataFrame:
    return _site(va.filter_sites(_variants(t), filter_status="named", filter_names=["s50", "x"], variant="indel"))


@query("G2_variant_type", f"WITH {fx.VARIANTS} SELECT {KIND} AS variant_type, count(*) AS n, count(DISTINCT chrom) AS chromosomes FROM vcf GROUP BY 1")
def _g2(t: Tables) -> DataFrame:
    kinds = _variants(t).withColumn("variant_type", va.variant_type(F.col("ref"), F.col("alt")))
    return kinds.groupBy("variant_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chrom").alias("chromosomes"))


@query("G3_info_predicates", f"WITH {fx.VARIANTS} SELECT {SITE}, info FROM vcf WHERE dp_info >= 20 AND af_info < 0.05 AND db_info")
def _g3(t: Tables) -> DataFrame:
    return _site(va.filter_info(_variants(t), ["DP >= 20", "AF<0.05", "DB = true"]), "info")


@query(
    "G4_consequence",
    f"""WITH {fx.VARIANTS} SELECT {SITE}, 'missense_variant|MODERATE|' || gene || '|' || split_part(split_part(info, 'ANN=', 2), '|', 11) AS consequence FROM vcf WHERE missense AND gene IN ('G7', 'G12', 'G30') AND contains(info, 'p.Lys2')""",
)
def _g4(t: Tables) -> DataFrame:
    rows = va.filter_consequence(_variants(t), impact="moderate", terms=["missense_variant"], genes=["g7", "G12", "G30"], amino_acids=["lys2"])
    return _site(rows, "consequence")


@query(
    "G5_genotype_filter",
    f"""WITH {fx.VARIANTS}, g AS (SELECT chrom, pos, ref, alt, sv, count(*) AS copies, i, any_value(gt) AS gt, any_value(dp) AS dp, any_value(gq) AS gq, id, qual, "filter" FROM geno GROUP BY chrom, pos, ref, alt, sv, i, id, qual, "filter"),
    s AS (SELECT chrom, pos, ref, alt, sv, id, qual, "filter", any_value(copies) AS copies, avg(CASE WHEN gt = './.' THEN 1 ELSE 0 END) AS rate, string_agg('S' || i, ',' ORDER BY i) FILTER (gt = '0/1' AND dp >= 10 AND gq >= 20) AS m FROM g GROUP BY ALL)
    SELECT {SITE}, m AS matching_samples, round(rate, 4) AS missing_genotype_rate FROM s, unnest(range(copies)) WHERE rate <= 0.4 AND m IS NOT NULL""",
)
def _g5(t: Tables) -> DataFrame:
    rows = va.filter_genotypes(_variants(t), S, genotype="heterozygous", max_missing_rate=0.4, min_depth=10, min_gq=20)
    return _site(rows, "matching_samples", "missing_genotype_rate")


@query(
    "G5_site_modes",
    f"""WITH {fx.VARIANTS}, f AS (SELECT *, list_transform(sv, lambda x: string_split(x, ':')[1]) AS g FROM vcf)
    SELECT 'all-called' AS mode, count(*) AS sites FROM f WHERE NOT list_contains(g, './.') UNION ALL SELECT 'any-missing', count(*) FROM f WHERE list_contains(g, './.')
    UNION ALL SELECT 'all-hom-ref', count(*) FROM f WHERE g = ['0/0', '0/0', '0/0'] UNION ALL SELECT 'S2 homozygous-alt', count(*) FROM f WHERE g[2] = '1/1'""",
)
def _g5b(t: Tables) -> DataFrame:
    rules = {site: {"site": site} for site in ("all-called", "any-missing", "all-hom-ref")}
    return va.genotype_census(_variants(t), S, {**rules, "S2 homozygous-alt": {"genotype": "homozygous-alt", "sample_names": ["S2"]}})


@query("G6_project_samples", f"WITH {fx.VARIANTS} SELECT {SITE}, sv[1] || ' ' || sv[3] AS sample_values FROM vcf")
def _g6(t: Tables) -> DataFrame:
    kept, _, _ = va.project_samples(_variants(t), S, ["S2"], keep=False)
    return _site(kept.withColumn("sample_values", F.array_join("sample_values", " ")), "sample_values")


@query(
    "G7_header_tables",
    """SELECT 'contig' AS kind, 'chr' || p_partkey AS id, NULL AS number, NULL AS type, NULL AS description, cast(p_size * 1000 as bigint) AS length, NULL AS value FROM part
    UNION ALL SELECT 'INFO', 'T' || p_partkey, '1', 'Integer', p_name || ', size', NULL, NULL FROM part UNION ALL SELECT 'metadata', 'source', NULL, NULL, NULL, NULL, p_brand FROM part""",
)
def _g7(t: Tables) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    lines = t.part.select(F.explode(F.array(
        F.concat(F.lit("##contig=<ID=chr"), k, F.lit(",length="), (F.col("p_size") * 1000).cast("string"), F.lit(">")),
        F.concat(F.lit("##INFO=<ID=T"), k, F.lit(',Number=1,Type=Integer,Description="'), F.col("p_name"), F.lit(', size">')),
        F.concat(F.lit("##source="), F.col("p_brand")), F.concat(F.lit("chr1\t"), k),
    )).alias("line"))
    return va.header_tables(lines)


@query(
    "U6_melt_genotypes",
    f"""WITH {fx.VARIANTS} SELECT chrom, pos, id, ref, alt, sample, gt, cast(gq as varchar) AS gq, cast(dp as varchar) AS dp, cast(NULL as varchar) AS ad, 'GT:DP:GQ' AS format, sv[i] AS sample_values FROM geno""",
)
def _u6(t: Tables) -> DataFrame:
    return va.melt_genotypes(_variants(t), S)


@query(
    "U7_split_info",
    f"""WITH {fx.VARIANTS} SELECT chrom, pos, ref, alt, cast(dp_info as varchar) AS "info_DP", cast(af_info as varchar) AS "info_AF", CASE WHEN db_info THEN 'true' END AS "info_DB", split_part(info, 'ANN=', 2) AS "info_ANN" FROM vcf""",
)
def _u7(t: Tables) -> DataFrame:
    wide = va.split_info(_variants(t), ["DP", "AF"])
    return wide.select("chrom", "pos", "ref", "alt", "info_DP", "info_AF", "info_DB", "info_ANN")


@query(
    "W10_sampling_candidates",
    f"""WITH {fx.VARIANTS} SELECT {SITE} FROM vcf WHERE NOT contains(alt, ',') AND {KIND} = 'snv' AND len(list_filter(sv, lambda x: x LIKE './.%')) / 3 <= 0.2""",
)
def _w10(t: Tables) -> DataFrame:
    return _site(va.sampling_candidates(_variants(t), S, autosomes_only=True, biallelic_only=True, variant="snv", max_missing_rate=0.2))


@query(
    "W10_sample_variants",
    f"""WITH {fx.VARIANTS} SELECT {SITE} FROM vcf WHERE NOT contains(alt, ',') AND alt <> '.' ORDER BY md5(concat_ws('|', chrom, pos, ref, alt, info, '11')) LIMIT 300""",
)
def _w10b(t: Tables) -> DataFrame:
    return _site(va.sample_variants(_variants(t), S, 300, 11, ["chrom", "pos", "ref", "alt", "info"], biallelic_only=True))


# --- alignments --------------------------------------------------------------------------------

CIGAR = f"""{fx.ALIGNMENTS}, a1 AS (SELECT *, row_number() OVER () AS rid, regexp_extract_all(cigar, '\\d+[MIDNSHP=X]') AS ops FROM aln),
o1 AS (SELECT rid, generate_subscripts(ops, 1) AS i, unnest(ops) AS op FROM a1), o2 AS (SELECT rid, i, cast(regexp_extract(op, '\\d+') as bigint) AS n, right(op, 1) AS k FROM o1),
o3 AS (SELECT *, coalesce(sum(CASE WHEN k IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM o2),
sp AS (SELECT rid, cast(sum(n) FILTER (k IN ('M', '=', 'X', 'D', 'N')) as bigint) AS span, cast(sum(n) FILTER (k IN ('M', '=', 'X')) as bigint) AS aligned, cast(sum(n) FILTER (k IN ('M', '=', 'X', 'I', 'S')) as bigint) AS rl FROM o2 GROUP BY 1),
m AS (SELECT a1.*, flag & 4 = 0 AS mapped, span, aligned, rl FROM a1 JOIN sp USING (rid)),
bl AS (SELECT m.rid, rname, mapq, aligned, cast(pos + off as bigint) AS s, cast(pos + off + n - 1 as bigint) AS e FROM m JOIN o3 USING (rid) WHERE mapped AND k = 'M'),
len AS (SELECT rname, max(pos + span) + 100 AS length FROM m GROUP BY 1)"""
DEPTH = """ev AS (SELECT rname, p, sum(d) AS d FROM (SELECT rname, s AS p, 1 AS d FROM bl2 UNION ALL SELECT rname, e + 1, -1 FROM bl2 UNION ALL SELECT rname, 1, 0 FROM len UNION ALL SELECT rname, length + 1, 0 FROM len) GROUP BY 1, 2),
seg AS (SELECT rname, p AS s, lead(p) OVER (PARTITION BY rname ORDER BY p) - 1 AS e, cast(sum(d) OVER (PARTITION BY rname ORDER BY p) as bigint) AS depth FROM ev),
sg AS (SELECT * FROM seg WHERE e IS NOT NULL AND s <= e)"""


def _lengths(t: Tables) -> DataFrame:
    rows = al.typed_alignments(fx.alignments(t))
    span = al.ops_length(F.col("ops"), "M=XDN")
    return rows.groupBy(F.col("rname").alias("reference")).agg((F.max(F.col("pos") + span) + 100).alias("length"))


@query(
    "G8_reference_stats",
    f"""WITH {CIGAR} SELECT rname AS reference, length, count(*) AS alignments, count(*) FILTER (mapped) AS mapped_alignments, round(avg(mapq) FILTER (mapped), 3) AS mean_mapq,
      min(pos) FILTER (mapped) AS covered_min, max(pos + span - 1) FILTER (mapped) AS covered_max FROM m JOIN len USING (rname) GROUP BY 1, 2""",
)
def _g8(t: Tables) -> DataFrame:
    return al.reference_stats(fx.alignments(t), _lengths(t))


@query(
    "G9_flag_census",
    "WITH " + fx.ALIGNMENTS + ", f AS (SELECT * FROM (VALUES " + ", ".join(f"({bit}, '{label}')" for bit, label in SAM_FLAGS.items()) + ") x(bit, label)) "
    "SELECT bit AS flag, label, count(*) FILTER (aln.flag & bit <> 0) AS count, round(count(*) FILTER (aln.flag & bit <> 0) / count(*) * 100, 3) AS percent FROM f, aln GROUP BY 1, 2",
)
def _g9(t: Tables) -> DataFrame:
    return al.flag_census(fx.alignments(t))


@query(
    "G10_coverage_summary",
    f"""WITH {CIGAR}, bl2 AS (SELECT * FROM bl), {DEPTH}, mp AS (SELECT rname, count(*) AS n FROM m WHERE mapped GROUP BY 1)
    SELECT rname AS reference, 'reference length' AS scope, cast(1 as bigint) AS scope_start, length AS scope_end, length AS scope_length, n AS mapped_alignments,
      cast(coalesce(sum(e - s + 1) FILTER (depth > 0), 0) as bigint) AS covered_bases, round(coalesce(sum(e - s + 1) FILTER (depth > 0), 0) / length * 100, 3) AS breadth_percent,
      round(sum((e - s + 1) * depth) / length, 3) AS mean_depth, max(depth) AS max_depth, cast(sum((e - s + 1) * depth) as bigint) AS total_depth,
      count(*) FILTER (depth = 0) AS zero_coverage_region_count, max(e - s + 1) FILTER (depth = 0) AS largest_zero_coverage_region FROM sg JOIN len USING (rname) JOIN mp USING (rname) GROUP BY rname, length, n""",
)
def _g10(t: Tables) -> DataFrame:
    return al.coverage_summary(fx.alignments(t), _lengths(t))


@query(
    "G10_zero_regions",
    f"""WITH {CIGAR}, bl2 AS (SELECT * FROM bl), {DEPTH} SELECT rname AS record, s AS "start", e AS "end", e - s + 1 AS length FROM sg WHERE depth = 0""",
)
def _g10b(t: Tables) -> DataFrame:
    lengths = _lengths(t)
    scope = lengths.select(F.col("reference").alias("record"), F.lit(1).alias("scope_start"), F.col("length").alias("scope_end"))
    return al.zero_regions(al.depth_segments(al.blocks(fx.alignments(t)), scope))


@query(
    "G11_window_coverage",
    f"""WITH {CIGAR}, bl2 AS (SELECT * FROM bl WHERE mapq >= 10 AND aligned >= 5), {DEPTH},
    w AS (SELECT rname, b * 500 + 1 AS ws, least(length, (b + 1) * 500) AS we FROM (SELECT rname, length, unnest(range(cast(ceil(length / 500) as bigint))) AS b FROM len)),
    c AS (SELECT w.rname, ws, we, least(e, we) - greatest(s, ws) + 1 AS n, depth FROM w JOIN sg ON w.rname = sg.rname AND s <= we AND e >= ws)
    SELECT rname AS reference, ws AS "start", we AS "end", we - ws + 1 AS window_size, round(sum(n * depth) / (we - ws + 1), 3) AS mean_depth, max(depth) AS max_depth,
      cast(coalesce(sum(n) FILTER (depth > 0), 0) as bigint) AS covered_bases, round(coalesce(sum(n) FILTER (depth > 0), 0) / (we - ws + 1) * 100, 2) AS covered_percent FROM c GROUP BY 1, 2, 3""",
)
def _g11(t: Tables) -> DataFrame:
    return al.window_coverage(fx.alignments(t), _lengths(t), 500, min_mapq=10, min_aligned_bases=5)


@query("G12_region_query", f"""WITH {CIGAR} SELECT qname, flag, pos, cast(pos + span - 1 as bigint) AS "end", cigar FROM m WHERE rname = 'chr3' AND mapped AND pos <= 9000 AND pos + span - 1 >= 4000""")
def _g12(t: Tables) -> DataFrame:
    return al.region_query(fx.alignments(t), "chr3", 4000, 9000).select("qname", "flag", "pos", "end", "cigar")


@query(
    "G13_alignment_metrics",
    f"""WITH {CIGAR}, x AS (SELECT *, CASE WHEN mapped THEN aligned ELSE 0 END AS ab, cast(right(tags, 1) as int) AS nm FROM m)
    SELECT qname AS read, CASE WHEN mapped THEN rname END AS reference, CASE WHEN mapped THEN pos END AS "start", CASE WHEN mapped THEN pos + span - 1 END AS "end", CASE WHEN mapped THEN CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END END AS strand,
      ab AS aligned_bases, rl AS read_length, CASE WHEN ab > 0 THEN round(greatest(0, least(100, (ab - nm) / ab * 100)), 2) END AS identity_percent, nm AS mismatches,
      CASE WHEN flag & 1 = 0 THEN 'not paired' WHEN NOT mapped THEN 'read unmapped' WHEN flag & 2 <> 0 THEN 'proper pair' ELSE 'paired' END AS pair_status, CASE WHEN mapped THEN 'mapped' ELSE 'unmapped' END AS status FROM x""",
)
def _g13(t: Tables) -> DataFrame:
    return al.alignment_metrics(fx.alignments(t))


# --- reads -------------------------------------------------------------------------------------

METRICS = f"""{fx.READS}, q AS (SELECT read_id, unnest(list_transform(string_split(quality, ''), lambda c: ascii(c) - 33)) AS s FROM reads),
qs AS (SELECT read_id, sum(s) AS q_sum, count(*) AS q_count, count(*) FILTER (s >= 20) AS q20, count(*) FILTER (s >= 30) AS q30, min(s) AS q_min, max(s) AS q_max FROM q GROUP BY 1),
rm AS (SELECT read_id, sequence, length(sequence) AS len, length(regexp_replace(sequence, '[^GC]', '', 'g')) AS gc, length(regexp_replace(sequence, '[^N]', '', 'g')) AS n, length(regexp_replace(sequence, '[^ACGTU]', '', 'g')) AS known FROM reads),
mt AS (SELECT *, gc / known * 100 AS gcp, n / len * 100 AS np, q_sum / q_count AS mq FROM rm JOIN qs USING (read_id))"""


def summary_sql() -> str:
    rows = [
        ("read_count", "cast(nr as varchar)", "reads", "''"), ("total_bases", "cast(nb as varchar)", "bases", "''"), ("min_read_length", "cast(lo as varchar)", "bases", "''"),
        ("mean_read_length", "cast(round(nb / nr, 6) as varchar)", "bases", "''"), ("median_read_length", "cast(round(ml, 6) as varchar)", "bases", "''"), ("max_read_length", "cast(hi as varchar)", "bases", "''"),
        ("gc_percent", "cast(round(gc / nb * 100, 2) as varchar)", "%", "''"), ("median_read_gc_percent", "cast(round(mg, 2) as varchar)", "%", "''"), ("n_count", "cast(n as varchar)", "bases", "''"),
        ("reads_with_n_percent", "cast(round(wn / nr * 100, 2) as varchar)", "%", "CASE WHEN wn / nr <= 0.05 THEN 'low' WHEN wn / nr <= 0.2 THEN 'review' ELSE 'high' END"),
        ("median_read_n_percent", "cast(round(mn, 2) as varchar)", "%", "''"),
        ("mean_phred_quality", "cast(round(qs / qc, 6) as varchar)", "Phred+33", "CASE WHEN qs / qc >= 30 THEN 'good' WHEN qs / qc >= 20 THEN 'review' ELSE 'low' END"),
        ("median_read_mean_quality", "cast(round(mm, 3) as varchar)", "Phred+33", "''"), ("q20_bases_percent", "cast(round(q20 / qc * 100, 2) as varchar)", "%", "''"),
        ("q30_bases_percent", "cast(round(q30 / qc * 100, 2) as varchar)", "%", "CASE WHEN q30 / qc >= 0.8 THEN 'good' WHEN q30 / qc >= 0.5 THEN 'review' ELSE 'low' END"),
        ("duplicate_reads", "cast(du as varchar)", "reads", "''"),
        ("duplicate_reads_percent", "cast(round(du / nr * 100, 2) as varchar)", "%", "CASE WHEN du / nr <= 0.1 THEN 'low' WHEN du / nr <= 0.3 THEN 'review' ELSE 'high' END"),
        ("overrepresented_sequence_count", "cast(rp as varchar)", "sequences", "''"),
        ("quality_encoding_assumption", "'Phred+33'", "", "'assumed, as current sequencers write it'"),
        ("quality_ascii_range", "(qlo + 33) || '-' || (qhi + 33)", "ASCII", "''"),
    ]
    return f"""WITH {METRICS}, d AS (SELECT cast(sum(c - 1) as bigint) AS du, count(*) AS rp FROM (SELECT count(*) AS c FROM reads GROUP BY sequence HAVING count(*) > 1)),
    s AS (SELECT count(*) AS nr, cast(sum(len) as bigint) AS nb, min(len) AS lo, max(len) AS hi, sum(gc) AS gc, cast(sum(n) as bigint) AS n, count(*) FILTER (n > 0) AS wn, sum(q_sum) AS qs, sum(q_count) AS qc, sum(q20) AS q20, sum(q30) AS q30,
      min(q_min) AS qlo, max(q_max) AS qhi, quantile_cont(cast(len as double), 0.5) AS ml, quantile_cont(gcp, 0.5) AS mg, quantile_cont(np, 0.5) AS mn, quantile_cont(mq, 0.5) AS mm FROM mt) """ + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {v} AS value, '{u}' AS unit, {a} AS assessment FROM s, d" for m, v, u, a in rows
    )


@query("G14_fastq_summary", summary_sql())
def _g14(t: Tables) -> DataFrame:
    return rd.fastq_summary(fx.reads(t))


@query(
    "G15_per_base_profile",
    f"""WITH {fx.READS}, c AS (SELECT generate_subscripts(string_split(sequence, ''), 1) AS position, unnest(string_split(sequence, '')) AS b, unnest(string_split(quality, '')) AS q FROM reads), d AS (SELECT position, b, cast(ascii(q) - 33 as double) AS s FROM c)
    SELECT position, count(*) AS read_count, round(avg(s), 3) AS mean_quality, round(quantile_cont(s, 0.25), 3) AS q25_quality, round(quantile_cont(s, 0.5), 3) AS median_quality, round(quantile_cont(s, 0.75), 3) AS q75_quality,
      {", ".join(f"round(count(*) FILTER (b = '{x}') / count(*) * 100, 2) AS {x.lower()}_percent" for x in "ACGTN")}, cast(0 as double) AS other_percent FROM d GROUP BY 1""",
)
def _g15(t: Tables) -> DataFrame:
    return rd.per_base_profile(fx.reads(t))


@query("G16_length_distribution", f"WITH {fx.READS} SELECT length(sequence) AS bin, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 2) AS percent FROM reads GROUP BY 1")
def _g16(t: Tables) -> DataFrame:
    return rd.length_distribution(fx.reads(t))


def _binned_sql(metric: str, high: int, step: int) -> str:
    bins = high // step
    return f"""WITH {METRICS}, f AS (SELECT least({bins - 1}, cast(floor({metric} / {step}) as bigint)) AS i, count(*) AS c FROM mt GROUP BY 1)
    SELECT (i * {step}) || '-' || CASE WHEN i = {bins - 1} THEN {high} ELSE (i + 1) * {step} - 1 END AS bin, coalesce(c, 0) AS count, round(coalesce(c, 0) / (SELECT count(*) FROM mt) * 100, 2) AS percent
    FROM (SELECT unnest(range({bins})) AS i) LEFT JOIN f USING (i)"""


@query("G16_gc_distribution", _binned_sql("gcp", 100, 10))
def _g16b(t: Tables) -> DataFrame:
    return rd.binned_distribution(fx.reads(t), "gc_percent")


@query("G16_quality_distribution", _binned_sql("mq", 50, 5))
def _g16c(t: Tables) -> DataFrame:
    return rd.binned_distribution(fx.reads(t), "mean_quality", high=50, step=5)


@query("G17_overrepresented", f"WITH {fx.READS} SELECT sequence, count(*) AS count, round(count(*) / (SELECT count(*) FROM reads) * 100, 2) AS percent FROM reads GROUP BY 1 HAVING count(*) > 1")
def _g17(t: Tables) -> DataFrame:
    return rd.overrepresented(fx.reads(t))


FILTERED = f"""{fx.READS}, e AS (SELECT read_id, unnest(range(4, length(quality) + 1)) AS e, quality FROM reads),
w AS (SELECT read_id, max(e) AS keep FROM e WHERE (ascii(quality[e-3]) + ascii(quality[e-2]) + ascii(quality[e-1]) + ascii(quality[e]) - 132) / 4 >= 20 GROUP BY 1),
tr AS (SELECT r.read_id, title, substr(sequence, 1, coalesce(keep, 0)) AS sequence, plus, substr(quality, 1, coalesce(keep, 0)) AS quality FROM reads r LEFT JOIN w USING (read_id)),
jd AS (SELECT *, CASE WHEN length(sequence) < 20 THEN 'too_short' WHEN len(list_filter(string_split(sequence, ''), lambda c: c = 'N')) > 0 THEN 'too_many_n'
  WHEN len(list_filter(string_split(quality, ''), lambda c: c <> '' AND ascii(c) - 33 < 20)) / length(quality) * 100 > 55 THEN 'low_quality' ELSE 'passed' END AS reason FROM tr)"""


@query("G18_filter_reads", f"WITH {FILTERED} SELECT * FROM jd")
def _g18(t: Tables) -> DataFrame:
    return rd.filter_reads(fx.reads(t), minimum_length=20, maximum_n=0, max_low_quality_percent=55, keep_failed=True)


@query(
    "G18_filter_report",
    f"""WITH {FILTERED}, b AS (SELECT 'before' AS stage, sequence AS s, quality AS q FROM reads UNION ALL SELECT 'after', sequence, quality FROM jd WHERE reason = 'passed'),
    c AS (SELECT stage, length(s) AS n, length(regexp_replace(s, '[^GC]', '', 'g')) AS gc, len(list_filter(string_split(q, ''), lambda x: ascii(x) - 33 >= 30)) AS q30 FROM b)
    SELECT stage, count(*) AS reads, cast(sum(n) as bigint) AS bases, round(sum(q30) / sum(n) * 100, 3) AS q30_percent, round(sum(gc) / sum(n) * 100, 3) AS gc_percent FROM c GROUP BY 1""",
)
def _g18b(t: Tables) -> DataFrame:
    reads = fx.reads(t)
    return rd.filter_report(reads, rd.filter_reads(reads, minimum_length=20, maximum_n=0, max_low_quality_percent=55))


@query("W9_sample_reads", f"WITH {fx.READS} SELECT * FROM reads ORDER BY md5(read_id || '|5') LIMIT 400")
def _w9(t: Tables) -> DataFrame:
    return rd.sample_reads(fx.reads(t), 400, 5, "read_id")


@query(
    "W9_sample_read_pairs",
    f"""WITH {fx.READS}, s AS (SELECT * FROM reads ORDER BY md5(read_id || '|5') LIMIT 400) SELECT * FROM s UNION ALL SELECT * REPLACE (regexp_replace(title, '/1$', '/2') AS title) FROM s""",
)
def _w9b(t: Tables) -> DataFrame:
    first = fx.reads(t)
    second = first.withColumn("title", F.regexp_replace("title", "/1$", "/2"))
    a, b = rd.sample_reads(first, 400, 5, "read_id", second)
    return a.unionByName(b)
