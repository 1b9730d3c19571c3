"""Queries for interval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators import intervals as iv
from assayloom.plans import fixtures as fx
from assayloom.plans.registry import Tables, query

PAIRS = f"""{fx.INTERVALS}, p AS (SELECT a.record, a."start", a."end", a.name, a.strand, b."start" AS ps, b."end" AS pe, b.name AS pn,
  least(a."end", b."end") - greatest(a."start", b."start") + 1 AS ov FROM a JOIN b ON a.record = b.record AND a."start" <= b."end" AND b."start" <= a."end")"""
ISLANDS = """{r} AS (SELECT record, "start", "end", max("end") OVER (PARTITION BY record ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe, name FROM {t}),
{r}2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR pe + {gap} + 1 < "start" THEN 1 ELSE 0 END) OVER (PARTITION BY record ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {r}),
{r}3 AS (SELECT record, g, min("start") AS "start", max("end") AS "end", count(*) AS n, arg_min(name, ("start", "end", name)) AS name FROM {r}2 GROUP BY 1, 2)"""


@query(
    "I1_intersect",
    f"""WITH {PAIRS} SELECT record, "start", "end", name, 'intersect' AS operation, ps AS partner_start, pe AS partner_end, pn AS partner_name, ov AS overlap_bp, strand FROM p""",
)
def _i1(t: Tables) -> DataFrame:
    return iv.intersect(fx.intervals_a(t), fx.intervals_b(t))


@query(
    "I1_intersect_reciprocal",
    f"""WITH {PAIRS} SELECT record, "start", "end", name, 'intersect' AS operation, ps AS partner_start, pe AS partner_end, pn AS partner_name, ov AS overlap_bp, strand
    FROM p WHERE ov >= 5 AND ov / ("end" - "start" + 1) >= 0.25 AND ov / (pe - ps + 1) >= 0.25""",
)
def _i1b(t: Tables) -> DataFrame:
    return iv.intersect(fx.intervals_a(t), fx.intervals_b(t), min_overlap_bp=5, min_reciprocal_percent=25)


@query(
    "J5_overlap_join_long_and_short",
    f"""WITH {fx.INTERVALS}, w AS (SELECT record, min("start") AS "start", max("end") AS "end", record || '_' || cast(floor("start" / 5000) as bigint) AS name FROM b GROUP BY record, floor("start" / 5000))
    SELECT w.name, count(*) AS hits, cast(sum(least(a."end", w."end") - greatest(a."start", w."start") + 1) as bigint) AS overlap_bp
    FROM a JOIN w ON a.record = w.record AND a."start" <= w."end" AND w."start" <= a."end" GROUP BY 1""",
)
def _j5(t: Tables) -> DataFrame:
    b = fx.intervals_b(t)
    block = F.floor(F.col("start") / 5000)
    wide = b.groupBy("record", block.alias("k")).agg(F.min("start").alias("start"), F.max("end").alias("end")).select(
        "record", "start", "end", F.concat_ws("_", "record", F.col("k").cast("string")).alias("name")
    )
    return iv.range_join(fx.intervals_a(t), wide).groupBy(F.col("b_name").alias("name")).agg(
        F.count(F.lit(1)).alias("hits"), F.sum(iv.overlap_bp()).alias("overlap_bp")
    )


@query(
    "I2_subtract",
    f"""WITH {fx.INTERVALS}, {ISLANDS.format(r="m", t="b", gap=0)},
    runs AS (SELECT record, "start" AS rs, "end" AS re, lead("start") OVER (PARTITION BY record ORDER BY "start") AS ns, row_number() OVER (PARTITION BY record ORDER BY "start") AS k FROM m3),
    holes AS (SELECT record, re + 1 AS hs, coalesce(ns - 1, 1000000000000) AS he FROM runs UNION ALL SELECT record, 0, rs - 1 FROM runs WHERE k = 1
      UNION ALL SELECT DISTINCT record, 0, 1000000000000 FROM a WHERE record NOT IN (SELECT record FROM b))
    SELECT a.record, a.name, a.strand, greatest(a."start", hs) AS "start", least(a."end", he) AS "end", 'subtract' AS operation FROM a JOIN holes h ON a.record = h.record AND a."start" <= he AND hs <= a."end" AND hs <= he""",
)
def _i2(t: Tables) -> DataFrame:
    return iv.subtract(fx.intervals_a(t), fx.intervals_b(t))


@query(
    "I3_merge",
    f"""WITH {fx.INTERVALS}, {ISLANDS.format(r="m", t="a", gap=0)} SELECT record, "start", "end", name, 'merge' AS operation, n AS interval_count FROM m3""",
)
def _i3(t: Tables) -> DataFrame:
    return iv.merge(fx.intervals_a(t))


@query(
    "I3_merge_gap",
    f"""WITH {fx.INTERVALS}, {ISLANDS.format(r="m", t="b", gap=120)} SELECT record, "start", "end", name, 'merge' AS operation, n AS interval_count FROM m3""",
)
def _i3b(t: Tables) -> DataFrame:
    return iv.merge(fx.intervals_b(t), gap=120)


@query(
    "I3_merge_members",
    f"""WITH {fx.INTERVALS}, {ISLANDS.format(r="m", t="b", gap=120)} SELECT record, m3."start" AS run_start, m3."end" AS run_end, m2."start", m2."end", m2.name FROM m2 JOIN m3 USING (record, g)""",
)
def _i3c(t: Tables) -> DataFrame:
    return iv.merge_members(fx.intervals_b(t), gap=120)


@query(
    "I4_nearest",
    f"""WITH {fx.INTERVALS}, d AS (SELECT a.record, a."start", a."end", a.name, a.strand, b."start" AS ps, b."end" AS pe, b.name AS pn, cast(substr(b.name, 5) as bigint) AS o,
      CASE WHEN a."start" <= b."end" AND b."start" <= a."end" THEN 0 WHEN a."end" < b."start" THEN b."start" - a."end" ELSE a."start" - b."end" END AS dist FROM a JOIN b USING (record)),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dist, o) AS k FROM d)
    SELECT record, "start", "end", name, strand, 'nearest' AS operation, ps AS partner_start, pe AS partner_end, pn AS partner_name,
      cast(greatest(0, least("end", pe) - greatest("start", ps) + 1) as bigint) AS overlap_bp, dist AS distance_bp FROM r WHERE k = 1""",
)
def _i4(t: Tables) -> DataFrame:
    b = fx.intervals_b(t).withColumn("row_id", F.substring("name", 5, 20).cast("bigint"))
    return iv.nearest(fx.intervals_a(t), b, query_id="name", order="row_id")


@query(
    "J6_nearest_sparse",
    f"""WITH {fx.INTERVALS}, s AS (SELECT * FROM b),
    d AS (SELECT a.name, s.name AS pn, CASE WHEN a."start" <= s."end" AND s."start" <= a."end" THEN 0 WHEN a."end" < s."start" THEN s."start" - a."end" ELSE a."start" - s."end" END AS dist, cast(substr(s.name, 5) as bigint) AS o FROM a JOIN s USING (record)),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dist, o) AS k FROM d) SELECT name, pn AS partner_name, dist AS distance_bp FROM r WHERE k = 1""",
)
def _j6(t: Tables) -> DataFrame:
    b = fx.intervals_b(t).withColumn("row_id", F.substring("name", 5, 20).cast("bigint"))
    return iv.nearest(fx.intervals_a(t), b, query_id="name", order="row_id").select("name", "partner_name", "distance_bp")


@query(
    "I5_union_length",
    f"""WITH {fx.INTERVALS}, {ISLANDS.format(r="m", t="a", gap=0)} SELECT record, cast(sum("end" - "start" + 1) as bigint) AS union_bp, count(*) AS runs FROM m3 GROUP BY 1""",
)
def _i5(t: Tables) -> DataFrame:
    return iv.union_length(fx.intervals_a(t))


def _blocks(t: Tables) -> DataFrame:
    start, size = F.col("l_partkey") * 10 + F.col("l_linenumber"), F.col("l_quantity").cast("bigint")
    return t.lineitem.select(
        F.concat(F.lit("g"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("comparison"), start.alias("reference_start"), (start + size).alias("reference_end"),
        (F.col("l_orderkey") * 3).alias("comparison_start"), (F.col("l_orderkey") * 3 + size).alias("comparison_end"), size.alias("block_length"),
        (90 + F.col("l_discount") * 100).alias("identity"), (F.col("l_partkey") % 61).alias("mapq"), F.when(F.col("l_linenumber") == 3, "-").otherwise("+").alias("strand"),
    )


BLOCKS = """blocks AS (SELECT 'g' || (l_suppkey % 22 + 1) AS comparison, l_partkey * 10 + l_linenumber AS rs, l_partkey * 10 + l_linenumber + cast(l_quantity as bigint) AS re,
  l_orderkey * 3 AS cs, l_orderkey * 3 + cast(l_quantity as bigint) AS ce, cast(l_quantity as bigint) AS bl, 90 + l_discount * 100 AS identity, l_partkey % 61 AS mapq, CASE WHEN l_linenumber = 3 THEN '-' ELSE '+' END AS strand FROM lineitem),
lens AS (SELECT comparison, max(ce) AS comparison_length FROM blocks GROUP BY 1), f AS (SELECT * FROM blocks WHERE identity >= 92 AND bl >= 5 AND mapq >= 10 AND strand <> '-'),
ri AS (SELECT comparison AS record, rs + 1 AS "start", re AS "end", '' AS name FROM f), ci AS (SELECT comparison AS record, cs + 1 AS "start", ce AS "end", '' AS name FROM f)"""


@query(
    "I6_block_summary",
    f"""WITH {BLOCKS}, {ISLANDS.format(r="x", t="ri", gap=0)}, {ISLANDS.format(r="y", t="ci", gap=0)},
    xr AS (SELECT record, cast(sum("end" - "start" + 1) as bigint) AS bp FROM x3 GROUP BY 1), yr AS (SELECT record, cast(sum("end" - "start" + 1) as bigint) AS bp FROM y3 GROUP BY 1),
    w AS (SELECT comparison, count(*) AS n, sum(identity * bl) / sum(bl) AS m FROM f GROUP BY 1)
    SELECT l.comparison, comparison_length, coalesce(n, 0) AS block_count, coalesce(xr.bp, 0) AS aligned_reference_bp, round(coalesce(xr.bp, 0) / 50000 * 100, 2) AS reference_coverage_percent,
      coalesce(yr.bp, 0) AS aligned_comparison_bp, round(coalesce(yr.bp, 0) / comparison_length * 100, 2) AS comparison_coverage_percent, round(m, 2) AS mean_identity_percent
    FROM lens l LEFT JOIN w USING (comparison) LEFT JOIN xr ON xr.record = l.comparison LEFT JOIN yr ON yr.record = l.comparison""",
)
def _i6(t: Tables) -> DataFrame:
    blocks = _blocks(t)
    lengths = blocks.groupBy("comparison").agg(F.max("comparison_end").alias("comparison_length"))
    kept = iv.filter_blocks(blocks, min_identity=92, min_length=5, min_mapq=10, include_reverse=False)
    return iv.block_summary(kept, lengths, 50000)


@query(
    "I7_features_at",
    f"""WITH {fx.INTERVALS} SELECT a.record, a."start" AS position, a.name, b."start" AS feature_start, b."end" AS feature_end, b.name AS feature_name, b.strand AS feature_strand
    FROM a JOIN b ON a.record = b.record AND a."start" BETWEEN b."start" AND b."end" """,
)
def _i7(t: Tables) -> DataFrame:
    points = fx.intervals_a(t).select("record", F.col("start").alias("position"), "name")
    return iv.features_at(points, fx.intervals_b(t))


@query(
    "I7_match_layers",
    f"""WITH {fx.INTERVALS}, l AS (SELECT record, max("end") - 200 AS length FROM b WHERE record <> 'chr5' GROUP BY 1)
    SELECT a.record, "start", "end", name, strand, CASE WHEN length IS NULL THEN 'no_record' WHEN "start" >= 1 AND "end" <= length THEN 'ok' ELSE 'out_of_bounds' END AS layer_status FROM a LEFT JOIN l USING (record)""",
)
def _i7b(t: Tables) -> DataFrame:
    lengths = fx.intervals_b(t).filter("record <> 'chr5'").groupBy("record").agg((F.max("end") - 200).alias("length"))
    return iv.match_layers(fx.intervals_a(t), lengths)


def _features(t: Tables) -> DataFrame:
    return fx.intervals_b(t).join(
        t.part.select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"), "p_brand", "p_type", "p_name", "p_size"), "name"
    ).select(
        "record", "start", "end", F.when(F.col("p_size") % 2 == 0, "-").otherwise("+").alias("strand"), F.col("p_type").alias("type"),
        F.create_map(F.lit("Gene"), F.col("p_brand"), F.lit("note"), F.col("p_name")).alias("attributes"), "name",
    )


@query(
    "I8_filter_features",
    f"""WITH {fx.INTERVALS} SELECT b.record, b."start", b."end", b.name FROM b JOIN part ON b.name = 'part' || p_partkey
    WHERE p_size % 2 = 0 AND p_type IN ('ECONOMY', 'PROMO') AND b."end" >= 500 AND b."start" <= 15000 AND contains(lower(p_brand), 'brand#1') AND contains(lower(p_name), 'red')""",
)
def _i8(t: Tables) -> DataFrame:
    out = iv.filter_features(
        _features(t), types=["economy", "Promo"], strand="-", start=500, end=15000, qualifier="gene", qualifier_value="BRAND#1", text="red"
    )
    return out.select("record", "start", "end", "name")


def _regions(t: Tables) -> DataFrame:
    start = F.col("l_linenumber") * 11 + F.col("l_suppkey") % 40 - 20
    return t.lineitem.select(
        fx.line_name().alias("name"), F.col("l_partkey").alias("record"), start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("end"),
        F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


REGIONS = f"""regions AS (SELECT {fx.LINE_NAME} AS name, l_partkey AS record, l_linenumber * 11 + l_suppkey % 40 - 20 AS rs,
  l_linenumber * 11 + l_suppkey % 40 - 20 + cast(l_quantity as bigint) AS re, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem)"""


@query(
    "I9_extract_regions",
    f"""WITH {fx.SEQS}, {REGIONS}, c AS (SELECT name, record, strand, greatest(1, rs) AS "start", least(re, length(sequence)) AS "end", sequence AS s FROM regions JOIN seqs USING (record))
    SELECT name, record, "start", "end", strand, CASE WHEN strand = '-' THEN reverse(translate(substr(s, "start", "end" - "start" + 1), 'ACGT', 'TGCA')) ELSE substr(s, "start", "end" - "start" + 1) END AS sequence FROM c WHERE "start" <= "end" """,
)
def _i9(t: Tables) -> DataFrame:
    return iv.extract_regions(_regions(t), fx.sequences(t).select("record", "sequence"), key=["name"])


@query(
    "I9_selected_regions_complement",
    f"""WITH {fx.SEQS}, {REGIONS}, c AS (SELECT record, greatest(1, rs) AS s, least(re, 128) AS e FROM regions WHERE re >= 1 AND rs <= 128), p AS (SELECT record, unnest(range(1, 129)) AS x FROM seqs),
    u AS (SELECT record, x FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.record = p.record AND x BETWEEN s AND e)), g AS (SELECT record, x, x - row_number() OVER (PARTITION BY record ORDER BY x) AS k FROM u)
    SELECT record, min(x) AS "start", max(x) AS "end" FROM g GROUP BY record, k""",
)
def _i9b(t: Tables) -> DataFrame:
    lengths = fx.sequences(t).select("record", F.length("sequence").cast("bigint").alias("length"))
    return iv.selected_regions(_regions(t).select("record", "start", "end"), lengths, complement=True)


@query(
    "I10_splice_transcripts",
    f"""WITH {fx.SEQS}, x AS (SELECT 'tx' || l_partkey AS transcript, l_partkey AS record, l_linenumber * 15 AS s, l_linenumber * 15 + least(14, max(cast(l_quantity as bigint))) AS e, CASE WHEN l_partkey % 2 = 0 THEN '-' ELSE '+' END AS strand FROM lineitem GROUP BY l_partkey, l_linenumber),
    c AS (SELECT transcript, record, strand, s, least(e, 128) AS e, substr(sequence, s, least(e, 128) - s + 1) AS q FROM x JOIN seqs USING (record) WHERE s <= 128),
    j AS (SELECT transcript, record, strand, string_agg(q, '' ORDER BY s) AS q, count(*) AS parts, min(s) AS "start", max(e) AS "end" FROM c GROUP BY 1, 2, 3)
    SELECT transcript, record, strand, CASE WHEN strand = '-' THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END AS sequence, parts, cast("start" as bigint) AS "start", "end", length(q) AS length FROM j""",
)
def _i10(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    parts = t.lineitem.groupBy("l_partkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("bigint")).alias("q")).select(
        F.concat(F.lit("tx"), F.col("l_partkey").cast("string")).alias("transcript"), F.col("l_partkey").alias("record"), (n * 15).alias("start"),
        (n * 15 + F.least(F.lit(14), F.col("q"))).alias("end"), F.when(F.col("l_partkey") % 2 == 0, "-").otherwise("+").alias("strand"),
    )
    return iv.splice_transcripts(parts, fx.sequences(t).select("record", "sequence"))
