"""Queries for sequence-scale jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.functions.sequence import ALL_CODONS, GENETIC_CODES, start_codons, stop_codons
from assayloom.operators import kmers as km
from assayloom.operators import scans as sc
from assayloom.operators import sequences as sq
from assayloom.plans import fixtures as fx
from assayloom.plans.registry import Tables, query

RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _n(symbols: str, text: str) -> str:
    return f"cast(length({text}) - length(translate({text}, '{symbols}', '')) as bigint)"


def _words_sql(name: str, source: str, k: int, extra: str = "") -> str:
    return f"""{name} AS (SELECT record, length(sequence) AS len, i AS p, substr(sequence, i, {k}) AS w{extra} FROM (SELECT *, unnest(range(1, length(sequence) - {k} + 2)) AS i FROM {source}))"""


def _stats_sql() -> str:
    each = ", ".join(f"{_n(s, 'sequence')} AS n_{s}" for s in sq.DNA_SYMBOLS)
    sums = ", ".join(f"cast(sum(n_{s}) as bigint) AS n_{s}" for s in sq.DNA_SYMBOLS)
    out = ", ".join(f"n_{s} AS \"count_{s}\"" for s in sq.DNA_SYMBOLS)
    ambiguous = " + ".join(f"n_{s}" for s in "RYSWKMBDHVNX")
    return f"""WITH {fx.SEQS}, c AS (SELECT title, length(sequence) AS length, {each}, cast(0 as bigint) AS n_gaps FROM seqs),
    t AS (SELECT * FROM c UNION ALL SELECT 'Total', cast(sum(length) as bigint), {sums}, cast(0 as bigint) FROM c)
    SELECT title, length, n_A + n_C + n_G + n_T + n_U AS unambiguous_bases, n_G + n_C AS gc_count, round((n_G + n_C) / (n_A + n_C + n_G + n_T + n_U) * 100, 6) AS gc_percent, {ambiguous} AS ambiguous_symbols,
      n_N AS n_count, n_X AS x_count, {out}, n_gaps AS count_gaps FROM t"""


@query("Q1_dna_stats", _stats_sql())
def _q1(t: Tables) -> DataFrame:
    return sq.dna_stats(fx.sequences(t))


def _protein_sql() -> str:
    residues = list(sq.RESIDUE_MASS)
    each = ", ".join(f"{_n(r, 'sequence')} AS n_{r}" for r in residues)
    sums = ", ".join(f"cast(sum(n_{r}) as bigint) AS n_{r}" for r in residues)
    mass = " + ".join(f"n_{r} * {m}" for r, m in sq.RESIDUE_MASS.items()) + f" + {sq.WATER_MASS}"
    charge = " + ".join(f"{'1' if k == 'n_terminus' else 'n_' + k} / {1 + 10 ** (7 - p)!r}" for k, p in sq.PKA_POSITIVE.items()) + "".join(
        f" - {'1' if k == 'c_terminus' else 'n_' + k} / {1 + 10 ** (p - 7)!r}" for k, p in sq.PKA_NEGATIVE.items())
    standard = " + ".join(f"n_{r}" for r in residues)
    return f"""WITH {fx.PROTEINS}, c AS (SELECT title, length(sequence) AS length, {each} FROM prots), t AS (SELECT * FROM c UNION ALL SELECT 'Total', cast(sum(length) as bigint), {sums} FROM c)
    SELECT title, length, {standard} AS standard_residues, cast(0 as bigint) AS ambiguous_residues, cast(0 as bigint) AS uncommon_residues, cast(0 as bigint) AS stop_count, round(cast({mass} as double), 4) AS molecular_weight,
      round(({mass}) / ({standard}), 4) AS average_residue_weight, round(cast({charge} as double), 6) AS charge, {", ".join(f'n_{r} AS "count_{r}"' for r in residues)} FROM t"""


@query("Q2_protein_stats", _protein_sql())
def _q2(t: Tables) -> DataFrame:
    return sq.protein_stats(fx.proteins(t), isoelectric_point=False)


def _charge_sql(ph: str) -> str:
    return " + ".join(f"{'1' if k == 'n_terminus' else 'n_' + k} / (1 + power(10, {ph} - {p}))" for k, p in sq.PKA_POSITIVE.items()) + "".join(
        f" - {'1' if k == 'c_terminus' else 'n_' + k} / (1 + power(10, {p} - {ph}))" for k, p in sq.PKA_NEGATIVE.items())


def _isoelectric_sql() -> str:
    ionic = "HKRCDEY"
    each, sums = ", ".join(f"{_n(r, 'sequence')} AS n_{r}" for r in ionic), ", ".join(f"cast(sum(n_{r}) as bigint)" for r in ionic)
    names, middle = ", ".join(f"n_{r}" for r in ionic), "(low + high) / 2"
    return f"""WITH RECURSIVE {fx.PROTEINS}, c AS (SELECT title, length(sequence) AS length, {each} FROM prots), t AS (SELECT * FROM c UNION ALL SELECT 'Total', cast(sum(length) as bigint), {sums} FROM c),
    b AS (SELECT title, length, {names}, cast(0 as double) AS low, cast(14 as double) AS high, 0 AS step FROM t
      UNION ALL SELECT title, length, {names}, CASE WHEN {_charge_sql(middle)} > 0 THEN {middle} ELSE low END, CASE WHEN {_charge_sql(middle)} > 0 THEN high ELSE {middle} END, step + 1 FROM b WHERE step < 50)
    SELECT title, length, round({_charge_sql('7.0')}, 6) AS charge, round({middle}, 4) AS isoelectric_point FROM b WHERE step = 50"""


@query("Q2_isoelectric_point", _isoelectric_sql())
def _q2b(t: Tables) -> DataFrame:
    return sq.protein_stats(fx.proteins(t)).select("title", "length", "charge", "isoelectric_point")


HYDRO = "CASE c " + " ".join(f"WHEN '{r}' THEN cast({v} as double)" for r, v in sq.HYDROPATHY.items()) + " END"


@query(
    "Q3_hydropathy_windows",
    f"""WITH {fx.PROTEINS}, ch AS (SELECT record, i, {HYDRO} AS h FROM (SELECT record, unnest(range(1, length(sequence) + 1)) AS i, unnest(string_split(sequence, '')) AS c FROM prots)),
    w AS (SELECT record, i AS s, sum(h) OVER win AS h, count(h) OVER win AS n, count(*) OVER win AS m FROM ch WINDOW win AS (PARTITION BY record ORDER BY i ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING))
    SELECT record, s + 4.0::double AS position, s AS window_start, s + 8 AS window_end, cast(9 as bigint) AS window_size, n AS standard_residues, 9 - n AS excluded_symbols, round(h / n, 4) AS hydropathy FROM w WHERE m = 9""",
)
def _q3(t: Tables) -> DataFrame:
    return sq.hydropathy_windows(fx.proteins(t), 9).withColumn("hydropathy", F.round("hydropathy", 4))


@query("Q3_gravy", f"""WITH {fx.PROTEINS}, ch AS (SELECT record, {HYDRO} AS h FROM (SELECT record, unnest(string_split(sequence, '')) AS c FROM prots)) SELECT record, round(avg(h), 6) AS gravy, count(h) AS residue_count FROM ch GROUP BY 1""")
def _q3b(t: Tables) -> DataFrame:
    return sq.gravy(fx.proteins(t))


@query(
    "W7_composition_windows",
    f"""WITH {fx.SEQS}, w AS (SELECT record, s, substr(sequence, s, 30) AS x FROM (SELECT *, unnest(range(1, length(sequence) - 28, 7)) AS s FROM seqs)),
    c AS (SELECT record, s, {_n('A', 'x')} AS a, {_n('C', 'x')} AS c, {_n('G', 'x')} AS g, {_n('T', 'x')} AS t FROM w)
    SELECT record, s AS window_start, s + 29 AS window_end, s + 14.5::double AS position, cast(30 as bigint) AS window_size, a AS a_count, c AS c_count, g AS g_count, t AS t_u_count, cast(0 as bigint) AS ambiguous_count,
      round((g + c) / 30 * 100, 6) AS gc_percent, round((a + t) / 30 * 100, 6) AS at_percent, CASE WHEN g + c > 0 THEN round((g - c) / (g + c), 6) END AS gc_skew, CASE WHEN a + t > 0 THEN round((a - t) / (a + t), 6) END AS at_skew, cast(0 as double) AS ambiguous_percent FROM c""",
)
def _w7(t: Tables) -> DataFrame:
    return sq.composition_windows(fx.sequences(t), 30, 7)


@query(
    "Q4_filter_sequences",
    f"""WITH {fx.SEQS}, h AS (SELECT *, length(regexp_extract(sequence, '^(T{{2,}})', 1)) AS hd, length(regexp_extract(sequence, '(A{{2,}})$', 1)) AS tl FROM seqs),
    c AS (SELECT *, substr(sequence, hd + 1, 128 - hd - tl) AS s FROM h), m AS (SELECT *, length(s) AS n, round({_n('GC', 's')} / length(s) * 100, 2) AS gc FROM c),
    r AS (SELECT *, concat_ws('; ', CASE WHEN n < 127 THEN 'length ' || n || ' is shorter than minimum 127' END, CASE WHEN NOT contains(lower(title), 'red') THEN 'title does not contain "red"' END,
      CASE WHEN NOT contains(s, 'ACG') THEN 'sequence does not contain "ACG"' END, CASE WHEN gc < 45 THEN 'GC percent is below 45' END, CASE WHEN gc > 55 THEN 'GC percent is above 55' END) AS reason FROM m)
    SELECT record, title, cast(128 as bigint) AS length, n AS output_length, gc AS gc_percent, cast(0 as bigint) AS ambiguous_count, hd AS trimmed_5_prime, tl AS trimmed_3_prime, CASE WHEN reason = '' THEN 'kept' ELSE 'removed' END AS status, reason, s AS sequence FROM r""",
)
def _q4(t: Tables) -> DataFrame:
    return sq.filter_sequences(fx.sequences(t), min_length=127, title_contains="red", sequence_contains="acg", min_gc=45, max_gc=55, max_ambiguous=0, trim_poly_at=2)


@query(
    "Q5_rename_headers",
    f"""WITH {fx.SEQS}, n AS (SELECT *, row_number() OVER (ORDER BY record) AS k FROM seqs), x AS (SELECT *, 'lab_' || regexp_replace(title, 'seq(\\d+) ', 'S\\1:') || '_' || lpad(cast(k + 9 as varchar), 5, '0') AS nt FROM n)
    SELECT record, title AS original_title, regexp_replace(regexp_replace(nt, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS new_title, length(sequence) AS length, true AS changed, sequence FROM x""",
)
def _q5(t: Tables) -> DataFrame:
    return sq.rename_headers(fx.sequences(t), "record", find=r"seq(\d+) ", replace="S$1:", regex=True, prefix="lab_", number="suffix", number_start=10, number_width=5, safe_ids=True)


@query("Q5_duplicate_titles", "SELECT replace(p_name, ' ', '_') AS new_title, count(*) AS count FROM part GROUP BY 1 HAVING count(*) > 1")
def _q5b(t: Tables) -> DataFrame:
    named = t.part.select("p_partkey", F.col("p_name").alias("title"), F.lit("ACGT").alias("sequence"))
    return sq.duplicate_titles(sq.rename_headers(named, "p_partkey", safe_ids=True))


@query(
    "Q6_clean_sequences",
    """SELECT doc_id, length(regexp_replace(text, '[ACGTURYSWKMBDHVNXacgturyswkmbdhvnx]', '', 'g')) AS removed_count, upper(regexp_replace(text, '[^ACGTURYSWKMBDHVNXacgturyswkmbdhvnx]', '', 'g')) AS sequence FROM documents""",
)
def _q6(t: Tables) -> DataFrame:
    return sq.clean_sequences(t.documents.select("doc_id", F.col("text").alias("sequence")), case="upper").select("doc_id", "removed_count", "sequence")


@query("Q7_reverse_complement", f"WITH {fx.SEQS} SELECT record, title, {RC.format('sequence')} AS sequence FROM seqs")
def _q7(t: Tables) -> DataFrame:
    return sq.reverse_complements(fx.sequences(t))


CODON_TABLE = "code AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in zip(ALL_CODONS, GENETIC_CODES[1])) + ") v(codon, aa))"


@query(
    "Q8_translate_frames",
    f"""WITH {fx.SEQS}, {CODON_TABLE}, f AS (SELECT record, title, fr AS frame, CASE WHEN fr < 0 THEN {RC.format('sequence')} ELSE sequence END AS s, abs(fr) - 1 AS o FROM seqs, (SELECT unnest([1, 2, 3, -1, -2, -3]) AS fr)),
    c AS (SELECT record, title, frame, o, i, substr(s, cast(o + 3 * i + 1 as bigint), 3) AS codon FROM (SELECT *, unnest(range((128 - o) // 3)) AS i FROM f)),
    p AS (SELECT record, title, frame, o, string_agg(aa, '' ORDER BY i) AS protein FROM c JOIN code USING (codon) GROUP BY ALL)
    SELECT record, title AS source_title, title || ' frame ' || frame AS title, frame, 1 AS genetic_code, length(protein) AS length, cast(0 as bigint) AS ambiguous_codons, cast((128 - o) % 3 as bigint) AS trailing_bases, frame < 0 AS reverse, cast(o as bigint) AS "offset", protein FROM p""",
)
def _q8(t: Tables) -> DataFrame:
    return sq.translate_frames(fx.sequences(t))


def _quoted(codons: list[str]) -> str:
    return ", ".join(f"'{c}'" for c in codons)


ORF = f"""{fx.SEQS}, o0 AS (SELECT record, '+' AS strand, sequence AS s FROM seqs UNION ALL SELECT record, '-', {RC.format('sequence')} FROM seqs),
cd AS (SELECT record, strand, i AS p, (i - 1) % 3 + 1 AS f, substr(s, i, 3) AS c FROM (SELECT *, unnest(range(1, 127)) AS i FROM o0)),
st AS (SELECT record, strand, f, p, c FROM cd WHERE c IN ({_quoted(stop_codons())})),
sg AS (SELECT *, count(*) FILTER (c IN ({_quoted(stop_codons())})) OVER (PARTITION BY record, strand, f ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM cd)"""
ORF_OUT = """SELECT record, strand || f AS frame, strand, CASE strand WHEN '+' THEN b ELSE 128 - e + 1 END AS "start", CASE strand WHEN '+' THEN e ELSE 128 - b + 1 END AS "end", e - b + 1 AS nt_length, aa AS aa_length"""


@query(
    "Q9_find_orfs",
    f"""WITH {ORF}, g AS (SELECT record, strand, f, seg, min(p) FILTER (c IN ({_quoted(start_codons())})) AS b, max(p) FILTER (c IN ({_quoted(stop_codons())})) AS stop, arg_max(c, p) FILTER (c IN ({_quoted(stop_codons())})) AS sc, max(p) AS lastp FROM sg GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, coalesce(stop, lastp) + 2 AS e, coalesce((stop - b) // 3, (lastp + 3 - b) // 3) AS aa FROM g WHERE b IS NOT NULL)
    {ORF_OUT}, c AS start_codon, coalesce(sc, '') AS stop_codon, sc IS NOT NULL AS complete FROM r JOIN (SELECT record, strand, p, c FROM cd) x USING (record, strand) WHERE x.p = b AND aa >= 10""",
)
def _q9(t: Tables) -> DataFrame:
    return sq.find_orfs(fx.sequences(t), min_aa=10)


@query(
    "Q9_find_orfs_any_codon",
    f"""WITH {ORF}, g AS (SELECT record, strand, f, seg, min(p) AS b, max(p) FILTER (c IN ({_quoted(stop_codons())})) AS stop, arg_max(c, p) FILTER (c IN ({_quoted(stop_codons())})) AS sc, max(p) AS lastp FROM sg GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, coalesce(stop, lastp) + 2 AS e, coalesce((stop - b) // 3, (lastp + 3 - b) // 3) AS aa FROM g)
    {ORF_OUT}, coalesce(sc, '') AS stop_codon, sc IS NOT NULL AS complete FROM r WHERE aa >= 15""",
)
def _q9b(t: Tables) -> DataFrame:
    return sq.find_orfs(fx.sequences(t), mode="any-codon", min_aa=15).drop("start_codon")


USAGE = f"""{fx.SEQS}, {CODON_TABLE}, cn AS (SELECT record, substr(sequence, cast(3 * i + 1 as bigint), 3) AS codon FROM (SELECT *, unnest(range(42)) AS i FROM seqs))"""


@query(
    "Q10_codon_usage",
    f"""WITH {USAGE}, k AS (SELECT record, codon, count(*) AS n FROM cn GROUP BY 1, 2), g AS (SELECT record, codon, aa, coalesce(n, 0) AS n FROM seqs CROSS JOIN code LEFT JOIN k USING (record, codon)),
    w AS (SELECT *, sum(n) OVER (PARTITION BY record) AS t, sum(n) OVER (PARTITION BY record, aa) AS f FROM g)
    SELECT record, aa AS amino_acid, codon, n AS count, round(n / t * 1000, 6) AS per_1000, CASE WHEN f > 0 THEN round(n / f, 6) ELSE 0 END AS fraction, cast(f as bigint) AS amino_acid_total FROM w""",
)
def _q10(t: Tables) -> DataFrame:
    return sq.codon_usage(fx.sequences(t))


@query(
    "Q10_codon_usage_merged",
    f"""WITH {USAGE}, k AS (SELECT codon, aa, count(*) AS n FROM cn JOIN code USING (codon) GROUP BY 1, 2)
    SELECT 'All records' AS record, aa AS amino_acid, codon, n AS count, round(n / sum(n) OVER () * 1000, 6) AS per_1000, round(n / sum(n) OVER (PARTITION BY aa), 6) AS fraction, cast(sum(n) OVER (PARTITION BY aa) as bigint) AS amino_acid_total FROM k""",
)
def _q10b(t: Tables) -> DataFrame:
    return sq.codon_usage(fx.sequences(t), merged=True)


@query(
    "Q10_codon_summary",
    f"""WITH {USAGE} SELECT record, count(*) AS counted_codons, count(*) FILTER (aa <> '*') AS sense_codons, count(*) FILTER (aa = '*') AS stop_codons, cast(0 as bigint) AS ambiguous_codons, round(count(*) FILTER (codon[3] IN ('G', 'C')) / count(*) * 100, 6) AS gc3_percent FROM cn JOIN code USING (codon) GROUP BY 1""",
)
def _q10c(t: Tables) -> DataFrame:
    return sq.codon_summary(fx.sequences(t))


@query(
    "Q11_codon_adaptation",
    f"""WITH {USAGE}, k AS (SELECT codon, aa, count(*) FILTER (codon <> 'GGG') AS n FROM cn JOIN code USING (codon) GROUP BY 1, 2), w AS (SELECT codon, n / max(n) OVER (PARTITION BY aa) AS w FROM k WHERE aa <> '*')
    SELECT record, 'all' AS reference_id, count(*) FILTER (w > 0) AS codons_scored, count(*) FILTER (w IS NULL OR w = 0) AS codons_ignored, round(exp(avg(ln(w)) FILTER (w > 0)), 6) AS cai, round(avg(ln(w)) FILTER (w > 0), 6) AS geometric_mean_log, count(*) FILTER (w = 0) AS zero_weight_codons
    FROM (SELECT record, codon, w FROM cn LEFT JOIN w USING (codon)) GROUP BY 1""",
)
def _q11(t: Tables) -> DataFrame:
    seqs = fx.sequences(t)
    table = {r["codon"]: r["count"] for r in sq.codon_counts(seqs, merged=True).collect()}
    table["GGG"] = 0
    return sq.codon_adaptation_index(seqs, table, reference_id="all")


MOTIFS = [{"id": "m1", "name": "tata-like", "pattern": "TATAWA"}, {"id": "m2", "name": "e-box", "pattern": "CANNTG"}, {"id": "m3", "name": "plain", "pattern": "GATTAC", "syntax": "plain"}]
MOTIF_SQL = {"m1": ("tata-like", "TATA[AT]A", "T[AT]TATA"), "m2": ("e-box", "CA[ACGT][ACGT]TG", "CA[ACGT][ACGT]TG"), "m3": ("plain", "GATTAC", "GTAATC")}


@query(
    "Q12_scan_motifs",
    f"WITH {fx.SEQS}, {_words_sql('k', 'seqs', 6, ', sequence')} " + " UNION ALL ".join(
        f"""SELECT record, '{i}' AS motif_id, '{name}' AS motif_name, '{strand}' AS strand, p AS "start", p + 5 AS "end", cast(6 as bigint) AS length, substr(sequence, greatest(1, p - 4), least(4, p - 1)) AS left_context,
        {RC.format('w') if strand == '-' else 'w'} AS matched_text, substr(sequence, p + 6, 4) AS right_context FROM k WHERE regexp_full_match(w, '{pattern}')"""
        for i, (name, plus, minus) in MOTIF_SQL.items() for strand, pattern in (("+", plus), ("-", minus))
    ),
)
def _q12(t: Tables) -> DataFrame:
    return sc.scan_motifs(fx.sequences(t), MOTIFS, flank=4)


@query(
    "Q12_scan_regex",
    f"""WITH {fx.SEQS}, o AS (SELECT record, '+' AS strand, sequence AS s FROM seqs UNION ALL SELECT record, '-', {RC.format('sequence')} FROM seqs), k AS (SELECT record, strand, p, regexp_extract(substr(s, p), '^(GC[AT]{{2,6}}C+)') AS m FROM (SELECT *, unnest(range(1, 129)) AS p FROM o))
    SELECT record, 'r1' AS motif_id, strand, CASE strand WHEN '+' THEN p ELSE 128 - (p + length(m) - 1) + 1 END AS "start", length(m) AS length, m AS matched_text FROM k WHERE m <> ''""",
)
def _q12b(t: Tables) -> DataFrame:
    out = sc.scan_motifs(fx.sequences(t), [{"id": "r1", "pattern": "GC[AT]{2,6}C+", "syntax": "regex"}])
    return out.select("record", "motif_id", "strand", "start", "length", "matched_text")


@query(
    "Q12_scan_protein",
    f"""WITH {fx.PROTEINS}, k AS (SELECT record, p, substr(sequence, p, 3) AS w FROM (SELECT record, sequence, unnest(range(1, length(sequence) - 1)) AS p FROM prots)),
    h AS (SELECT *, 'site' AS motif_id FROM k WHERE regexp_full_match(w, 'N[A-Z][BDN]') UNION ALL SELECT *, 'fixed' FROM k WHERE w = 'KCR')
    SELECT record, motif_id, '+' AS strand, p AS "start", p + 2 AS "end", w AS matched_text FROM h
    UNION ALL SELECT record, 'regex', '+', p, p + 2, w FROM k WHERE regexp_full_match(w, '[DE][HK]C')""",
)
def _q12c(t: Tables) -> DataFrame:
    motifs = [{"id": "site", "pattern": "NXB"}, {"id": "fixed", "pattern": "kcr", "syntax": "plain"}, {"id": "regex", "pattern": "[de][hk]c", "syntax": "regex"}]
    return sc.scan_motifs(fx.proteins(t), motifs, alphabet="protein").select("record", "motif_id", "strand", "start", "end", "matched_text")


PWM = [{"A": 1.2, "C": -1.0, "G": 0.1, "T": -2.0}, {"A": -1.5, "C": 1.4, "G": -0.3, "T": 0.2}, {"A": 0.3, "C": -0.7, "G": 1.1, "T": -1.2}, {"A": -0.9, "C": 0.6, "G": -1.1, "T": 1.3}, {"A": 0.8, "C": 0.7, "G": -2.1, "T": -0.4}]
_PWM_LOW, _PWM_HIGH = sum(min(c.values()) for c in PWM), sum(max(c.values()) for c in PWM)
_PWM_SCORE = " + ".join("CASE w[%d] %s END" % (i + 1, " ".join(f"WHEN '{b}' THEN cast({v} as double)" for b, v in c.items())) for i, c in enumerate(PWM))


@query(
    "Q13_scan_pwm",
    f"""WITH {fx.SEQS}, {_words_sql('k0', 'seqs', 5)}, k AS (SELECT record, p, '+' AS strand, w FROM k0 UNION ALL SELECT record, p, '-', {RC.format('w')} FROM k0), s AS (SELECT *, ({_PWM_SCORE} - ({_PWM_LOW!r})) / {_PWM_HIGH - _PWM_LOW!r} * 100 AS x FROM k)
    SELECT record, 'pwm' AS motif_id, strand, p AS "start", p + 4 AS "end", cast(5 as bigint) AS length, w AS matched_text, round(x, 1) AS score FROM s WHERE x >= 84.9""",
)
def _q13(t: Tables) -> DataFrame:
    return sc.scan_pwm(fx.sequences(t), "pwm", PWM, threshold=84.9).withColumn("score", F.round("score", 1))


ADAPTER = "ACGTTGCANG"


def _mismatch_list(pattern: str, minus: bool) -> str:
    sets = {"N": "ACGT", "R": "AG"}
    m = len(pattern)
    parts = [f"CASE WHEN NOT contains('{sets.get(s, s)}', w[{i + 1}]) THEN {m - i if minus else i + 1} END" for i, s in enumerate(pattern)]
    return f"list_sort(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))"


@query(
    "Q14_scan_mismatches",
    f"""WITH {fx.SEQS}, {_words_sql('k', 'seqs', 10)}, b AS (SELECT record, p, '+' AS strand, w, {_mismatch_list(ADAPTER, False)} AS bad FROM k UNION ALL SELECT record, p, '-', {RC.format('w')}, {_mismatch_list('CNTGCAACGT', True)} FROM k)
    SELECT record, 'ad1' AS motif_id, strand, p AS "start", p + 9 AS "end", cast(10 as bigint) AS length, w AS matched_text, len(bad) AS mismatches, array_to_string(bad, ',') AS mismatch_positions, round((10 - len(bad)) / 10 * 100, 3) AS identity_percent
    FROM b WHERE len(bad) <= 3 AND coalesce(list_max(bad), 0) <= 8""",
)
def _q14(t: Tables) -> DataFrame:
    return sc.scan_mismatches(fx.sequences(t), [{"id": "ad1", "pattern": ADAPTER}], max_mismatches=3, exact_three_prime=2)


def _partial_sql() -> str:
    p = "GATTACAGAT"
    parts = []
    for strand in "+-":
        text = "sequence" if strand == "+" else RC.format("sequence")
        whens = []
        for n in range(len(p) - 1, 3, -1):
            whens += [f"WHEN {text} LIKE '{p[-n:]}%' THEN '5_prime_partial:{n}'", f"WHEN {text} LIKE '%{p[:n]}' THEN '3_prime_partial:{n}'"]
        parts.append(f"SELECT record, '{strand}' AS strand, {text} AS s, CASE {' '.join(whens)} END AS k FROM seqs")
    return f"""WITH {fx.SEQS}, h AS ({" UNION ALL ".join(parts)}), x AS (SELECT *, split_part(k, ':', 1) AS kind, cast(split_part(k, ':', 2) as bigint) AS n FROM h WHERE k IS NOT NULL), y AS (SELECT *, CASE WHEN kind = '5_prime_partial' THEN 1 ELSE 128 - n + 1 END AS b FROM x)
    SELECT record, 'ad2' AS motif_id, strand, CASE strand WHEN '+' THEN b ELSE 128 - (b + n - 1) + 1 END AS "start", CASE strand WHEN '+' THEN b + n - 1 ELSE 128 - b + 1 END AS "end", n AS length, substr(s, b, n) AS matched_text, kind AS match_type FROM y"""


@query("Q14_scan_partial_ends", _partial_sql())
def _q14b(t: Tables) -> DataFrame:
    return sc.scan_partial_ends(fx.sequences(t), [{"id": "ad2", "pattern": "GATTACAGAT"}], minimum=4)


ENZYMES = [{"name": "CutA", "recognition": "GATC", "cut_top": 0, "cut_bottom": 4, "overhang": "5 prime"}, {"name": "CutB", "recognition": "GGWCC", "cut_top": 1, "cut_bottom": 4, "overhang": "5 prime"}, {"name": "CutC", "recognition": "GCAGC", "cut_top": 13, "cut_bottom": 17, "overhang": "5 prime"}]
SITES = f"""{fx.SEQS}, {_words_sql('k4', 'seqs', 4)}, {_words_sql('k5', 'seqs', 5)}, sites AS (SELECT record, 'CutA' AS enzyme, 'GATC' AS recognition, '+' AS strand, p AS site_start, p + 3 AS site_end, p - 1 AS cut_after FROM k4 WHERE w = 'GATC'
  UNION ALL SELECT record, 'CutB', 'GGWCC', '+', p, p + 4, p FROM k5 WHERE w IN ('GGACC', 'GGTCC') UNION ALL SELECT record, 'CutC', 'GCAGC', '+', p, p + 4, p + 12 FROM k5 WHERE w = 'GCAGC' UNION ALL SELECT record, 'CutC', 'GCAGC', '-', p, p + 4, p - 13 FROM k5 WHERE w = 'GCTGC')"""


@query("Q15_restriction_sites", f"WITH {SITES} SELECT *, '5 prime' AS overhang FROM sites")
def _q15(t: Tables) -> DataFrame:
    return sc.restriction_sites(fx.sequences(t), ENZYMES)


@query("Q15_enzyme_counts", f"WITH {SITES} SELECT record, enzyme, count(*) AS sites, count(DISTINCT cut_after) AS cuts FROM sites GROUP BY 1, 2 HAVING count(*) BETWEEN 1 AND 2")
def _q15b(t: Tables) -> DataFrame:
    return sc.enzyme_counts(sc.restriction_sites(fx.sequences(t), ENZYMES), minimum=1, maximum=2)


@query(
    "Q15_digest_linear",
    f"""WITH {SITES}, c AS (SELECT DISTINCT record, cut_after AS p FROM sites WHERE cut_after > 0 AND cut_after < 128 UNION SELECT record, 0 FROM seqs UNION SELECT record, 128 FROM seqs), n AS (SELECT *, lead(p) OVER (PARTITION BY record ORDER BY p) AS q, row_number() OVER (PARTITION BY record ORDER BY p) AS fragment FROM c)
    SELECT record, p + 1 AS "start", q AS "end", q - p AS length, fragment, 'linear' AS topology FROM n WHERE q IS NOT NULL""",
)
def _q15c(t: Tables) -> DataFrame:
    seqs = fx.sequences(t)
    return sc.digest(sc.restriction_sites(seqs, ENZYMES), seqs.select("record", F.length("sequence").cast("bigint").alias("length")))


@query(
    "Q15_digest_circular",
    f"""WITH {SITES}, c AS (SELECT DISTINCT record, cut_after AS p FROM sites WHERE cut_after BETWEEN 0 AND 128), n AS (SELECT *, lead(p) OVER (PARTITION BY record ORDER BY p) AS q, min(p) OVER (PARTITION BY record) AS f, row_number() OVER (PARTITION BY record ORDER BY p) AS fragment FROM c)
    SELECT record, p + 1 AS "start", coalesce(q, f) AS "end", coalesce(q - p, 128 - p + f) AS length, fragment, 'circular' AS topology FROM n UNION ALL SELECT record, 1, 128, 128, 1, 'circular' FROM seqs WHERE record NOT IN (SELECT record FROM c)""",
)
def _q15d(t: Tables) -> DataFrame:
    seqs = fx.sequences(t)
    return sc.digest(sc.restriction_sites(seqs, ENZYMES), seqs.select("record", F.length("sequence").cast("bigint").alias("length")), topology="circular")


PRIMERS = [{"name": "p1", "sequence": "ACGTCAGT"}, {"name": "p2", "sequence": "GGATCCTA"}]


def _pcr_sql(circular: bool) -> str:
    source = "seqs2 AS (SELECT record, sequence || substr(sequence, 1, 7) AS sequence FROM seqs)" if circular else "seqs2 AS (SELECT record, sequence FROM seqs)"
    near = []
    for p in PRIMERS:
        q = p["sequence"]
        back = q.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        for strand, pattern in (("+", q), ("-", back)):
            end = f"w[6:8] = '{pattern[5:]}'" if strand == "+" else f"w[1:3] = '{pattern[:3]}'"
            near.append(f"SELECT w, '{p['name']}' AS primer, '{strand}' AS strand, hamming(w, '{pattern}') AS mm FROM d WHERE hamming(w, '{pattern}') <= 2 AND {end}")
    size = "CASE WHEN r.p + 7 - f.p + 1 <= 0 THEN r.p + 7 - f.p + 1 + 128 ELSE r.p + 7 - f.p + 1 END" if circular else "r.p + 7 - f.p + 1"
    rule = "true" if circular else "f.p <= r.p"
    text = "substr(sequence || sequence, f.p, n)" if circular else "substr(sequence, f.p, n)"
    return f"""WITH {fx.SEQS}, {source}, {_words_sql('k', 'seqs2', 8)}, d AS MATERIALIZED (SELECT DISTINCT w FROM k), near AS MATERIALIZED ({" UNION ALL ".join(near)}), s AS MATERIALIZED (SELECT record, primer, strand, p, mm FROM k JOIN near USING (w) WHERE p <= 128),
    j AS (SELECT f.record, f.primer AS fp, r.primer AS rp, f.p AS fs, r.p AS rs, f.mm AS fm, r.mm AS rm, {size} AS n FROM s f JOIN s r ON f.record = r.record AND f.strand = '+' AND r.strand = '-' AND {rule})
    SELECT record AS template, fp AS forward_primer, rp AS reverse_primer, n AS length, '{"circular" if circular else "linear"}' AS topology, fs AS forward_start, (fs + 6) % 128 + 1 AS forward_end, rs AS reverse_start, (rs + 6) % 128 + 1 AS reverse_end, fm AS forward_mismatches, rm AS reverse_mismatches,
      {text.replace("f.p", "fs")} AS product_sequence FROM j JOIN seqs USING (record) WHERE n BETWEEN 20 AND 110"""


@query("Q16_pcr_products", _pcr_sql(False))
def _q16(t: Tables) -> DataFrame:
    return sc.pcr_products(fx.sequences(t).select("record", "sequence"), PRIMERS, max_mismatches=2, exact_three_prime=3, minimum=20, maximum=110)


@query("Q16_pcr_products_circular", _pcr_sql(True))
def _q16b(t: Tables) -> DataFrame:
    return sc.pcr_products(fx.sequences(t).select("record", "sequence"), PRIMERS, max_mismatches=2, exact_three_prime=3, minimum=20, maximum=110, topology="circular")


def _changed(t: Tables) -> DataFrame:
    """The same records with their second quarter replaced."""
    k = F.col("p_partkey")
    made = fx.compute_once(fx.parts(t).select("p_partkey"), sequence=F.concat(fx.dna32(k * 8), fx.dna32(k * 8 + 77), fx.dna32(k * 8 + 2), fx.dna32(k * 8 + 3)))
    return made.select((k + 1000000).alias("record"), "sequence")


CHANGED = f"seqsb AS (SELECT p_partkey + 1000000 AS record, {fx.dna32_sql('p_partkey * 8')} || {fx.dna32_sql('p_partkey * 8 + 77')} || {fx.dna32_sql('p_partkey * 8 + 2')} || {fx.dna32_sql('p_partkey * 8 + 3')} AS sequence FROM part)"
def _shared(least: int) -> str:
    return f"""{fx.SEQS}, {CHANGED}, {_words_sql('ka0', 'seqs', 11)}, {_words_sql('kb0', 'seqsb', 11)}, ka AS (SELECT DISTINCT record, w FROM ka0), kb AS (SELECT DISTINCT record, w FROM kb0),
na AS (SELECT record, count(*) AS n FROM ka GROUP BY 1), nb AS (SELECT record, count(*) AS n FROM kb GROUP BY 1), sh AS (SELECT ka.record AS a, kb.record AS b, count(*) AS s FROM ka JOIN kb USING (w) GROUP BY 1, 2 HAVING count(*) >= {least}),
pr AS (SELECT a AS a_record, b AS b_record, cast(128 as bigint) AS a_length, cast(128 as bigint) AS b_length, s AS shared_kmers, na.n AS a_kmers, nb.n AS b_kmers, cast(1 as double) AS length_ratio, round(s / (na.n + nb.n - s), 6) AS jaccard FROM sh JOIN na ON na.record = a JOIN nb ON nb.record = b),
rk AS (SELECT *, row_number() OVER (PARTITION BY a_record ORDER BY shared_kmers DESC, b_record) AS a_best_rank, row_number() OVER (PARTITION BY b_record ORDER BY shared_kmers DESC, a_record) AS b_best_rank FROM pr),
cl AS (SELECT *, CASE WHEN a_best_rank = 1 AND b_best_rank = 1 THEN 'reciprocal_best' WHEN a_best_rank = 1 THEN 'best_for_a' WHEN b_best_rank = 1 THEN 'best_for_b' ELSE 'candidate' END AS classification FROM rk WHERE a_best_rank <= 2 OR b_best_rank <= 2)"""


@query("J7_shared_word_pairs", f"WITH {_shared(6)} SELECT * FROM pr")
def _j7(t: Tables) -> DataFrame:
    return km.candidate_pairs(fx.sequences(t), _changed(t), k=11, min_shared=6, alphabet=km.DNA_WORD)


@query("J7_shared_word_pairs_hot", f"WITH {_shared(6)} SELECT * FROM pr")
def _j7b(t: Tables) -> DataFrame:
    return km.candidate_pairs(fx.sequences(t), _changed(t), k=11, min_shared=6, alphabet=km.DNA_WORD)


@query("Q17_reciprocal_best", f"WITH {_shared(6)} SELECT * FROM cl")
def _q17(t: Tables) -> DataFrame:
    return km.reciprocal_best(km.candidate_pairs(fx.sequences(t), _changed(t), k=11, min_shared=6, alphabet=km.DNA_WORD), top=2)


@query(
    "Q17_unmatched",
    f"""WITH {_shared(77)}, u AS (SELECT 'A' AS "set", record, max(CASE WHEN classification = 'reciprocal_best' THEN 1 WHEN classification IS NOT NULL THEN 0 END) AS ok FROM seqs LEFT JOIN cl ON a_record = record GROUP BY record
      UNION ALL SELECT 'B', record, max(CASE WHEN classification = 'reciprocal_best' THEN 1 WHEN classification IS NOT NULL THEN 0 END) FROM seqsb LEFT JOIN cl ON b_record = record GROUP BY record)
    SELECT "set", record, CASE WHEN ok IS NULL THEN 'no_candidate' ELSE 'not_reciprocal' END AS reason FROM u WHERE coalesce(ok, 0) = 0""",
)
def _q17b(t: Tables) -> DataFrame:
    a, b = fx.sequences(t), _changed(t)
    return km.unmatched(a, b, km.reciprocal_best(km.candidate_pairs(a, b, k=11, min_shared=77, alphabet=km.DNA_WORD), top=2))


@query(
    "Q18_dot_table",
    f"""WITH {fx.SEQS}, {CHANGED}, {_words_sql('a', 'seqs', 11)}, {_words_sql('b0', 'seqsb', 11)}, b AS (SELECT 'direct' AS o, record, p, w FROM b0 UNION ALL SELECT 'reverse-complement', record, p, {RC.format('w')} FROM b0)
    SELECT o AS orientation, a.record AS sequence_a, a.p AS sequence_a_start, a.p + 10 AS sequence_a_end, b.record AS sequence_b, b.p AS sequence_b_start, b.p + 10 AS sequence_b_end, w AS word FROM a JOIN b USING (w)""",
)
def _q18(t: Tables) -> DataFrame:
    return km.dot_table(fx.sequences(t), _changed(t), 11)


def _library(t: Tables) -> DataFrame:
    """One library sequence per supplier, cut from a part sequence with one base changed."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        F.concat(F.lit("lib"), k.cast("string")).alias("record"),
        F.concat(fx.dna32(k * 24 + 1), F.translate(F.substring(fx.dna32(k * 24 + 2), 1, 1), "ACGT", "CGTA"), F.substring(fx.dna32(k * 24 + 2), 2, 31)).alias("sequence"),
    )


@query("Q19_contamination_hits")
def _q19(t: Tables) -> DataFrame:
    return km.contamination_hits(fx.sequences(t).select(F.col("record").cast("string").alias("record"), "sequence"), _library(t))


GUIDES = f"""{fx.SEQS}, {CHANGED}, {_words_sql('g0', 'seqs', 12)}, {_words_sql('h0', 'seqsb', 12)},
g1 AS (SELECT record, '+' AS strand, p, w FROM g0 WHERE w[11:12] = 'GG' UNION ALL SELECT record, '-', p, {RC.format('w')} FROM g0 WHERE w[1:2] = 'CC'), h1 AS (SELECT w FROM h0 WHERE w[11:12] = 'GG' UNION ALL SELECT {RC.format('w')} FROM h0 WHERE w[1:2] = 'CC'),
g AS (SELECT record, strand, CASE strand WHEN '+' THEN p ELSE p + 3 END AS guide_start, CASE strand WHEN '+' THEN p + 8 ELSE p + 11 END AS guide_end, CASE strand WHEN '+' THEN p + 9 ELSE p END AS pam_start, CASE strand WHEN '+' THEN p + 11 ELSE p + 2 END AS pam_end,
  CASE strand WHEN '+' THEN p + 9 - 3 ELSE p + 2 + 3 END AS cut_position, w[1:9] AS guide_dna, w[10:12] AS pam_sequence, round({_n('GC', 'w[1:9]')} / 9 * 100, 6) AS gc_percent FROM g1)"""


@query("Q20_guide_sites", f"WITH {GUIDES} SELECT * FROM g WHERE gc_percent BETWEEN 40 AND 70")
def _q20(t: Tables) -> DataFrame:
    return sc.guide_sites(fx.sequences(t), guide_length=9, min_gc=40, max_gc=70)


@query(
    "Q20_off_target_census",
    f"""WITH {GUIDES}, d AS (SELECT DISTINCT guide_dna FROM g WHERE gc_percent BETWEEN 40 AND 70), r AS (SELECT w[1:9] AS s, count(*) AS n FROM h1 GROUP BY 1), m AS (SELECT guide_dna, n, hamming(guide_dna, s) AS x FROM d, r WHERE hamming(guide_dna, s) <= 1)
    SELECT guide_dna, cast(coalesce(sum(n), 0) as bigint) AS reference_match_count, cast(coalesce(sum(n) FILTER (x = 0), 0) as bigint) AS exact_reference_match_count, cast(coalesce(sum(n) FILTER (x > 0), 0) as bigint) AS near_reference_match_count, min(x) AS best_reference_mismatches FROM d LEFT JOIN m USING (guide_dna) GROUP BY 1""",
)
def _q20b(t: Tables) -> DataFrame:
    guides = sc.guide_sites(fx.sequences(t), guide_length=9, min_gc=40, max_gc=70)
    return sc.off_target_census(guides, sc.guide_sites(_changed(t), guide_length=9), max_mismatches=1, guide_length=9)


@query(
    "Q21_oligo_properties",
    f"""WITH o AS (SELECT p_partkey AS record, substr({fx.dna32_sql("p_partkey")}, 1, cast(8 + p_size % 20 as bigint)) AS s FROM part), c AS (SELECT record, s, length(s) AS n, {_n('A', 's')} AS a, {_n('C', 's')} AS c, {_n('G', 's')} AS g, {_n('T', 's')} AS t FROM o)
    SELECT record, n AS length, round((g + c) / n * 100, 6) AS gc_percent, a AS a_count, c AS c_count, g AS g_count, t AS t_count, n - a - c - g - t AS n_count, round(CASE WHEN n < 14 THEN 2 * (a + t) + 4 * (g + c) ELSE 69.3::double + 0.41::double * (g + c) / n * 100 - 650 / n END, 6) AS tm_c,
      CASE WHEN n < 14 THEN 'Wallace' ELSE 'Marmur-Doty GC' END AS tm_method, {RC.format('s')} AS reverse_complement FROM c""",
)
def _q21(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    oligos = t.part.select(k.alias("record"), fx.dna32(k).substr(F.lit(1), 8 + F.col("p_size") % 20).alias("sequence"))
    return sq.oligo_properties(oligos)


BLOCKS = f"""WITH {fx.SEQS}, {CHANGED}, {_words_sql('a', 'seqs', 10)}, {_words_sql('b0', 'seqsb', 10)}, b AS (SELECT '+' AS strand, record, p, w FROM b0 UNION ALL SELECT '-', record, 128 - (p + 9) + 1, {RC.format('w')} FROM b0),
    m AS (SELECT a.record AS ar, b.record AS br, strand, a.p AS ap, a.p - b.p AS d FROM a JOIN b USING (w)), i AS (SELECT *, ap - row_number() OVER (PARTITION BY ar, br, strand, d ORDER BY ap) AS g FROM m),
    r AS (SELECT ar, br, strand, d, min(ap) AS s, max(ap) + 9 AS e FROM i GROUP BY ar, br, strand, d, g)
    SELECT ar AS a_record, br AS b_record, strand, s AS a_start, e AS a_end, CASE strand WHEN '+' THEN s - d ELSE 128 - (e - d) + 1 END AS b_start, CASE strand WHEN '+' THEN e - d ELSE 128 - (s - d) + 1 END AS b_end, e - s + 1 AS block_length FROM r WHERE e - s + 1 >= 12"""


@query("Q22_exact_blocks", BLOCKS)
def _q22(t: Tables) -> DataFrame:
    return km.exact_blocks(fx.sequences(t).select("record", "sequence"), _changed(t), seed=10, min_length=12, deduplicate=False)


_SHARE = "(least(x.{0}_end, y.{0}_end) - greatest(x.{0}_start, y.{0}_start) + 1) / least(x.block_length, y.block_length) > 0.85"


@query(
    "Q22_exact_blocks_best",
    # No block that is beaten here beats another one, so one comparison tells which stay.
    f"""WITH RECURSIVE blocks AS ({BLOCKS.replace("WITH RECURSIVE", "WITH")})
    SELECT * FROM blocks y WHERE NOT EXISTS (SELECT 1 FROM blocks x WHERE x.a_record = y.a_record AND x.b_record = y.b_record AND x.strand = y.strand AND {_SHARE.format("a")} AND {_SHARE.format("b")}
      AND (x.block_length > y.block_length OR x.block_length = y.block_length AND (x.a_start, x.b_start) < (y.a_start, y.b_start)))""",
)
def _q22b(t: Tables) -> DataFrame:
    return km.exact_blocks(fx.sequences(t).select("record", "sequence"), _changed(t), seed=10, min_length=12)


@query(
    "Q22_window_identity",
    f"""WITH {fx.SEQS}, {CHANGED}, w AS (SELECT a.record AS a_record, b.record AS b_record, i * 20 + 1 AS s, substr(a.sequence, i * 20 + 1, 20) AS x, substr(b.sequence, i * 20 + 1, 20) AS y FROM seqs a JOIN seqsb b ON b.record = a.record + 1000000, (SELECT unnest(range(7)) AS i)),
    m AS (SELECT *, length(x) AS n, length(x) - hamming(x, y) AS k FROM w) SELECT a_record, b_record, s AS "start", s + n - 1 AS "end", n AS compared, k AS matches, round(k / n * 100, 4) AS identity FROM m WHERE k / n * 100 >= 65""",
)
def _q22c(t: Tables) -> DataFrame:
    a = fx.sequences(t).select(F.col("record").alias("a_record"), F.col("sequence").alias("a"))
    b = _changed(t).select(F.col("record").alias("b_record"), F.col("sequence").alias("b"))
    return km.window_identity(a.join(b, F.col("b_record") == F.col("a_record") + 1000000), window=20)
