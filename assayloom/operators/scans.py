"""Pattern work on many sequences: motifs, weight matrices, mismatches, restriction sites, primers, guides.

Each tile is searched once for all patterns and strands together, and only hits become rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.sequence import IUPAC_BASES, as_dna, count_any, hamming, iupac_regex, matching_symbols, reverse_complement, reverse_complement_text
from assayloom.operators.intervals import extract_regions, range_join
from assayloom.operators.ladder import numbered
from assayloom.operators.patterns import regex_hits, tile_hits, tile_scores
from assayloom.operators.sequences import CHUNK, cut_tiles
from assayloom.operators.tiles import next_position


# Protein letters that stand for several residues.
PROTEIN_SETS = {"B": "BDN", "Z": "ZEQ", "J": "JIL"}


def _protein_places(pattern: str) -> list[str]:
    """Accepted residues: B is D or N, Z is E or Q, J is I or L, X is any."""
    return [string.ascii_uppercase if c == "X" else PROTEIN_SETS.get(c, c) for c in pattern]


def _dna_places(pattern: str) -> list[str]:
    """Accepted symbols; ambiguous sequence symbols match what they may stand for."""
    return [matching_symbols(c) if c in IUPAC_BASES else c for c in pattern.upper()]


def scan_motifs(
    seqs: DataFrame, motifs: Sequence[Mapping], *, both_strands: bool = True, flank: int = 0, spread: bool = False, alphabet: str = "dna"
) -> DataFrame:
    """Matches of ``{"id", "name", "pattern", "syntax"}`` motifs, overlaps included.

    ``plain`` and ``iupac`` motifs have a fixed length and are searched in tiles. ``regex`` motifs may match
    any length and are searched in whole records. Case does not count. ``alphabet`` is ``dna``, ``rna`` (the
    same, U being T) or ``protein``, whose letters stay as they are and whose motifs have one strand.
    """
    if alphabet not in ("dna", "rna", "protein"):
        raise ValueError(f"unknown alphabet {alphabet!r}")
    protein = alphabet == "protein"
    both_strands = both_strands and not protein
    source = seqs.select("record", (F.upper("sequence") if protein else as_dna(F.col("sequence"))).alias("sequence"))
    fixed = [m for m in motifs if m.get("syntax", "iupac") != "regex"]
    free = [m for m in motifs if m.get("syntax", "iupac") == "regex"]
    frames = []
    if fixed:
        longest = max(len(m["pattern"]) for m in fixed)
        tiles = cut_tiles(source, before=flank, after=longest - 1 + flank, spread=spread)
        places, labels = [], {"motif_id": [], "motif_name": [], "strand": []}
        for motif in fixed:
            pattern = motif["pattern"].upper() if protein else motif["pattern"].upper().replace("U", "T")
            sides = [("+", pattern), ("-", reverse_complement_text(pattern))] if both_strands else [("+", pattern)]
            for strand, text in sides:
                places.append((_protein_places(text) if protein else _dna_places(text)) if motif.get("syntax", "iupac") == "iupac" else list(text))
                for name, value in zip(labels, (str(motif["id"]), motif.get("name", str(motif["id"])), strand)):
                    labels[name].append(value)
        rows = tile_hits(tiles, ["record", "offset", "lead"], places, labels, flank=flank).filter((F.col("p") > F.col("lead")) & (F.col("p") <= F.col("lead") + CHUNK))
        start = F.col("offset") - F.col("lead") + F.col("p")
        frames.append(rows.select(
            "record", *labels, start.alias("start"), (start + F.col("n") - 1).alias("end"), F.col("n").alias("length"), F.col("left").alias("__l"), F.col("matched").alias("__m"), F.col("right").alias("__r"),
        ))
    for strand in ("+", "-") if both_strands else ("+",):
        for motif in free:
            text = F.col("sequence") if strand == "+" else reverse_complement(F.col("sequence"))
            # Letters after a backslash are classes; all others may be read as T for U.
            regex = "(?i)" + (motif["pattern"] if protein else re.sub(r"(?<!\\)[uU]", "T", motif["pattern"]))
            found = regex_hits(source.select("record", F.length("sequence").cast("bigint").alias("L"), text.alias("text")), ["record", "L"], regex, flank)
            n = F.length("matched").cast("bigint")
            low = F.col("p") if strand == "+" else F.col("L") - (F.col("p") + n - 1) + 1
            turn = (lambda c: c) if strand == "+" else reverse_complement
            before, after = ("left", "right") if strand == "+" else ("right", "left")
            frames.append(found.select(
                "record", F.lit(str(motif["id"])).alias("motif_id"), F.lit(motif.get("name", str(motif["id"]))).alias("motif_name"), F.lit(strand).alias("strand"),
                low.alias("start"), (low + n - 1).alias("end"), n.alias("length"), turn(F.col(before)).alias("__l"), turn(F.col("matched")).alias("__m"), turn(F.col(after)).alias("__r"),
            ))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    minus = F.col("strand") == "-"
    return out.select(
        "record", "motif_id", "motif_name", "strand", "start", "end", "length", F.col("__l").alias("left_context"),
        F.when(minus, reverse_complement(F.col("__m"))).otherwise(F.col("__m")).alias("matched_text"), F.col("__r").alias("right_context"),
    )


def scan_pwm(seqs: DataFrame, motif_id: str, weights: Sequence[Mapping[str, float]], *, threshold: float = 80.0, both_strands: bool = True, spread: bool = False) -> DataFrame:
    """Windows whose relative weight-matrix score reaches ``threshold`` percent."""
    tiles = cut_tiles(seqs.select("record", as_dna(F.col("sequence")).alias("sequence")), after=len(weights) - 1, spread=spread)
    scored = tile_scores(tiles, ["record", "offset"], weights, threshold, both_strands).filter(F.col("p") <= CHUNK)
    start, minus = F.col("offset") + F.col("p"), F.col("strand") == "-"
    return scored.select(
        "record", F.lit(motif_id).alias("motif_id"), "strand", start.alias("start"), (start + len(weights) - 1).alias("end"),
        F.lit(len(weights)).cast("bigint").alias("length"), F.when(minus, reverse_complement(F.col("matched"))).otherwise(F.col("matched")).alias("matched_text"), F.round("relative", 2).alias("score"),
    )


# --- mismatches --------------------------------------------------------------------------------

def _segments(size: int, parts: int) -> list[tuple[int, int]]:
    edges = [round(i * size / parts) for i in range(parts + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def scan_mismatches(
    seqs: DataFrame, motifs: Sequence[Mapping], *, max_mismatches: int = 1, exact_three_prime: int = 0, both_strands: bool = True, spread: bool = False, circular: bool = False,
) -> DataFrame:
    """Sites with at most ``max_mismatches``, all patterns and both strands searched in one pass.

    The last ``exact_three_prime`` pattern symbols must match. On a circular record a site may run over the end.
    """
    longest = max(len(m["pattern"]) for m in motifs)
    source = seqs.select("record", as_dna(F.col("sequence")).alias("sequence"))
    if circular:
        source = source.withColumn("__L", F.length("sequence")).withColumn("sequence", F.concat("sequence", F.substring("sequence", 1, longest - 1)))
        lengths = source.select("record", F.col("__L").cast("bigint").alias("__L"))
        source = source.drop("__L")
    tiles = cut_tiles(source, after=longest - 1, spread=spread)
    places, exact, labels = [], [], {"motif_id": [], "strand": []}
    for motif in motifs:
        pattern = motif["pattern"].upper().replace("U", "T")
        for strand in ("+", "-") if both_strands else ("+",):
            places.append(_dna_places(pattern if strand == "+" else reverse_complement_text(pattern)))
            ends = range(min(exact_three_prime, len(pattern)))
            exact.append([len(pattern) - 1 - i if strand == "+" else i for i in ends])
            labels["motif_id"].append(str(motif["id"]))
            labels["strand"].append(strand)
    hits = tile_hits(tiles, ["record", "offset"], places, labels, most=max_mismatches, must_match=exact).filter(F.col("p") <= CHUNK)
    start, wrong, plus = F.col("offset") + F.col("p"), F.size("bad").cast("bigint"), F.col("strand") == "+"
    turned = F.array_sort(F.transform("bad", lambda i: F.col("n") + 1 - i))
    out = hits.select(
        "record", "motif_id", "strand", start.alias("start"), (start + F.col("n") - 1).alias("end"), F.col("n").alias("length"),
        F.when(plus, F.col("matched")).otherwise(reverse_complement(F.col("matched"))).alias("matched_text"), wrong.alias("mismatches"),
        F.array_join(F.when(plus, F.col("bad")).otherwise(turned).cast("array<string>"), ",").alias("mismatch_positions"), F.round((F.col("n") - wrong) / F.col("n") * 100, 3).alias("identity_percent"),
    )
    if circular:
        out = out.join(lengths, "record").filter(F.col("start") <= F.col("__L")).drop("__L")
    return out


def scan_partial_ends(seqs: DataFrame, motifs: Sequence[Mapping], *, minimum: int = 12, both_strands: bool = True) -> DataFrame:
    """Adapter remains: the longest motif suffix at the 5' end, or motif prefix at the 3' end, of each record."""
    frames = []
    for strand in ("+", "-") if both_strands else ("+",):
        base = as_dna(F.col("sequence"))
        text = base if strand == "+" else reverse_complement(base)
        rows = seqs.select("record", F.length("sequence").cast("bigint").alias("L"), text.alias("text"))
        for motif in motifs:
            pattern = motif["pattern"].upper().replace("U", "T")
            best = F.lit(None).cast("struct<n:bigint,kind:string>")
            for n in range(minimum, len(pattern)):
                prefix_hit = F.col("text").rlike("^" + iupac_regex(pattern[-n:]))
                suffix_hit = F.col("text").rlike(iupac_regex(pattern[:n]) + "$")
                made = lambda kind, n=n: F.struct(F.lit(n).cast("bigint").alias("n"), F.lit(kind).alias("kind"))
                best = F.when(prefix_hit, made("5_prime_partial")).when(suffix_hit, made("3_prime_partial")).otherwise(best)
            found = rows.withColumn("b", best).filter("b IS NOT NULL")
            n, front = F.col("b.n"), F.col("b.kind") == "5_prime_partial"
            s = F.when(front, F.lit(1).cast("bigint")).otherwise(F.col("L") - n + 1)
            low = s if strand == "+" else F.col("L") - (s + n - 1) + 1
            frames.append(found.select(
                "record", F.lit(str(motif["id"])).alias("motif_id"), F.lit(strand).alias("strand"), low.alias("start"), (low + n - 1).alias("end"), n.alias("length"),
                F.when(front, F.col("text").substr(F.lit(1), n.cast("int"))).otherwise(F.right("text", n.cast("int"))).alias("matched_text"), F.col("b.kind").alias("match_type"),
            ))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# --- restriction enzymes -----------------------------------------------------------------------

def restriction_sites(seqs: DataFrame, enzymes: Sequence[Mapping], *, spread: bool = False) -> DataFrame:
    """Sites of ``{"name", "recognition", "cut_top", "cut_bottom", "overhang"}`` enzymes in both orientations."""
    motifs, table = [], {}
    for enzyme in enzymes:
        forward = enzyme["recognition"].upper()
        turned = reverse_complement_text(forward)
        sides = [("+", forward, enzyme["cut_top"])] + ([("-", turned, len(forward) - enzyme["cut_bottom"])] if turned != forward else [])
        for strand, pattern, cut in sides:
            key = f"{enzyme['name']}{strand}"
            motifs.append({"id": key, "pattern": pattern})
            table[key] = (enzyme["name"], enzyme["recognition"], strand, cut, enzyme.get("overhang", ""))
    hits = scan_motifs(seqs, motifs, both_strands=False, spread=spread)
    pick = lambda i, kind: _choose(F.col("motif_id"), {k: v[i] for k, v in table.items()}).cast(kind)
    return hits.select(
        "record", pick(0, "string").alias("enzyme"), pick(1, "string").alias("recognition"), pick(2, "string").alias("strand"), F.col("start").alias("site_start"),
        F.col("end").alias("site_end"), (F.col("start") + pick(3, "bigint") - 1).alias("cut_after"), pick(4, "string").alias("overhang"),
    )


def _choose(key: Column, values: Mapping[str, object]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def enzyme_counts(sites: DataFrame, *, minimum: int = 0, maximum: int | None = None) -> DataFrame:
    counts = sites.groupBy("record", "enzyme").agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("cut_after").alias("cuts")).filter(F.col("sites") >= minimum)
    return counts if maximum is None else counts.filter(F.col("sites") <= maximum)


def digest(sites: DataFrame, lengths: DataFrame, *, topology: str = "linear") -> DataFrame:
    """Fragments between the distinct cuts of each record of ``lengths(record, length)``."""
    cuts = sites.join(lengths, "record").select("record", F.col("cut_after").alias("position"), "length").distinct()
    if topology == "linear":
        inner = cuts.filter((F.col("position") > 0) & (F.col("position") < F.col("length")))
        edges = lengths.select("record", F.explode(F.array(F.lit(0).cast("bigint"), F.col("length").cast("bigint"))).alias("position"), F.col("length").cast("bigint").alias("length"))
        lined = next_position(inner.unionByName(edges).select("record", "position"), "next").filter("next IS NOT NULL")
        rows = lined.select("record", (F.col("position") + 1).alias("start"), F.col("next").alias("end"), (F.col("next") - F.col("position")).alias("length"))
    else:
        valid = cuts.filter((F.col("position") >= 0) & (F.col("position") <= F.col("length")))
        firsts = valid.groupBy("record").agg(F.min("position").alias("first"))
        lined = next_position(valid.select("record", "position"), "next").join(firsts, "record").join(lengths, "record")
        end = F.coalesce("next", "first")
        size = F.when(F.col("next").isNull(), F.col("length") - F.col("position") + F.col("first")).otherwise(F.col("next") - F.col("position"))
        whole = lengths.join(firsts, "record", "left_anti").select("record", F.lit(1).cast("bigint").alias("start"), F.col("length").alias("end"), "length")
        rows = lined.select("record", (F.col("position") + 1).alias("start"), end.alias("end"), size.alias("length")).unionByName(whole)
    return numbered(rows, [F.col("start")], "fragment", ["record"]).withColumn("topology", F.lit(topology))


# --- paired sites ------------------------------------------------------------------------------

def pcr_products(
    seqs: DataFrame, primers: Sequence[Mapping], *, max_mismatches: int = 1, exact_three_prime: int = 3, minimum: int = 50, maximum: int = 3000, topology: str = "linear", spread: bool = False,
) -> DataFrame:
    """Products between a forward site and a later reverse site of any primer pair on the same record."""
    circular = topology == "circular"
    sites = scan_mismatches(
        seqs, [{"id": p["name"], "pattern": p["sequence"]} for p in primers], max_mismatches=max_mismatches, exact_three_prime=exact_three_prime, spread=spread, circular=circular
    )
    lengths = seqs.select("record", F.length("sequence").cast("bigint").alias("L"))
    plus = sites.filter("strand = '+'").select("record", "start", (F.col("start") + maximum - 1).alias("end"), F.col("start").alias("site_start"), F.col("end").alias("site_end"), "motif_id", "mismatches")
    minus = sites.filter("strand = '-'").select("record", F.col("end").alias("start"), "end", F.col("start").alias("site_start"), F.col("end").alias("site_end"), "motif_id", "mismatches").withColumn("turn", F.lit(0))
    if circular:
        again = minus.join(lengths, "record").select("record", (F.col("start") + F.col("L")).alias("start"), (F.col("end") + F.col("L")).alias("end"), "site_start", "site_end", "motif_id", "mismatches", F.lit(1).alias("turn"))
        minus = minus.unionByName(again)
    pairs = range_join(plus, minus, prefixes=("f", "r")).withColumn("size", F.col("r_end") - F.col("f_start") + 1).filter((F.col("size") >= minimum) & (F.col("size") <= maximum))
    direct = F.col("r_site_end") - F.col("f_site_start") + 1
    pairs = pairs.filter(((F.col("r_turn") == 0) & (direct > 0)) | ((F.col("r_turn") == 1) & (direct <= 0))) if circular else pairs.filter("f_site_start <= r_site_start")
    wrap = lambda c: (F.col(c) - 1) % F.col("L") + 1
    rows = pairs.withColumnRenamed("f_record", "record").join(lengths, "record").select(
        "record", F.col("f_start").alias("start"), F.col("r_end").alias("end"), F.lit("+").alias("strand"), F.col("f_motif_id").alias("forward_primer"),
        F.col("r_motif_id").alias("reverse_primer"), F.col("f_site_start").alias("forward_start"), wrap("f_site_end").alias("forward_end"),
        F.col("r_site_start").alias("reverse_start"), wrap("r_site_end").alias("reverse_end"), F.col("f_mismatches").alias("forward_mismatches"), F.col("r_mismatches").alias("reverse_mismatches"),
    )
    template = seqs.select("record", F.concat("sequence", "sequence").alias("sequence") if circular else F.col("sequence"))
    kept = [c for c in rows.columns if c not in ("record", "start", "end", "strand")]
    cut = extract_regions(rows, template, key=kept)
    return cut.select(
        F.col("record").alias("template"), "forward_primer", "reverse_primer", (F.col("end") - F.col("start") + 1).alias("length"), F.lit(topology).alias("topology"),
        "forward_start", "forward_end", "reverse_start", "reverse_end", "forward_mismatches", "reverse_mismatches", F.col("sequence").alias("product_sequence"),
    )


# --- guide sites -------------------------------------------------------------------------------

def guide_sites(
    seqs: DataFrame, *, pam: str = "NGG", guide_length: int = 20, pam_side: str = "3prime", min_gc: float = 0.0, max_gc: float = 100.0, cut_offset: int | None = -3,
    five_prime_g: bool = False, spread: bool = False,
) -> DataFrame:
    """Unambiguous guide sequences next to a PAM on both strands, with the cut position on the record."""
    known = lambda pattern: ["".join(b for b in "ACGT" if b in matching_symbols(s)) for s in pattern.upper()]
    bases, front = ["ACGT"] * guide_length, pam_side == "3prime"
    turned = known(reverse_complement_text(pam.upper()))
    sides = [bases + known(pam), turned + bases] if front else [known(pam) + bases, bases + turned]
    size = guide_length + len(pam)
    tiles = cut_tiles(seqs.select("record", as_dna(F.col("sequence")).alias("sequence")), after=size - 1, spread=spread)
    hits = tile_hits(tiles, ["record", "offset"], sides, {"strand": ["+", "-"]}).filter(F.col("p") <= CHUNK)
    rows = hits.select("record", (F.col("offset") + F.col("p")).alias("low"), "strand", F.col("matched").alias("w"))
    site = F.when(F.col("strand") == "-", reverse_complement(F.col("w"))).otherwise(F.col("w"))
    guide_at, pam_at = (0, guide_length) if front else (len(pam), 0)
    rows = rows.select("record", "strand", "low", site.substr(F.lit(guide_at + 1), F.lit(guide_length)).alias("guide_dna"), site.substr(F.lit(pam_at + 1), F.lit(len(pam))).alias("pam_sequence"))
    gc = count_any(F.col("guide_dna"), "GC") / guide_length * 100
    rows = rows.withColumn("gc_percent", F.round(gc, 6)).filter((gc >= min_gc) & (gc <= max_gc))
    if five_prime_g:
        rows = rows.filter(F.col("guide_dna").startswith("G"))
    high = F.col("low") + size - 1
    plus = F.col("strand") == "+"
    span = lambda at, n: (F.when(plus, F.col("low") + at).otherwise(high - at - n + 1), F.when(plus, F.col("low") + at + n - 1).otherwise(high - at))
    g, p = span(guide_at, guide_length), span(pam_at, len(pam))
    cut = F.lit(None).cast("bigint") if cut_offset is None else F.when(plus, F.col("low") + pam_at + cut_offset).otherwise(high - pam_at - cut_offset)
    return rows.select(
        "record", "strand", g[0].alias("guide_start"), g[1].alias("guide_end"), p[0].alias("pam_start"), p[1].alias("pam_end"), cut.alias("cut_position"), "guide_dna", "pam_sequence", "gc_percent"
    )


def off_target_census(guides: DataFrame, sites: DataFrame, *, max_mismatches: int = 2, guide_length: int = 20) -> DataFrame:
    """Reference sites within ``max_mismatches`` of each distinct guide.

    Equal guides and equal sites are joined once, with counts. A pair is compared in the first of the
    ``max_mismatches + 1`` segments in which it agrees.
    """
    parts = _segments(guide_length, max_mismatches + 1)
    piece = lambda c: F.array(*[F.substring(c, a + 1, b - a) for a, b in parts])
    g = guides.select("guide_dna").distinct().withColumn("gp", piece("guide_dna"))
    s = sites.groupBy(F.col("guide_dna").alias("site_dna")).agg(F.count(F.lit(1)).alias("copies")).withColumn("sp", piece("site_dna"))
    ge = g.select("guide_dna", "gp", F.posexplode("gp").alias("gi", "gx"))
    se = s.select("site_dna", "copies", "sp", F.posexplode("sp").alias("si", "sx"))
    pairs = ge.join(se, (F.col("gi") == F.col("si")) & (F.col("gx") == F.col("sx")))
    first = F.array_position(F.zip_with("gp", "sp", lambda x, y: x == y), F.lit(True)) == F.col("gi") + 1
    hits = pairs.filter(first).withColumn("d", hamming(F.col("guide_dna"), F.col("site_dna"))).filter(F.col("d") <= max_mismatches)
    counts = hits.groupBy("guide_dna").agg(
        F.sum("copies").alias("reference_match_count"), F.sum(F.when(F.col("d") == 0, F.col("copies")).otherwise(0)).alias("exact_reference_match_count"),
        F.sum(F.when(F.col("d") > 0, F.col("copies")).otherwise(0)).alias("near_reference_match_count"), F.min("d").cast("bigint").alias("best_reference_mismatches"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return g.select("guide_dna").join(counts, "guide_dna", "left").select(
        "guide_dna", zero("reference_match_count"), zero("exact_reference_match_count"), zero("near_reference_match_count"), "best_reference_mismatches"
    )
