"""Pattern sets, weight matrices and regular expressions against plain scans."""

import re
import time

import numpy as np
import pytest

from assayloom.functions.patternset import OTHER, PatternSet, Texts
from assayloom.functions.sequence import matching_symbols, reverse_complement_text
from assayloom.operators import patterns, scans
from assayloom.operators.sequences import CHUNK


def places(pattern):
    return [matching_symbols(c) for c in pattern]


def plain_hits(text, pattern, most=0):
    out = []
    for p in range(len(text) - len(pattern) + 1):
        bad = [i + 1 for i, c in enumerate(pattern) if text[p + i] not in c]
        if len(bad) <= most:
            out.append((p, bad))
    return out


def test_search_equals_plain_scan():
    random = np.random.default_rng(1)
    text = "".join(random.choice(list("ACGTN-"), 4000, p=[0.3, 0.2, 0.2, 0.2, 0.05, 0.05]))
    # More patterns than a word has lanes, of many lengths.
    sets = [places("".join(random.choice(list("ACGTNRY"), int(random.integers(1, 14))))) for _ in range(90)]
    found, codes = PatternSet(sets), np.frombuffer(text.encode(), dtype=np.uint8)
    for most in (0, 1, 2, 3, 5):
        got = {i: set() for i in range(len(sets))}
        for i, starts in found.search(codes, most):
            got[i] |= set(starts.tolist())
            wrong = found.rejected(i, codes, starts)
            assert (wrong.sum(axis=1) <= most).all()
        for i, pattern in enumerate(sets):
            assert got[i] == {p for p, _ in plain_hits(text, pattern, most)}, (i, most)
    with pytest.raises(ValueError):
        PatternSet([[]])


def test_texts_are_cut_as_they_are():
    texts = ["ACGT", "", "é日ACG", "T"]
    for some in (texts, ["AC", "G"]):
        joined = Texts(some)
        assert [joined.cut(np.array([s]), np.array([n])).to_pylist()[0] for s, n in zip(joined.starts, joined.sizes)] == some
        assert joined.owner(joined.starts).tolist() == list(range(len(some))) and joined.codes.max() <= OTHER


def seqs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "record bigint, sequence string")


def test_hits_cross_tiles_and_strands(spark):
    random = np.random.default_rng(2)
    text = "".join(random.choice(list("ACGT"), 2 * CHUNK + 500))
    text = text[: CHUNK - 3] + "GATTACA" + text[CHUNK + 4 :]
    rows = scans.scan_motifs(seqs(spark, [text, "", "gauuaca", "GATNACA", None]), [{"id": "m", "pattern": "GATTACA"}, {"id": "n", "pattern": "TGNAW"}], flank=3).collect()
    want = set()
    for record, source in enumerate([text, "", "GATTACA", "GATNACA"]):
        for name, pattern in (("m", "GATTACA"), ("n", "TGNAW")):
            for strand, turned in (("+", pattern), ("-", reverse_complement_text(pattern))):
                for p, _ in plain_hits(source, places(turned)):
                    piece = source[p : p + len(pattern)]
                    want.add((record, name, strand, p + 1, p + len(pattern), source[max(0, p - 3) : p], piece if strand == "+" else reverse_complement_text(piece), source[p + len(pattern) : p + len(pattern) + 3]))
    assert {(r["record"], r["motif_id"], r["strand"], r["start"], r["end"], r["left_context"], r["matched_text"], r["right_context"]) for r in rows} == want and len(rows) == len(want)
    assert any(r["start"] == CHUNK - 2 for r in rows if r["motif_id"] == "m")


def test_mismatches_and_required_ends(spark):
    random = np.random.default_rng(3)
    text = "".join(random.choice(list("ACGTN"), 3000))
    motif = "ACGTRCAN"
    rows = scans.scan_mismatches(seqs(spark, [text]), [{"id": "x", "pattern": motif}], max_mismatches=2, exact_three_prime=2).collect()
    want = set()
    for strand, turned in (("+", motif), ("-", reverse_complement_text(motif))):
        for p, bad in plain_hits(text, places(turned), 2):
            bad = bad if strand == "+" else sorted(len(motif) + 1 - i for i in bad)
            if max(bad, default=0) <= len(motif) - 2:
                want.add((strand, p + 1, len(bad), ",".join(map(str, bad))))
    assert {(r["strand"], r["start"], r["mismatches"], r["mismatch_positions"]) for r in rows} == want and len(want) > 50


def test_regex_hits_and_back_references(spark):
    texts = ["xabab ab", "", "aabbaab", "nothing"]
    rows = patterns.regex_hits(spark.createDataFrame(list(enumerate(texts)), "record bigint, text string"), ["record"], r"(a|b)\1", 2).collect()
    want = {(i, m.start() + 1, t[m.start() : m.start() + 2]) for i, t in enumerate(texts) for m in re.finditer(r"(?=(a|b)\1)", t)}
    assert {(r["record"], r["p"], r["matched"]) for r in rows} == want and len(want) == 3
    assert {r["left"] for r in rows if r["p"] == 3 and r["record"] == 2} == {"aa"}


def test_a_long_record_full_of_hits_is_linear(spark):
    size = 5_000_000
    frame = spark.range(1).selectExpr("id AS record", f"repeat('A', {size}) AS sequence")
    for motif, hits in (({"id": "a", "pattern": "AAAAAA"}, size - 5), ({"id": "r", "pattern": "A{6}", "syntax": "regex"}, size - 5)):
        start = time.perf_counter()
        assert scans.scan_motifs(frame, [motif], both_strands=False).count() == hits
        assert time.perf_counter() - start < 60
