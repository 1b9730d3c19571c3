"""Tiles searched for whole sets of patterns in one pass each; only hits become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from assayloom.functions.patternset import PatternSet, Texts
from assayloom.functions.sequence import COMPLEMENT_FROM, COMPLEMENT_TO
from assayloom.operators.text import CLOSE, OPEN

#: Symbols of the tiles that are joined to one array, and hits in an output batch.
AT_ONCE, HITS = 1 << 20, 1 << 16


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Runs of rows whose last column, the text, has about ``AT_ONCE`` symbols, with these texts joined."""
    for batch in batches:
        texts, first, held = batch.column(batch.num_columns - 1).to_pylist(), 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= AT_ONCE or i + 1 == len(texts):
                yield batch.slice(first, i + 1 - first), Texts(texts[first : i + 1])
                first, held = i + 1, 0


def _tile_rows(tiles: DataFrame, keep: Sequence[str], find: Callable[[Texts], Iterator[tuple]], fields: Sequence[StructField]) -> DataFrame:
    """The kept columns of each tile next to its hits; ``find`` gives tile numbers and one Arrow array per field."""
    schema = StructType([*[tiles.schema[c] for c in keep], *fields])
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _pieces(batches):
            for owner, *columns in find(texts):
                for low in range(0, len(owner), HITS):
                    mine = pa.array(owner[low : low + HITS])
                    kept = [batch.column(i).take(mine) for i in range(len(keep))]
                    made = [c.slice(low, HITS).cast(f.type) for c, f in zip(columns, list(shape)[len(keep) :])]
                    yield pa.RecordBatch.from_arrays([*kept, *made], schema=shape)

    return tiles.select(*keep, "text").mapInArrow(run, schema)


def tile_hits(
    tiles: DataFrame, keep: Sequence[str], patterns: Sequence[Sequence[str]], labels: Mapping[str, Sequence[str]], *, most: int = 0, flank: int | None = None, must_match: Sequence[Sequence[int]] | None = None,
) -> DataFrame:
    """Hits of all patterns (accepted symbols for each place) in the ``text`` of the tiles.

    Adds the pattern's ``labels``, ``p`` (1-based start in the tile), ``n`` (length), ``matched``; with ``flank`` the
    texts ``left`` and ``right`` of it; with ``most`` above 0 or ``must_match`` (places of each pattern, from 0, that may
    not be rejected) the 1-based rejected places ``bad``.
    """
    found = PatternSet(patterns)
    names = list(labels)
    values = [pa.array(labels[n], pa.string()) for n in names]
    with_bad = most > 0 or must_match is not None

    def find(texts: Texts) -> Iterator[tuple]:
        for pattern, starts in found.search(texts.codes, most):
            owner, size = texts.owner(starts), int(found.sizes[pattern])
            inside = starts - texts.starts[owner] + size <= texts.sizes[owner]
            starts, owner = starts[inside], owner[inside]
            for low in range(0, len(starts), HITS):
                s, o = starts[low : low + HITS], owner[low : low + HITS]
                if with_bad:
                    wrong = found.rejected(pattern, texts.codes, s)
                    if must_match is not None and len(must_match[pattern]):
                        good = ~wrong[:, list(must_match[pattern])].any(axis=1)
                        s, o, wrong = s[good], o[good], wrong[good]
                p = s - texts.starts[o]
                out = [o, *[v.take(pa.array(np.full(len(s), pattern))) for v in values], pa.array(p + 1), pa.array(np.full(len(s), size, dtype=np.int64)), texts.cut(s, np.full(len(s), size, dtype=np.int64))]
                if flank is not None:
                    before, after = np.minimum(p, flank), np.minimum(texts.sizes[o] - p - size, flank)
                    out += [texts.cut(s - before, before), texts.cut(s + size, after)]
                if with_bad:
                    rows, places = np.nonzero(wrong)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(s)))]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(places + 1, pa.int64())))
                yield tuple(out)

    fields = [*[StructField(n, StringType()) for n in names], StructField("p", LongType()), StructField("n", LongType()), StructField("matched", StringType())]
    fields += [StructField("left", StringType()), StructField("right", StringType())] if flank is not None else []
    fields += [StructField("bad", ArrayType(LongType()))] if with_bad else []
    return _tile_rows(tiles, keep, find, fields)


def tile_scores(tiles: DataFrame, keep: Sequence[str], weights: Sequence[Mapping[str, float]], threshold: float, both_strands: bool = True) -> DataFrame:
    """Windows whose weights, as percent between the lowest and highest sum, reach ``threshold``: ``strand``, ``p``, ``matched``, ``relative``.

    Scores of all windows of some tiles are one array; the minus strand reads complements from the window's end.
    """
    from pyspark.sql.types import DoubleType

    size = len(weights)
    low, high = sum(min(c.values()) for c in weights), sum(max(c.values()) for c in weights)
    table = np.full((size, 128), np.nan)
    for i, column in enumerate(weights):
        for symbol, weight in column.items():
            table[i, ord(symbol)] = float(weight)
    turned = np.arange(128)
    for symbol, other in zip(COMPLEMENT_FROM, COMPLEMENT_TO):
        turned[ord(symbol)] = ord(other)
    sides = [("+", list(range(size)), table)] + ([("-", list(range(size - 1, -1, -1)), table[:, turned])] if both_strands else [])

    def find(texts: Texts) -> Iterator[tuple]:
        windows = len(texts.codes) - size + 1
        for strand, places, values in sides:
            for first in range(0, windows, HITS):
                n = min(HITS, windows - first)
                score = np.zeros(n)
                for i, place in enumerate(places):
                    score = score + values[i][texts.codes[first + place : first + place + n]]
                relative = np.full(n, 100.0) if high == low else (score - low) / (high - low) * 100
                hit = np.flatnonzero(relative >= threshold)
                starts = first + hit
                owner = texts.owner(starts)
                inside = starts - texts.starts[owner] + size <= texts.sizes[owner]
                starts, owner = starts[inside], owner[inside]
                p = starts - texts.starts[owner] + 1
                yield owner, pa.array([strand] * len(starts), pa.string()), pa.array(p), texts.cut(starts, np.full(len(starts), size, dtype=np.int64)), pa.array(relative[hit[inside]])

    fields = [StructField("strand", StringType()), StructField("p", LongType()), StructField("matched", StringType()), StructField("relative", DoubleType())]
    return _tile_rows(tiles, keep, find, fields)


def _wrapped(regex: str) -> str:
    """The expression as a first group of its own; numbers of groups that it refers to go up by one."""
    out, i = [], 0
    while i < len(regex):
        if regex[i] == "\\" and i + 1 < len(regex):
            number = ""
            while i + 1 + len(number) < len(regex) and regex[i + 1 + len(number)].isdigit():
                number += regex[i + 1 + len(number)]
            refers = number and number[0] != "0"
            out.append("\\" + (str(int(number) + 1) if refers else regex[i + 1]))
            i += 1 + (len(number) if refers else 1)
        else:
            out.append(regex[i])
            i += 1
    return f"({''.join(out)})"


def regex_hits(rows: DataFrame, keep: Sequence[str], regex: str, flank: int = 0) -> DataFrame:
    """Non-empty matches that start at each place of ``text``, overlaps included: ``p``, ``matched``, ``left``, ``right``.

    One replacement marks each start and copies the match behind the mark; the places are the sums of what lies between.
    """
    marked = rows.select(*keep, F.split(F.regexp_replace("text", f"(?={_wrapped(regex)})", OPEN + "$1" + CLOSE), OPEN).alias("pieces"), "text")
    schema = StructType([*[rows.schema[c] for c in keep], StructField("p", LongType()), *[StructField(n, StringType()) for n in ("matched", "left", "right")]])
    shape = to_arrow_schema(schema)

    def hits(pieces: list[str], text: str) -> Iterator[tuple]:
        at = len(pieces[0])
        for piece in pieces[1:]:
            matched, rest = piece.split(CLOSE, 1)
            if matched:
                end = at + len(matched)
                yield at + 1, matched, text[max(0, at - flank) : at], text[end : end + flank]
            at += len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, owner = [], []
            for i in range(batch.num_rows):
                for hit in hits(batch.column(len(keep))[i].as_py(), batch.column(len(keep) + 1)[i].as_py()):
                    held.append(hit)
                    owner.append(i)
                    if len(held) == HITS:
                        yield out(batch, owner, held)
                        held, owner = [], []
            if held:
                yield out(batch, owner, held)

    def out(batch: pa.RecordBatch, owner: list[int], held: list[tuple]) -> pa.RecordBatch:
        mine = pa.array(owner)
        made = [pa.array(c, f.type) for c, f in zip(zip(*held), list(shape)[len(keep) :])]
        return pa.RecordBatch.from_arrays([*[batch.column(i).take(mine) for i in range(len(keep))], *made], schema=shape)

    return marked.mapInArrow(run, schema)
