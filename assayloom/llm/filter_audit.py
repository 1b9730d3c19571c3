"""How filters act on each other, in every order of applying them.

A document that fails some of the filters survives exactly those subsets of filters that hold none of
them. With five filters its survival is a 32-bit word, one bit for each subset. Words are counted by
bit position with carry-save adders: three words of one weight become a sum word of that weight and a
carry word of the next, in whole arrays at a time, until a few words stand for all. The survivors of
all subsets then give every figure of every order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.batches import map_rows
from assayloom.session import settle

FILTERS = "ABCDE"
#: Failure conditions: under so many words; distinct words under so many percent; capitals above so many percent; any of these signs; a text that stands under a smaller key.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
SIGNS = re.compile(r"[#$%&*|]")
CAPITALS = re.compile(r"[A-Z]")
SUBSETS = 1 << len(FILTERS)
#: Parts whose counts a task holds before it hands them on, and words it counts at once.
HELD_PARTS, AT_ONCE = 4096, 1 << 16
GROUPS = ("all", "good", "toxic")
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def own_failures(text: str) -> int:
    """Bits of the filters that a text fails by itself (all but the last)."""
    words = text.encode("utf-8", "surrogatepass").split()
    fails = int(len(words) < MIN_WORDS)
    fails |= (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
    fails |= (100 * len(CAPITALS.findall(text)) > MAX_CAPITALS * len(text)) << 2
    return fails | (SIGNS.search(text) is not None) << 3


def survival_words() -> np.ndarray:
    """For each set of failed filters the word whose bit s is set if no filter of subset s is failed."""
    masks = np.arange(SUBSETS)
    return ((masks[:, None] & masks[None, :]) == 0).astype(np.uint64).dot(np.uint64(1) << masks.astype(np.uint64)).astype(np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set, by carry-save addition."""
    counts, weight = np.zeros(SUBSETS, dtype=np.int64), 1
    words = np.asarray(words, dtype=np.uint32)
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            carries.append((a & b) | (c & (a ^ b)))
            words = np.concatenate([a ^ b ^ c, words[3 * third :]])
        for word in words.tolist():
            counts += weight * (word >> np.arange(SUBSETS) & 1)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return counts


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _count_survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of each subset by part and label for the rows (part, fails, good, toxic) of a task."""
    table = survival_words()
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        names = list(held)
        columns = [pa.array(names, pa.string()), *[pa.array([held[n][g].tolist() for n in names], pa.list_(pa.int64())) for g in range(len(GROUPS))]]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["part", *GROUPS])

    for batch in _larger(batches):
        parts = batch.column(0).dictionary_encode()
        place = parts.indices.to_numpy()
        words = table[batch.column(1).to_numpy()]
        labels = [np.ones(len(words), dtype=bool), *[batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (2, 3)]]
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(len(parts.dictionary) + 1))
        for i, name in enumerate(parts.dictionary.to_pylist()):
            rows = order[edges[i] : edges[i + 1]]
            have = held.setdefault(name, np.zeros((len(GROUPS), SUBSETS), dtype=np.int64))
            for g, label in enumerate(labels):
                have[g] += positional_counts(words[rows[label[rows]]])
        if len(held) > HELD_PARTS:
            yield out()
    if held:
        yield out()


def document_failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``id``, ``part`` and ``fails`` (bits of the failed filters, A lowest) of each row.

    A null text is empty, and so is a null part. Empty texts fail A only, and E if a smaller key has one too. A row with
    a null key is no smaller than any other and none is smaller than it, so it never fails E. Rows that share a key
    do not make each other fail E.
    """

    def make():
        def work(keys, parts, texts):
            texts = [t or "" for t in texts]
            return [keys, [p or "" for p in parts], [own_failures(t) for t in texts], [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]]

        return work

    kind = docs.schema[key].dataType.simpleString()
    columns = [F.col(f"`{key}`").alias("__key"), F.col(f"`{part}`").cast("string").alias("__part"), F.col(f"`{text}`").cast("string").alias("__text")]
    rows = settle(map_rows(docs, columns, make, f"id {kind}, part string, fails int, print binary"))
    # Narrow rows and group minima are written before they meet, so that a text of very many copies can be split.
    first = settle(rows.filter("id IS NOT NULL").groupBy("print").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("print").alias("__print"), "first"))
    joined = rows.join(first, F.col("print") == F.col("__print"), "left")
    again = F.when(F.col("id") > F.col("first"), F.lit(1 << 4)).otherwise(F.lit(0))
    return joined.select("id", "part", F.col("fails").bitwiseOR(again).alias("fails"))


def subset_survivors(failures: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row per part: for all, good and toxic documents an array with the survivors of each of the 32 subsets.

    A document is good (toxic) if some row of ``labels`` with its key says 1; one without labels is neither.
    """
    marks = labels.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__id")).agg(
        F.coalesce(F.max(F.col(f"`{quality}`") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col(f"`{toxic}`") == 1), F.lit(False)).alias("toxic")
    )
    marked = failures.join(settle(marks), F.col("id") == F.col("__id"), "left")
    dealt = marked.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    counted = dealt.mapInArrow(_count_survivors, "part string, all array<bigint>, good array<bigint>, toxic array<bigint>")
    sums = [F.array(*[F.sum(F.col(g)[i]) for i in range(SUBSETS)]).alias(g) for g in GROUPS]
    return counted.groupBy("part").agg(*sums)


def order_figures(everyone: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[dict]:
    """The figures of each step of each order from the survivors of all subsets."""
    size = len(FILTERS)
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    shapley = {
        f: sum(factorial(s.bit_count()) * factorial(size - 1 - s.bit_count()) * int(everyone[s] - everyone[s | b]) for s in range(SUBSETS) if not s & b) for f, b in bit.items()
    }
    out = []
    for order in ORDERS:
        done = 0
        for step, name in enumerate(order, 1):
            b = bit[name]
            after, removed = done | b, int(everyone[done] - everyone[done | b])
            out.append({
                "filter_order": order, "step": step, "kept": int(everyone[after]), "removed": removed, "redundant": int(everyone[0] - everyone[b]) - removed,
                "unique_fails": int(everyone[(SUBSETS - 1) ^ b] - everyone[SUBSETS - 1]), "good_lost": int(good[done] - good[after]), "toxic_lost": int(toxic[done] - toxic[after]), "shapley": shapley[name],
            })
            done = after
    return out


_FIGURES = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(n, pa.int64()) for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]])
_FIGURES_DDL = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            figures = order_figures(*[np.array(row[g], dtype=np.int64) for g in GROUPS])
            yield pa.RecordBatch.from_pylist([{"part": row["part"], **f} for f in figures], schema=_FIGURES)


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """600 rows for each part: what each filter keeps, removes and loses at its step, for every order of the five.

    Nulls, repeated rows and keys: see ``document_failures`` and ``subset_survivors``. Without documents there are no rows.
    """
    counts = subset_survivors(document_failures(docs, key, text, part), labels, key)
    return counts.select("part", *GROUPS).mapInArrow(_expand, _FIGURES_DDL)
