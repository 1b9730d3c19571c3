"""Near-duplicate documents by SetSketch registers.

A register is the exponentially spaced, truncated minimum of one hash over all shingles, so sketches
of parts merge by their larger registers and similar sets agree in many of them. Bands of registers
bring candidates together; the likelihood of the registers, given the exact set sizes, estimates the
similarity of two candidates; and what may be linked is confirmed on the full sets.

Equal sets are one class from the start. In a band bucket each class meets two members picked by an
order of the bucket's own, never all others. Classes that may be linked, directly or through others,
form clusters. A cluster is compared exactly in blocks of bounded size: every block in itself and with
the cluster's first member, then only members that are not yet joined to that one with all other blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.batches import groups_of, map_rows, short_batches
from assayloom.llm.components import connected
from assayloom.session import settle, shuffle_width

SHINGLE = 5
#: A pair is linked if 100 * intersection >= percent * union; this is the percent unless another is asked for.
LINK_PERCENT = 85
#: Rows of a band, and the chance that a pair at the link differs in all bands: it sets their number, 20 at 85 percent.
ROWS, MISSED = 4, 4e-7
#: Base and rate of the registers, and the largest register.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Estimates lower than the link by more than this, about nine deviations, are not confirmed.
BELOW = 0.35
BLOCK = 64

_GOLD = 0x9E3779B97F4A7C15


def bands_for(percent: int) -> int:
    """Bands that a pair at the link shares one of but for a chance of ``MISSED``."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    return 1 if percent == 100 else math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)))


_SEEDS: dict[int, np.ndarray] = {}


def _seeds(bands: int) -> np.ndarray:
    if bands not in _SEEDS:
        _SEEDS[bands] = np.array([(xxhash.xxh64_intdigest(b"register", seed=i) | 1) for i in range(bands * ROWS)], dtype=np.uint64)
    return _SEEDS[bands]


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, no words are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    wide = min(size, len(words))
    out = np.full(len(words) - wide + 1, wide, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(wide):
            out = out * np.uint64(_GOLD) + codes[i : len(codes) - wide + 1 + i]
            out ^= out >> np.uint64(29)
    return np.unique(out)


def registers(shingles: np.ndarray, bands: int = bands_for(LINK_PERCENT)) -> np.ndarray:
    """SetSketch registers of a set of hashes: 16-bit numbers, larger for smaller minima."""
    seeds = _seeds(bands)
    least = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), 512):
            x = shingles[start : start + 512, None] * seeds
            x ^= x >> np.uint64(31)
            x *= np.uint64(_GOLD)
            least = np.minimum(least, x.min(axis=0))
    wait = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(wait, 1e-300)) / np.log(BASE)), 0, TOP).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likely_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity that makes the registers of each pair (rows of ``a`` and ``b``) most likely."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        p, q = chance(np.maximum(u - v * j, 1e-12)), chance(np.maximum(v - u * j, 1e-12))
        return above * np.log(p) + below * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood has one peak
        left, right = low + (high - low) / 3, high - (high - low) / 3
        up = fit(left) < fit(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a bounded number of sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    column = (np.cumsum(often) - 1)[place]
    inside = often[place]
    owner, column = owner[inside], column[inside]
    total, width = np.zeros((len(sets), len(sets)), dtype=np.int64), int(often.sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, width, 8192):
        lo, hi = np.searchsorted(column, [start, start + 8192])
        grid = np.zeros((len(sets), min(8192, width - start)), dtype=np.float32)
        grid[owner[lo:hi], column[lo:hi] - start] = 1
        total += (grid @ grid.T).astype(np.int64)
    return total


def linked(sets: list[np.ndarray], percent: int = LINK_PERCENT) -> np.ndarray:
    sizes, common = np.array([len(s) for s in sets]), common_counts(sets)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def spanning(ids: np.ndarray, links: np.ndarray, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what the full link matrix joins: each id with the smallest id of its part."""
    label = ids.copy() if label is None else label.copy()
    while True:
        least = np.where(links, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        lower = np.minimum(label, least)
        for value in np.unique(label[lower < label]):  # a label that was joined before moves as a whole
            part = label == value
            lower[part] = lower[part].min()
        if (lower == label).all():
            break
        label = lower
    return [(int(i), int(m)) for i, m in zip(ids, label) if i != m]


def sketch_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = LINK_PERCENT) -> DataFrame:
    """``id``, ``n_shingles``, ``print`` (of the exact set) and ``registers`` of each row."""

    bands = bands_for(percent)

    def make():
        def work(keys, texts):
            sets = [shingle_set(t) for t in texts]
            return [keys, [len(s) for s in sets], [blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [registers(s, bands).tobytes() if len(s) else None for s in sets]]

        return work

    columns = [F.col(key).cast("bigint").alias("__key"), F.col(text).cast("string").alias("__text")]
    return map_rows(docs, columns, make, "id bigint, n_shingles bigint, print binary, registers binary")


def likely_links(classes: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """Pairs of classes (``a``, ``b``) that share a band bucket's pick and whose registers allow a link."""
    salt = F.xxhash64("band", F.lit("salt"))
    width = 2 * ROWS
    pieces = classes.select(
        F.col("rep"), F.posexplode(F.array(*[F.substring("registers", 1 + i * width, width) for i in range(bands_for(percent))])).alias("band", "piece")
    ).withColumn("place", F.col("rep").bitwiseXOR(salt))
    picks = settle(pieces.groupBy("band", "piece").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter(F.col("first") != F.col("last")))
    met = pieces.join(picks, ["band", "piece"]).select("rep", F.explode(F.array(F.col("first").bitwiseXOR(salt), F.col("last").bitwiseXOR(salt))).alias("pick"))
    pairs = met.filter(F.col("rep") != F.col("pick")).select(F.least("rep", "pick").alias("a"), F.greatest("rep", "pick").alias("b")).distinct()

    @F.pandas_udf("double")
    def estimate(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        a, b = (np.frombuffer(b"".join(s), dtype="<u2").reshape(len(s), -1) for s in (x, y))
        return pd.Series(likely_similarity(a, b, n.to_numpy(dtype=float), m.to_numpy(dtype=float)))

    def side(name: str) -> DataFrame:
        return classes.select(F.col("rep").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))

    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return sized.filter(near).withColumn("estimate", estimate("r_a", "r_b", "n_a", "n_b")).filter(F.col("estimate") >= percent / 100 - BELOW).select("a", "b")


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each group of (cluster, block, chunk): links within it, without those inside a known part."""
    for group in groups_of(batches, 3):
        ids, parts = group.column("id").to_numpy(), group.column("part").to_numpy()
        sets = [np.frombuffer(s, dtype="<u8") for s in group.column("shingles").to_pylist()]
        out = [] if len(np.unique(parts)) < 2 else spanning(ids, linked(sets, percent), parts)
        a, b = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _in_groups(rows: DataFrame, percent: int) -> DataFrame:
    keys = ["cluster", "block", "chunk"]
    dealt = short_batches(rows).select(*keys, "id", "part", "shingles").repartition(shuffle_width(rows.sparkSession), *keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(lambda batches: _compare(batches, percent), "a bigint, b bigint")


def confirmed_links(docs: DataFrame, links: DataFrame, key: str = "doc_id", text: str = "text", percent: int = LINK_PERCENT) -> DataFrame:
    """Pairs (``a``, ``b``) of confirmed links that join what all true links inside the likely clusters join."""
    below = connected(links, "a", "b")
    members = settle(below.unionByName(below.select(F.col("component").alias("id"), "component").distinct()))
    sizes = settle(members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    placed = members.join(sizes, "component").select("id", F.col("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))

    def make():
        return lambda ids, clusters, blocks, block, texts: [ids, clusters, blocks, block, [shingle_set(t).tobytes() for t in texts]]

    texts = docs.select(F.col(key).cast("bigint").alias("__key"), F.col(text).cast("string").alias("__text"))
    held = texts.join(placed, F.col("__key") == F.col("id")).select("id", "cluster", "blocks", "block", "__text")
    sets = settle(map_rows(held, held.columns, make, "id bigint, cluster bigint, blocks int, block int, shingles binary").filter(F.length("shingles") > 0))

    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = sets.withColumn("block", F.explode(F.when(F.col("id") == F.col("cluster"), everywhere).otherwise(F.array("block"))))
    first = settle(_in_groups(own.select("cluster", "block", F.lit(0).alias("chunk"), "id", F.col("id").alias("part"), "shingles"), percent))

    parts = connected(first, "a", "b").select(F.col("id").alias("__id"), "component")
    split = sets.filter(F.col("blocks") > 1).join(parts, F.col("id") == F.col("__id"), "left").withColumn("part", F.coalesce("component", "id")).drop("__id", "component")
    # The first member of a cluster is its smallest id, so its part is named after it.
    outside = F.col("part") != F.col("cluster")
    chunks = settle(split.filter(outside).groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks")))
    all_chunks = F.sequence(F.lit(0), F.col("chunks") - 1)
    facing = split.join(chunks, "cluster")
    rows = facing.withColumn("chunk", F.explode(all_chunks)).unionByName(
        facing.filter(outside).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int")).withColumn("block", F.explode(everywhere))
    )
    return first.unionByName(_in_groups(rows, percent))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = LINK_PERCENT) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest linked key, itself included) and ``kept`` for each row.

    Texts link if their common shingles are ``percent`` of all of both, or more.

    Words are lower-cased in A-Z only. Null texts and texts without words have an empty set and link
    with nothing. Rows with a null key are kept and link with nothing. A key that repeats with
    different texts is one document that is linked if one of its texts is; equal rows are equal results.
    """
    sketches = settle(sketch_documents(docs, key, text, percent))
    usable = sketches.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = settle(usable.groupBy("print").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers")))
    found = connected(confirmed_links(docs, settle(likely_links(classes, percent)), key, text, percent), "a", "b")
    named = settle(classes.join(found, F.col("rep") == F.col("id"), "left").select(F.col("print").alias("__print"), F.coalesce("component", "rep").alias("component")))
    linked_rows = sketches.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("print")).alias("print"))
    joined = linked_rows.join(named, F.col("print") == F.col("__print"), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
