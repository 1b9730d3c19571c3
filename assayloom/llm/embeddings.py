"""Near-duplicate embeddings by NN-descent.

Equal vectors are one class. Seeds come from orders by random sign codes, where each class is compared
with the next few. NN-descent then lets the neighbours of every class meet each other, both listed and
listing ones, and keeps the best few per class and, so that a list full of near copies hides no one,
what joins close classes however full their lists are. Clusters of close classes are compared exactly, in
blocks of bounded size, and only blocks whose projections are near enough to hold a link. An audit compares
a fixed number of classes with all others; while it finds a missed link, more seeds are drawn, and places
(label and dimension) where it still finds one after the last draw are compared exactly as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.batches import groups_of, map_rows, short_batches
from assayloom.llm.components import connected
from assayloom.llm.near_duplicates import spanning
from assayloom.session import settle, shuffle_width

LINK = 0.98
#: Clusters join classes at least so alike.
CLOSE = 0.95
#: Orders of a place of up to ``CROWD`` classes, and so many more for each doubling; bits of a code (so many that large
#: places are told apart), and classes compared on each side in an order.
ORDERS, CROWD, BITS, REACH = 12, 4096, 40, 5
#: Length of neighbour lists, rounds of descent, classes of a middle or a block compared together.
LIST, ROUNDS, BLOCK = 10, 2, 128
#: Block of places that are compared as a whole.
WIDE = 1024
#: Classes audited, and seed draws at most.
AUDITED, DRAWS = 256, 3


def unit_vector(values: list | None) -> np.ndarray | None:
    """The vector in double precision at length 1; None if it is null, empty, zero, or holds null or non-finite values."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, dtype=np.float64)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top
    return x / np.linalg.norm(x)


def _direction(*seed: int, rows: int = 1) -> np.ndarray:
    """Random directions for the dimension that ends ``seed``."""
    return np.random.default_rng(seed).standard_normal((rows, seed[-1]))


def prepare(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """``id``, ``place`` (label and dimension), ``print`` (of place and vector), ``unit`` and ``cell`` of vectors that can link, nulls for others."""
    reach = float(np.sqrt(2 - 2 * LINK)) * 1.0000001

    def make():
        across: dict[int, np.ndarray] = {}

        def work(ids, values, labels):
            out: list[tuple] = []
            for v, name in zip(values, labels):
                x = unit_vector(v) if name is not None else None
                if x is None:
                    out.append((None, None, None, None))
                    continue
                if len(x) not in across:
                    d = _direction(99, len(x))[0]
                    across[len(x)] = d / np.linalg.norm(d)
                place = f"{name}/{len(x)}"
                raw = (x + 0.0).tobytes()
                out.append((place, blake2b(raw, digest_size=16, key=blake2b(place.encode()).digest()).digest(), raw, int(np.floor(x @ across[len(x)] / reach))))
            return [ids, *map(list, zip(*out))]

        return work

    columns = [F.col(key).cast("bigint").alias("id"), F.col(embedding).alias("embedding"), F.col(label).cast("string").alias("label")]
    return map_rows(vectors, columns, make, "id bigint, place string, print binary, unit binary, cell int")


def _unit(column: pa.ChunkedArray | pa.Array, kind: str = "<f8") -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1)


def seed_pairs(classes: DataFrame, draw: int) -> DataFrame:
    """Pairs ``a``, ``b``, ``alike`` that stand close to each other in one of the orders, of which larger places have more."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ids, orders = (batch.column(c).to_pylist() for c in ("place", "id", "orders"))
            rows: list[tuple] = []
            for i, raw in enumerate(batch.column("unit").to_pylist()):
                x = np.frombuffer(raw, dtype="<f8")
                short = x.astype("<f4").tobytes()
                for order in range(orders[i]):
                    if (order, len(x)) not in planes:
                        planes[order, len(x)] = _direction(draw, order, len(x), rows=BITS + 1)
                    side = planes[order, len(x)] @ x
                    rows.append((order, places[i], int((side[1:] > 0) @ powers), float(side[0]), ids[i], short))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    planes: dict[tuple[int, int], np.ndarray] = {}
    powers = 1 << np.arange(BITS, dtype=np.int64)[::-1]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.binary()]
    names = ["turn", "place", "code", "side", "id", "vector"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch]) if batch.num_rows else None
            if table is None:
                continue
            old = sum(b.num_rows for b in held)
            marks, ids = list(zip(table["turn"].to_pylist(), table["place"].to_pylist())), table["id"].to_numpy()
            starts = [0, *[i for i in range(1, len(marks)) if marks[i] != marks[i - 1]], len(marks)]
            found: list[tuple[np.ndarray, ...]] = []
            for lo, hi in zip(starts, starts[1:]):
                x = _unit(table["vector"].slice(lo, hi - lo), "<f4")
                for step in range(1, min(REACH, hi - lo - 1) + 1):
                    alike = np.einsum("ij,ij->i", x[:-step], x[step:])
                    first = max(0, old - lo - step)
                    found.append((ids[lo + first : hi - step], ids[lo + first + step : hi], alike[first:]))
            held = table.slice(max(0, table.num_rows - REACH)).combine_chunks().to_batches()
            columns = [np.concatenate(c) for c in zip(*found)] if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.float64()])], names=["a", "b", "alike"])

    order = ["turn", "place", "code", "side", "id"]
    doublings = F.greatest(F.lit(0.0), F.log2(F.count(F.lit(1)) / CROWD))
    sizes = classes.groupBy("place").agg(F.ceil(ORDERS * (1 + doublings)).cast("int").alias("orders"))
    coded = short_batches(classes.join(sizes, "place")).select("place", "id", "unit", "orders").mapInArrow(code, "turn int, place string, code bigint, side double, id bigint, vector binary")
    dealt = coded.repartitionByRange(shuffle_width(classes.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(meet, "a bigint, b bigint, alike double")


def best_lists(pairs: DataFrame, size: int = LIST) -> DataFrame:
    """The ``size`` most alike neighbours ``v`` of each ``u`` and all close ones, with their ``rank``, from pairs seen either way round."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "alike").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "alike"))
    once = both.groupBy("u", "v").agg(F.max("alike").alias("alike"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("alike"), "v"))
    return once.withColumn("rank", rank).filter((F.col("rank") <= size) | (F.col("alike") >= CLOSE - 1e-5))


def _tree(links: np.ndarray) -> np.ndarray:
    """A mask with links that join what all ``links`` join, one for each row but the first of its part."""
    out, new = np.zeros_like(links), np.ones(len(links), dtype=bool)
    for root in range(len(links)):
        front = np.flatnonzero(new[root : root + 1]) + root
        new[front] = False
        while len(front):
            reach = links[front] & new
            found = np.flatnonzero(reach.any(axis=0))
            out[front[reach[:, found].argmax(axis=0)], found] = True
            new[found] = False
            front = found
    return np.triu(out | out.T, 1)


def descend(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """One round: the members of each middle's list, and those that list it (in bounded chunks), meet; pairs that improve a list or join close classes."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 2):
            ids, first = np.unique(group["id"].to_numpy(), return_index=True)
            bars, x = group["bar"].to_numpy()[first], _unit(group["unit"])[first]
            alike = x @ x.T
            better = np.triu(alike > np.minimum(bars[:, None], bars[None, :]), 1)
            i, j = np.nonzero(better | _tree(alike >= CLOSE))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(alike[i, j])], names=["a", "b", "alike"])

    lists = lists.filter(F.col("rank") <= LIST)
    bars = lists.groupBy("u").agg(F.when(F.count(F.lit(1)) >= LIST, F.min("alike")).otherwise(F.lit(-2.0)).alias("bar"))
    known = settle(bars.join(classes.select(F.col("id").alias("u"), "unit"), "u").select(F.col("u").alias("id"), "bar", "unit"))
    widths = settle(lists.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks")).select(F.col("v").alias("middle"), "chunks"))
    listing = lists.select(F.col("v").alias("middle"), F.col("u").alias("id")).join(widths, "middle").select("middle", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id")
    listed = lists.select(F.col("u").alias("middle"), F.col("v").alias("id")).join(widths, "middle").select("middle", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id")
    rows = listing.unionByName(listed).distinct().join(known, "id").select("middle", "chunk", "id", "bar", "unit")
    dealt = short_batches(rows).repartition(shuffle_width(classes.sparkSession), "middle", "chunk").sortWithinPartitions("middle", "chunk")
    return dealt.mapInArrow(meet, "a bigint, b bigint, alike double")


def exact_links(members: DataFrame, size: int = BLOCK) -> DataFrame:
    """For classes of clusters (``id``, ``copies``, ``unit``, ``cell``, ``cluster``): ``id``, ``label`` (joins what is linked), ``n`` (linked vectors met).

    Linked vectors lie in the same or neighbouring cells. Cells are cut in blocks of about ``size``, and each
    two blocks of such cells meet once.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 5):
            ids, copies, left = group["id"].to_numpy(), group["copies"].to_numpy(), group["left"].to_numpy(zero_copy_only=False)
            x = _unit(group["unit"])
            links = x @ x.T >= LINK
            at, one, two = (group[c][0].as_py() for c in ("at", "one", "two"))
            if at % 2 or one != two:  # two blocks, of which one may be empty: only pairs across
                links &= left[:, None] != left[None, :]
            np.fill_diagonal(links, False)
            label = dict(spanning(ids, links))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([label.get(int(i), int(i)) for i in ids], pa.int64()), pa.array(links @ copies)], names=["id", "label", "n"])

    sizes = settle(members.groupBy("cluster", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks")))
    placed = members.join(sizes, ["cluster", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def beside(shift: int) -> DataFrame:
        other = sizes.select("cluster", (F.col("cell") + shift).alias("cell"), F.col("blocks").alias("others"))
        return placed.join(other, ["cluster", "cell"])

    def rows(frame: DataFrame, cell, one, two, left) -> DataFrame:
        return frame.select("cluster", cell.alias("at"), one.alias("one"), two.alias("two"), F.lit(0).alias("turn"), "id", "copies", "unit", left.alias("left"))

    same = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    within = rows(same, 2 * F.col("cell"), low, high, F.col("block") == low)
    upper = rows(beside(-1).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))), 2 * F.col("cell") + 1, F.col("block"), F.col("other"), F.lit(True))
    lower = rows(beside(1).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))), 2 * F.col("cell") - 1, F.col("other"), F.col("block"), F.lit(False))
    keys = ["cluster", "at", "one", "two", "turn"]
    dealt = short_batches(within.unionByName(upper).unionByName(lower)).repartition(shuffle_width(members.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(meet, "id bigint, label bigint, n bigint")


def audit(classes: DataFrame, counts: DataFrame, size: int = AUDITED) -> list[str]:
    """Places in which one of ``size`` classes, half of them with links, has more links than found; the classes are compared with all others."""
    half = size // 2
    with_links = counts.filter("n > 0").orderBy(F.xxhash64("id"), "id").limit(half).select("id")
    asked = classes.select("id").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(half).unionByName(with_links).distinct()
    rows = classes.join(F.broadcast(asked), "id").select("id", "place", "unit").limit(size).collect()
    by_place: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for place in {r["place"] for r in rows}:
        own = [r for r in rows if r["place"] == place]
        by_place[place] = np.array([r["id"] for r in own]), np.array([np.frombuffer(r["unit"], dtype="<f8") for r in own])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        for batch in batches:
            for place, ids, copies, raw in zip(*[batch.column(c).to_pylist() for c in ("place", "id", "copies", "unit")]):
                if place in by_place:
                    asked_ids, asked_units = by_place[place]
                    for i in asked_ids[asked_units @ np.frombuffer(raw, dtype="<f8") >= LINK].tolist():
                        if i != ids:
                            totals[i] = totals.get(i, 0) + copies
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["id", "true_n"])

    true = short_batches(classes).select("place", "id", "copies", "unit").mapInArrow(compare, "id bigint, true_n bigint").groupBy("id").agg(F.sum("true_n").alias("true_n"))
    # One row per audited class.
    short = true.join(counts, "id", "left").filter(F.col("true_n") > F.coalesce("n", F.lit(0))).select("id").collect()
    missed = {r["id"] for r in short}
    return sorted({r["place"] for r in rows if r["id"] in missed})


def near_embeddings(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` for each row.

    Rows are compared when their labels are equal and not null and their dimensions agree. Vectors that
    are null, empty, zero, or hold null or non-finite values link with nothing, and rows with a null key
    do not either; both are kept. Equal rows, even with the same key, count as vectors of their own.
    """
    ready = settle(prepare(vectors, key, embedding, label))
    usable = ready.filter(F.col("print").isNotNull() & F.col("id").isNotNull())
    classes = settle(
        usable.groupBy("print").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("place").alias("place"), F.max("unit").alias("unit"), F.max("cell").alias("cell"))
    )
    pairs = None
    for draw in range(DRAWS):
        seeds = seed_pairs(classes, draw)
        pairs = seeds if pairs is None else pairs.unionByName(seeds)
        pairs = lists = settle(best_lists(pairs))
        for _ in range(ROUNDS):
            known = lists.select(F.col("u").alias("a"), F.col("v").alias("b"), "alike")
            lists = settle(best_lists(known.unionByName(descend(lists, classes))))
        pairs = lists.select(F.col("u").alias("a"), F.col("v").alias("b"), "alike")
        below = connected(pairs.filter(F.col("alike") >= CLOSE - 1e-5), "a", "b")
        members = below.unionByName(below.select(F.col("component").alias("id"), "component").distinct()).withColumnRenamed("component", "cluster")
        met = settle(exact_links(classes.join(members, "id"), BLOCK))
        counts = settle(met.groupBy("id").agg(F.sum("n").alias("n")))
        missed = audit(classes, counts)
        if not missed:
            break
    else:  # the audit is not met: the places it names are compared as a whole
        whole = classes.filter(F.col("place").isin(missed))
        named = whole.groupBy("place").agg(F.min("id").alias("cluster"))
        others = classes.filter(~F.col("place").isin(missed)).join(members, "id")
        met = settle(exact_links(others, BLOCK).unionByName(exact_links(whole.join(named, "place"), WIDE)))
        counts = settle(met.groupBy("id").agg(F.sum("n").alias("n")))
    joined = connected(met.filter(F.col("id") != F.col("label")), "id", "label").withColumnRenamed("id", "__id")
    full = classes.join(counts, "id", "left").join(joined, F.col("id") == F.col("__id"), "left")
    named = settle(full.select(F.col("print").alias("__print"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component")))
    rows = ready.select("id", F.when(F.col("id").isNotNull(), F.col("print")).alias("print"))
    out = rows.join(named, F.col("print") == F.col("__print"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
