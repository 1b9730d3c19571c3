"""Connected components by contraction and alternating stars; the links never leave the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.session import settle

#: Links that a task contracts together.
RUN = 1 << 20


def star(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of what these links join, and the smallest node of each."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            break
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    inner = low != np.arange(len(nodes))
    return nodes[inner], nodes[low[inner]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of links as stars, with a number of its own."""
    held, rows, run = [], 0, TaskContext.get().partitionId() << 32

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nodes, least = star(table.column(0).to_numpy(), table.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(least, pa.int64()), pa.array(np.full(len(nodes), run), pa.int64())], names=["u", "v", "run"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= RUN:
            yield flush()
            held, rows, run = [], 0, run + 1
    if rows:
        yield flush()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, left: str, right: str) -> DataFrame:
    """``id`` and ``component`` (its smallest member) of every linked node that is not itself the smallest.

    Tasks first contract the links they hold, a bounded number at a time. If one run held all of them, that is the result.
    Else each round hangs every larger neighbour of a node under the smallest one, then every smaller
    neighbour, until nothing changes. The smallest neighbours are written to the shared checkpoint
    folder before they are joined, so that Spark can split a node with very many links.
    """
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    stars = settle(pairs.mapInArrow(_contract, "u bigint, v bigint, run bigint"))
    first, last = stars.agg(F.min("run"), F.max("run")).first()
    edges, mark = stars.select("u", "v"), None
    if first != last:
        edges = settle(edges.distinct())
        mark = _mark(edges)
    while mark is not None:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large)
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
