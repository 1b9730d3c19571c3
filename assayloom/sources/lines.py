"""Plain and gzipped text lines, with line numbers per file when the format needs them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], *, spread: int | None = None) -> DataFrame:
    """``line`` per text line. A gzipped file is one split; ``spread`` shuffles it over that many."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))
    return lines.repartition(spread) if spread else lines


def numbered_lines(spark: SparkSession, path: str | list[str], *, skip_empty: bool = False) -> DataFrame:
    """``(file, n, line)`` with 0-based line numbers; ``skip_empty`` leaves empty lines out and does not count them."""
    groups = line_groups(located_lines(spark.read.text(path)), 1, skip_empty=skip_empty)
    return groups.select("file", "n", F.col("l0").alias("line"))


def located_lines(text: DataFrame) -> DataFrame:
    """Lines of a text scan, a streaming one too, with their file, the start of their block and whether the file has other blocks."""
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("cut"), F.regexp_replace("value", "\r$", "").alias("line"),
    )


def line_groups(lines: DataFrame, size: int, *, skip_empty: bool = False) -> DataFrame:
    """``(file, n, l0, l1, …)``: each ``size`` lines of a file as one row, numbered from 0; what a file's last group lacks is null.

    ``lines`` come straight from ``located_lines``. None is shuffled: the lines of a file block come in order, so a
    block needs only the number of lines before it and the up to ``size - 1`` lines behind it that end its last
    group. Both come from one row per block, for files of several blocks only.
    """
    if skip_empty:
        lines = lines.filter("line <> ''")
    parts = lines.filter("cut").select("file", "block", "line")
    if size == 1:
        blocks = parts.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines")).withColumn("head", F.array().cast("array<string>"))
    else:
        blocks = parts.mapInArrow(_block_heads(size - 1), "file string, block bigint, lines bigint, head array<string>")
    in_file = Window.partitionBy("file").orderBy("block")
    placed = blocks.select(
        "file", "block", F.sum("lines").over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.flatten(F.collect_list("head").over(in_file.rowsBetween(1, max(1, size - 1)))).alias("behind"),
    )
    # One short row per file block, so its size is bounded by the number of blocks; the hint also keeps the lines in order.
    known = lines.drop("cut").join(F.broadcast(placed), ["file", "block"], "left").select(
        "file", "block", "line", F.coalesce("before", F.lit(0)).cast("bigint").alias("before"), F.slice("behind", 1, max(1, size - 1)).alias("behind")
    )
    columns = ", ".join(f"l{i} string" for i in range(size))
    return known.mapInArrow(_grouper(size), f"file string, n bigint, {columns}")


def _block_heads(keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number of lines and first lines of each file block of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}  # one entry per block of this task
        for batch in batches:
            file, block, line = batch.columns
            place = block.to_numpy(zero_copy_only=False)
            names = file.dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (code[1:] != code[:-1])]) if len(place) else []
            for start, end in zip(starts, [*starts[1:], len(place)]):
                entry = found.setdefault((names.dictionary[int(code[start])].as_py(), int(place[start])), [0, []])
                entry[0] += int(end - start)
                missing = keep - len(entry[1])
                if missing > 0:
                    entry[1] += line.slice(start, min(missing, end - start)).to_pylist()
        rows = [(f, b, n, head) for (f, b), (n, head) in found.items()]
        types = pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())
        arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(arrays, ["file", "block", "lines", "head"])

    return run


def _grouper(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut the lines of each file block into groups; a group belongs to the block that holds its first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "n", *[f"l{i}" for i in range(size)]]
        here, number, skip, held, behind = None, 0, 0, [], []

        def whole(file: str, lines: pa.Array) -> pa.RecordBatch:
            count = len(lines) // size
            columns = [lines.take(pa.array(np.arange(i, count * size, size))) for i in range(size)]
            return pa.RecordBatch.from_arrays([pa.array([file] * count, pa.string()), pa.array(np.arange(number, number + count)), *columns], names)

        def rest() -> Iterator[pa.RecordBatch]:
            if held:
                lines = (held + behind + [None] * size)[:size]
                yield whole(here[0], pa.array(lines, pa.string()))

        for batch in batches:
            file, block, line, before, after = batch.columns
            place = block.to_numpy(zero_copy_only=False)
            coded = file.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (code[1:] != code[:-1])]) if len(place) else []
            for start, end in zip(starts, [*starts[1:], len(place)]):
                now = coded.dictionary[int(code[start])].as_py(), int(place[start])
                if now != here:
                    yield from rest()
                    earlier = before[int(start)].as_py()
                    here, held, skip = now, [], -earlier % size
                    number = (earlier + skip) // size
                    behind = after[int(start)].as_py() or []
                passed = min(skip, int(end - start))
                skip -= passed
                piece = line.slice(start + passed, end - start - passed)
                if held and len(piece):
                    piece = pa.concat_arrays([pa.array(held, piece.type), piece])
                    held = []
                count = len(piece) // size
                if count:
                    yield whole(now[0], piece)
                    number += count
                if len(piece):
                    held = piece.slice(count * size).to_pylist()
        yield from rest()

    return run
