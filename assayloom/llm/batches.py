"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 256


def short_batches(df: DataFrame) -> DataFrame:
    """Let Arrow batches of whole texts hold ``BATCH_ROWS`` rows at most, so that memory follows the longest texts only."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_KEY, "10000")) not in range(1, BATCH_ROWS + 1):
        conf.set(BATCH_KEY, str(BATCH_ROWS))
    return df


def map_rows(df: DataFrame, columns: Sequence[str], make: Callable[[], Callable[..., list]], schema: str) -> DataFrame:
    """Run a function over lists of column values, one Arrow batch at a time.

    ``make()`` runs once in a task and gives a function from one list per column to one list per
    column of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                made = work(*[batch.column(i).to_pylist() for i in range(batch.num_columns)])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, kinds)], names=names)

    import pyspark.sql.pandas.types as kinds_of
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    names = [f.name for f in fields]
    kinds = [kinds_of.to_arrow_type(f.dataType) for f in fields]
    return short_batches(df).select(*columns).mapInArrow(run, schema)


def crc_fold(key: str, parts: int):
    """``crc32`` of the key as text, modulo ``parts``; null keys have none."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns; the rows must come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        start = 0
        marks = list(zip(*[batch.column(i).to_pylist() for i in range(keys)]))
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, mark
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
