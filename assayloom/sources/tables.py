"""Delimited and JSON tables in, delimited, JSON and Markdown tables out."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Delimiters that are tried.
DELIMITERS = ("\t", ",", ";", "|")
SNIFF_LINES = 25


def sniff_delimiter(lines: Sequence[str]) -> str:
    """The delimiter with the steadiest, widest split of the first lines."""
    def score(mark: str) -> float:
        counts = [len(next(csv.reader([line], delimiter=mark), [""])) - 1 for line in lines]
        used = [c for c in counts if c > 0]
        if not used:
            return 0.0
        consistency = Counter(used).most_common(1)[0][1] / len(used)
        return consistency * len(used) / len(counts) * (sum(used) / len(used) + 1)

    return max(DELIMITERS, key=score) if lines else "\t"


def column_ids(labels: Sequence[str]) -> list[str]:
    """Lower snake-case ids, unique; a blank label becomes ``column_N``."""
    taken: set[str] = set()
    out = []
    for i, label in enumerate(labels, 1):
        base = re.sub(r"[^a-z0-9]+", "_", label.strip().lower()).strip("_") or f"column_{i}"
        name, n = base, 2
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name)
        out.append(name)
    return out


def read_delimited(
    spark: SparkSession, path: str, *, delimiter: str = "auto", has_header: bool = True, multi_line: bool = False
) -> DataFrame:
    """Text columns named by the header; short rows are padded. Labels stay in the field metadata."""
    first = [r["value"] for r in spark.read.text(path).limit(SNIFF_LINES).collect()]
    mark = sniff_delimiter([line for line in first if line.strip()]) if delimiter == "auto" else delimiter
    cells = next(csv.reader(io.StringIO("\n".join(first)), delimiter=mark), [])
    labels = [c.strip() or f"Column {i}" for i, c in enumerate(cells, 1)] if has_header else [f"Column {i}" for i in range(1, len(cells) + 1)]
    schema = T.StructType([T.StructField(c, T.StringType(), True, {"label": label}) for c, label in zip(column_ids(labels), labels)])
    return spark.read.csv(path, schema=schema, sep=mark, header=has_header, quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE", enforceSchema=True)


# Keys that may hold the rows of a JSON table.
ROW_KEYS = ("rows", "data", "records", "items")


def read_json_table(spark: SparkSession, path: str, *, json_lines: bool = False) -> DataFrame:
    """An array of objects, an object that holds one, or an array of arrays led by its header. Nested cells become JSON text."""
    def table(df: DataFrame) -> DataFrame:
        cells = []
        for field in df.schema.fields:
            column = F.col(f"`{field.name}`")
            nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
            cells.append((F.to_json(column) if nested else column.cast("string")).alias(field.name))
        return df.select(*cells)

    raw = spark.read.option("multiLine", not json_lines).json(path)
    if raw.columns == ["_corrupt_record"]:
        rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("t"))
        header = rows.select(F.element_at("t", 1).alias("h")).first()["h"]
        ids = column_ids(header)
        body = rows.select(F.explode(F.slice("t", F.lit(2), F.size("t"))).alias("r"))
        return body.select(*[F.try_element_at("r", F.lit(i)).alias(c) for i, c in enumerate(ids, 1)])
    for key in ROW_KEYS:
        if key in raw.columns and isinstance(raw.schema[key].dataType, T.ArrayType) and isinstance(raw.schema[key].dataType.elementType, T.StructType):
            return table(raw.select(F.explode(key).alias("r")).select("r.*"))
    return table(raw)


def write_delimited(df: DataFrame, path: str, *, delimiter: str = "\t", mode: str = "errorifexists") -> None:
    """Delimited files headed by the column labels."""
    labelled = df.select(*[F.col(f"`{f.name}`").alias(f.metadata.get("label", f.name)) for f in df.schema.fields])
    labelled.write.csv(path, sep=delimiter, header=True, quote='"', escape='"', mode=mode, emptyValue="")


def write_json(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.write.json(path, mode=mode, ignoreNullFields=False)


def markdown_lines(df: DataFrame) -> DataFrame:
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))


def write_markdown(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Markdown rows; the head goes to a first part of its own."""
    labels = [f.metadata.get("label", f.name) for f in df.schema.fields]
    head = ["| " + " | ".join(labels) + " |", "| " + " | ".join("---" for _ in labels) + " |"]
    write_with_header(markdown_lines(df), head, path, mode=mode)


def write_with_header(lines: DataFrame, header: Sequence[str], path: str, *, mode: str = "errorifexists") -> None:
    """Text parts with a few header lines in the first part."""
    body = lines.select("line")
    if header:
        head = lines.sparkSession.createDataFrame([("\n".join(header),)], "line string").coalesce(1)
        body = head.unionByName(body)
    body.write.mode(mode).text(path)
