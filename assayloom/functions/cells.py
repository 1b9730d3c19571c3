"""Column functions for table cells: missing values, numbers read from text, natural order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that count as missing.
MISSING_TOKENS = ("NA", "N/A", "na", "n/a", "null", "NULL", "-")

# Fixed value: the plain decimal numbers accepted from text cells.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[resolve(df, name)].dataType


def resolve(df: DataFrame, name: str) -> str:
    """Find a column by id, then by label, both ignoring case."""
    for field in df.schema.fields:
        if field.name == name:
            return field.name
    wanted = name.strip().lower()
    for field in df.schema.fields:
        if field.name.lower() == wanted:
            return field.name
    for field in df.schema.fields:
        if str(field.metadata.get("label", "")).strip().lower() == wanted:
            return field.name
    raise ValueError(f"no column {name!r} among {df.columns}")


def text_of(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{resolve(df, name)}`")
    return column if isinstance(dtype_of(df, name), T.StringType) else column.cast("string")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def is_missing(text: Column, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    return is_blank(text) | F.trim(text).isin(*tokens)


def finite(number: Column) -> Column:
    number = number.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def parse_number(text: Column) -> Column:
    """The number written in a text cell, NULL when it is not a finite decimal number."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_PATTERN), finite(trimmed.try_cast("double")))


def number_of(df: DataFrame, name: str) -> Column:
    """A column as DOUBLE; already numeric columns skip the text test."""
    kind = dtype_of(df, name)
    column = F.col(f"`{resolve(df, name)}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(column)
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    return parse_number(column.cast("string"))


def value_text(df: DataFrame, name: str, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    """Trimmed text of a cell, NULL when missing."""
    text = F.trim(text_of(df, name))
    return F.when(~is_missing(text, tokens), text)


def natural_key(text: Column) -> Column:
    """Sort key that orders digit runs by value and everything else without case.

    A digit run becomes its length followed by its digits, so numbers of any length order by value.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))

    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(
            F.lower(run)
        )

    return F.transform(runs, key)


def round_to(column: Column, digits: int = 6) -> Column:
    return F.round(column.cast("double"), digits)


def safe_div(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)
