"""Cell cleaning, row and column filters, calculated columns."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.functions.cells import dtype_of, is_blank, natural_key, number_of, resolve, text_of


def clean_cells(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    trim: bool = True,
    collapse_whitespace: bool = True,
    missing_values: Iterable[str] = (),
    count_column: str | None = None,
) -> DataFrame:
    """Trim, collapse runs of white space and blank out missing tokens (compared without case).

    With ``count_column`` each row also carries how many of its cells changed.
    """
    names = [resolve(df, c) for c in (columns or df.columns)]
    tokens = [t.strip().lower() for t in missing_values if t.strip()]
    cleaned, changed = {}, []
    for name in names:
        original = F.coalesce(text_of(df, name), F.lit(""))
        text = F.regexp_replace(original, r"^\s+|\s+$", "") if trim else original
        if collapse_whitespace:
            text = F.regexp_replace(text, r"\s+", " ")
        if tokens:
            text = F.when(F.lower(text).isin(tokens), F.lit("")).otherwise(text)
        cleaned[name] = text
        changed.append((text != original).cast("bigint"))
    out = df.select(
        *[cleaned[c].alias(c) if c in cleaned else F.col(c) for c in df.columns],
        *([reduce(lambda a, b: a + b, changed).alias(count_column)] if count_column else []),
    )
    return out


def plain_test(df: DataFrame, column: str, operator: str, value: object) -> Column | None:
    """The bare comparison of a typed column that every row meeting the rule meets too; readers can skip rows by it.

    Cell rules wrap columns (blank cells, text forms), which no reader understands. None where there is
    no such comparison.
    """
    kind, own = dtype_of(df, column), F.col(f"`{resolve(df, column)}`")
    if isinstance(kind, T.StringType):
        return own == str(value) if operator == "==" and str(value).strip() else None
    if not isinstance(kind, T.NumericType) or isinstance(kind, T.DecimalType):
        return None
    try:
        number = float(str(value))
    except ValueError:
        return None
    if not math.isfinite(number):
        return None
    if isinstance(kind, T.IntegralType):
        # A whole limit of the column's own kind is compared without a cast of the column.
        whole = {">": math.floor, ">=": math.ceil, "<": math.ceil, "<=": math.floor, "==": math.floor}.get(operator)
        limit = whole(number) if whole else 0
        if whole is None or operator == "==" and limit != number or not -(2**31) <= limit < 2**31:
            return None
    else:
        limit = number
    tests = {">": own > limit, ">=": own >= limit, "<": own < limit, "<=": own <= limit, "==": own == limit}
    return tests.get(operator)


def _with_plain(condition: Column, plain: Column | None) -> Column:
    return condition if plain is None else plain & condition


def rule_condition(df: DataFrame, column: str, operator: str, value: object = "") -> Column:
    """One filter rule as a condition. A missing cell counts as blank text."""
    cell = F.coalesce(text_of(df, column), F.lit(""))
    wanted = str(value)
    if operator == "contains":
        return F.lower(cell).contains(wanted.lower())
    if operator == "not_contains":
        return ~F.lower(cell).contains(wanted.lower())
    if operator == "equals":
        typed_text = isinstance(dtype_of(df, column), T.StringType)
        return _with_plain(cell == wanted, plain_test(df, column, "==", wanted) if typed_text else None)
    if operator == "not_equals":
        return cell != wanted
    if operator == "empty":
        return is_blank(cell)
    if operator == "not_empty":
        return ~is_blank(cell)
    number = number_of(df, column)
    limit = F.lit(float(wanted))
    compare = {
        "gt": number > limit,
        "gte": number >= limit,
        "lt": number < limit,
        "lte": number <= limit,
    }
    if operator not in compare:
        raise ValueError(f"unknown filter operator {operator!r}")
    sign = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[operator]
    return _with_plain(F.coalesce(compare[operator], F.lit(False)), plain_test(df, column, sign, wanted))


def filter_rows(df: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Keep rows that meet every ``(column, operator[, value])`` rule."""
    for rule in rules:
        df = df.filter(rule_condition(df, *rule))
    return df


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{resolve(df, c)}`") for c in columns])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    gone = {resolve(df, c) for c in columns}
    if len(gone) == len(df.columns):
        raise ValueError("a table keeps at least one column")
    return df.drop(*gone)


def filter_columns(df: DataFrame, rules: Sequence[tuple[str, str]], *, keep: bool = True) -> DataFrame:
    """Keep (or remove) the columns whose name meets every ``(operator, text)`` rule."""
    tests = {
        "contains": lambda name, text: text in name,
        "not_contains": lambda name, text: text not in name,
        "equals": lambda name, text: name == text,
        "not_equals": lambda name, text: name != text,
        "starts_with": lambda name, text: name.startswith(text),
        "ends_with": lambda name, text: name.endswith(text),
    }
    chosen = [
        c for c in df.columns if all(tests[op](c.lower(), text.lower()) for op, text in rules) == keep
    ]
    if not chosen:
        raise ValueError("a table keeps at least one column")
    return df.select(*chosen)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [~is_blank(text_of(df, c)) for c in df.columns]))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any filled cell; one aggregated row decides."""
    filled = df.agg(*[F.max(~is_blank(text_of(df, c))).alias(c) for c in df.columns]).first()
    kept = [c for c in df.columns if filled[c]]
    return df.select(*kept) if kept else df


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def add_calculated_column(
    df: DataFrame,
    left: str,
    operation: str,
    right: str | None = None,
    constant: float | None = None,
    name: str = "calculated_value",
    digits: int = 6,
) -> DataFrame:
    """Arithmetic on one or two columns; impossible results (x/0, log of 0, missing) are NULL."""
    a = number_of(df, left)
    if operation == "zscore":
        moments = df.select(a.alias("v")).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
        one_row = moments.select(F.struct("m", "s").alias("z")).scalar()
        spread = one_row["s"]
        result = F.when(spread > 0, (a - one_row["m"]) / spread)
    elif operation in ("log2", "log10"):
        log = F.log2(a) if operation == "log2" else F.log10(a)
        result = F.when(a > 0, log)
    else:
        b = number_of(df, right) if right is not None else F.lit(constant).cast("double")
        results = {
            "add": a + b,
            "subtract": a - b,
            "multiply": a * b,
            "divide": F.when(b != 0, a / b),
            "percent": F.when(b != 0, a / b * 100),
        }
        if operation not in results:
            raise ValueError(f"unknown operation {operation!r}")
        result = results[operation]
    return df.withColumn(name, F.round(result, digits))


def where_condition(
    df: DataFrame, column: str, operator: str, value: object = "", *, like_mode: str = "contains",
    blank_as_zero: bool = False,
) -> Column:
    """A WHERE term: numeric when both sides are numbers, otherwise on text.

    ``like`` looks for the text without its ``%`` signs, without case; ``like_mode="sql"`` is real SQL LIKE.
    """
    text = F.coalesce(text_of(df, column), F.lit(""))
    number = number_of(df, column)
    if blank_as_zero:
        number = F.when(is_blank(text), F.lit(0.0)).otherwise(number)
    operator = operator.lower()
    if operator in ("like", "not like"):
        if like_mode == "sql":
            found = text.like(str(value))
        else:
            found = F.lower(text).contains(str(value).replace("%", "").lower())
        return found if operator == "like" else ~found
    if operator in ("is", "is not"):
        blank = value is None or str(value).strip() == ""
        same = is_blank(text) if blank else text == str(value)
        return same if operator == "is" else ~same

    def as_number(item: object) -> float | None:
        try:
            found = float(str(item))
        except ValueError:
            return None
        return found if found == found and abs(found) != float("inf") else None

    def equal(item: object, positive: bool = True) -> Column:
        wanted = as_number(item)
        same = text == str(item) if wanted is None else F.coalesce(number == wanted, text == str(item))
        typed_text = isinstance(dtype_of(df, column), T.StringType)
        # Number texts such as 1.0 and 1 are equal, so text columns allow no bare test for numbers.
        plain = plain_test(df, column, "==", item) if positive and not blank_as_zero and (wanted is None) == typed_text else None
        return _with_plain(same, plain)

    if operator == "in":
        return reduce(lambda a, b: a | b, [equal(item) for item in value])
    if operator == "=":
        return equal(value)
    if operator in ("!=", "<>"):
        return ~equal(value, positive=False)
    wanted = as_number(value)
    key, wanted_key = natural_key(text), natural_key(F.lit(str(value)))

    def ordered(test) -> Column:
        by_text = test(key, wanted_key)
        return by_text if wanted is None else F.when(number.isNotNull(), test(number, F.lit(wanted))).otherwise(by_text)

    tests = {
        ">": lambda a, b: a > b,
        ">=": lambda a, b: a >= b,
        "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b,
    }
    plain = None if blank_as_zero or wanted is None else plain_test(df, column, operator, value)
    if plain is not None and operator in ("<", "<="):
        plain = plain | F.col(f"`{resolve(df, column)}`").isNull()  # a missing cell is a blank text, before all numbers
    return _with_plain(ordered(tests[operator]), plain)


def where(df: DataFrame, terms: Sequence[tuple], **options) -> DataFrame:
    """Keep rows that meet every ``(column, operator, value)`` term."""
    for term in terms:
        df = df.filter(where_condition(df, *term, **options))
    return df


def project(df: DataFrame, columns: Sequence[str | tuple[str, str]]) -> DataFrame:
    """SELECT list: names, ``(name, alias)`` pairs and ``"*"``."""
    out: list[Column] = []
    for item in columns:
        if item == "*":
            out += [F.col(f"`{c}`") for c in df.columns]
        else:
            name, alias = item if isinstance(item, tuple) else (item, resolve(df, item))
            out.append(F.col(f"`{resolve(df, name)}`").alias(alias))
    return df.select(*out)


def filter_stream(df: DataFrame, field: str, operator: str, value: object) -> DataFrame:
    """Filter records or rows by one field; ``length`` stands for the sequence length."""
    if field == "length" and "length" not in df.columns and "sequence" in df.columns:
        actual, number, typed = F.length("sequence").cast("string"), F.length("sequence").cast("double"), False
    else:
        typed = True
        actual, number = F.coalesce(text_of(df, field), F.lit("")), number_of(df, field)
    if operator == "contains":
        return df.filter(actual.contains(str(value)))
    if operator == "matches":
        return df.filter(actual.rlike(str(value)))
    if operator == "==":
        text = typed and isinstance(dtype_of(df, field), T.StringType)
        return df.filter(_with_plain(actual == str(value), plain_test(df, field, "==", value) if text else None))
    if operator == "!=":
        return df.filter(actual != str(value))
    limit = F.lit(float(str(value)))
    tests = {">": number > limit, ">=": number >= limit, "<": number < limit, "<=": number <= limit}
    return df.filter(_with_plain(tests[operator], plain_test(df, field, operator, value) if typed else None))


