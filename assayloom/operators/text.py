"""Search and replace in text, word counts and item lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.cells import is_blank, natural_key, parse_number
from assayloom.operators.ladder import numbered
from assayloom.operators.once import explode_once

# Marks that cannot occur in interchanged text (Unicode noncharacters).
OPEN, CLOSE = "﷐", "﷑"

# English stop words left out of word counts (the Snowball project's list, with what is left of
# its contractions when an apostrophe splits them).
STOP_WORDS = (
    "a about above after again against ain all am an and any are aren as at be because been before "
    "being below between both but by can could couldn d did didn do does doesn doing don down during "
    "each few for from further had hadn has hasn have haven having he her here hers herself him himself "
    "his how i if in into is isn it its itself just ll m ma me might mightn more most must mustn my "
    "myself need needn no nor not now o of off on once only or other our ours ourselves out over own re "
    "s same shan she should shouldn so some such t than that the their theirs them themselves then there "
    "these they this those through to too under until up ve very was wasn we were weren what when where "
    "which while who whom why will with won would wouldn y you your yours yourself yourselves"
).split()

# Fixed value: what counts as a word.
WORD_PATTERN = r"[\p{L}\p{N}][\p{L}\p{N}'-]*"


def text_pattern(pattern: str, mode: str = "plain", case_sensitive: bool = False) -> str:
    quoted = pattern if mode == "regex" else "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return quoted if case_sensitive else "(?iu)" + quoted


def match_offsets(line: Column, pattern: str) -> Column:
    """Array of ``(start, matched_text)`` with 1-based starts, in order, without empty matches."""
    pieces = F.split(F.regexp_replace(line, pattern, OPEN + "$0" + CLOSE), OPEN)
    first = F.length(F.element_at(pieces, 1)).cast("bigint")
    start = F.struct(first.alias("at"), F.array().cast("array<struct<start:bigint,matched_text:string>>").alias("hits"))

    def step(acc: Column, piece: Column) -> Column:
        matched = F.substring_index(piece, CLOSE, 1)
        hit = F.struct((acc["at"] + 1).alias("start"), matched.alias("matched_text"))
        return F.struct(
            (acc["at"] + F.length(piece) - 1).alias("at"),
            F.when(F.length(matched) > 0, F.concat(acc["hits"], F.array(hit))).otherwise(acc["hits"]).alias("hits"),
        )

    return F.aggregate(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda a: a["hits"])


def search_text(
    df: DataFrame, text: str, pattern: str, replacement: str = "", *, keys: Sequence[str] = (),
    mode: str = "plain", case_sensitive: bool = False,
) -> DataFrame:
    """Every match inside the lines of each text row, numbered per row, with 1-based columns."""
    regex = text_pattern(pattern, mode, case_sensitive)
    lines = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")

    def of_line(line: Column, index: Column) -> Column:
        return F.transform(
            match_offsets(line, regex),
            lambda m: F.struct((index + 1).cast("bigint").alias("line"), m["start"].alias("start"), m["matched_text"].alias("matched_text")),
        )

    matched = F.col("m.matched_text")
    new_text = F.regexp_replace(matched, regex, replacement) if mode == "regex" else F.lit(replacement)
    return df.filter(F.col(text).rlike(regex)).select(
        *keys, F.posexplode_outer(F.flatten(F.transform(lines, of_line))).alias("i", "m")
    ).filter("m IS NOT NULL").select(
        *keys,
        (F.col("i") + 1).cast("bigint").alias("match"),
        F.col("m.line").alias("line"),
        F.col("m.start").alias("start"),
        (F.col("m.start") + F.length(matched) - 1).alias("end"),
        matched.alias("matched_text"),
        new_text.alias("replacement"),
    )


def replace_text(df: DataFrame, text: str, pattern: str, replacement: str, *, mode: str = "plain",
                 case_sensitive: bool = False) -> DataFrame:
    new = replacement if mode == "regex" else replacement.replace("\\", "\\\\").replace("$", "\\$")
    return df.withColumn(text, F.regexp_replace(text, text_pattern(pattern, mode, case_sensitive), new))


def extract_matches(df: DataFrame, text: str, pattern: str, *, delimiter: str = "\n", mode: str = "plain",
                    case_sensitive: bool = False, name: str = "matches") -> DataFrame:
    found = F.regexp_extract_all(F.col(text), F.lit(text_pattern(pattern, mode, case_sensitive)), F.lit(0))
    return df.withColumn(name, F.array_join(F.filter(found, lambda m: m != ""), delimiter))


def remove_matching_lines(df: DataFrame, text: str, pattern: str, *, mode: str = "plain",
                          case_sensitive: bool = False) -> DataFrame:
    regex = text_pattern(pattern, mode, case_sensitive)
    lines = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")
    return df.withColumn(text, F.array_join(F.filter(lines, lambda line: ~line.rlike(regex)), "\n"))


def word_counts(
    df: DataFrame, text: str, *, extra_stop_words: Iterable[str] = (), minimum_length: int = 3,
    max_words: int | None = None, case_sensitive: bool = False,
) -> DataFrame:
    """All words, or the ``max_words`` most frequent, with their rank and their share of all kept words."""
    source = F.col(text) if case_sensitive else F.lower(F.col(text))
    stop = sorted({*STOP_WORDS, *[w.lower() for w in extra_stop_words]})
    words = (
        explode_once(df, F.regexp_extract_all(source, F.lit(WORD_PATTERN), F.lit(0)), "token")
        .select(F.regexp_replace("token", r"^[-']+|[-']+$", "").alias("word"))
        .filter((F.length("word") >= minimum_length) & ~F.lower("word").isin(stop))
    )
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("t")).scalar()
    top = counts if max_words is None else counts.orderBy(F.desc("count"), "word").limit(max_words)
    ranked = numbered(top, [F.desc("count"), F.col("word")], "rank")
    return ranked.select(
        "rank", "word", "count", F.round(F.col("count") / total * 100, 4).alias("frequency_percent")
    )


def _item_key(item: Column, case_sensitive: bool) -> Column:
    return item if case_sensitive else F.lower(item)


def list_counts(df: DataFrame, item: str, order: str, *, case_sensitive: bool = False) -> DataFrame:
    """Item counts ignoring case, spelled as first seen, most frequent first."""
    text = F.trim(F.col(item))
    return (
        df.filter(~is_blank(F.col(item)))
        .select(text.alias("__item"), F.col(order).alias("__order"))
        .groupBy(_item_key(F.col("__item"), case_sensitive).alias("__key"))
        .agg(F.min_by("__item", "__order").alias("item"), F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), natural_key(F.col("item")), "item")
        .select("item", "count")
    )


def unique_list(df: DataFrame, item: str, order: str, *, case_sensitive: bool = False) -> DataFrame:
    """First spelling of each item, with the place where it was first seen."""
    return (
        df.filter(~is_blank(F.col(item)))
        .groupBy(_item_key(F.trim(F.col(item)), case_sensitive).alias("__key"))
        .agg(F.min_by(F.trim(F.col(item)), order).alias("item"), F.min(order).alias(order))
        .select("item", order)
    )


def list_order(item: Column, mode: str = "natural", case_sensitive: bool = False) -> list[Column]:
    """Sort columns for a list: natural, numeric (numbers first) or plain text."""
    compared = _item_key(item, case_sensitive)
    if mode == "numeric":
        return [parse_number(item).asc_nulls_last(), compared.asc()]
    return [natural_key(compared).asc()] if mode == "natural" else [compared.asc()]


def sort_list(df: DataFrame, item: str, order: str, *, mode: str = "natural", case_sensitive: bool = False) -> DataFrame:
    return df.orderBy(*list_order(F.col(item), mode, case_sensitive), F.col(order))
