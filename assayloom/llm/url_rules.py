"""URL filters as a sort-merge range join.

A rule (host, path) holds for its host and all subdomains and for all paths that begin with its path.
Hosts are written from the top-level label down, so that with a fixed number of labels a rule is the
interval of keys that begin with it. Rules and page keys are sorted together, and one sweep keeps the
stack of rules that are open at the current key: its top is the longest rule for that host.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.session import shuffle_width

#: Keys looked at per slice to place the borders of the slices; borders only spread the work.
KEYS_PER_SLICE = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _key(labels: Column, depth: Column, path: Column) -> Column:
    """The last ``depth`` labels from the top down, a zero character, the path."""
    return F.concat(F.array_join(F.slice(F.reverse(labels), F.lit(1), depth), "."), F.lit("\x00"), path)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by slice and key, rules before equal keys; gives each key its innermost open rule."""
    stack: list[tuple[str, str, str, str]] = []
    at = None
    for batch in batches:
        rows: list[tuple] = []
        for part, key, is_page, host, path, rule, verdict in zip(*[c.to_pylist() for c in batch.columns]):
            if part != at:
                at, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_page:
                stack.append((key, rule, verdict, host))
            elif stack:
                _, best, says, rule_host = stack[-1]
                rows.append((host, path, best, says, len(best), len(rule_host)))
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string()] * 4 + [pa.int32()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "path", "rule", "verdict", "size", "host_size"])


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule for each distinct (``host``, ``path``) of ``places``; places without one are left out.

    ``rules`` has ``host``, ``path`` and ``verdict``. Longest means the most characters in host and
    path together, then in the host; of equal rules ``block`` comes before ``allow``. Rules with a null
    or an empty host fit nothing.
    """
    width = shuffle_width(places.sparkSession)
    rules = (
        rules.filter(F.length("host") > 0)
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("labels", F.split("host", r"\."))
    )
    # At most as many numbers as a host name has labels.
    depths = [r[0] for r in rules.select(F.size("labels")).distinct().collect()]
    if not depths:
        return places.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    pages = (
        places.filter(F.length("host") > 0)
        .select("host", "path")
        .distinct()
        .withColumn("labels", F.split("host", r"\."))
        .withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)])))
        .filter(F.size("labels") >= F.col("depth"))
        .select(_key(F.col("labels"), F.col("depth"), F.col("path")).alias("key"), "host", "path")
    )
    # A look at a fixed number of keys per slice; every key is matched all the same.
    look = pages.orderBy(F.xxhash64("key", "host"), "key").limit(KEYS_PER_SLICE * width).select("key").collect()
    ladder = sorted(r[0] for r in look)
    borders = ladder[KEYS_PER_SLICE // 2 :: KEYS_PER_SLICE]

    @F.pandas_udf("int")
    def slice_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect.bisect_right(borders, k)).astype("int32")

    starts = rules.select(_key(F.col("labels"), F.size("labels"), F.col("path")).alias("key"), "host", "path", "verdict")
    opened = starts.withColumn("first", slice_of("key")).withColumn("last", slice_of(F.concat("key", F.lit(LAST))))
    open_rules = opened.select(
        F.explode(F.sequence("first", "last")).alias("part"), "key", F.lit(False).alias("is_page"), "host", "path", F.concat("host", "path").alias("rule"), "verdict"
    )
    keys = pages.select(slice_of("key").alias("part"), "key", F.lit(True).alias("is_page"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    swept = keys.unionByName(open_rules).repartition(width, "part").sortWithinPartitions("part", "key", "is_page").mapInArrow(
        _sweep, "host string, path string, rule string, verdict string, size int, host_size int"
    )
    best = F.max(F.struct("size", "host_size", "rule", "verdict")).alias("best")
    return swept.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (host and path of the deciding rule, else null) and ``verdict``.

    A url that is null or has no ``://`` has an empty host and path, meets no rule and gets ``default``.
    Every row is judged, repeated ones alike; columns of ``pages`` named like the new ones are replaced.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    placed = pages.select(*kept, url_host(text).alias("host"), url_path(text).alias("path"))
    best = match_rules(placed, rules).select(F.col("host").alias("__host"), F.col("path").alias("__path"), "rule", F.col("verdict").alias("__verdict"))
    joined = placed.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    return joined.select(*kept, "host", "path", "rule", F.coalesce("__verdict", F.lit(default)).alias("verdict"))
