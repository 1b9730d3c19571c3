"""Table joins with trimmed, case-folded keys; id extraction; mate pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.functions.cells import dtype_of, resolve, text_of
from assayloom.operators.once import plain


def join_key(df: DataFrame, name: str, case_sensitive: bool = False, *, typed: bool = False) -> Column:
    """Trimmed, case-folded key, NULL when blank; ``typed`` integer keys stay integers."""
    if typed:
        return F.col(f"`{resolve(df, name)}`").cast("bigint")
    text = F.trim(text_of(df, name))
    text = text if case_sensitive else F.lower(text)
    return F.when(text != "", text)


def _integral(df: DataFrame, name: str) -> bool:
    return isinstance(dtype_of(df, name), T.IntegralType)


def _keyed(df: DataFrame, keys: Sequence[str], prefix: str, case_sensitive: bool, typed: Sequence[bool]) -> DataFrame:
    """Add the key columns and a ``salt``: 0 for complete keys, spread numbers that meet no
    number of the other side for incomplete ones, so a third of blank keys is not one task."""
    parts = [join_key(df, k, case_sensitive, typed=kind) for k, kind in zip(keys, typed)]
    complete = parts[0].isNotNull()
    for part in parts[1:]:
        complete = complete & part.isNotNull()
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("int") + 1
    out = df.withColumn(f"__{prefix}s", F.when(complete, 0).otherwise(spread if prefix == "l" else -spread))
    for i, part in enumerate(parts):
        out = out.withColumn(f"__{prefix}{i}", F.when(complete, part))
    return out


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    how: str = "inner",
    *,
    case_sensitive: bool = False,
) -> DataFrame:
    """Inner, left or full join. Blank keys never match; right keys are dropped; clashing
    names get ``_right``. A full join is a left join plus the unmatched right rows, so
    that both halves can be split on a hot key at run time."""
    right_keys = right_keys or left_keys
    left_keys = [resolve(left, k) for k in left_keys]
    right_keys = [resolve(right, k) for k in right_keys]
    taken, names = {c.lower() for c in left.columns}, {}
    for column in right.columns:
        if column in right_keys:
            continue
        name, n = column, 1
        while name.lower() in taken:
            name = f"{column}_right" if n == 1 else f"{column}_right_{n}"
            n += 1
        taken.add(name.lower())
        names[column] = name
    typed = [_integral(left, a) and _integral(right, b) for a, b in zip(left_keys, right_keys)]
    l = _keyed(left, left_keys, "l", case_sensitive, typed)
    r = _keyed(right, right_keys, "r", case_sensitive, typed)
    pairs = [*map(str, range(len(left_keys))), *([] if how == "inner" else ["s"])]
    r_slim = r.select(
        *[F.col(f"__r{i}") for i in pairs], *[F.col(f"`{c}`").alias(n) for c, n in names.items()]
    )
    match = None
    for i in pairs:
        part = F.col(f"__l{i}") == F.col(f"__r{i}")
        match = part if match is None else match & part
    columns = [*left.columns, *names.values()]
    joined = l.join(r_slim, match, "inner" if how == "inner" else "left").select(*columns)
    if how != "full":
        return joined
    known = l.select(*[F.col(f"__l{i}") for i in pairs]).distinct()
    alone = r.join(known, match, "left_anti")
    filled = []
    for column in left.columns:
        kind = left.schema[column].dataType
        if column in left_keys:
            filled.append(F.col(f"`{right_keys[left_keys.index(column)]}`").cast(kind).alias(column))
        else:
            filled.append(F.lit(None).cast(kind).alias(column))
    return joined.unionByName(alone.select(*filled, *[F.col(f"`{c}`").alias(n) for c, n in names.items()]))


def join_diagnostics(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str] | None = None,
    *, case_sensitive: bool = False,
) -> DataFrame:
    """Rows, incomplete keys and duplicated key groups on each side."""
    def side(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        parts = [join_key(df, k, case_sensitive).alias(f"k{i}") for i, k in enumerate(keys)]
        counted = df.select(*parts).groupBy(*[f"k{i}" for i in range(len(parts))]).agg(F.count(F.lit(1)).alias("n"))
        incomplete = F.lit(False)
        for i in range(len(parts)):
            incomplete = incomplete | F.col(f"k{i}").isNull()
        zero = F.lit(0).cast("bigint")
        return counted.agg(
            F.lit(name).alias("side"),
            F.coalesce(F.sum("n"), zero).alias("rows"),
            F.coalesce(F.sum(F.when(incomplete, F.col("n"))), zero).alias("incomplete_key_rows"),
            F.count(F.when(~incomplete & (F.col("n") > 1), 1)).alias("duplicate_key_groups"),
        )

    return side(left, left_keys, "left").unionByName(side(right, right_keys or left_keys, "right"))


def _id_matches(records: DataFrame, ids: DataFrame, mode: str, case_sensitive: bool) -> tuple[DataFrame, DataFrame, str]:
    fold = (lambda c: c) if case_sensitive else F.lower
    title = F.trim(F.col("title"))
    wanted = ids.withColumn("__want", fold(F.trim(F.col("query")))).filter(F.col("__want") != "")
    if mode == "title_contains":
        # Needle lengths are few; substrings of those lengths turn "contains" into an equi-join.
        # Titles are short, so the longest needle worth trying is the longest title.
        longest = records.agg(F.max(F.length("title"))).first()[0] or 0
        sizes = sorted(
            r[0] for r in wanted.select(F.length("__want").alias("n")).filter(F.col("n") <= longest).distinct().collect()
        )
        folded = fold(F.col("title"))

        def pieces(n: int) -> Column:
            found = F.transform(F.sequence(F.lit(1), F.length(folded) - n + 1), lambda i: folded.substr(i, F.lit(n)))
            return F.when(F.length(folded) >= n, found).otherwise(F.array().cast("array<string>"))

        windows = [pieces(n) for n in sizes]
        probe = F.array_distinct(F.concat(*windows)) if windows else F.array().cast("array<string>")
        return records.withColumn("__have", F.explode(probe)), wanted, "__have"
    have = title if mode == "title_exact" else F.regexp_extract(title, r"^(\S+)", 1)
    return records.withColumn("__have", fold(have)), wanted, "__have"


def extract_by_id(
    records: DataFrame, ids: DataFrame, *, mode: str = "id_exact", action: str = "keep", case_sensitive: bool = True,
    record_key: Sequence[str] = ("title",),
) -> DataFrame:
    """Keep or remove the records named in ``ids(query[, list_pos])``.

    ``action="order"`` gives one row per (id, record) with ``list_pos``, in the order of the list.
    """
    keyed, wanted, have = _id_matches(records, ids, mode, case_sensitive)
    match = F.col(have) == F.col("__want")
    if action == "order":
        return (
            keyed.join(wanted.select("__want", "list_pos"), match).drop(have, "__want")
            .orderBy("list_pos", *record_key)
        )
    if mode != "title_contains":
        names = wanted.select("__want").distinct()
        return keyed.join(names, match, "left_semi" if action == "keep" else "left_anti").drop(have)
    hits = keyed.join(wanted.select("__want").distinct(), match, "left_semi").select(*record_key).distinct()
    return records.join(plain(hits), list(record_key), "left_semi" if action == "keep" else "left_anti")


def id_match_report(
    records: DataFrame, ids: DataFrame, *, mode: str = "id_exact", case_sensitive: bool = True
) -> DataFrame:
    """How many records each listed id found: ``missing``, ``single`` or ``multiple``."""
    keyed, wanted, have = _id_matches(records, ids, mode, case_sensitive)
    found = keyed.groupBy(have).agg(F.count(F.lit(1)).alias("records"))
    return wanted.join(plain(found), F.col("__want") == F.col(have), "left").select(
        "query",
        F.coalesce("records", F.lit(0).cast("bigint")).alias("records"),
        F.when(F.col("records").isNull(), "missing").when(F.col("records") == 1, "single").otherwise("multiple").alias("status"),
    )


def mate_pairs(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pair read ``i`` of one file with read ``i`` of the other and compare their names."""
    def name(column: str) -> Column:
        return F.regexp_replace(F.regexp_extract(F.col(column), r"^(\S+)", 1), r"/[12]$", "")

    a = first.select(*keys, F.col("title").alias("title_1"), F.col("sequence").alias("sequence_1"), F.col("quality").alias("quality_1"))
    b = second.select(*keys, F.col("title").alias("title_2"), F.col("sequence").alias("sequence_2"), F.col("quality").alias("quality_2"))
    return a.join(b, list(keys), "full").withColumn(
        "pair_status",
        F.when(F.col("title_1").isNull() | F.col("title_2").isNull(), "unpaired")
        .when(name("title_1") == name("title_2"), "matched")
        .otherwise("name_mismatch"),
    )
