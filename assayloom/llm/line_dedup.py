"""Removal of repeated passages by winnowing over line hashes, with DataFrame functions only.

Lines are told apart by a 128-bit hash; lines without a word only separate. A gram is the fewest whole
lines from a line on that hold ``GRAM_WORDS`` words. Of the grams that begin within ``WINDOW_WORDS``
words, the one with the smallest hash is a fingerprint. So two equal runs of lines with at least
``GRAM_WORDS + WINDOW_WORDS - 1`` words share a fingerprint wherever they stand, and a long line is one
by itself. Positions of fingerprints that occur again are joined and the matches extended to both sides, line
by line, to maximal runs. A run of at least ``GRAM_WORDS + WINDOW_WORDS - 1`` words is the union of two kinds
of stretches of just that many words or a line more: those that begin at a line of it (they reach its first line)
and those that end at one (they reach its last). Every stretch but the first of its kind goes, so whole runs
go, without a pair of copies being built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.operators.once import compute_once
from assayloom.session import settle

#: Together they let no repeated run of 50 words or more pass.
GRAM_WORDS, WINDOW_WORDS = 25, 26
WORD = r"[^\x20\x09-\x0D]+"


def _text_hash(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with a word: document (``key``, hash of its text), ``pos``, hashes ``h1`` and ``h2``, ``words``, and the words before it, ``start``."""
    body = F.col(text).cast("string")
    texts = docs.select(F.col(key).alias("__id"), body.alias("__text")).filter(F.col("__text").isNotNull())
    # The hashes come before the lines are spread, else each line would hash its whole text; the outer form keeps
    # the optimizer from splitting texts a second time to look for empty lists.
    hashed = texts.select("__id", *[h.alias(f"t{i}") for i, h in enumerate(_text_hash(F.col("__text")), 1)], F.split("__text", "\n").alias("__lines"))
    rows = hashed.select("__id", "t1", "t2", F.posexplode_outer("__lines").alias("pos", "line"))
    counted = rows.withColumn("words", F.regexp_count("line", F.lit(WORD))).filter(F.col("words") > 0)
    narrow = counted.select("__id", "t1", "t2", "pos", *[h.alias(f"h{i}") for i, h in enumerate(_text_hash(F.col("line")), 1)], "words")
    # One exchange serves the equal rows and all windows over a document.
    narrow = narrow.repartition("__id", "t1", "t2").dropDuplicates(["__id", "t1", "t2", "pos"])
    before = Window.partitionBy("__id", "t1", "t2").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return narrow.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("bigint"))


def _stretch(words: int) -> Window:
    """From a line on, the fewest lines that hold so many words."""
    return Window.partitionBy("__id", "t1", "t2").orderBy("start").rangeBetween(0, words - 1)


def _back_stretch(words: int) -> Window:
    """Up to a line, the fewest lines that hold so many words."""
    return Window.partitionBy("__id", "t1", "t2").orderBy("stop").rangeBetween(1 - words, 0)


def _list_hashes(over: Window) -> list[Column]:
    return [F.xxhash64(F.collect_list(h).over(over)) for h in ("h1", "h2")]


def _grams(lines: DataFrame, words: int) -> DataFrame:
    """Add hashes ``g1``, ``g2`` of the stretch at each line and its last line ``last``; they are null where the text ends before."""
    over = _stretch(words)
    whole = F.sum("words").over(over) >= words
    return (
        lines.withColumn("__a", F.collect_list("h1").over(over)).withColumn("__b", F.collect_list("h2").over(over)).withColumn("last", F.max("pos").over(over)).withColumn("__whole", whole)
        .withColumn("g1", F.when(F.col("__whole"), F.xxhash64("__a"))).withColumn("g2", F.when(F.col("__whole"), F.xxhash64("__b"))).drop("__a", "__b", "__whole")
    )


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """The lines to delete: ``__id``, ``t1``, ``t2``, ``gone`` (sorted positions)."""
    run_words = gram_words + window_words - 1
    lines = text_lines(docs, key, text)
    document = ["__id", "t1", "t2"]
    grams = _grams(lines, gram_words).withColumnsRenamed({"g1": "f1", "g2": "f2"}).drop("last")
    least = F.min(F.when(F.col("f1").isNotNull(), F.struct("f1", "f2", "pos"))).over(_stretch(window_words))
    begun = _grams(grams.withColumn("__least", least), run_words).withColumn("stop", F.col("start") + F.col("words"))
    over = _back_stretch(run_words)
    b1, b2 = _list_hashes(over)
    first = lambda c: F.first(c).over(over)
    # A stretch that ends here is listed with those that begin unless it is one of them.
    extra = (F.sum("words").over(over) >= run_words) & (first("last") != F.col("pos"))
    both = begun.select(
        *document, F.struct("pos", "last", "g1", "g2", F.col("__least").alias("least")).alias("__ahead"),
        F.when(extra, F.struct(first("pos").alias("pos"), F.col("pos").alias("last"), b1.alias("g1"), b2.alias("g2"), first("__least").alias("least"))).alias("__back"),
    )
    runs = both.select(*document, F.explode(F.array_compact(F.array("__ahead", "__back"))).alias("__run")).select(*document, "__run.*").filter(F.col("least").isNotNull())
    fingerprint = [F.col("least.f1").alias("f1"), F.col("least.f2").alias("f2")]
    runs = settle(runs.select(*document, "pos", "last", "g1", "g2", *fingerprint, F.col("least.pos").alias("at")))
    prints = runs.select(*document, "f1", "f2", "at").distinct()
    again = settle(prints.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("f1", "f2"))
    # A run holds the fingerprint of its first window wherever it stands, so it occurs again only if that does.
    candidates = runs.filter(F.col("g1").isNotNull()).drop("at").join(again, ["f1", "f2"])
    place = F.struct("__id", "t1", "t2", "pos", "last")
    firsts = settle(candidates.groupBy("g1", "g2").agg(F.min(place).alias("held"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("g1", "g2", "held"))
    later = candidates.join(firsts, ["g1", "g2"]).filter(place != F.col("held"))
    own = F.col("held.__id").eqNullSafe(F.col("__id")) & (F.col("held.t1") == F.col("t1")) & (F.col("held.t2") == F.col("t2"))
    begin = F.when(own, F.greatest(F.col("pos"), F.col("held.last") + 1)).otherwise(F.col("pos"))
    spans = later.withColumn("begin", begin).filter(F.col("begin") <= F.col("last"))
    gone = spans.groupBy(*document).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("begin", "last"))))).alias("gone"))
    return gone


def remove_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS, count: str = "removed_lines"
) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without repeated runs, and ``count``: how many lines went.

    A maximal run of at least ``gram_words + window_words - 1`` words in whole lines stays where it stands first, by
    key (nulls first) and position; equal runs later, in other documents or the same, go whole, each from its
    first to its last line (within one document only what lies behind the copy that stays). A null text
    stays null and an empty one empty. Rows equal in key and text are one document and get the same
    result. A column named like ``count`` is replaced.
    """
    rows = docs.drop(count)
    gone = repeated_lines(rows, key, text, gram_words, window_words)
    gone = gone.select(F.col("__id").alias("__gone_id"), F.col("t1").alias("__gone_1"), F.col("t2").alias("__gone_2"), F.col("gone").alias("__gone"))
    first, second = _text_hash(F.col(text).cast("string"))
    found = rows.withColumn("__1", first).withColumn("__2", second)
    joined = found.join(gone, F.col(key).eqNullSafe(F.col("__gone_id")) & (F.col("__1") == F.col("__gone_1")) & (F.col("__2") == F.col("__gone_2")), "left")
    # Worked out once a row: the lambda below would split the text again for each line.
    joined = compute_once(joined, __lines=F.when(F.col("__gone").isNotNull(), F.split(F.col(text), "\n")))
    staying = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    left = F.array_join(F.transform(staying, lambda i: F.get(F.col("__lines"), i)), "\n")
    kept = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left)
    return joined.select(*[kept.alias(c) if c == text else F.col(f"`{c}`") for c in rows.columns], F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).alias(count))
