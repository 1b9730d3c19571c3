"""Quality rules with verdicts per host.

Each document is measured by plain counts and fails or passes the base rules. Failures are summed per
host; the failure rates of all hosts give a beta prior, each host's own rate is shrunk towards it, and
the documents of a host whose shrunk rate is too high go with it.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.batches import map_rows
from assayloom.session import settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: A host goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.8
#: Bounds of the prior's weight in documents.
PRIOR_WEIGHT = (1.0, 1000.0)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that occur at least twice, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, upto = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    lines = Counter(text.split("\n"))
    again = sum(n - 1 for line, n in lines.items() if n > 1 and WORD.search(line))
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), again, repeated_words(words)


def measure_documents(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """``key``, ``host``, the five counts and ``base_failed`` for each row.

    A null text counts as empty and fails (too few words). Repeated rows are measured one by one.
    """

    def make():
        return lambda keys, hosts, texts: [keys, hosts, *map(list, zip(*map(measure, texts)))]

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    columns = [F.col(key).alias("__key"), F.col(host).cast("string").alias("__host"), F.col(text).cast("string").alias("__text")]
    measured = map_rows(docs, columns, make, f"`{key}` {kind}, host string, {counts}")
    return measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate and ``host_kept``; null is a host of its own.

    The prior has the mean failure rate of all documents. Its weight (alpha + beta) follows from how
    far the hosts' rates lie apart, by the method of moments, within ``PRIOR_WEIGHT``.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed"))
    total = hosts.agg(F.sum("n_docs").alias("docs"), F.sum("n_failed").alias("failed"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("squares"))
    mean = F.col("failed") / F.col("docs")
    spread = F.col("squares") / F.col("docs") - mean * mean
    weight = F.when(spread > 1e-9, mean * (1 - mean) / spread - 1).otherwise(F.lit(PRIOR_WEIGHT[1]))
    prior = total.select(F.struct(mean.alias("mean"), F.greatest(F.lit(PRIOR_WEIGHT[0]), F.least(F.lit(PRIOR_WEIGHT[1]), weight)).alias("weight")).alias("prior"))
    rated = hosts.withColumn("__prior", prior.scalar())
    rate = (F.col("n_failed") + F.col("__prior.mean") * F.col("__prior.weight")) / (F.col("n_docs") + F.col("__prior.weight"))
    return rated.withColumn("failure_rate", rate).withColumn("host_kept", F.col("failure_rate") <= max_rate).drop("__prior")


def judge_documents(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The counts of each document and ``kept``: it passes the base rules and so does its host.

    The narrow counts are written once to the shared checkpoint folder, so that texts are read once
    although hosts need all documents first.
    """
    measured = settle(measure_documents(docs, key, host, text))
    verdicts = host_verdicts(measured, max_rate).select(F.col("host").alias("__host"), "host_kept")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("__host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).drop("__host")
