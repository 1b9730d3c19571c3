"""Mixing documents to target weights of domains, with DataFrame functions only.

A naive Bayes classifier, taught by a labelled table, gives each document a soft membership of every
domain. Document rates are fitted by projected gradient steps on the weighted least squares between the
expected domain totals (rate x tokens x membership, summed over all documents) and their targets. A step
needs one number per domain from the cluster; the rates stay there.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.session import settle

#: Labelled rows learned from, words in the model, and domains told apart, at most.
TRAIN_ROWS, WORDS, DOMAINS = 8_000, 4_096, 200
#: A document's known words count as so many at most, so that mixed documents stay mixed.
EVIDENCE = 50
#: Steps at most, steps between writes of the rates, and the distance from the targets to stop at.
STEPS, WRITE_EVERY, TOLERANCE = 60, 10, 1e-4
#: Least share of the tokens with which a domain limits the budget "once".
LEAST_SHARE = 0.01
#: Default targets: shares of the domains to this power.
TEMPERATURE = 0.5
SCALE = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-case words between blanks, tabs and line ends."""
    plain = F.lower(text.cast("string"))
    for mark in ("\n", "\t", "\r"):
        plain = F.replace(plain, F.lit(mark), F.lit(" "))
    return F.split(plain, " ")


def learn_domains(labelled: DataFrame, domain: str, text: str = "text", key: str = "doc_id", max_rows: int = TRAIN_ROWS) -> tuple[list[str], DataFrame]:
    """Domain names, and a table of at most ``WORDS`` words with the log likelihood (millionths) in each domain.

    The rows learned from are those with the smallest hashes of their key, ``max_rows`` at most. Rows with
    a null domain or text teach nothing.
    """
    usable = labelled.filter(F.col(domain).isNotNull())
    counts = usable.groupBy(F.col(domain).cast("string").alias("d")).count().orderBy(F.desc("count"), "d").limit(DOMAINS).collect()
    names = sorted(r["d"] for r in counts)
    picked = usable.select(F.col(key).alias("__id"), F.col(domain).cast("string").alias("__d")).filter(F.col("__d").isin(names)).orderBy(F.xxhash64("__id"), "__id", "__d").limit(max_rows)
    # max_rows keys at most are sent to the tasks.
    sample = usable.join(F.broadcast(picked.distinct()), (F.col(key) == F.col("__id")) & (F.col(domain).cast("string") == F.col("__d")))
    words = sample.select("__d", F.explode_outer(words_of(F.col(text))).alias("word")).filter("word <> ''")
    per_domain = [F.count_if(F.col("__d") == n).alias(f"n{i}") for i, n in enumerate(names)]
    frequent = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *per_domain).orderBy(F.desc("n"), "word").limit(WORDS)
    frequent = settle(frequent)
    totals = frequent.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(names))]).first() if names else []
    chances = [F.round(SCALE * F.log((F.col(f"n{i}") + 0.1) / (totals[i] + 0.1 * WORDS))).cast("bigint") for i in range(len(names))]
    return names, frequent.select("word", F.array(*chances).alias("chances")) if names else frequent.select("word")


def memberships(docs: DataFrame, names: Sequence[str], model: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``__id``, ``t1``, ``t2`` (hashes of the text), ``tokens`` and ``p`` (one number per domain, sum 1).

    A document without known words belongs to all domains alike. Rows equal in key and text are one
    row here, with the tokens of all of them.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    place = [F.col(key).alias("__id"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2")]
    # The hashes come before the words are spread, else each word would hash its whole text; the outer form keeps
    # the optimizer from splitting texts a second time to look for empty lists.
    words = docs.select(*place, words_of(body).alias("words")).select("__id", "t1", "t2", F.explode_outer("words").alias("word"))
    # The model has WORDS rows at most.
    met = words.join(F.broadcast(model), "word", "left")
    sums = [F.coalesce(F.sum(F.get("chances", F.lit(i))), F.lit(0)).alias(f"s{i}") for i in range(len(names))]
    found = met.groupBy("__id", "t1", "t2").agg(F.count_if(F.col("word") != "").alias("tokens"), F.count("chances").alias("known"), *sums)
    weight = F.least(F.lit(1.0), EVIDENCE / F.greatest(F.col("known"), F.lit(1))) / SCALE
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(names))]) if len(names) > 1 else F.col("s0")
    powers = found.select("__id", "t1", "t2", "tokens", F.array(*[F.exp((F.col(f"s{i}") - top) * weight) for i in range(len(names))]).alias("e"))
    total = sum((F.get("e", F.lit(i)) for i in range(len(names))), F.lit(0.0))
    return powers.select("__id", "t1", "t2", "tokens", F.array(*[F.get("e", F.lit(i)) / total for i in range(len(names))]).alias("p"))


def target_totals(
    expected: Sequence[float], names: Sequence[str], targets: Mapping[str, float] | None, budget: str | float, temperature: float = TEMPERATURE, least_share: float = LEAST_SHARE,
) -> list[float]:
    """Tokens wanted of each domain.

    Weights are ``targets`` (domains left out get none), or the shares to the power ``temperature``;
    domains without tokens cannot be met and count nothing. ``budget`` is a number of tokens,
    ``"all"`` (as many as there are) or ``"once"`` (as many as no domain's tokens must repeat for). A domain with less than ``least_share`` of
    the tokens, such as a few stray labels, does not set that budget: it is wanted once, as it is, if its target is above that.
    """
    share = sum(expected) or 1.0
    weights = [(targets.get(n, 0.0) if targets is not None else (x / share) ** temperature) if x > 0 else 0.0 for n, x in zip(names, expected)]
    total = sum(weights)
    if total <= 0:
        raise ValueError("no domain with tokens has a target weight")
    weights = [w / total for w in weights]
    if budget != "once":
        size = {"all": share}[budget] if isinstance(budget, str) else float(budget)
        return [w * size for w in weights]
    pairs = [(x, w) for x, w in zip(expected, weights) if w > 0]
    size = min(x / w for x, w in [p for p in pairs if p[0] >= least_share * share] or pairs)
    return [min(w * size, x) for x, w in zip(expected, weights)]


def fit_rates(soft: DataFrame, names: Sequence[str], targets: Mapping[str, float] | None = None, budget: str | float = "all", temperature: float = TEMPERATURE) -> DataFrame:
    """Add ``rate``: nonnegative, so that expected domain totals match the targets.

    The squares are weighted by 1 / T, with T a domain's tokens at rate 1, and rates are scaled by
    their tokens. As memberships sum to 1, the largest curvature is then exactly 1 and steps of 1 are safe.
    Targets that the memberships cannot meet, or not within ``STEPS``, are reported in a warning.
    """
    size = range(len(names))

    def totals(frame: DataFrame) -> list[float]:
        row = frame.agg(*[F.sum(F.col("tokens") * F.col("rate") * F.get("p", F.lit(i))).alias(f"x{i}") for i in size]).first()
        return [float(x or 0.0) for x in row]

    rated = soft.withColumn("rate", F.lit(1.0))
    have = expected = totals(rated)
    if sum(expected) <= 0:
        return rated
    wanted = target_totals(expected, names, targets, budget, temperature)

    def met() -> bool:
        return max(abs(x - t) for x, t in zip(have, wanted)) <= TOLERANCE * sum(wanted)

    for step in range(1, STEPS + 1):
        if met():
            break
        slope = [(x - t) / e if e > 0 else 0.0 for x, t, e in zip(have, wanted, expected)]
        move = sum((F.get("p", F.lit(i)) * F.lit(slope[i]) for i in size), F.lit(0.0))
        rated = rated.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - move))
        if step % WRITE_EVERY == 0:
            rated = settle(rated)
        have = totals(rated)
    if not met():
        warnings.warn(f"after {STEPS} steps the tokens of {dict(zip(names, have))} still differ from {dict(zip(names, wanted))}", stacklevel=2)
    return rated


def document_rates(
    docs: DataFrame, labelled: DataFrame, domain: str, key: str = "doc_id", text: str = "text", targets: Mapping[str, float] | None = None, budget: str | float = "all",
    temperature: float = TEMPERATURE, seed: int = 0,
) -> DataFrame:
    """One row per document: ``__id``, ``t1``, ``t2``, ``tokens``, ``p``, ``rate`` and ``copies``.

    ``copies`` is the rate rounded down or up, up with the chance of its fraction, by a hash of key and
    text. Without any labelled row all rates are 1.
    """
    names, model = learn_domains(labelled, domain, text, key)
    if not names:
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        soft = docs.select(F.col(key).alias("__id"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2")).distinct()
        rated = soft.select("*", F.lit(None).cast("bigint").alias("tokens"), F.array().cast("array<double>").alias("p"), F.lit(1.0).alias("rate"))
    else:
        rated = settle(fit_rates(settle(memberships(docs, names, model, text, key)), names, targets, budget, temperature))
    draw = F.shiftrightunsigned(F.xxhash64("__id", "t1", F.lit(seed)), 11) / F.lit(float(2**53))
    return rated.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def _beside(docs: DataFrame, rates: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    found = docs.withColumn("__1", F.xxhash64(body)).withColumn("__2", F.xxhash64(F.lit(1), body))
    named = rates.select(*[F.col(c).alias(f"__rate_{c.strip('_')}") for c in ("__id", "t1", "t2", "tokens", "rate", "copies")])
    return found.join(named, F.col(f"`{key}`").eqNullSafe(F.col("__rate_id")) & (F.col("__1") == F.col("__rate_t1")) & (F.col("__2") == F.col("__rate_t2")))


def rate_documents(docs: DataFrame, labelled: DataFrame, domain: str, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Each row's ``key``, ``n_tokens``, ``mix_rate`` and ``copies``; rows equal in key and text share one rate."""
    rates = document_rates(docs, labelled, domain, key, text, **how)
    return _beside(docs.select(key, text), rates, key, text).select(key, F.col("__rate_tokens").alias("n_tokens"), F.col("__rate_rate").alias("mix_rate"), F.col("__rate_copies").alias("copies"))


def mix_documents(docs: DataFrame, labelled: DataFrame, domain: str, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, none to several times; columns as they are."""
    rates = document_rates(docs, labelled, domain, key, text, **how).filter("copies > 0")
    joined = _beside(docs, rates, key, text)
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__rate_copies")))).select(*[f"`{c}`" for c in docs.columns])
