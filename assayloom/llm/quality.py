"""Quality classifier: histogram gradient-boosted trees over document statistics.

Tasks turn whole texts into a few numbers. A bounded sample of labelled rows trains the trees on the
driver; the trees are laid out level by level in arrays, and a batch of documents walks all trees
together, one level per numpy step.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.batches import crc_fold, map_rows

#: Labelled rows used for training at most: those with the smallest hashes of their key.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.2
#: Smallest weight (sum of second derivatives) on a side of a split, and the ridge on leaf values.
LEAF_WEIGHT, RIDGE = 3.0, 1.0
THRESHOLD = 0.3
PARTS, HELD = 5, 0

STATISTICS = (
    "log_words", "word_length", "longest_word", "distinct_words", "repeat_neighbours", "distinct_pairs", "top_word", "upper_words", "upper_ascii", "symbols", "marks", "digits",
    "bars", "stops", "newlines", "repeat_lines", "byte_entropy", "symbol_endings", "non_ascii",
)
_BYTES = {name: np.array([bytes([b]) and chr(b) in chars for b in range(256)]) for name, chars in {
    "symbols": "#*$%&<>^~=+@", "marks": "!?", "digits": "0123456789", "bars": "|", "stops": ".,;:", "newlines": "\n",
}.items()}


def statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of a whole text; a null or blank text has zeros."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, size, different = len(words), len(raw), Counter(words)
    shares = counts[counts > 0] / size
    lines = [line for line in text.split("\n") if line]
    pairs = set(zip(words, words[1:]))
    lengths = [len(w) for w in words]
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    per_word = {name: float(counts[mask].sum()) / n for name, mask in _BYTES.items()}
    return [
        float(np.log1p(n)), sum(lengths) / n, float(max(lengths)), len(different) / n, sum(map(eq, words, words[1:])) / n, (len(pairs) + 1) / n, different.most_common(1)[0][1] / n,
        sum(map(str.isupper, words)) / n, float(counts[65:91].sum()) / letters, per_word["symbols"], per_word["marks"], per_word["digits"], per_word["bars"], per_word["stops"], per_word["newlines"],
        1 - len(set(lines)) / max(1, len(lines)), float(-(shares * np.log2(shares)).sum()), sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / n, float(counts[128:].sum()) / size,
    ]


def fit_trees(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray | float]:
    """Boosted trees for 0/1 labels, as arrays: ``feature`` and ``cut`` by tree and inner node, ``leaf`` by tree and leaf."""
    n, width = x.shape if len(x) else (0, len(STATISTICS))
    inner = 2**DEPTH - 1
    model = {"feature": np.zeros((0, inner), dtype=np.int64), "cut": np.zeros((0, inner)), "leaf": np.zeros((0, inner + 1))}
    mean = (y.sum() + 0.5) / (n + 1) if n else 0.5
    model["start"] = float(np.log(mean / (1 - mean)))
    if not 0 < y.sum() < n:
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    flat_bins = bins + np.arange(width) * BINS
    margin = np.full(n, model["start"])
    features, places, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * width * BINS + flat_bins).ravel()
            shape = (many, width, BINS)
            gs = np.bincount(cell, np.repeat(g, width), many * width * BINS).reshape(shape).cumsum(axis=2)
            hs = np.bincount(cell, np.repeat(h, width), many * width * BINS).reshape(shape).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hs < LEAF_WEIGHT) | (ht - hs < LEAF_WEIGHT)] = 0
            for k in range(many):
                j, b = np.unravel_index(gain[k].argmax(), (width, BINS))
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[first + k], cut[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        margin += value[leaf]
        features.append(feature), places.append(cut), leaves.append(value)
    return model | {"feature": np.array(features), "cut": np.array(places), "leaf": np.array(leaves)}


def walk_trees(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row: all rows go down all trees together."""
    trees = np.arange(len(model["feature"]))
    node = np.zeros((len(x), len(trees)), dtype=np.int64)
    rows = np.arange(len(x))[:, None]
    for _ in range(DEPTH):
        node = 2 * node + 1 + (x[rows, model["feature"][trees, node]] > model["cut"][trees, node])
    margin = model["start"] + model["leaf"][trees, node - (2**DEPTH - 1)].sum(axis=1)
    return 1 / (1 + np.exp(-margin))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learned, key: str = "doc_id", text: str = "text", max_rows: int = TRAIN_ROWS) -> DataFrame:
    """Texts and labels of at most ``max_rows`` labelled rows where ``learned`` holds, picked by the hash of their key.

    The picked keys are sent to all tasks (``max_rows`` rows at most), so texts are not shuffled.
    """
    picked = (
        labels.filter(learned & F.col(label).isNotNull())
        .select(F.col(key).alias("__id"), F.col(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id", "__label")
        .limit(max_rows)
    )
    joined = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).join(F.broadcast(picked), F.col("__key") == F.col("__id"))
    return joined.select("__key", "__text", "__label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_rows: int = TRAIN_ROWS) -> dict:
    """Fit the trees on labelled rows outside the held-out fold; without both labels the score is the prior.

    A sample key that repeats in ``docs`` is used up to ``max_rows`` rows in all.
    """
    sample = labelled_sample(docs, labels, label, crc_fold(key, PARTS) != HELD, key, text, max_rows)

    def make():
        return lambda keys, texts, marks: [keys, [statistics(t) for t in texts], marks]

    kind = docs.schema[key].dataType.simpleString()
    rows = map_rows(sample, ["__key", "__text", "__label"], make, f"key {kind}, numbers array<double>, label int").orderBy(F.xxhash64("key"), "key", "label").limit(max_rows).collect()
    x = np.array([r["numbers"] for r in rows]).reshape(-1, len(STATISTICS))
    return fit_trees(x, np.array([r["label"] for r in rows], dtype=float))


def _scored(docs: DataFrame, model: dict, columns: list[str], text: str) -> DataFrame:
    """The columns as ``__0``, ``__1`` and so on, and ``__score``."""

    def make():
        return lambda texts, *others: [*others, walk_trees(model, np.array([statistics(t) for t in texts])).tolist()]

    chosen = [docs[f"`{text}`"].cast("string").alias("__text"), *[docs[f"`{c}`"].alias(f"__{i}") for i, c in enumerate(columns)]]
    shape = ", ".join(f"__{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    return map_rows(docs, chosen, make, f"{shape}, __score double")


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for each row.

    Null and blank texts are scored by their zero statistics; a null key is not held out. Every row is
    scored by itself, repeated ones alike.
    """
    fold = F.coalesce(crc_fold("__0", PARTS) == HELD, F.lit(False))
    return _scored(docs, model, [key], text).select(F.col("__0").alias(key), fold.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score at least ``threshold``."""
    found = _scored(docs, model, docs.columns, text).filter(F.col("__score") >= threshold)
    return found.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
