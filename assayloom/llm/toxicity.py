"""Toxicity by noisy-channel deobfuscation.

A character language model is counted over all documents. A word that looks disguised (digits or signs
among letters, long repetitions, letters set apart) opens a lattice: each sign may be one of the letters
it resembles, noise, or a separator, and a repeated letter may be one. The cheapest path under the
language model restores the word, and plain and restored words are scored with a learned lexicon.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.batches import crc_fold, map_rows, short_batches
from assayloom.llm.quality import labelled_sample

PARTS, HELD = 3, 1
THRESHOLD = 0.7
#: Labelled rows learned from at most, and lexicon entries tried at most (those in most toxic texts).
TRAIN_ROWS, CANDIDATES = 20_000, 5_000
#: An entry is taken for so many toxic texts that no entry before it explains, at this share of toxic texts.
SUPPORT, PRECISION = 3, 0.9
#: Entries in so large a part of the toxic texts of the most frequent entry are taken besides.
COMMON = 0.2
PREFIXES = (4, 5, 6)
#: Words remembered in a task before the memory starts anew.
KNOWN_WORDS = 400_000

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
SIZE = len(LETTERS) + 2
BORDER, OTHER = 0, SIZE - 1
CODE = {c: i for i, c in enumerate(LETTERS, 1)}
#: What a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs in nats: a look-alike, a look-alike that is noise, a separator, a letter written again.
LOOK_COST, NOISE_COST, APART_COST, AGAIN_COST = 0.7, 4.5, 0.3, 3.0
STATES = 40
DISGUISED = re.compile(r"[^\W\d_].*[\W\d_].*[^\W_]|[\d@$!|+(€£¡].*[^\W\d_]|[^\W\d_].*[\d@$|+(€£¡]|(\w)\1\1", re.DOTALL)
SPELLED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”„‘’…–—¿¡"
BLUNT = "".join(c for c in EDGES if c not in LOOKS)


def _codes() -> np.ndarray:
    table = np.fromiter((OTHER if chr(i).isalpha() else BORDER for i in range(0x110000)), dtype=np.int64, count=0x110000)
    for letter, code in CODE.items():
        table[ord(letter)] = code
    return table


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each letter follows two others, over all whole texts (``SIZE`` cubed cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cells = _codes(), np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            for one in batch.column(0).to_pylist():
                if one:
                    code = table[np.frombuffer(one.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
                    code = np.concatenate([[BORDER, BORDER], code[(code > 0) | (np.concatenate([[1], code[:-1]]) > 0)], [BORDER]])
                    cells += np.bincount((code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:], minlength=SIZE**3)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used])], names=["cell", "n"])

    texts = short_batches(docs).select(F.col(text).cast("string").alias("text"))
    found = texts.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(SIZE**3)
    cells[found["cell"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    return cells.reshape(SIZE, SIZE, SIZE)


def character_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of a letter after two others, smoothed by shorter contexts."""
    one = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + SIZE)
    pairs = counts.sum(axis=0)
    two = (pairs + 5 * one) / (pairs.sum(axis=1, keepdims=True) + 5)
    three = (counts + 5 * two) / (counts.sum(axis=2, keepdims=True) + 5)
    return -np.log(three).astype(np.float32)


def restore(word: str, costs: list) -> str:
    """The letters that most likely were disguised as ``word`` (Viterbi over the last two letters)."""
    states = {(BORDER, BORDER): (0.0, "")}
    before = ""
    for sign in word:
        options: list[tuple[str, float]] = []
        if sign.isalpha():
            options.append((sign, 0.0))
            if sign == before:
                options.append(("", AGAIN_COST))
        elif sign in LOOKS:
            options += [(c, LOOK_COST) for c in LOOKS[sign]] + [("", APART_COST if sign == before else NOISE_COST)]
        else:
            options.append(("", APART_COST if not sign.isdigit() else NOISE_COST))
        before = sign
        found: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in states.items():
            for letter, extra in options:
                if letter:
                    code = CODE.get(letter, OTHER)
                    at, total = (b, code), cost + extra + costs[a][b][code]
                else:
                    at, total = (a, b), cost + extra
                if at not in found or total < found[at][0]:
                    found[at] = (total, text + letter)
        states = found if len(found) <= STATES else dict(sorted(found.items(), key=lambda x: x[1][0])[:STATES])
    return min((cost + costs[a][b][BORDER], text) for (a, b), (cost, text) in states.items())[1]


def entries(word: str) -> list[str]:
    """The lexicon entries a restored word can meet: itself and its beginnings."""
    return ["=" + word, *["^" + word[:n] for n in PREFIXES if len(word) >= n]] if len(word) > 2 else []


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words, and letters set apart one by one as one word."""
    low = (text or "").lower()
    found = set(low.split())
    for run in SPELLED.findall(low):
        found.add(run.replace(" ", ""))
    return found


def readings(token: str, costs: list) -> Iterable[str]:
    """A word without edge signs, and restored if it looks disguised."""
    plain = token.strip(EDGES)
    if plain.isalpha():
        yield plain
    rough = re.sub(r"([^\w\s])\1+$", "", token.strip(BLUNT))
    if DISGUISED.search(rough) and not rough.isalpha() or re.search(r"(\w)\1\1", plain):
        restored = restore(rough, costs)
        if restored != plain:
            yield restored


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", max_rows: int = TRAIN_ROWS) -> dict:
    """Character costs of the whole corpus and a lexicon from labelled rows outside the held-out fold.

    Entries are taken one after another, each for the toxic texts that no earlier one explains, so that
    words which merely stand next to toxic ones do not enter. Equal texts count once.
    """
    costs = character_costs(character_counts(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast(costs)
    sample = labelled_sample(docs, labels, label, crc_fold(key, PARTS) != HELD, key, text, max_rows).dropDuplicates(["__text", "__label"])

    def make(only: frozenset | None = None):
        table = shared.value.tolist()

        def work(texts, marks):
            met = [{e for t in tokens(x) for r in readings(t, table) for e in entries(r)} for x in texts]
            return [[sorted(m if only is None else m & only) for m in met], marks]

        return work

    shape = "entries array<string>, label int"
    read = map_rows(sample, ["__text", "__label"], make, shape)
    said = read.select(F.explode("entries").alias("entry"), "label").groupBy("entry").agg(F.count_if(F.col("label") > 0).alias("bad"), F.count_if(F.col("label") <= 0).alias("good"))
    tried = said.filter((F.col("bad") >= SUPPORT) & (F.col("bad") >= PRECISION * (F.col("bad") + F.col("good")))).orderBy(F.desc("bad"), "good", "entry").limit(CANDIDATES).collect()
    known = {r["entry"]: (r["bad"], r["good"]) for r in tried}
    only = frozenset(known)
    toxic = map_rows(sample.filter(F.col("__label") > 0), ["__text", "__label"], lambda: make(only), shape).collect() if known else []
    return {"costs": costs, "lexicon": pick_entries(known, [set(r["entries"]) for r in toxic])}


def pick_entries(known: dict[str, tuple[int, int]], texts: list[set[str]]) -> dict[str, float]:
    """The entries taken, each with its smoothed share of toxic texts.

    First each for the texts that no earlier one explains; then those in at least ``COMMON`` times as
    many toxic texts as the most frequent one. Longer forms of an entry add nothing.
    """
    taken: list[str] = []
    left = [t for t in texts if t]
    while left:
        gain = Counter(e for t in left for e in t)
        best = max(gain, key=lambda e: (gain[e] - 5 * known[e][1], -len(e), e))
        if gain[best] < SUPPORT:
            break
        taken.append(best)
        left = [t for t in left if best not in t]
    most = max((bad for bad, _ in known.values()), default=0)
    for entry in sorted(known, key=lambda e: (-known[e][0], len(e), e)):
        if known[entry][0] >= COMMON * most and not any(t[0] == "^" and entry[1:].startswith(t[1:]) for t in taken):
            taken.append(entry)
    return {e: (known[e][0] + 0.5) / (sum(known[e]) + 1) for e in taken}


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for each row, repeated ones alike.

    The score is the chance that at least one of the lexicon entries met is right; a text without words,
    null or empty, scores 0. A null key is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        lexicon, table = shared.value["lexicon"], shared.value["costs"].tolist()
        known: dict[str, tuple[str, ...]] = {}

        def met(token: str) -> tuple[str, ...]:
            hits = known.get(token)
            if hits is None:
                hits = known[token] = tuple({e for r in readings(token, table) for e in entries(r) if e in lexicon})
            return hits

        def rate(one: str | None) -> float:
            clean = 1.0
            for entry in sorted({e for t in tokens(one) for e in met(t)}):
                clean *= 1 - lexicon[entry]
            return 1 - clean

        def work(keys, texts):
            if len(known) > KNOWN_WORDS:
                known.clear()
            return [keys, [rate(t) for t in texts]]

        return work

    kind = docs.schema[key].dataType.simpleString()
    found = map_rows(docs, [F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")], make, f"__key {kind}, score double")
    fold = F.coalesce(crc_fold("__key", PARTS) == HELD, F.lit(False))
    return found.select(F.col("__key").alias(key), fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
