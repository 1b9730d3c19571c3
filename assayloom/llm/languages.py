"""Language identification by cross-parsing.

For each language a suffix automaton holds all substrings of a bounded amount of labelled text. A
whole document is cut from left to right into phrases, each the longest match at its place in that text. The
fewer phrases per character a language needs, in proportion to what text of its size would need, the closer
its text is to the document.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.batches import crc_fold, map_rows

#: Labelled documents of a language looked at, and characters of them learned, at most.
TRAIN_DOCS, TRAIN_CHARS = 200, 40_000
#: Longer documents teach only where a language has no shorter one (they are identified like all others).
TRAIN_LENGTH = 20_000
#: Characters that are parsed side by side as one stretch, and cells of the grid of stretches held at a time.
STRETCH, CELLS = 256, 8_000_000
#: Cells of the plain table of next states; it holds as many of the frequent letters as fit.
PLAIN_CELLS = 32_000_000
PARTS, HELD = 4, 2
STOP, BLANK, OTHER = 0, 1, 2


def folded(text: str, codes: np.ndarray) -> np.ndarray:
    """Codes of a lower-case text; runs of anything but letters are one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = codes[points]
    blank = out == BLANK
    return out[~(blank & np.concatenate([[True], blank[:-1]]))] if len(out) else out


def letter_codes(texts: list[str]) -> np.ndarray:
    """Code of every code point: blank for what is no letter, a number of its own for each letter that is taught, frequent ones first."""
    taught = [c for c, _ in sorted(Counter("".join(texts).lower()).items(), key=lambda x: (-x[1], x[0])) if c.isalpha()]
    kind = np.min_scalar_type(len(taught) + OTHER)
    codes = np.fromiter((OTHER if chr(i).isalpha() else BLANK for i in range(0x110000)), dtype=kind, count=0x110000)
    codes[[ord(c) for c in taught]] = np.arange(len(taught)) + OTHER + 1
    return codes


def suffix_automaton(codes: list[int]) -> np.ndarray:
    """Transitions (state, code, next state) of the smallest automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in codes:
        new = len(step)
        step.append({}), size.append(size[last] + 1), link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q])), size.append(size[p] + 1), link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return np.array([(s, c, t) for s, out in enumerate(step) for c, t in out.items()], dtype=np.int32).reshape(-1, 3)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Automata of all languages named in rows outside the held-out fold.

    At most ``TRAIN_DOCS`` rows with text a language are looked at, those with the smallest hashes of their
    key, and whole texts of them are learned up to ``TRAIN_CHARS`` characters. Rows without text and rows longer than
    ``TRAIN_LENGTH`` do not count as long as there are others; of a longer one the beginning is taught.
    The model grows by about 1 MB a language.
    """
    body = F.col(text).cast("string")
    usable = docs.filter((crc_fold(key, PARTS) != HELD) & F.col(lang).isNotNull() & (F.length(body) > 0)).select(
        F.col(key).alias("__key"), F.col(lang).cast("string").alias("__lang"), body.substr(1, TRAIN_CHARS).alias("__text"), (F.length(body) > TRAIN_LENGTH).alias("__long"), F.xxhash64(key).alias("__hash")
    )
    # Spark keeps the first rows of each language in every task before it exchanges them.
    order = Window.partitionBy("__lang").orderBy("__long", "__hash", "__key", "__text")
    picked = usable.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= TRAIN_DOCS)
    texts: dict[str, list[tuple[str, bool]]] = {}
    for row in picked.orderBy("__lang", "__rank").select("__lang", "__text", "__long").collect():
        texts.setdefault(row["__lang"], []).append((row["__text"], row["__long"]))
    codes = letter_codes([t for own in texts.values() for t, _ in own])
    model = {"names": [], "moves": [], "taught": [], "codes": codes}
    for name, own in texts.items():
        taught: list[int] = []
        for one, long in own:
            more = folded(one, codes).tolist()
            if (len(taught) + len(more) <= TRAIN_CHARS and not long) or not taught:
                taught += [BLANK, *more]
        if len(set(taught)) > 1:
            model["names"].append(name)
            model["moves"].append(suffix_automaton(taught))
            model["taught"].append(len(taught))
    return model


class Parser:
    """All automata in one table from (state, code) to the next state: plain for frequent letters, hashed for the others."""

    def __init__(self, model: dict) -> None:
        self.names, self.codes = model["names"], model["codes"]
        self.taught = np.array(model.get("taught", [2] * len(self.names)), dtype=np.float64)
        self.width = int(self.codes.max()) + 1
        sizes = [int(m[:, [0, 2]].max()) + 1 for m in model["moves"]]
        self.roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if sizes else np.zeros(0, dtype=np.int64)
        moves = np.concatenate([m.astype(np.int64) + [root, 0, root] for root, m in zip(self.roots, model["moves"])]) if sizes else np.zeros((0, 3), dtype=np.int64)
        self.first = np.full((len(sizes), self.width), -1, dtype=np.int64)
        for n, root in enumerate(self.roots):
            own = moves[moves[:, 0] == root]
            self.first[n, own[:, 1]] = own[:, 2]
        self.plain_width = min(self.width, PLAIN_CELLS // max(1, sum(sizes)))
        self.plain = np.full(sum(sizes) * self.plain_width, -1, dtype=np.int32)
        often = moves[:, 1] < self.plain_width
        self.plain[moves[often, 0] * self.plain_width + moves[often, 1]] = moves[often, 2]
        moves = moves[~often]
        self.bits = max(4, int(2 * len(moves)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.next = np.full(1 << self.bits, -1, dtype=np.int32)
        key, target = moves[:, 0] * self.width + moves[:, 1], moves[:, 2]
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            where, chosen = np.unique(slot[free], return_index=True)
            self.keys[where], self.next[where] = key[free[chosen]], target[free[chosen]]
            left = self.keys[slot] != key
            key, target, slot = key[left], target[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hashed(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = state * self.width + code
        slot = self._slot(key)
        out = np.full(len(key), -1, dtype=np.int64)
        left = np.arange(len(key))
        while len(left):
            now = self.keys[slot[left]]
            hit = left[now == key[left]]
            out[hit] = self.next[slot[hit]]
            left = left[(now != key[left]) & (now >= 0)]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        return out

    def _step(self, state: np.ndarray, code: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and whether a phrase begins with this letter (if only one of an unknown letter)."""
        if self.plain_width == self.width:
            ahead = self.plain[state * self.width + code]
        else:
            state, code, lang = np.broadcast_arrays(state, code, lang)
            ahead = np.empty(state.shape, dtype=np.int64)
            often = code < self.plain_width
            ahead[often] = self.plain[state[often] * self.plain_width + code[often]]
            ahead[~often] = self._hashed(state[~often], code[~often])
        ended = ahead < 0
        if ended.any():
            afresh = self.first[lang, code]
            ahead = np.where(ended, np.where(afresh < 0, self.roots[lang], afresh), ahead)
        return ahead, ended | (state == self.roots[lang])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and characters by text.

        All stretches of a slab are parsed side by side as if a phrase began at each. Then each goes on from
        where the one before it really ended, until it is in the state it was in at that letter the first time.
        """
        folds = [folded(t, self.codes) for t in texts]
        sizes = np.array([len(f) for f in folds])
        total = np.zeros((len(texts), len(self.roots)), dtype=np.int64)
        cuts = [(n, at) for n, f in enumerate(folds) for at in range(0, len(f), STRETCH)]
        slab = max(1, CELLS // (STRETCH * max(1, len(self.roots))))
        end = None
        for low in range(0, len(cuts), slab):
            part = cuts[low : low + slab]
            owner = np.array([n for n, _ in part])
            begins = np.array([at == 0 for _, at in part])
            grid = np.zeros((STRETCH, len(part)), dtype=self.codes.dtype)
            for lane, (n, at) in enumerate(part):
                piece = folds[n][at : at + STRETCH]
                grid[: len(piece), lane] = piece
            count, end = self._slab(grid, begins, end)
            np.add.at(total, owner, count)
        return total, sizes

    def _slab(self, grid: np.ndarray, begins: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by stretch and language, and the states at the very end; ``before`` are those ahead of the first stretch."""
        fill = (grid != STOP).sum(axis=0)
        order = np.argsort(-fill, kind="stable")
        langs = np.arange(len(self.roots))
        shape = (grid.shape[1], len(langs))
        state = np.repeat(self.roots[None, :], shape[0], axis=0)
        states = np.zeros((len(grid), *shape), dtype=np.int32)
        began = np.zeros((len(grid), *shape), dtype=bool)
        ranked = -fill[order]
        for i in range(int(fill.max())):
            live = order[: int(np.searchsorted(ranked, -i, side="left"))]
            live = live if len(live) < len(order) else slice(None)
            ahead, new = self._step(state[live], grid[i, live, None].astype(np.int64), langs[None, :])
            state[live], states[i, live], began[i, live] = ahead, ahead, new
        given = np.repeat(self.roots[None, :], shape[0], axis=0)
        while True:
            true = np.concatenate([self.roots[None, :] if before is None else before[None, :], state[:-1]])
            true[begins] = self.roots
            lane, lang = np.nonzero(true != given)
            if not len(lane):
                return began.sum(axis=0), state[-1]
            given = true
            now = true[lane, lang]
            for i in range(len(grid)):
                going = fill[lane] > i
                lane, lang, now = lane[going], lang[going], now[going]
                if not len(lane):
                    break
                now, new = self._step(now, grid[i, lane].astype(np.int64), lang)
                began[i, lane, lang] = new
                apart = states[i, lane, lang] != now
                states[i, lane, lang] = now
                lane, lang, now = lane[apart], lang[apart], now[apart]
            state = states[fill - 1, np.arange(shape[0])].astype(np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and confidence: the runner-up's share of the phrases of the best two.

        Phrases grow with the logarithm of the text that was taught, so their number times that logarithm
        compares languages of which much and little was taught.
        """
        spoken = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if spoken and self.names:
            total, sizes = self.phrases([texts[i] for i in spoken])
            rate = total * np.log(np.maximum(2, self.taught)) / np.maximum(1, sizes)[:, None]
            best = rate.argmin(axis=1)
            ranked = np.sort(rate, axis=1)
            for k, i in enumerate(spoken):
                names[i] = self.names[best[k]]
                scores[i] = float(ranked[k, 1] / (ranked[k, 0] + ranked[k, 1])) if len(self.names) > 1 else 1.0
        return names, scores


def identify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1) for each row, repeated ones alike.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned; equal
    languages go to the first name. A null key is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        parser = Parser(shared.value)
        return lambda keys, texts: [keys, *parser.predict(texts)]

    kind = docs.schema[key].dataType.simpleString()
    found = map_rows(docs, [F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")], make, f"__key {kind}, lang_pred string, score double")
    return found.select(F.col("__key").alias(key), F.coalesce(crc_fold("__key", PARTS) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
