"""BPE encoding and decoding by speculation and checking.

The words of a batch that were not met before are cut greedily into the longest known pieces. A
cut is the BPE result exactly if each piece encodes to itself and each two neighbours would also
stay apart when encoded together; numpy tests all neighbours of all words at once by undoing
merges on both sides of the border. Only words that fail the test are merged step by step.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.batches import map_rows

END = "</w>"
#: White space as the tokenizer's own patterns see it.
SPACE = r"\t-\r \x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Words remembered in a task before the memory starts anew.
KNOWN_WORDS = 400_000
#: Words merged together fill so many cells at most, besides a single longer word.
MERGE_CELLS = 400_000
NEW_COLUMNS = ("n_tokens", "token_ids", "decoded")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for byte in range(256):
        if byte in plain:
            letters[byte] = chr(byte)
        else:
            letters[byte] = chr(spare)
            spare += 1
    return letters


def read_tokenizer(path: str) -> dict:
    """Vocabulary, merges and special tokens of a word-end BPE file; read on the driver, as large as the vocabulary."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model = data["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
        raise ValueError("a BPE file with word ends is needed")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in data["added_tokens"]}}


class Bpe:
    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], special: dict[str, int]) -> None:
        self.vocab, self.special = vocab, special
        count = max([*vocab.values(), *special.values()]) + 1
        self.text = [""] * count
        for token, i in [*vocab.items(), *special.items()]:
            self.text[i] = token
        self.reach: dict[str, int] = {}
        for token in vocab:
            size = len(token.removesuffix(END))
            self.reach[token[:3]] = max(size, self.reach.get(token[:3], 0))
        self.letters = dict(enumerate(byte_letters()))
        # Order of creation: base symbols first, then the merges by rank.
        self.order = np.zeros(count, dtype=np.int64)
        self.left = np.arange(count, dtype=np.int64)
        self.right = np.arange(count, dtype=np.int64)
        self.made = np.zeros(len(merges) + 1, dtype=np.int64)
        for n, (a, b) in enumerate(merges, 1):
            made = self.made[n] = vocab[a + b]
            self.left[made], self.right[made] = vocab[a], vocab[b]
            self.order[made] = n
        made = self.made[1:]
        keys, ranks = self.left[made] << 32 | self.right[made], np.arange(1, len(merges) + 1)
        place = np.argsort(keys)
        self.keys, self.ranks = keys[place], ranks[place]
        self.whole = np.ones(count, dtype=bool)
        self.whole[made] = self._apart(self.left[made], self.right[made], self.order[made])
        for i in made:
            self.whole[i] &= self.whole[self.left[i]] and self.whole[self.right[i]]
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)

    def _apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each two neighbours whether no merge across their border comes before the merges that made them.

        The younger side is undone step by step: before its last merge (rank ``limit``) no
        earlier merge may have joined the two symbols at the border.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.copy()
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            bad = self._pair_rank(x, y) < limit[live]
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            age_x, age_y = self.order[x], self.order[y]
            more = (age_x > 0) | (age_y > 0)
            live, x, y, age_x, age_y = live[more], x[more], y[more], age_x[more], age_y[more]
            first = age_x > age_y
            # An equal rank at the border would win on the left of b, but lose on the right of a.
            limit[live] = np.where(first, age_x, age_y + 1)
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
        return good

    def guess(self, word: str) -> list[int]:
        """The longest known piece at each place."""
        vocab, out, at, size = self.vocab, [], 0, len(word)
        while True:
            whole = vocab.get(word[at:] + END)
            if whole is not None:
                out.append(whole)
                return out
            for end in range(min(size - 1, at + self.reach.get(word[at:at + 3], 2)), at, -1):
                piece = vocab.get(word[at:end])
                if piece is not None:
                    out.append(piece)
                    at = end
                    break

    def merge(self, words: Sequence[str]) -> list[list[int]]:
        """Merge by rank, leftmost first: one merge in every word at a time, words of like length together."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(order):
            end = start
            while end < len(order) and (end - start) * len(words[order[end]]) <= MERGE_CELLS:
                end += 1
            end = max(end, start + 1)
            for i, ids in zip(order[start:end], self._merge_block([words[i] for i in order[start:end]])):
                out[i] = ids
            start = end
        return out

    def _merge_block(self, words: list[str]) -> list[list[int]]:
        sizes = np.array([len(w) for w in words])
        ids = np.full((len(words), int(sizes.max()) + 1), -1, dtype=np.int64)
        for row, word in enumerate(words):
            ids[row, : len(word)] = [*map(self.vocab.__getitem__, word[:-1]), self.vocab[word[-1] + END]]
        never = np.iinfo(np.int64).max
        ranks = np.full((len(words), ids.shape[1]), never)
        here = np.nonzero(ids[:, 1:] >= 0)
        ranks[here] = self._pair_rank(ids[here], ids[here[0], here[1] + 1])
        rows = np.arange(len(words))
        done: list[list[int]] = [[]] * len(words)
        columns = np.arange(ids.shape[1])
        while len(rows):
            best = ranks.argmin(axis=1)
            open_ = ranks[np.arange(len(rows)), best] < never
            for i in np.flatnonzero(~open_):
                done[rows[i]] = ids[i][ids[i] >= 0].tolist()
            rows, ids, ranks, best = rows[open_], ids[open_], ranks[open_], best[open_]
            if not len(rows):
                break
            at = np.arange(len(rows))
            made = self.made[ranks[at, best]]
            # Close the gap: what stands right of the pair moves one place left.
            take = np.minimum(columns + (columns > best[:, None]), len(columns) - 1)
            ids = np.take_along_axis(ids, take, axis=1)
            ranks = np.take_along_axis(ranks, take, axis=1)
            ids[:, -1], ranks[:, -1] = -1, never
            ids[at, best] = made
            for place, ok in ((best - 1, best > 0), (best, ids[at, np.minimum(best + 1, len(columns) - 1)] >= 0)):
                r, c = at[ok], place[ok]
                ranks[r, c] = self._pair_rank(ids[r, c], ids[r, c + 1])
                ranks[at[~ok], np.maximum(place[~ok], 0)] = np.where(place[~ok] < 0, ranks[at[~ok], 0], never)
        return done

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """Token ids of byte-letter words; guesses are tested together."""
        guesses = [self.guess(w) for w in words]
        if not guesses:
            return []
        flat = np.fromiter((i for g in guesses for i in g), dtype=np.int64)
        owner = np.repeat(np.arange(len(guesses)), [len(g) for g in guesses])
        failed = np.zeros(len(guesses), dtype=bool)
        failed[owner[~self.whole[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        failed[owner[inside[~self._apart(flat[inside], flat[inside + 1])]]] = True
        wrong = np.flatnonzero(failed)
        for i, ids in zip(wrong, self.merge([words[i] for i in wrong])):
            guesses[i] = ids
        return guesses

    def split(self, text: str) -> list[str]:
        """Special tokens as they are and words in lower case, each as encoded."""
        if self.splitter is None or "<|" not in text:
            return self._words(text)
        out = []
        for part in self.splitter.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out.extend(self._words(part))
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        if not text.isascii():
            # Sigma has one lower-case form here, wherever it stands.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return WORD.findall(text.lower())

    def encode_texts(self, texts: Sequence[str], known: dict[str, bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; ``known`` remembers words."""
        split = [self.split(t) for t in texts]
        fresh = list(dict.fromkeys(w for words in split for w in words if w not in known))
        plain = [w for w in fresh if w not in self.special]
        lettered = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for w in plain]
        for word, ids in zip(plain, self.encode_words(lettered)):
            known[word] = np.array(ids, dtype="<u4").tobytes()
        for word in fresh:
            if word in self.special:
                known[word] = np.array([self.special[word]], dtype="<u4").tobytes()
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, set apart by blanks, special tokens included."""
        return " ".join(map(self.text.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode whole texts and decode them again.

    Returns ``key``, the columns in ``keep``, ``n_tokens``, ``token_ids`` (binary: little-endian unsigned
    32-bit numbers) and ``decoded``; kept columns with one of these names give way. A null text counts as
    empty: no tokens, an empty decoded text. Each row, repeated or not, gives one row. The vocabulary is
    sent to the tasks once: its size is fixed by the file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    kept = [c for c in keep if c not in (key, *NEW_COLUMNS)]

    def make():
        bpe, known = Bpe(**shared.value), {}

        def work(texts, keys, *others):
            if len(known) > KNOWN_WORDS:
                known.clear()
            ids = bpe.encode_texts([t or "" for t in texts], known)
            return [keys, *others, [len(x) // 4 for x in ids], ids, [bpe.decode(x) for x in ids]]

        return work

    columns = [docs[f"`{text}`"].cast("string").alias("__text"), *[docs[f"`{c}`"].alias(f"__{i}") for i, c in enumerate([key, *kept])]]
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [key, *kept])
    return map_rows(docs, columns, make, f"{shape}, n_tokens bigint, token_ids binary, decoded string")


def digest(encoded: DataFrame, key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``n_tokens``, the SHA-256 of ids and decoded text, and the columns in ``more`` (those names give way)."""
    made = {"ids_sha256": F.sha2("token_ids", 256), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}
    return encoded.select(key, "n_tokens", *[v.alias(k) for k, v in made.items()], *[f"`{c}`" for c in more if c not in (key, "n_tokens", *made)])
