"""Many patterns searched in one pass over an array of symbols.

Each pattern is a lane (one bit) of a 64-bit word. For each place in the patterns a table gives the word
of the lanes that accept a symbol, so one table lookup and one bitwise operation test a place of up to 64
patterns at every position of the text together. With errors, the rejected lanes are added into counters
whose bits lie in words of their own. Work grows with text, pattern length and hits, not with the number of patterns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

LANES = 64
#: Positions tested together.
STEP = 1 << 17
#: Symbols beyond the table are read as this one, which patterns do not accept.
OTHER = 127


class PatternSet:
    """Patterns given as the accepted symbols of each of their places."""

    def __init__(self, patterns: Sequence[Sequence[str]]) -> None:
        if not patterns or not all(patterns):
            raise ValueError("patterns need at least one place")
        self.sizes = np.array([len(p) for p in patterns])
        self.longest = int(self.sizes.max())
        self.accepts = []
        for pattern in patterns:
            table = np.zeros((len(pattern), OTHER + 1), dtype=bool)
            for place, symbols in enumerate(pattern):
                table[place, [ord(s) for s in symbols if ord(s) < OTHER]] = True
            self.accepts.append(table)
        order = np.argsort(self.sizes, kind="stable")
        self.groups = []
        for first in range(0, len(order), LANES):
            lanes = order[first : first + LANES]
            tables = np.zeros((int(self.sizes[lanes].max()), OTHER + 1), dtype=np.uint64)
            for bit, i in enumerate(lanes):
                lane = np.uint64(1 << bit)
                tables[: self.sizes[i]][self.accepts[i]] |= lane
                tables[self.sizes[i] :] |= lane  # beyond its end a pattern takes anything
            self.groups.append((lanes, tables))

    def search(self, codes: np.ndarray, most: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """Pattern and 0-based starts of its matches with at most ``most`` places rejected."""
        padded = np.concatenate([codes, np.zeros(self.longest, dtype=codes.dtype)])
        for lanes, tables in self.groups:
            for low in range(0, len(codes), STEP):
                size = min(STEP, len(codes) - low)
                at, live = self._exact(padded, low, size, tables) if most == 0 else self._near(padded, low, size, tables, most)
                present = int(np.bitwise_or.reduce(live)) if len(live) else 0
                for bit, i in enumerate(lanes):
                    if present >> bit & 1:
                        starts = low + at[(live >> np.uint64(bit) & np.uint64(1)).astype(bool)]
                        yield int(i), starts[starts + self.sizes[i] <= len(codes)]

    @staticmethod
    def _exact(padded: np.ndarray, low: int, size: int, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, live = None, tables[0][padded[low : low + size]]
        for place in range(1, len(tables)):
            if at is None and place >= 3 and 4 * np.count_nonzero(live) < size:
                at = np.flatnonzero(live)
                live = live[at]
            live &= tables[place][padded[low + place : low + place + size] if at is None else padded[at + (low + place)]]
            if at is not None:
                left = live != 0
                at, live = at[left], live[left]
        if at is None:
            at = np.flatnonzero(live)
            live = live[at]
        return at, live

    @staticmethod
    def _near(padded: np.ndarray, low: int, size: int, tables: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Rejections of all lanes are counted side by side: bit i of plane k is bit k of the count of lane i."""
        at = np.arange(size)
        planes = [np.zeros(size, dtype=np.uint64) for _ in range(most.bit_length())]
        beyond = np.zeros(size, dtype=np.uint64)
        for place in range(len(tables)):
            carry = ~tables[place][padded[at + (low + place)]]
            for k, plane in enumerate(planes):
                planes[k], carry = plane ^ carry, plane & carry
            beyond |= carry
            over, equal = beyond.copy(), ~beyond
            for k in range(len(planes) - 1, -1, -1):
                if most >> k & 1:
                    equal &= planes[k]
                else:
                    over |= equal & planes[k]
                    equal &= ~planes[k]
            if place >= most:
                left = ~over != 0
                if 4 * np.count_nonzero(left) < 3 * len(at):
                    at, beyond, over = at[left], beyond[left], over[left]
                    planes = [p[left] for p in planes]
        return at, ~over

    def rejected(self, pattern: int, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which places of the pattern are rejected at each start, one row per start."""
        places = np.arange(self.sizes[pattern])
        return ~self.accepts[pattern][places, codes[starts[:, None] + places]]


class Texts:
    """Some texts as one array of symbols, each followed by a symbol that no pattern accepts."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.joined = "\0".join(texts) + "\0"
        self.plain = self.joined.isascii()
        if self.plain:
            self.codes = np.frombuffer(self.joined.encode("ascii"), dtype=np.uint8)
        else:
            self.codes = np.minimum(np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), dtype="<u4"), OTHER)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The text in which each place lies."""
        return np.searchsorted(self.starts, places, side="right") - 1

    def cut(self, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """The pieces of the joined texts as an Arrow array."""
        if not self.plain:
            return pa.array([self.joined[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist())], pa.string())
        ends = np.cumsum(lengths)
        places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.codes[places].tobytes())])
