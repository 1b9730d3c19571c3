"""Repair of the structure of conversations by cheapest edits.

A conversation is good if the initials of its roles read ``(s?(ua)+)?``. The edits of its rows form a
lattice: a node is a place between two rows and what the roles so far read; edges keep, re-role or delete
the next row or insert one. A bidirectional Dijkstra search finds the cheapest path: a forward and a
reverse heap meet, all crossings of equal cost are finished, and of their concatenated audits the least
is taken. Two different paths of one cost over the same rows never have an audit that begins with the
other's whole audit (what follows could be insertions only, which cost), so the least audit of a whole is made of
least audits of its parts, and long conversations can be searched in blocks.

Rows are dealt by range of conversation and turn, so a conversation of any length spreads over tasks. One that
lies inside a task and fits a block is searched and hashed there. Others give one row per block, with
the cheapest edits from each state to each other; these are joined per conversation, and the repaired text
of the blocks passes once, in order, through its hash, which is the one step that no hash function lets us split.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.batches import short_batches
from assayloom.session import settle, shuffle_width

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: Added for each truncated row that is not deleted.
TRUNCATED_COST = 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: What the roles so far read: nothing, a system row, a user row last, an assistant row last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, GOOD_ENDS = range(4), (START, ASSISTANT)
#: The state after a role initial.
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The only role that may be inserted or given in a state.
NEXT_ROLE = ("user", "user", "assistant", "user")
LEGAL_NEIGHBOURS = ("su", "ua", "au")
BLOCK = 256
WORD_SIGN = re.compile(r"[^\x20\x09-\x0D]")

#: A row as the search sees it: role initial and fault (0 for none).
Row = tuple[str, int]


def row_edges(state: int, row: Row) -> list[tuple[int, int, str]]:
    """Next state, cost and letter of each edit of a row."""
    initial, fault = row
    out = [(state, COSTS[DELETE], DELETE)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    if (state, initial) in MOVES:
        out.append((MOVES[state, initial], COSTS[KEEP] + more, KEEP))
    given = NEXT_ROLE[state]
    if given[0] != initial:
        out.append((MOVES[state, given[0]], COSTS[REROLE] + more, REROLE))
    return out


def edges_into(state: int, row: Row) -> list[tuple[int, int, str]]:
    """State before, cost and letter of each edit of a row that leads to ``state``."""
    return [(before, cost, letter) for before in STATES for after, cost, letter in row_edges(before, row) if after == state]


INSERTED = {s: MOVES[s, NEXT_ROLE[s][0]] for s in STATES}
INSERTED_FROM = {s: [b for b in STATES if INSERTED[b] == s] for s in STATES}


def cheapest(rows: list[Row], start: int, ends: Iterable[int]) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits from state ``start`` to one of ``ends``; none if no edits lead there."""
    size = len(rows)
    best = [{(0, start): (0, "")}, {(size, e): (0, "") for e in ends}]
    done: list[set] = [set(), set()]
    # Nodes of one cost are finished in the order of the rows, so labels of equal cost are final when they are taken.
    heaps = [[(0, 0, start)], [(0, -size, e) for e in ends]]
    for heap in heaps:
        heapq.heapify(heap)
    meet = min((0 for e in ends if size == 0 and e == start), default=None)
    # Few kinds of rows occur; the edges of each are worked out once.
    edges: list[dict] = [{}, {}]

    def edges_of(side: int, state: int, row: Row) -> list[tuple[int, int, str]]:
        if (state, row) not in edges[side]:
            edges[side][state, row] = (edges_into if side else row_edges)(state, row)
        return edges[side][state, row]

    def steps(side: int, at: int, state: int) -> list[tuple[int, int, int, str]]:
        if side == 0:
            out = [(at, INSERTED[state], COSTS[INSERT], INSERT)]
            return out + [(at + 1, *edge) for edge in edges_of(0, state, rows[at])] if at < size else out
        out = [(at, before, COSTS[INSERT], INSERT) for before in INSERTED_FROM[state]]
        return out + [(at - 1, *edge) for edge in edges_of(1, state, rows[at - 1])] if at else out

    while heaps[0] and heaps[1]:
        if meet is not None and heaps[0][0][0] + heaps[1][0][0] > meet:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, at, state = heapq.heappop(heaps[side])
        node = (abs(at), state)
        if node in done[side]:
            continue
        done[side].add(node)
        audit = best[side][node][1]
        for place, other, more, letter in steps(side, *node):
            label = (cost + more, audit + letter if side == 0 else letter + audit)
            old = best[side].get((place, other))
            if old is None or label < old:
                best[side][place, other] = label
                if old is None or label[0] < old[0]:
                    heapq.heappush(heaps[side], (label[0], place if side == 0 else -place, other))
            across = best[1 - side].get((place, other))
            if across is not None and (meet is None or label[0] + across[0] < meet):
                meet = label[0] + across[0]
    if meet is None:
        return None
    crossings = [(best[0][n][0] + best[1][n][0], best[0][n][1] + best[1][n][1]) for n in best[0].keys() & best[1].keys()]
    return min(crossings)


def repaired_lines(rows: list[tuple[str, str, int]], audit: str, state: int = START) -> list[str]:
    """``role:text`` of the rows (role, text, fault) after the edits."""
    out, rest = [], iter(rows)
    for letter in audit:
        role, text = (NEXT_ROLE[state], "") if letter == INSERT else next(rest)[:2]
        if letter == DELETE:
            continue
        if letter == REROLE:
            role = NEXT_ROLE[state]
        out.append(f"{role}:{text}")
        state = MOVES[state, role[:1]]
    return out


def fault_of(text: str, again: bool) -> int:
    last = next((c for c in reversed(text) if WORD_SIGN.match(c)), None)
    return BLANK if last is None else DUPLICATE if again else 0 if last in ".!?" else TRUNCATED


class Summary:
    """Counts of consecutive rows that can be joined with those of the rows after them."""

    FIELDS = ("first", "last", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "n")

    def __init__(self, values: dict | None = None) -> None:
        self.first = self.last = None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.n = 0
        for name in self.FIELDS if values else ():
            setattr(self, name, values[name])

    def values(self) -> dict:
        return {name: getattr(self, name) for name in self.FIELDS}

    def add(self, other: "Summary") -> None:
        if not other.n:
            return
        if self.n:
            self.illegal += self.last + other.first not in LEGAL_NEIGHBOURS
        self.illegal += other.illegal
        # Rows come by turn, nulls first, so a turn can be shared at the border only.
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        self.first = other.first if not self.n else self.first
        self.last = other.last
        for name in ("blank", "duplicate", "truncated", "n"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def add_row(self, turn: int | None, initial: str, fault: int) -> None:
        one = Summary()
        one.first = one.last = initial
        one.low = one.high = turn
        one.turns, one.n = int(turn is not None), 1
        one.blank, one.duplicate, one.truncated = (int(fault == f) for f in (BLANK, DUPLICATE, TRUNCATED))
        self.add(one)

    def figures(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = pa.schema([("conv", pa.int64()), *[(n, pa.int64()) for n in FIGURES], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_RESULT_DDL = f"conv bigint, {', '.join(f'{n} bigint' for n in FIGURES)}, audit string, repaired_sha256 string"
_PATH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())])
_SUMMARY = pa.struct([("first", pa.string()), ("last", pa.string()), *[(n, pa.int64()) for n in Summary.FIELDS[2:]]])
_BLOCKS = pa.schema([*_RESULT, ("part", pa.int64()), ("block", pa.int64()), ("summary", _SUMMARY), ("paths", pa.list_(_PATH)), ("rows", pa.list_(_ROW))])
_BLOCKS_DDL = (
    f"{_RESULT_DDL}, part bigint, block bigint, summary struct<first string, last string, {', '.join(f'{n}: bigint' for n in Summary.FIELDS[2:])}>, "
    "paths array<struct<start int, end int, cost bigint, audit string>>, rows array<struct<role string, text string, fault int>>"
)


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` and ``copies`` of the rows after the damage that their key decides."""

    def told(name: str):
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(told(conv), F.lit(":"), told(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), told(role).alias("__role"), told(text).alias("__text"), draw.alias("__draw"))
    changed = F.when(F.col("__draw") == 1, F.lit("")).when(F.col("__draw") == 2, F.translate("__text", ".!?", "")).otherwise(F.col("__text"))
    return rows.filter("__draw <> 0").select(
        "conv", "turn", F.when(F.col("__draw") == 4, F.lit("user")).otherwise(F.col("__role")).alias("role"), changed.alias("text"), F.when(F.col("__draw") == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies")
    )


def plain_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same columns for conversations that are taken as they are."""
    told = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return conversations.select(F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), *told, F.lit(1).alias("copies"))


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations that fit one block, and blocks of all others; rows (part, conv, turn, role, text, copies, again) come sorted."""
    out: list[dict] = []

    def block(conv, part, number, rows, summary) -> dict:
        seen = [(role[:1], fault) for role, _, fault in rows]
        paths = [{"start": s, "end": e, "cost": p[0], "audit": p[1]} for s in STATES for e in STATES if (p := cheapest(seen, s, (e,)))]
        # Rows that must be deleted need no text any more.
        kept = [{"role": r, "text": None if f in (BLANK, DUPLICATE) else t, "fault": f} for r, t, f in rows]
        return {"conv": conv, "part": part, "block": number, "summary": summary.values(), "paths": paths, "rows": kept}

    def whole(conv, rows, summary) -> dict:
        cost, audit = cheapest([(role[:1], fault) for role, _, fault in rows], START, GOOD_ENDS)
        return {"conv": conv, "cost": cost, "audit": audit, "repaired_sha256": text_hash(repaired_lines(rows, audit)), **summary.figures()}

    conv = part = number = None
    first, rows, summary = True, [], Summary()
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(7)]):
            here, turn, role, text, copies, again = row[1:]
            if number is None or here != conv:
                if number is not None:
                    # The first conversation of a task may have begun in the task before.
                    out.append(whole(conv, rows, summary) if not first and number == 0 else block(conv, part, number, rows, summary))
                    first = False
                part, conv, number, rows, summary = row[0], here, 0, [], Summary()
            for copy in range(copies):
                if len(rows) == BLOCK:
                    out.append(block(conv, part, number, rows, summary))
                    number, rows, summary = number + 1, [], Summary()
                fault = fault_of(text, again or copy > 0)
                rows.append((role, text, fault))
                summary.add_row(turn, role[:1], fault)
                if len(out) >= 64:
                    yield pa.RecordBatch.from_pylist(out, schema=_BLOCKS)
                    out = []
    if number is not None:
        out.append(block(conv, part, number, rows, summary))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_BLOCKS)


def text_hash(lines: list[str]) -> str:
    return sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, dict]]:
    """Each row of sorted batches as a dict, with its conversation and whether that is a new one."""
    last, begun = None, False
    for batch in batches:
        for row in batch.to_pylist():
            yield row["conv"], not begun or row["conv"] != last, row
            last, begun = row["conv"], True


_CHOICE = pa.schema([*_RESULT, ("choices", pa.list_(pa.struct([("part", pa.int64()), ("block", pa.int64()), ("start", pa.int32()), ("audit", pa.string())])))])
_CHOICE_DDL = f"{_RESULT_DDL}, choices array<struct<part bigint, block bigint, start int, audit string>>"


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cheapest edits of each conversation from the cheapest edits of its blocks (sorted), and the edits of each block."""

    def close(conv, summary, blocks, reach) -> pa.RecordBatch:
        end = min((e for e in GOOD_ENDS if e in reach[-1]), key=lambda e: reach[-1][e][:2])
        cost, audit = reach[-1][end][:2]
        choices = []
        for (part, block), ways in zip(reversed(blocks), reversed(reach)):
            _, whole, start, own = ways[end]
            choices.append({"part": part, "block": block, "start": start, "audit": own})
            end = start
        made = {"conv": conv, "cost": cost, "audit": audit, **summary.figures(), "choices": choices}
        return pa.RecordBatch.from_pylist([made], schema=_CHOICE)

    held = None
    for conv, new, row in _runs(batches):
        if new:
            if held:
                yield close(*held)
            held = (conv, Summary(), [], [])
        _, summary, blocks, reach = held
        summary.add(Summary(row["summary"]))
        before = {s: w[:2] for s, w in reach[-1].items()} if reach else {START: (0, "")}
        ways: dict[int, tuple] = {}
        for p in row["paths"]:
            if p["start"] in before:
                cost, audit = before[p["start"]]
                way = (cost + p["cost"], audit + p["audit"], p["start"], p["audit"])
                if p["end"] not in ways or way[:2] < ways[p["end"]][:2]:
                    ways[p["end"]] = way
        if reach:  # whole audits are needed of the last block only
            reach[-1] = {s: (w[0], None, w[2], w[3]) for s, w in reach[-1].items()}
        blocks.append((row["part"], row["block"]))
        reach.append(ways)
    if held:
        yield close(*held)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired lines of each block after its chosen edits, as text; none if no line is left."""
    for batch in batches:
        for row in batch.to_pylist():
            lines = repaired_lines([(r["role"], r["text"], r["fault"]) for r in row["rows"]], row["audit"], row["start"])
            piece = "\n".join(lines).encode("utf-8", "surrogatepass") if lines else None
            yield pa.RecordBatch.from_arrays([pa.array([row[n]], pa.int64()) for n in ("conv", "part", "block")] + [pa.array([piece], pa.binary())], names=["conv", "part", "block", "piece"])


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's pieces, which come sorted and are read one after the other."""

    def close(conv, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["conv", "hash"])

    held = None
    for conv, new, row in _runs(batches):
        if new:
            if held:
                yield close(*held[:2])
            held = [conv, sha256(), True]
        if row["piece"] is not None:
            held[1].update(row["piece"] if held[2] else b"\n" + row["piece"])
            held[2] = False
    if held:
        yield close(*held[:2])


def repair(rows: DataFrame) -> DataFrame:
    """Figures, cost, audit and hash of the repaired text for each conversation of ``rows`` (``conv``, ``turn``, ``role``, ``text``, ``copies``).

    Rows are taken by turn, nulls first, then role and the hash of the text. Roles other than those with the initials s, u and
    a, the empty one too, cannot be kept. A null ``conv`` is a conversation of its own.
    """
    width = shuffle_width(rows.sparkSession)
    hashed = rows.withColumn("print", F.sha2(F.col("text").cast("binary"), 256))
    same = settle(hashed.groupBy("conv", "turn", "role", "print").agg(F.first("text").alias("text"), F.sum("copies").cast("int").alias("copies")))
    order = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    earliest = settle(same.groupBy("conv", "role", "print").agg(F.min(order).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(c).alias(f"__{c}") for c in ("conv", "role", "print")], "earliest"))
    met = F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("print") == F.col("__print"))
    marked = same.join(earliest, met, "left").select("conv", "turn", "role", "text", "copies", "print", F.coalesce(order > F.col("earliest"), F.lit(False)).alias("again"))
    # The place of a row in the ranges must not move in a retry, hence the written copy.
    by = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "print"]
    ranged = short_batches(marked).repartitionByRange(width, *by).sortWithinPartitions(*by)
    found = settle(ranged.select(F.spark_partition_id().cast("bigint").alias("part"), "conv", "turn", "role", "text", "copies", "again").mapInArrow(_search_blocks, _BLOCKS_DDL))
    blocks = found.filter("part IS NOT NULL")

    place = ["conv", "part", "block"]
    chosen = settle(blocks.select(*place, "summary", "paths").repartition(width, "conv").sortWithinPartitions(*place).mapInArrow(_join_blocks, _CHOICE_DDL))
    choice = chosen.select(F.col("conv").alias("__conv"), F.explode("choices").alias("c")).select("__conv", F.col("c.part").alias("__part"), F.col("c.block").alias("__block"), F.col("c.start").alias("start"), F.col("c.audit").alias("audit"))
    told = (F.col("part") == F.col("__part")) & (F.col("block") == F.col("__block")) & F.col("conv").eqNullSafe(F.col("__conv"))
    pieces = blocks.select(*place, "rows").join(choice, told).select(*place, "rows", "start", "audit").mapInArrow(_replay, "conv bigint, part bigint, block bigint, piece binary")
    hashes = pieces.repartition(width, "conv").sortWithinPartitions(*place).mapInArrow(_hash_pieces, "conv bigint, hash string").select(F.col("conv").alias("__conv"), "hash")
    names = ["conv", *FIGURES, "audit"]
    long = chosen.join(hashes, F.col("conv").eqNullSafe(F.col("__conv"))).select(*names, F.col("hash").alias("repaired_sha256"))
    return found.filter("part IS NULL").select(*names, "repaired_sha256").unionByName(long)


def repair_damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: it is damaged, judged and repaired.

    Null roles and texts are one space. A conversation that has lost all rows has zeros, an empty audit and the hash of
    an empty text. Keys and turns are whole numbers. Without conversations there are no rows.
    """
    kept = repair(damaged(conversations, conv, turn, role, text)).withColumnRenamed("conv", "__conv")
    names = conversations.select(F.col(f"`{conv}`").cast("bigint").alias("conv")).distinct()
    joined = names.join(kept, F.col("conv").eqNullSafe(F.col("__conv")), "left")
    empty = {"audit": "", "repaired_sha256": sha256().hexdigest(), **dict.fromkeys(FIGURES, 0)}
    return joined.select(F.col("conv").alias(conv), *[F.coalesce(c, F.lit(empty[c]).cast("bigint" if c in FIGURES else "string")).alias(c) for c in (*FIGURES, "audit", "repaired_sha256")])
