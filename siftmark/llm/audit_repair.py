"""Conversation repair by a dynamic program over edits, with its audit.

The turns are dealt out by ranges of (conversation, turn, ...), so a conversation of any
size spans as many tasks as it needs. A conversation that lies inside one task and has
at most ``BLOCK`` turns is finished there. The others (two a task, and the long ones)
are cut into blocks: each block is solved for every role state it may be entered in, a
fold over the blocks' small cost tables picks the way through them, and the repaired
text is hashed as a stream, never held.

Edits of a turn are Keep (0), Rerole to user or assistant (1) and Delete (2, the only one
for blank turns and for those whose role and text came before); an empty turn is
Inserted for 5; a truncated turn that stays costs 5 more. The cheapest edits must leave
roles of initials ``(s?(ua)+)?``; of equal cost, the audit that is least in ASCII wins.

In a block the program runs forward. Its state is the kind of the last role, and every
state holds the last node of its best edits: nodes link to the edits before them and
share them (:class:`Trails`), with ancestors at powers of two and a rolling hash. A tie is
decided at the end of the longest common prefix, found by descending both ancestor
tables while hashes differ; that the prefixes are equal is verified link by link.

Edits that end with a turn's own edit cannot be prefixes of each other, so the order of
two ways into different states of a block is kept by all that follows: the fold needs
their ranks only.

Null ids, roles and texts count as one space, null turns come first; turns of one number
are ordered by role and text. A role without a character cannot be kept. Rows marked as
dropped only make their conversation known; one without other rows has zeros, an empty
audit and the hash of nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize
from .common import slices

#: Turns of a block: what a task solves at once.
BLOCK = 1024

_START, _SYSTEM, _USER, _ASSISTANT = STATES = range(4)
_KEPT = (
    {"s": _SYSTEM, "u": _USER},
    {"u": _USER},
    {"a": _ASSISTANT},
    {"u": _USER},
)
_MADE = (_USER, _USER, _ASSISTANT, _USER)  # the only role that may be inserted or given
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
_CLOSING = ("", "II", "I", "")  # what makes each state a legal end
_INSERT, _DELETE, _REROLE, _TRUNCATED = 5, 2, 1, 5
_SPACE = " \t\n\v\f\r"
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Trails:
    """Edit strings as nodes that share their prefixes."""

    def __init__(self):
        self.mark, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... edits back

    def add(self, node: int, mark: str) -> int:
        """The edits of ``node`` and one more."""
        new, up, at = len(self.mark), [node], 0
        while at < len(self.up[up[at]]):
            up.append(self.up[up[at]][at])
            at += 1
        self.mark.append(mark)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(mark)) % _PRIME)
        self.up.append(up)
        return new

    def at_depth(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def _same(self, a: int, b: int) -> bool:
        """Whether nodes of one depth are the same edits, link by link up to a shared node."""
        while a != b:
            if self.mark[a] != self.mark[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the edits of ``a`` are before those of ``b``; a prefix is before."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.at_depth(a, depth), self.at_depth(b, depth)
        if self.hash[x] == self.hash[y] and self._same(x, y):
            return self.depth[a] < self.depth[b]
        for j in range(len(self.up[x]) - 1, -1, -1):
            if j < len(self.up[x]):
                p, q = self.up[x][j], self.up[y][j]
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
        if self.mark[x] == self.mark[y] or not self._same(self.up[x][0], self.up[y][0]):
            return self.marks(a) < self.marks(b)  # a hash of two different prefixes
        return self.mark[x] < self.mark[y]

    def marks(self, node: int) -> str:
        out = []
        while node:
            out.append(self.mark[node])
            node = self.up[node][0]
        return "".join(reversed(out))


class Turn:
    """One turn as the program sees it: its role's initial and its first fault."""

    __slots__ = ("initial", "fault")

    def __init__(self, role: str, text: str, duplicate: bool):
        end = text.rstrip(_SPACE)[-1:]
        self.initial = role[:1]
        self.fault = (
            "blank" if not end
            else "duplicate" if duplicate
            else "truncated" if end not in ".!?"
            else None
        )


def solve(turns: Iterable[Turn], entry: int) -> tuple[Trails, list[tuple[int, int] | None]]:
    """Per state after ``turns``, entered in ``entry``: (cost, last node), None if unreachable."""
    trails = Trails()
    best: list[tuple[int, int] | None] = [None] * 4
    best[entry] = (0, 0)

    def offer(to: list, state: int, cost: int, node: int, mark: str) -> None:
        held = to[state]
        if held is not None and held[0] < cost:
            return
        new = trails.add(node, mark)
        if held is None or cost < held[0] or trails.less(new, held[1]):
            to[state] = (cost, new)

    for turn in turns:
        ready = best[:]
        for _ in range(2):  # two inserted turns lead everywhere
            for state, held in enumerate(ready[:]):
                if held is not None:
                    offer(ready, _MADE[state], held[0] + _INSERT, held[1], "I")
        best = [None] * 4
        stays = turn.fault not in ("blank", "duplicate")
        more = _TRUNCATED if turn.fault == "truncated" else 0
        for state, held in enumerate(ready):
            if held is None:
                continue
            cost, node = held
            offer(best, state, cost + _DELETE, node, "D")
            if stays:
                kept = _KEPT[state].get(turn.initial)
                if kept is not None:
                    offer(best, kept, cost + more, node, "K")
                offer(best, _MADE[state], cost + _REROLE + more, node, "R")
    return trails, best


def close(trails: Trails, best: list) -> tuple[int, str]:
    """Cost and edits of the best legal end."""
    chosen = None
    for state, held in enumerate(best):
        if held is None:
            continue
        cost, node = held[0] + _INSERT * len(_CLOSING[state]), held[1]
        for mark in _CLOSING[state]:
            node = trails.add(node, mark)
        if chosen is None or cost < chosen[0] or cost == chosen[0] and trails.less(node, chosen[1]):
            chosen = (cost, node)
    return chosen[0], trails.marks(chosen[1])


class Repaired:
    """Applies edits to turns as they come and hashes what is left."""

    def __init__(self):
        self.sha, self.state, self.any = hashlib.sha256(), _START, False

    def _write(self, role: str, text: str) -> None:
        if self.any:
            self.sha.update(b"\n")
        self.sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def _make(self, text: str) -> None:
        self.state = _MADE[self.state]
        self._write(_NAMES[self.state], text)

    def insert(self) -> None:
        self._make("")

    def apply(self, edit: str, role: str, text: str) -> None:
        if edit == "K":
            self.state = _KEPT[self.state][role[:1]]
            self._write(role, text)
        elif edit == "R":
            self._make(text)


_COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Census:
    """Faults, illegal neighbours and turn numbers of consecutive turns."""

    def __init__(self):
        self.n = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = None  # initials
        self.low = self.high = None
        self.numbers = 0

    def add(self, turn: Turn, number: int | None) -> None:
        if turn.fault:
            self.n[turn.fault] += 1
        self._join(turn.initial, turn.initial)
        if number is not None:
            self._number(number, number, 1)

    def _join(self, first: str, last: str) -> None:
        if self.last is None:
            self.first = first
        elif self.last + first not in ("su", "ua", "au"):
            self.n["illegal"] += 1
        self.last = last

    def _number(self, low: int, high: int, numbers: int) -> None:
        self.numbers += numbers - (low == self.high)
        self.low = low if self.low is None else self.low
        self.high = high

    def follow(self, row: dict) -> None:
        """Take in the census of the turns that come next."""
        for c in _COUNTS:
            self.n[c] += row[c]
        if row["first"] is not None:
            self._join(row["first"], row["last"])
        if row["low"] is not None:
            self._number(row["low"], row["high"], row["numbers"])

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.numbers


def finish(rows: list[tuple[int | None, str, str]]) -> dict:
    """All results of a conversation whose turns (number, role, text) are at hand."""
    census, seen, turns = Census(), set(), []
    for number, role, text in rows:
        turn = Turn(role, text, (role, text) in seen)
        seen.add((role, text))
        census.add(turn, number)
        turns.append(turn)
    cost, audit = close(*solve(turns, _START))
    repaired, left = Repaired(), iter(rows)
    for edit in audit:
        if edit == "I":
            repaired.insert()
        else:
            repaired.apply(edit, *next(left)[1:])
    return {
        "gaps": census.gaps, **census.n, "cost": cost, "audit": audit,
        "repaired_sha256": repaired.sha.hexdigest(),
    }


# --- the jobs --------------------------------------------------------------------

_RESULTS = {
    **dict.fromkeys(["gaps", *_COUNTS, "cost"], pa.int64()),
    "audit": pa.string(),
    "repaired_sha256": pa.string(),
}
_ROWS = {
    "part": pa.int64(), "at": pa.int64(), "turn": pa.int64(), "role": pa.string(),
    "text": pa.string(), "dropped": pa.bool_(), "digest": pa.binary(), "fresh": pa.bool_(),
}
_SEGMENT = {
    "part": pa.int64(), "block": pa.int64(), **dict.fromkeys(_COUNTS, pa.int64()),
    "first": pa.string(), "last": pa.string(), "low": pa.int64(), "high": pa.int64(),
    "numbers": pa.int64(), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int32()),
    "audits": pa.list_(pa.string()),
}
_DDL = {
    pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary",
    pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>",
    pa.list_(pa.string()): "array<string>",
}
_FLUSH = 2_000  # result rows of a batch
_FLUSH_BYTES = 8 << 20


class _Out:
    """Rows for Spark, in batches of bounded size."""

    def __init__(self, conv_kind, fields: dict):
        self.schema = pa.schema([("conv_id", conv_kind), *fields.items()])
        self.rows, self.held = [], 0

    def add(self, conv, row: dict, size: int = 0) -> None:
        self.rows.append({"conv_id": conv, **row})
        self.held += size

    def full(self) -> bool:
        return len(self.rows) >= _FLUSH or self.held > _FLUSH_BYTES

    def take(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.held = [], 0
        return made


def _ddl(kind: str, fields: dict) -> str:
    return ", ".join([f"conv_id {kind}", *(f"{n} {_DDL[t]}" for n, t in fields.items())])


def _rows_of(batches: Iterator[pa.RecordBatch], text: str, names: list[str]) -> Iterator[tuple]:
    for part in slices(batches, text):
        yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def _digest(role: str, text: str) -> bytes:
    made = hashlib.blake2b(f"{len(role)}:{role}".encode("utf-8", "surrogatepass"), digest_size=16)
    made.update(text.encode("utf-8", "surrogatepass"))
    return made.digest()


def _first_pass(turns: DataFrame) -> DataFrame:
    """Finished conversations, and the turns of those that are not, by (part, at)."""
    kind = turns.schema["conv_id"].dataType
    fields = {**_RESULTS, **_ROWS}
    order = [
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role",
        F.substring("text", 1, 64), F.xxhash64("text"), "_row",
    ]
    # The number of the input row tells copies apart, so that they too can be split.
    dealt = turns.withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, at = _Out(to_arrow_type(kind), fields), TaskContext.get().partitionId(), 0
        names = ["conv_id", "turn", "role", "text", "dropped"]
        held: list[tuple] = []
        seen: set[bytes] = set()
        first, conv, size = True, None, 0

        def leave() -> None:
            """Hand on the turns at hand, marking those not seen before in this part."""
            nonlocal at, size
            for turn, role, text, dropped in held:
                digest = _digest(role, text)
                row = {"part": part, "at": at, "turn": turn, "role": role, "text": text}
                fresh = not dropped and digest not in seen
                if fresh:
                    seen.add(digest)
                row |= {"dropped": dropped, "digest": digest, "fresh": fresh}
                out.add(conv, row, len(text))
                at += 1
            held.clear()
            size = 0

        for new, *row in _rows_of(batches, "text", names):
            if (held or seen) and new != conv:
                if first or seen:
                    leave()
                else:
                    out.add(conv, finish([r[:3] for r in held if not r[3]]))
                    held.clear()
                    size = 0
                first = False
                seen = set()
            conv = new
            held.append(tuple(row))
            size += len(row[2])
            if len(held) > BLOCK or size > _FLUSH_BYTES:
                leave()
                seen.add(b"")  # from now on handed on, whatever was seen
            if out.full():
                yield out.take()
        leave()
        yield out.take()

    columns = turns.columns
    return materialize(
        dealt.select(*columns).mapInArrow(walk, _ddl(kind.simpleString(), fields)), "repair_turns"
    )


def _segments(rows: DataFrame) -> DataFrame:
    """Every block solved for every state it may be entered in."""
    kind = rows.schema["conv_id"].dataType
    dealt = rows.repartition("conv_id", "part", "block").sortWithinPartitions(
        "conv_id", "part", "block", "at"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(to_arrow_type(kind), _SEGMENT)
        names = ["conv_id", "part", "block", "turn", "role", "text", "dropped", "duplicate"]
        for (conv, part, block), held in groupby(
            _rows_of(batches, "text", names), itemgetter(0, 1, 2)
        ):
            census, turns = Census(), []
            for *_, number, role, text, dropped, duplicate in held:
                if not dropped:
                    turn = Turn(role, text, duplicate)
                    census.add(turn, number)
                    turns.append(turn)
            costs, ranks, audits = [], [], []
            for entry in STATES:
                trails, best = solve(turns, entry)
                marks = [None if b is None else trails.marks(b[1]) for b in best]
                order = sorted(m for m in marks if m is not None)
                costs += [None if b is None else b[0] for b in best]
                ranks += [None if m is None else order.index(m) for m in marks]
                audits += marks
            row = {"part": part, "block": block, **census.n, "numbers": census.numbers}
            row |= {n: getattr(census, n) for n in ("first", "last", "low", "high")}
            row |= {"costs": costs, "ranks": ranks, "audits": audits}
            out.add(conv, row, 16 * len(turns))
            if out.full():
                yield out.take()
        yield out.take()

    return materialize(
        dealt.mapInArrow(work, _ddl(kind.simpleString(), _SEGMENT)), "repair_segments"
    )


_CHOICE = {
    "part": pa.int64(), "block": pa.int64(), "entry": pa.int64(), "exit": pa.int64(),
    "closing": pa.string(), **{n: t for n, t in _RESULTS.items() if t == pa.int64()},
}


def _choices(segments: DataFrame) -> DataFrame:
    """The states in which the best way enters and leaves each block; totals on the last."""
    kind = segments.schema["conv_id"].dataType
    names = [n for n in _SEGMENT if n != "audits"]
    dealt = (
        segments.select("conv_id", *names)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "block")
    )

    def fold(rows: Iterable[dict]) -> Iterator[dict]:
        census, steps, places = Census(), [], []
        costs: list[int | None] = [0, None, None, None]
        rank = [0, 0, 0, 0]
        for row in rows:
            census.follow(row)
            places.append((row["part"], row["block"]))
            new, step = [None] * 4, [0] * 4
            key: list[tuple] = [()] * 4
            for state in STATES:
                if costs[state] is None:
                    continue
                for to in STATES:
                    cost = row["costs"][4 * state + to]
                    if cost is None:
                        continue
                    whole, order = costs[state] + cost, (rank[state], row["ranks"][4 * state + to])
                    if new[to] is None or (whole, order) < (new[to], key[to]):
                        new[to], key[to], step[to] = whole, order, state
            sorted_keys = sorted(key[s] for s in STATES if new[s] is not None)
            rank = [sorted_keys.index(key[s]) if new[s] is not None else 0 for s in STATES]
            costs = new
            steps.append(step)
        cost, _, state = min(
            (costs[s] + _INSERT * len(_CLOSING[s]), rank[s], s) for s in STATES if costs[s] is not None
        )
        totals = {"closing": _CLOSING[state], "gaps": census.gaps, **census.n, "cost": cost}
        for (part, block), step in zip(reversed(places), reversed(steps), strict=True):
            yield {"part": part, "block": block, "entry": step[state], "exit": state, **totals}
            state, totals = step[state], {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(to_arrow_type(kind), _CHOICE)
        rows = (
            (conv, dict(zip(names, values, strict=True)))
            for conv, *values in _rows_of(batches, "first", ["conv_id", *names])
        )
        for conv, held in groupby(rows, itemgetter(0)):
            for row in fold(r for _, r in held):
                out.add(conv, row)
                if out.full():
                    yield out.take()
        yield out.take()

    return materialize(dealt.mapInArrow(work, _ddl(kind.simpleString(), _CHOICE)), "repair_choices")


def _stitched(rows: DataFrame, segments: DataFrame, choices: DataFrame) -> DataFrame:
    """Results of the conversations in blocks: edits joined, repaired text hashed in order.

    A hash has one order, so this last stream of a conversation is one task's; it holds
    a turn at a time besides the edits, which are a result.
    """
    kind = rows.schema["conv_id"].dataType
    chosen = F.get("audits", (4 * F.col("entry") + F.col("exit")).cast("int"))
    same = segments["conv_id"].eqNullSafe(choices["conv_id"])
    for c in ("part", "block"):
        same = same & (segments[c] == choices[c])
    totals = list(_CHOICE)[4:]
    edits = choices.join(segments.select("conv_id", "part", "block", "audits"), same).select(
        choices["conv_id"], choices["part"], choices["block"], F.lit(-1).cast("long").alias("at"),
        F.lit("").alias("role"), F.lit("").alias("text"), chosen.alias("edits"), *totals,
    )
    turns = rows.where(~F.col("dropped")).select("conv_id", "part", "block", "at", "role", "text")
    dealt = (
        edits.unionByName(turns, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "block", "at")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(to_arrow_type(kind), _RESULTS)
        numbers = [n for n in totals if n != "closing"]
        names = ["conv_id", "at", "role", "text", "edits", "closing", *numbers]
        for conv, held in groupby(_rows_of(batches, "text", names), itemgetter(0)):
            repaired, audit, left, found, closing = Repaired(), [], iter(""), {}, ""
            for _, at, role, text, marks, end, *counts in held:
                if at < 0:
                    audit.append(marks)
                    left = iter(marks)
                    if end is not None:
                        closing, found = end, dict(zip(numbers, counts, strict=True))
                    continue
                for edit in left:  # the turn's own edit follows those inserted before it
                    if edit != "I":
                        repaired.apply(edit, role, text)
                        break
                    repaired.insert()
            for _ in closing:
                repaired.insert()
            audit.append(closing)
            whole = {"audit": "".join(audit), "repaired_sha256": repaired.sha.hexdigest()}
            out.add(conv, found | whole, len(whole["audit"]))
            if out.full():
                yield out.take()
        yield out.take()

    return dealt.mapInArrow(work, _ddl(kind.simpleString(), _RESULTS))


def _duplicates(rows: DataFrame) -> DataFrame:
    """``rows`` with ``duplicate``: role and text came before in the conversation.

    Only the first of each part can be the first of all, so a group of copies brings at
    most one row a part to the aggregation and the join.
    """
    fresh = rows.where("fresh")
    first = fresh.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "at")).alias("found"))
    first = first.select(F.col("conv_id").alias("_c"), F.col("digest").alias("_d"), "found")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d"))
    judged = fresh.join(first, same).withColumn("duplicate", F.col("found") != F.struct("part", "at"))
    columns = [*rows.columns, "duplicate"]
    others = rows.where("NOT fresh").withColumn("duplicate", F.lit(True))
    return judged.select(*columns).unionByName(others.select(*columns))


def repair(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    dropped: Column | None = None,
) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    One row per conversation, those of which all rows are ``dropped`` included.
    """
    shown = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        F.coalesce(F.lit(False) if dropped is None else dropped, F.lit(False)).alias("dropped"),
    )
    walked = _first_pass(shown)
    done = walked.where("part IS NULL").select("conv_id", *_RESULTS)
    rows = walked.where("part IS NOT NULL").select("conv_id", *_ROWS)
    rows = rows.withColumn("block", F.floor(F.col("at") / BLOCK))
    rows = materialize(_duplicates(rows).drop("fresh", "digest"), "repair_blocks")
    segments = _segments(rows)
    found = _stitched(rows, segments, _choices(segments))
    return done.unionByName(found).withColumnRenamed("conv_id", conv)


def damage(conversations: DataFrame) -> DataFrame:
    """Turns as a damaged copy has them: some dropped, emptied, cut, repeated, reroled.

    By crc32 of ``conv_id:turn`` modulo 20. Rows to drop are kept and marked ``dropped``.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    how = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1])) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(how == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(how == 1, F.lit(""))
        .when(how == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        (how == 0).alias("dropped"),
        F.when(how == 3, F.array_repeat(F.lit(0), 2)).otherwise(F.array(F.lit(0))).alias("_copies"),
    ).select("conv_id", "turn", "role", "text", "dropped", F.explode("_copies")).drop("col")
