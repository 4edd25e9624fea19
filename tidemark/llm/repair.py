"""Conversation structure repair: the cheapest edits that make role initials fit ``(s?(ua)+)?``, by A* on the edit lattice.

A node of the lattice is (rows consumed, state), the state being nothing, system, user or assistant as the last role put out.
Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit of a blank or repeated row), Insert a user or assistant row without
text 2; a truncated row that is not deleted costs 1 more.  The heuristic is the suffix sum of what no path avoids: 3 for each row that must
go, 1 for each truncated row.  It is consistent, so a node that is taken from the queue, keyed (cost + heuristic, audit), has its least cost
and, of such paths, the ASCII-least audit; the state and the edit settle the role, so an audit is one path.

Conversations of any length: rows are dealt by ranges of (conversation, turn), a task cuts its part of a conversation into blocks of
``BLOCK`` rows, and A* runs in each block from each state in which it can be entered to each in which it can be left.  The blocks of a conversation
are then folded, a few strings each, and the chosen way through each block is joined back to its rows.  Equal rows are counted
before anything is dealt, and copies after the first are deleted as one run.  No task gathers a conversation's texts.

Edge cases: null roles and texts are one space each; rows without turn come first; rows of one turn are ordered by role and text; rows without
conv_id are one conversation; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked, staged

#: Rows, and bytes of text, from which a block ends.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a kept initial leads to, and the role and state that a rerole or insert brings.
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
PUTS = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Inserts that a conversation still needs at its end.
TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_SPACE = r"[\x20\x09-\x0D]"

#: One step of a block: its initial, how many rows must be deleted together (0: one row, free to stay), whether it is truncated.
Step = tuple[str, int, bool]


def search(steps: list[Step], entry: int) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the best path from the first step in state ``entry`` to the end, by the state there.

    Inserts stand before a step, so what follows the last one is left to the next block or the end.
    """
    n, ahead = len(steps), [0] * (len(steps) + 1)
    for i in range(n - 1, -1, -1):
        _, gone, cut = steps[i]
        ahead[i] = ahead[i + 1] + (3 * gone if gone else int(cut))
    queue, done, out = [(ahead[0], "", 0, entry)], set(), {}
    while queue and len(out) < 4:
        estimate, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = estimate - ahead[i]
        if i == n:
            out[state] = cost, audit
            continue
        initial, gone, cut = steps[i]
        put = PUTS[state][1]
        heapq.heappush(queue, (cost + 2 + ahead[i], audit + "I", i, put))
        heapq.heappush(queue, (cost + 3 * max(1, gone) + ahead[i + 1], audit + "D" * max(1, gone), i + 1, state))
        if not gone:
            if (kept := KEEPS.get((state, initial))) is not None:
                heapq.heappush(queue, (cost + cut + ahead[i + 1], audit + "K", i + 1, kept))
            heapq.heappush(queue, (cost + 2 + cut + ahead[i + 1], audit + "R", i + 1, put))
    return out


def replay(rows: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that an audit leaves, from a state on."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = KEEPS[state, role[:1]]
        else:
            role, state = PUTS[state]
        yield edit, role, text


def faults(turns: DataFrame) -> DataFrame:
    """Distinct rows with their copies: conv_id, turn, role, text, copies, blank, repeated (seen at an earlier turn), truncated."""
    one = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = picked(turns, conv_id="long", turn="long", role="string", text="string").withColumns({"role": one("role"), "text": one("text")})
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    counted = counted.withColumn("same", F.md5(F.to_json(F.struct("conv_id", "role", "text"))))
    # Upper case, so that the join deals both sides anew: rows of a common text can be split then.
    first = counted.groupBy("same").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first")).where("n > 1").select(F.upper("same").alias("again"), F.col("first.turn").alias("first"))
    later = F.col("first").isNull() & F.col("turn").isNotNull() | (F.col("turn") > F.col("first"))
    rows = counted.join(first.withColumn("known", F.lit(True)), F.upper("same") == F.col("again"), "left")
    return rows.select("conv_id", "turn", "role", "text", "copies", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), F.coalesce(F.col("known") & later, F.lit(False)).alias("repeated"), (~F.col("text").rlike(rf"[.!?]{_SPACE}*\z")).alias("truncated"))


_BLOCKS = pa.schema([
    ("conv_id", pa.int64()), ("at", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("initials", pa.string()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())),
])
_SPARK_BLOCKS = "conv_id long, at long, blank long, duplicate long, truncated long, illegal long, initials string, turns long, low long, high long, costs array<long>, audits array<string>, roles array<string>, texts array<string>, copies array<long>"
_LEGAL = ("su", "ua", "au")


def _block(conv_id: int | None, at: int, opens: bool, rows: list[tuple]) -> dict:
    """Counts, boundary turns and roles, and the best ways through some rows of a conversation.  ``opens``: nothing stands before them."""
    blank = duplicate = truncated = illegal = 0
    steps: list[Step] = []
    before = None
    for _, role, _, copies, is_blank, repeated, cut in rows:
        initial = role[:1]
        illegal += copies - 1 + (before is not None and before + initial not in _LEGAL)
        before = initial
        if is_blank or repeated:
            blank, duplicate = blank + copies * is_blank, duplicate + copies * (not is_blank)
            steps.append((initial, copies, False))
            continue
        truncated, duplicate = truncated + cut, duplicate + copies - 1
        steps.append((initial, 0, cut))
        if copies > 1:
            steps.append((initial, copies - 1, False))
    costs, audits = [None] * 16, [None] * 16
    for entry in (START,) if opens else range(4):
        for out, (cost, audit) in search(steps, entry).items():
            costs[4 * entry + out], audits[4 * entry + out] = cost, audit
    turns = [r[0] for r in rows if r[0] is not None]  # ascending
    return {
        "conv_id": conv_id, "at": at, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "initials": f"{rows[0][1][:1] or '.'}{before or '.'}",
        "turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
        "costs": costs, "audits": audits, "roles": [r[1] for r in rows], "texts": [r[2] for r in rows], "copies": [r[3] for r in rows],
    }


def _cut(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted rows of a task; ``at`` ascends along a conversation, from task to task as well."""
    at, open_, inside, size = TaskContext.get().partitionId() << 32, None, False, 0
    rows: list[tuple] = []
    ready: list[dict] = []
    for batch in batches:
        for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and (conv_id != open_ or len(rows) >= block or size >= BLOCK_BYTES):
                ready.append(_block(open_, at, inside, rows))
                at, rows, size, inside = at + 1, [], 0, conv_id != open_  # what follows another conversation opens its own
            open_ = conv_id
            rows.append(tuple(row))
            size += len(row[2])
        if len(ready) >= 64:
            yield pa.RecordBatch.from_pylist(ready, schema=_BLOCKS)
            ready = []
    if rows:
        ready.append(_block(open_, at, inside, rows))
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=_BLOCKS)


_FOLDED = pa.schema([("at", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("tail", pa.int32()), ("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
_SPARK_FOLDED = "at long, entry int, exit int, tail int, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Fold:
    """The blocks of one conversation so far: the best audit of each state, and through which states it came."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.ats = conv_id, []
        self.sums, self.last, self.turns, self.low, self.high = [0, 0, 0, 0], None, 0, None, None
        self.done: list[str] = []  # what all audits have in common at their front
        self.ways: dict[int, tuple[int, str, bytes]] = {START: (0, "", b"")}

    def add(self, b: dict) -> None:
        self.ats.append(b["at"])
        self.sums = [x + b[k] for x, k in zip(self.sums, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
        first, last = b["initials"]
        self.sums[3] += self.last is not None and self.last + first not in _LEGAL
        self.last = last
        if b["low"] is not None:
            self.turns += b["turns"] - (b["low"] == self.high)
            self.low, self.high = b["low"] if self.low is None else self.low, b["high"]
        new: dict[int, tuple[int, str, bytes]] = {}
        for entry, (cost, audit, path) in self.ways.items():
            for out in range(4):
                if (more := b["costs"][4 * entry + out]) is not None:
                    way = cost + more, audit + b["audits"][4 * entry + out], path + bytes([out])
                    if out not in new or way < new[out]:
                        new[out] = way
        audits = [a for _, a, _ in new.values()]
        low, high = min(audits), max(audits)
        same = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
        self.done.append(low[:same])
        self.ways = {s: (c, a[same:], p) for s, (c, a, p) in new.items()}

    def rows(self) -> Iterator[dict]:
        """The way through each block; the last block has the conversation's results as well."""
        cost, audit, path, tail = min((c + 2 * TAIL[s], a + "I" * TAIL[s], p, TAIL[s]) for s, (c, a, p) in self.ways.items())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        entry = START
        for i, (at, out) in enumerate(zip(self.ats, path, strict=True)):
            row = {"at": at, "entry": entry, "exit": out, "tail": 0}
            if i == len(self.ats) - 1:
                row |= {"tail": tail, "conv_id": self.conv_id, "gaps": gaps, **dict(zip(("blank", "duplicate", "truncated", "illegal"), self.sums, strict=True)), "cost": cost, "audit": "".join(self.done) + audit}
            yield row
            entry = out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold, ready = None, []
    for batch in batches:
        for b in batch.to_pylist():
            if fold is None or fold.conv_id != b["conv_id"]:
                ready.extend(fold.rows() if fold else ())
                fold = _Fold(b["conv_id"])
            fold.add(b)
        if len(ready) >= 1000:
            yield pa.RecordBatch.from_pylist(ready, schema=_FOLDED)
            ready = []
    ready.extend(fold.rows() if fold else ())
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=_FOLDED)


_PIECES = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("edits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_SPARK_PIECES = "conv_id long, at long, edits array<string>, roles array<string>, texts array<string>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for b in batch.to_pylist():
            rows = ((r, t) for r, t, n in zip(b["roles"], b["texts"], b["copies"], strict=True) for _ in range(n))
            kept = list(replay(rows, b["audit"], b["entry"]))
            state = b["exit"]
            for _ in range(b["tail"]):
                role, state = PUTS[state]
                kept.append(("I", role, ""))
            out.append({"conv_id": b["conv_id"], "at": b["at"], "edits": [k[0] for k in kept], "roles": [k[1] for k in kept], "texts": [k[2] for k in kept]})
        yield pa.RecordBatch.from_pylist(out, schema=_PIECES)


class Repair:
    """The repair of a table of turns (conv_id, turn, role, text): ``conversations``, ``rows`` and ``digest``."""

    def __init__(self, turns: DataFrame, block: int = BLOCK):
        order = ["conv_id", "turn", "role"]
        rows = faults(turns).repartitionByRange(*order, F.substring("text", 1, 256)).sortWithinPartitions(*order, "text")
        self.blocks, _ = staged(rows.mapInArrow(partial(_cut, block), _SPARK_BLOCKS), "blocks")
        light = self.blocks.drop("roles", "texts", "copies").repartition("conv_id").sortWithinPartitions("conv_id", "at")
        self.folded, _ = staged(light.mapInArrow(_fold, _SPARK_FOLDED), "folded")

    def conversations(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation."""
        return self.folded.where("audit IS NOT NULL").drop("at", "entry", "exit", "tail")

    def _kept(self) -> DataFrame:
        way = self.folded.select("at", "entry", "exit", "tail")
        rows = self.blocks.join(way, "at").select("conv_id", "at", "roles", "texts", "copies", "entry", "exit", "tail", F.expr("audits[4 * entry + exit]").alias("audit"))
        return rows.mapInArrow(_pieces, _SPARK_PIECES)

    def rows(self) -> DataFrame:
        """The repaired rows: conv_id, at and place (their order), edit, role, text."""
        return self._kept().select("conv_id", "at", F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("place", "x")).select("conv_id", "at", "place", F.col("x.edits").alias("edit"), F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))

    def digest(self) -> DataFrame:
        """(conv_id, repaired_sha256): of ``role:text`` of the repaired rows, joined by newlines.

        A hash of one sequence: a task reads a conversation's blocks in turn, and holds one at a time.
        """
        lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
        texts = self._kept().where("size(roles) > 0").select("conv_id", "at", lines.alias("lines"))
        return texts.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, hashes, now, own = [], [], None, None
    for batch in batches:
        for conv_id, lines in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own is None or conv_id != now:
                if own is not None:
                    ids.append(now)
                    hashes.append(own.hexdigest())
                now, own = conv_id, hashlib.sha256(lines.encode())
            else:
                own.update(b"\n" + lines.encode())
    if own is not None:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([*ids, now], type=pa.int64()), "repaired_sha256": pa.array([*hashes, own.hexdigest()], type=pa.string())})


def damage(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by crc32 of ``conv_id:turn``; nulls are one space each in it, and in roles and texts."""
    rows = picked(turns, conv_id="long", turn="long", role="string", text="string")
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def digest(turns: DataFrame) -> DataFrame:
    """The repair of damaged turns: a row for each conversation that was there before the damage."""
    repair = Repair(damage(turns))
    ids = picked(turns, conv_id="long").distinct()
    found = repair.conversations().withColumnRenamed("conv_id", "c")
    texts = repair.digest().withColumnRenamed("conv_id", "d")
    rows = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
