"""Repair of conversation structure by lightest derivations.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles.  Rows
are kept (cost 0), given the role user or assistant (1) or deleted (2; blank
and duplicate rows must be), rows without text may be inserted (5), and a
truncated row that stays costs 5.  Each edit is a weighted deduction: item
(rows read, state of the pattern) and the next row give another item.  An
agenda pops items by (cost, audit), where the audit is the string of edit
initials so far; every deduction only adds to both, so the first time an item
is popped it is final, and the search ends with its goal.  Two audits of one
item spell the same number of rows, so none of equal cost is a prefix of
another, and what is least stays least when more is appended.  An audit also
fixes the state, hence the new roles.

How it is spread: rows without their texts are sorted by conversation and turn
over all tasks, so a conversation with very many rows lies in many of them.
First sights of a (role, text) are minima over row numbers, combined before
they are shuffled.  Blocks of ``BLOCK`` rows, whatever conversations they hold,
get their own agenda for each state in which a block may be entered, and a
conversation's blocks are then joined in order: for every state in which the
last block ends, the item of least (cost, audit).  Only that pass meets the
texts, as a stream in order of turns with one text at a time; a digest of a
conversation is sequential, and its audit is one value, so that pass is by
conversation.

Defined results: nulls in role or text count as one space; rows go by turn,
nulls first, and rows of one turn by a hash of role and text; identical rows
are duplicates but for one; the null id is one conversation; roles of other
initials are never kept, an empty role has no initial; an id all of whose rows
were dropped before (see ``damage``) is reported with zeros if ``ids`` names
it; an empty table gives an empty one; columns beside the four named ones are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release

#: A power of two, as row numbers count from multiples of 2 ** 33.
BLOCK = 1 << 11
RELABEL, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  The role due in each, and where it leads.
DUE = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
#: What a conversation that ends in a state lacks: inserts and their cost.
MISSING = {0: "", 1: "II", 2: "I", 3: ""}
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"
SOUND, TRUNCATED, BLANK = 0, 1, 2


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of ``df`` with the faults that crc32 of ``conv:turn`` deals out; nulls count as one space.

    Of the checksum modulo 20: 0 drops the row, 1 empties its text, 2 removes
    its final marks, 3 repeats it, 4 makes it a user's.
    """

    def shown(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    kind = (F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20).alias("kind")
    rows = df.select(F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias(turn), shown(role).alias("r"), shown(text).alias("t"), kind).filter("kind <> 0")
    told = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("t", ".!?", "")).otherwise(F.col("t"))
    said = F.when(F.col("kind") == 4, "user").otherwise(F.col("r"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(conv, turn, said.alias(role), told.alias(text), F.explode(copies)).drop("col")


def lightest(initials: list[str], faults: list[int], enter: int) -> dict[int, tuple[int, str]]:
    """For each state in which these rows can end, (cost, audit) of the lightest derivation from state ``enter``.

    ``faults``: SOUND, TRUNCATED or BLANK (which stands for all that must go).
    Inserts after the last row are left to what follows.
    """
    n = len(initials)
    agenda = [(0, "", 0, enter)]
    final: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n:
            ends[state] = (cost, audit)
            continue
        heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, state))
        due = AFTER[state]
        if faults[i] != BLANK:
            stays = cost + CUT_OFF * (faults[i] == TRUNCATED)
            if initials[i] == DUE[state][0]:
                heapq.heappush(agenda, (stays, audit + "K", i + 1, due))
            else:
                heapq.heappush(agenda, (stays + RELABEL, audit + "R", i + 1, due))
                if initials[i] == "s" and state == 0:
                    heapq.heappush(agenda, (stays, audit + "K", i + 1, 1))
        if (i, due) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, due))
    return ends


_ITEM = T.StructType([T.StructField("enter", T.IntegerType()), T.StructField("leave", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("audit", T.StringType())])
_COUNTS = ("n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_turns", "low", "high", "first_turn", "last_turn")
_SEGMENT = T.StructType([*[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("items", T.ArrayType(_ITEM))])


def _segment(initials: list[str], faults: list[int], turns: list[int | None], fresh: list[bool], enters: range) -> dict:
    """What a run of rows of one conversation adds to it; ``fresh``: no row before has this role and text."""
    told = [t for t in turns if t is not None]
    repeated = sum(not f for f, fault in zip(fresh, faults, strict=True) if fault != BLANK)
    must_go = [fault if f else BLANK for f, fault in zip(fresh, faults, strict=True)]
    items = []
    for enter in enters:
        found = lightest(initials, must_go, enter)
        for place, leave in enumerate(sorted(found, key=lambda q: found[q][1])):
            items.append({"enter": enter, "leave": leave, "cost": found[leave][0], "place": place, "audit": found[leave][1]})
    return {
        "n_blank": faults.count(BLANK), "n_duplicate": repeated, "n_truncated": must_go.count(TRUNCATED),
        "n_illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "n_turns": len(set(told)), "low": min(told, default=None), "high": max(told, default=None),
        "first_turn": turns[0], "last_turn": turns[-1], "first": initials[0], "last": initials[-1], "items": items,
    }


def _blocks(turns: DataFrame, conv: T.DataType) -> DataFrame:
    """(conv, block, segment): each block's share of every conversation in it."""
    firsts = turns.filter(F.col("fault") != BLANK).groupBy("conv", "h1", "h2").agg(F.min("row").alias("row")).select(F.shiftright("row", BLOCK.bit_length() - 1).alias("block"), "row")
    rows = turns.select(F.shiftright("row", BLOCK.bit_length() - 1).alias("block"), "row", "conv", "turn", "initial", "fault")
    schema = T.StructType([T.StructField("conv", conv), T.StructField("block", T.LongType()), T.StructField("segment", _SEGMENT)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("row")
        new = np.isin(left.column("row").to_numpy(), right.column("row").to_numpy()).tolist()
        ids, when, initials, faults = (left.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault"))
        made, start = [], 0
        for end in range(1, len(ids) + 1):
            if end == len(ids) or ids[end] != ids[start]:
                own = slice(start, end)
                # Only the first run of a block can go on from another block.
                segment = _segment(initials[own], faults[own], when[own], new[own], range(1 if start else len(DUE)))
                made.append({"conv": ids[start], "block": left.column("block")[0].as_py(), "segment": segment})
                start = end
        kinds = pa.schema([("conv", left.schema.field("conv").type), ("block", pa.int64()), ("segment", _SEGMENT_ARROW)])
        return pa.Table.from_pylist(made, schema=kinds)

    return rows.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(run, schema)


_ITEM_ARROW = pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()), ("audit", pa.string())])
_SEGMENT_ARROW = pa.struct([*[(c, pa.int64()) for c in _COUNTS], ("first", pa.string()), ("last", pa.string()), ("items", pa.list_(_ITEM_ARROW))])


class _Joined:
    """A conversation's blocks, joined one after another.

    For each state the best item so far: its cost, its rank by audit among the
    states, and its blocks' audits as a chain that paths share while they agree.
    """

    def __init__(self, conv):
        self.conv = conv
        self.heads = {0: (0, 0, None)}
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.last_turn = self.last = None
        self.edits: str | None = None

    def add(self, s: dict) -> None:
        for c in self.counts:
            self.counts[c] += s[f"n_{c}"]
        if self.last is not None:
            self.counts["illegal"] += self.last + s["first"] not in LEGAL
            self.counts["turns"] -= self.last_turn is not None and self.last_turn == s["first_turn"]
        if s["low"] is not None:
            self.low = s["low"] if self.low is None else self.low
            self.high = s["high"]
        self.last, self.last_turn = s["last"], s["last_turn"]
        best: dict[int, tuple] = {}
        for item in s["items"]:
            if item["enter"] in self.heads:
                cost, rank, chain = self.heads[item["enter"]]
                # Audits from different states differ before this block, so their ranks decide.
                made = (cost + item["cost"], rank, item["place"], (chain, item["audit"]))
                if item["leave"] not in best or made[:2] < best[item["leave"]][:2]:
                    best[item["leave"]] = made
        order = sorted(best, key=lambda q: best[q][1:3])
        self.heads = {q: (best[q][0], order.index(q), best[q][3]) for q in best}

    def finish(self) -> None:
        """The goal: an ending that the pattern allows, with inserts where it lacks rows."""
        state = min(self.heads, key=lambda q: (self.heads[q][0] + INSERT * len(MISSING[q]), self.heads[q][1]))
        self.cost, _, chain = self.heads[state]
        self.cost += INSERT * len(MISSING[state])
        parts = [MISSING[state]]
        while chain is not None:
            chain, audit = chain
            parts.append(audit)
        self.edits = "".join(reversed(parts))
        self.heads = {}
        self.at, self.state = 0, 0

    def rows(self, role: str | None = None, text: str | None = None) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of inserted rows up to the next row, and of that row unless it is deleted; all that are left without one."""
        while self.at < len(self.edits):
            edit = self.edits[self.at]
            if edit != "I" and role is None:
                break
            self.at += 1
            if edit == "D":
                return
            due, self.state = DUE[self.state], 1 if edit == "K" and self.state == 0 and role.startswith("s") else AFTER[self.state]
            yield edit, role if edit == "K" else due, "" if edit == "I" else text
            if edit != "I":
                return

    def report(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return {"conv": self.conv, "gaps": gaps, **{c: self.counts[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": self.cost, "audit": self.edits}


def _replayed(df: DataFrame, ids: DataFrame | None, conv: str, turn: str, role: str, text: str, run, out: T.StructType) -> DataFrame:
    """``run`` over (conversation, its rows) in order; every conversation begins with its joined blocks."""
    col = lambda c: F.col(f"`{c}`")
    filled = df.select(col(conv).alias("conv"), col(turn).cast("long").alias("turn"), F.coalesce(col(role), F.lit(" ")).alias("role"), F.coalesce(col(text), F.lit(" ")).alias("text"))
    rows = filled.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("2"), "role", "text")})
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(shown == "", BLANK).when(F.right(shown, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    order = ["conv", "turn", "h1", "h2"]
    # Identical rows may come in any order; the last key only spreads very many of them.
    slim = rows.select(*order, F.left("role", F.lit(1)).alias("initial"), fault.alias("fault")).orderBy(*order, F.rand(13))
    turns = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "turns")
    kind = rows.schema["conv"].dataType
    segments = materialize(_blocks(turns, kind), "segments")
    release(turns)

    def aligned(part: DataFrame, rank: int) -> DataFrame:
        fields = {"block": "bigint", "turn": "bigint", "h1": "bigint", "h2": "bigint", "role": "string", "text": "string", "segment": _SEGMENT.simpleString()}
        return part.select("conv", F.lit(rank).cast("byte").alias("rank"), *[F.col(c) if c in part.columns else F.lit(None).cast(k).alias(c) for c, k in fields.items()])

    named = rows.select("conv") if ids is None else ids.select(col(conv).alias("conv"))
    stream = aligned(named.distinct(), 0).union(aligned(segments, 1)).union(aligned(rows, 2)).repartition("conv").sortWithinPartitions("conv", "rank", "block", "turn", "h1", "h2")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return stream.mapInArrow(each, T.StructType([T.StructField("conv", kind), *out.fields]))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Joined, list | None]]:
    """(conversation, its next row or None at its end), row by row; the edits are known by then."""
    now: _Joined | None = None
    for batch in batches:
        ids, ranks, roles, texts = (batch.column(k).to_pylist() for k in (0, 1, 6, 7))
        for k, rank in enumerate(ranks):
            if rank == 0:
                if now is not None:
                    if now.edits is None:
                        now.finish()
                    yield now, None
                now = _Joined(ids[k])
            elif rank == 1:
                now.add(batch.column(8)[k].as_py())
            else:
                if now.edits is None:
                    now.finish()
                yield now, [roles[k], texts[k]]
    if now is not None:
        if now.edits is None:
            now.finish()
        yield now, None


_REPORT = [("gaps", T.LongType()), ("blank", T.LongType()), ("duplicate", T.LongType()), ("truncated", T.LongType()), ("illegal", T.LongType()), ("cost", T.LongType()), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]


def _in_batches(made: Iterator[dict], first: pa.Field, fields: list, size: int = 2000, letters: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and letters."""
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.IntegerType(): pa.int32()}
    schema = pa.schema([first, *[(name, kinds[kind]) for name, kind in fields]])
    waiting, held = [], 0
    for row in made:
        waiting.append(row)
        held += sum(len(v) for v in row.values() if isinstance(v, str))
        if len(waiting) >= size or held >= letters:
            yield pa.RecordBatch.from_pylist(waiting, schema=schema)
            waiting, held = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema=schema)


def _first_field(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Field | None, Iterator[pa.RecordBatch]]:
    head = next(batches, None)
    if head is None:
        return None, iter(())

    def again() -> Iterator[pa.RecordBatch]:
        yield head
        yield from batches

    return head.schema.field(0).with_name("conv"), again()


def report(df: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: faults, cost and audit of its repair, and the digest of ``role:text`` of the repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, batches = _first_field(batches)

        def made() -> Iterator[dict]:
            digest, some = hashlib.sha256(), False
            for now, row in _conversations(batches):
                for _, said, told in now.rows(*(row or ())):
                    digest.update(("\n" if some else "").encode() + f"{said}:{told}".encode())
                    some = True
                if row is None:
                    yield now.report() | {"repaired_sha256": digest.hexdigest()}
                    digest, some = hashlib.sha256(), False

        if field is not None:
            yield from _in_batches(made(), field, _REPORT)

    out = _replayed(df, ids, conv, turn, role, text, run, T.StructType([T.StructField(n, k) for n, k in _REPORT]))
    return out.withColumnRenamed("conv", conv)


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of all repaired conversations: conversation, place (from 0), role, text and the edit's initial."""
    fields = [("place", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("edit", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, batches = _first_field(batches)

        def made() -> Iterator[dict]:
            place = 0
            for now, row in _conversations(batches):
                for edit, said, told in now.rows(*(row or ())):
                    yield {"conv": now.conv, "place": place, "role": said, "text": told, "edit": edit}
                    place += 1
                if row is None:
                    place = 0

        if field is not None:
            yield from _in_batches(made(), field, fields)

    return _replayed(df, None, conv, turn, role, text, run, T.StructType([T.StructField(n, k) for n, k in fields])).withColumnRenamed("conv", conv)
