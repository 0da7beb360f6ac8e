"""Repair of conversations whose turns have been damaged, by generalised LR parsing with edits.

The roles of a conversation should read ``(s?(ua)+)?``, with s, u, a for system, user, assistant. An LR automaton of
that grammar is run over the rows with every edit at once: a row is kept, gets another role or is
deleted, and rows are put in between. The stacks that are alive share what lies below their tops, and
stacks with equal tops are merged into the one with the least (cost, audit); what can follow depends on the top
alone, and of two audits with the same cost neither continues the other, so nothing better is lost.

A conversation may be longer than a task can hold: sorted rows are cut into blocks, each block is parsed from
every top that can stand at its beginning, and the blocks' results (cost and audit from top to top) are
folded in order. Only that fold, and the hash of the repaired text, follow a conversation from end to end, as a
stream of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skylattice.llm.common import written

#: Rows and bytes of text of one block.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
#: What edits cost, in the letters of the audit, and what a row without its end adds.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
#: Conv -> nothing | Pairs | s Pairs ; Pairs -> Pair | Pairs Pair ; Pair -> u a.
#: Shifts by (state, initial); a state reached by ``a`` reduces at once, and the state below u names the next top.
SHIFT = {(0, "s"): 1, (0, "u"): 3, (1, "u"): 3, (2, "u"): 3, (4, "u"): 3, (3, "a"): 5}
GOTO = {0: 2, 1: 4, 2: 2, 4: 4}
ACCEPTS = (0, 2, 4)
#: States with the same future, as the top that stands for them between blocks, and the stack below that top.
CLASS = {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"


class Stack(NamedTuple):
    """A top of the graph of stacks; ``below`` is shared with other stacks."""

    cost: int
    audit: str
    state: int
    below: Any


def _push(stack: Stack, initial: str, edit: str, extra: int = 0) -> Stack | None:
    """The stack after an edit that shows ``initial`` to the automaton, or None where that does not fit."""
    to = SHIFT.get((stack.state, initial))
    if to is None:
        return None
    cost, audit = stack.cost + COSTS[edit] + extra, stack.audit + edit
    if to == 5:  # a pair is complete: u and a go, and what lies below them says where to go on
        base = stack.below
        return Stack(cost, audit, GOTO[base.state], base if base.state in (0, 1) else base.below)
    return Stack(cost, audit, to, stack)


def _merge(tops: dict[int, Stack], new: Stack | None) -> bool:
    if new is None:
        return False
    old = tops.get(new.state)
    if old is None or (new.cost, new.audit) < (old.cost, old.audit):
        tops[new.state] = new
        return True
    return False


def _with_inserts(tops: dict[int, Stack]) -> dict[int, Stack]:
    """The stacks and all that inserted turns make of them."""
    tops, todo = dict(tops), list(tops)
    while todo:
        stack = tops[todo.pop()]
        for initial in ROLES:
            new = _push(stack, initial, "I")
            if _merge(tops, new):
                todo.append(new.state)
    return tops


def parse(initials: str, faults: str, entry: int = 0) -> dict[int, tuple[int, str]]:
    """Class of the top after the rows -> (cost, audit) of the cheapest edits, from class ``entry`` on.

    ``faults`` has b, d, t or a dot for each row: blank, duplicate, truncated, none. Inserts after the last
    row are left to what follows.
    """
    start = Stack(0, "", 0, None)
    tops = {entry: start if entry == 0 else Stack(0, "", entry, start)}
    for initial, fault in zip(initials, faults, strict=True):
        after: dict[int, Stack] = {}
        extra = TRUNCATED if fault == "t" else 0
        for stack in _with_inserts(tops).values():
            _merge(after, Stack(stack.cost + COSTS["D"], stack.audit + "D", stack.state, stack.below))
            if fault not in "bd":
                _merge(after, _push(stack, initial, "K", extra))
                for role in ROLES:
                    _merge(after, _push(stack, role, "R", extra))
        tops = after
    out: dict[int, tuple[int, str]] = {}
    for state, stack in tops.items():
        kind = CLASS[state]
        out[kind] = min(out.get(kind, (stack.cost, stack.audit)), (stack.cost, stack.audit))
    return out


def _tail(entry: int) -> tuple[int, str]:
    """Inserts that bring a conversation with this top to an end."""
    start = Stack(0, "", 0, None)
    tops = _with_inserts({entry: start if entry == 0 else Stack(0, "", entry, start)})
    return min((s.cost, s.audit) for state, s in tops.items() if state in ACCEPTS)


TAILS = {entry: _tail(entry) for entry in set(CLASS.values())}


def damaged(talks: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that CRC-32 of ``conv_id:turn`` deals out; nulls count as one blank."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = talks.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(one("role")).alias("role"), text.alias("text"), copies.alias("_copy"))
    return rows.drop("_copy")


def _lone_fault(text: str) -> str:
    """b, t or a dot: what is wrong with a text for itself."""
    solid = text.rstrip(SPACE)
    return "b" if not solid else "." if solid[-1] in ".!?" else "t"


class _Block:
    """Rows of one conversation that stand side by side."""

    def __init__(self, conv_id, number: int):
        self.conv_id, self.number = conv_id, number
        self.roles, self.texts, self.turns, self.faults, self.keys, self.seen, self.size = [], [], [], [], [], set(), 0

    def add(self, turn, role: str, text: str) -> None:
        fault, key = _lone_fault(text), None
        if fault != "b":
            key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            if key in self.seen:
                fault, key = "d", None
            else:
                self.seen.add(key)
        for column, value in ((self.roles, role), (self.texts, text), (self.turns, turn), (self.faults, fault), (self.keys, key)):
            column.append(value)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.roles) >= BLOCK_ROWS or self.size >= BLOCK_BYTES

    def row(self, whole: bool) -> tuple:
        turns = [t for t in self.turns if t is not None]
        keys = self.keys if not whole else []
        return (self.conv_id, self.number, whole, "".join(r[0] if r else " " for r in self.roles), "".join(self.faults), turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), keys, self.roles, self.texts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sorted rows into blocks. One is whole if its neighbours in the part belong to other conversations."""
    number = TaskContext.get().partitionId() << 33
    block: _Block | None = None
    cut, first, out, size, schema = False, True, [], 0, None
    for batch in batches:
        schema = batch.schema
        for conv_id, turn, role, text in _rows(iter([batch])):
            if block is not None and (block.conv_id != conv_id or block.full()):
                goes_on = block.conv_id == conv_id
                out.append(block.row(not (first or cut or goes_on)))
                size += block.size
                cut, first, number, block = goes_on, False, number + 1, None
                if size >= BLOCK_BYTES:
                    yield _batch(out, schema)
                    out, size = [], 0
            if block is None:
                block = _Block(conv_id, number)
            block.add(turn, role, text)
    if block is not None:
        out.append(block.row(False))
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    conv, turn = schema.field("conv_id").type, schema.field("turn").type
    kinds = [conv, pa.int64(), pa.bool_(), pa.string(), pa.string(), turn, turn, pa.int64(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_BLOCK)


_BLOCK = ["conv_id", "block", "whole", "initials", "faults", "first_turn", "last_turn", "n_turns", "keys", "roles", "texts"]


def _repeated(blocks: DataFrame) -> DataFrame:
    """block -> places of rows that an earlier block of the conversation has with the same role and text."""
    keys = blocks.where("NOT whole").select("conv_id", "block", F.posexplode("keys").alias("place", "key")).where("key IS NOT NULL")
    first = keys.groupBy("conv_id", "key").agg(F.min("block").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_c"), "key", "first")
    again = keys.join(first.hint("merge"), (keys["key"] == first["key"]) & F.col("conv_id").eqNullSafe(F.col("_c"))).where("block > first")
    return again.groupBy("block").agg(F.collect_list("place").alias("places"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their repeated rows marked, and what parsing makes of them: from where, to where, at which cost, how."""
    for batch in batches:
        *same, initials, faults, whole, places = batch.columns
        marked, moves = [], []
        for initial, fault, alone, again in zip(initials.to_pylist(), faults.to_pylist(), whole.to_pylist(), places.to_pylist(), strict=True):
            for p in again or ():
                fault = fault[:p] + "d" + fault[p + 1 :]
            marked.append(fault)
            moves.append([(entry, leave, cost, audit) for entry in ((0,) if alone else TAILS) for leave, (cost, audit) in parse(initial, fault, entry).items()])
        columns = [pa.array([[m[i] for m in row] for row in moves], pa.list_(k)) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*same, initials, pa.array(marked, pa.string()), *columns], names=[*batch.schema.names[:-4], "initials", "faults", "entries", "leaves", "costs", "audits"])


class _Fold:
    """The blocks of one conversation, taken in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.tops: dict[int, tuple[int, int, Any]] = {0: (0, 0, None)}  # class -> cost, rank of its audit among the classes, blocks before
        self.counts = {"b": 0, "d": 0, "t": 0}
        self.illegal = self.distinct = 0
        self.initial, self.low, self.high = "", None, None

    def add(self, block: int, initials: str, faults: str, first, last, distinct: int, moves: list[tuple]) -> None:
        for f in self.counts:
            self.counts[f] += faults.count(f)
        line = self.initial + initials
        self.illegal += sum(line[i : i + 2] not in ("su", "ua", "au") for i in range(len(line) - 1))
        self.initial = initials[-1]
        if first is not None:
            self.distinct += distinct - (self.high == first)
            self.low, self.high = first if self.low is None else self.low, last
        best: dict[int, tuple] = {}
        for entry, leave, more, audit in moves:
            if entry in self.tops:
                cost, rank, before = self.tops[entry]
                new = (cost + more, rank, audit, entry, before)
                if leave not in best or new[:3] < best[leave][:3]:
                    best[leave] = new
        order = sorted(best, key=lambda k: best[k][1:3])
        self.tops = {k: (best[k][0], order.index(k), (best[k][4], block, best[k][3], best[k][2])) for k in best}

    def rows(self) -> Iterator[tuple]:
        """The chosen edits of each block, then the conversation's row, whose block is -1."""
        cost, _, tail, links = min((c + TAILS[k][0], r, TAILS[k][1], b) for k, (c, r, b) in self.tops.items())
        chosen = []
        while links is not None:
            links, block, entry, audit = links
            chosen.append((block, entry, audit + (tail if not chosen else "")))
        gaps = self.high - self.low + 1 - self.distinct if self.low is not None else 0
        yield (self.conv_id, -1, 0, "".join(a for _, _, a in reversed(chosen)), [gaps, *self.counts.values(), self.illegal, cost])
        for block, entry, audit in chosen:
            yield (self.conv_id, block, entry, audit, None)


def _lines(entry: int, audit: str, roles: list[str], texts: list[str]) -> Iterator[str]:
    """The repaired rows of a block."""
    state, i = entry, 0
    for edit in audit:
        wanted = "a" if state == 3 else "u"
        if edit == "K":
            wanted = roles[i][0]
            yield f"{roles[i]}:{texts[i]}"
        elif edit == "R":
            yield f"{ROLES[wanted]}:{texts[i]}"
        elif edit == "I":
            yield f"{ROLES[wanted]}:"
        if edit != "D":
            state = {"s": 1, "u": 3, "a": 2}[wanted]
        i += edit != "I"


#: The counts of the result, in the order in which the fold gives them.
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_conversations(talks: DataFrame) -> DataFrame:
    """One row per conv_id of ``talks``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``talks`` (conv_id, turn, role, text) is damaged first (:func:`damaged`) and then repaired at the least cost; of
    edits with the same cost those with the least audit count. Null roles and texts count as one blank; a
    null turn stands first and has no part in ``gaps``; a null conv_id is a conversation of its own. Rows of the
    same turn stand in order of role, then text; rows that repeat another one's role and text are
    duplicates. A role that begins with none of s, u and a is never kept. A conversation that has no rows
    after the damage has zeros, an empty audit and the hash of an empty text. An empty table gives an empty
    result; other columns are ignored.
    """
    talks = talks.select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in talks.schema}
    conv, turn, key_type = kinds["conv_id"], kinds["turn"], to_arrow_type(talks.schema["conv_id"].dataType)
    key = ["conv_id", "turn", "role"]
    rows = damaged(talks).repartitionByRange(*key, F.substring("text", 1, 64)).sortWithinPartitions(*key, "text")
    shape = f"conv_id {conv}, block bigint, whole boolean, initials string, faults string, first_turn {turn}, last_turn {turn}, n_turns bigint, keys array<binary>, roles array<string>, texts array<string>"
    blocks = written(rows.mapInArrow(_blocks, shape), "talk-blocks")
    marks = written(_repeated(blocks), "talk-repeated")

    head = ["conv_id", "block", "first_turn", "last_turn", "n_turns"]
    narrow = blocks.select(*head, "initials", "faults", "whole")
    torn = narrow.where("NOT whole").join(marks.hint("merge"), "block", "left").select(*narrow.columns, "places")
    parts = narrow.where("whole").withColumn("places", F.lit(None).cast("array<int>")).unionByName(torn)
    parts = parts.mapInArrow(_parsed, f"conv_id {conv}, block bigint, first_turn {turn}, last_turn {turn}, n_turns bigint, initials string, faults string, entries array<bigint>, leaves array<bigint>, costs array<bigint>, audits array<string>")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken() -> Iterator[tuple]:
            state: _Fold | None = None
            for conv_id, block, first, last, distinct, initials, faults, *moves in _rows(batches):
                if state is None or state.conv_id != conv_id:
                    yield from state.rows() if state else ()
                    state = _Fold(conv_id)
                state.add(block, initials, faults, first, last, distinct, list(zip(*moves, strict=True)))
            yield from state.rows() if state else ()

        yield from _grouped(taken(), [key_type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())], ["conv_id", "block", "entry", "audit", "counts"], lambda r: len(r[3]) + 64)

    dealt = lambda df, *order: df.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    edits = dealt(parts, "block").mapInArrow(fold, f"conv_id {conv}, block bigint, entry bigint, audit string, counts array<bigint>")

    none = {"entry": "bigint", "audit": "string", "counts": "array<bigint>", "roles": "array<string>", "texts": "array<string>"}
    empty = lambda df, *has: df.select(*has, *[F.lit(None).cast(k).alias(c) for c, k in none.items() if c not in has])
    known = empty(talks.select("conv_id").distinct().withColumn("block", F.lit(-2).cast("bigint")).withColumn("kind", F.lit(0)), "conv_id", "block", "kind")
    chosen = empty(edits.withColumn("kind", F.lit(1)), "conv_id", "block", "kind", "entry", "audit", "counts")
    whole = empty(blocks.withColumn("kind", F.lit(2)), "conv_id", "block", "kind", "roles", "texts")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken() -> Iterator[tuple]:
            now, hashed, counts, audit, begun, edit = None, None, None, "", False, None
            done = lambda: (now, *counts, audit, hashed.hexdigest())
            for conv_id, block, kind, entry, piece, numbers, roles, texts in _rows(batches):
                if block == -2:
                    if hashed:
                        yield done()
                    now, hashed, counts, audit, begun = conv_id, hashlib.sha256(), [0] * len(COUNTS), "", False
                elif block == -1:
                    counts, audit = numbers, piece
                elif kind == 1:
                    edit = (entry, piece)
                else:
                    for line in _lines(*edit, roles, texts):
                        hashed.update((f"\n{line}" if begun else line).encode())
                        begun = True
            if hashed:
                yield done()

        yield from _grouped(taken(), [key_type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()], ["conv_id", *COUNTS, "audit", "repaired_sha256"], lambda r: len(r[-2]) + 128)

    schema = ", ".join([f"conv_id {conv}", *[f"{c} bigint" for c in COUNTS], "audit string", "repaired_sha256 string"])
    out = dealt(known.unionByName(chosen).unionByName(whole), "block", "kind").select("conv_id", "block", "kind", "entry", "audit", "counts", "roles", "texts")
    return out.mapInArrow(finish, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _grouped(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], size, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes from rows."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
