"""Secret scans with one deterministic automaton for all rules.

The regular expressions of the rules are read backwards into one nondeterministic automaton that may begin a
match at every byte; subset construction and minimisation turn it into transition arrays. One pass over the
bytes of a text, from its end to its start, then tells for every rule where matches start. A second,
anchored automaton, run forwards from a start alone, gives the end of the longest match there. Matches of a
rule are taken from left to right and don't overlap; those too short are dropped and use up their bytes.

Many pieces of text are scanned in step: texts may be cut before a byte that brings every state back to
the first one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import sliced, text_bytes


class Rule(NamedTuple):
    """A kind of secret: a pattern over ASCII, and the least length of one of its groups."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base rules. Counts stand in a pattern only where matches are maximal runs, so that a match that
#: is too short hides no other one.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: What the operator adds: published formats of keys and tokens that say what they are.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", 24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("login", r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%!$&*+=-]+@[A-Za-z0-9]", 12),
)


class _Nfa:
    """States with moves on sets of bytes and empty moves; built from its last state back to its first."""

    def __init__(self, reverse: bool):
        self.reverse, self.moves, self.empty = reverse, [], []

    def state(self, bytes_=None, target: int | None = None, empty=()) -> int:
        self.moves.append((bytes_, target))
        self.empty.append(list(empty))
        return len(self.moves) - 1

    def sequence(self, items, after: int, nocase: bool) -> int:
        for op, value in items if self.reverse else reversed(list(items)):
            after = self.item(op, value, after, nocase)
        return after

    def item(self, op, value, after: int, nocase: bool) -> int:
        if op is sre.BRANCH:
            return self.state(empty=[self.sequence(b, after, nocase) for b in value[1]])
        if op is sre.SUBPATTERN:
            _, add, remove, body = value
            return self.sequence(body, after, (nocase or bool(add & re.I)) and not remove & re.I)
        if op is sre.MAX_REPEAT:
            least, most, body = value
            if most is sre.MAXREPEAT:
                loop = self.state()
                self.empty[loop] = [self.sequence(body, loop, nocase), after]
            else:
                loop = after
                for _ in range(most - least):
                    loop = self.state(empty=[self.sequence(body, loop, nocase), after])
            for _ in range(least):
                loop = self.sequence(body, loop, nocase)
            return loop
        return self.state(_bytes_of(op, value, nocase), after)


def _bytes_of(op, value, nocase: bool) -> np.ndarray:
    """The bytes that a single item of a pattern takes."""
    out = np.zeros(256, dtype=bool)
    if op is sre.LITERAL and value < 128:
        out[value] = True
    elif op is sre.RANGE and value[1] < 256:
        out[value[0] : value[1] + 1] = True
    elif op is sre.IN:
        for o, v in value:
            if o is not sre.NEGATE:
                out |= _bytes_of(o, v, nocase)
        return ~out if value[0][0] is sre.NEGATE else out
    else:
        raise ValueError(f"a rule can't hold {op}")
    if nocase:
        lower, upper = slice(97, 123), slice(65, 91)
        out[lower], out[upper] = out[lower] | out[upper], out[lower] | out[upper]
    return out


class Automaton:
    """Transition arrays over classes of bytes; ``masks`` has a bit for each rule that ends in a state."""

    def __init__(self, rules: tuple[Rule, ...], reverse: bool):
        nfa = _Nfa(reverse)
        finals = [nfa.state() for _ in rules]
        begins = [nfa.sequence(_parser.parse(r.pattern), f, False) for r, f in zip(rules, finals, strict=True)]
        sets = np.array([m[0] for m in nfa.moves if m[0] is not None])
        _, self.classes = np.unique(sets, axis=1, return_inverse=True)
        self.classes = self.classes.reshape(256).astype(np.uint8)
        self.table, self.masks = self._subsets(nfa, begins, finals, anywhere=reverse)
        self._minimise()

    def _subsets(self, nfa: _Nfa, begins: list[int], finals: list[int], anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
        def closure(state: int) -> int:
            """Bits of the states that count, from ``state`` on by empty moves."""
            seen, todo = {state}, [state]
            while todo:
                new = [e for e in nfa.empty[todo.pop()] if e not in seen]
                seen.update(new)
                todo += new
            return sum(1 << s for s in seen if nfa.moves[s][0] is not None or s in final_of)

        final_of = {f: 1 << i for i, f in enumerate(finals)}
        count = int(self.classes.max()) + 1
        first = [int(np.flatnonzero(self.classes == c)[0]) for c in range(count)]
        moves = {s: (np.flatnonzero(m[0][first]).tolist(), closure(m[1])) for s, m in enumerate(nfa.moves) if m[0] is not None}
        start = 0
        for s in begins:
            start |= closure(s)
        numbers, order, table, masks = {start: 0}, [start], [], []
        for subset in order:
            row, mask = [start if anywhere else 0] * count, 0
            while subset:
                s = (subset & -subset).bit_length() - 1
                subset &= subset - 1
                mask |= final_of.get(s, 0)
                for c in moves[s][0] if s in moves else ():
                    row[c] |= moves[s][1]
            for to in row:
                if to not in numbers:
                    numbers[to] = len(order)
                    order.append(to)
            table.append([numbers[to] for to in row])
            masks.append(mask)
        return np.array(table, dtype=np.int64), np.array(masks, dtype=np.int64)

    def _minimise(self) -> None:
        """Merges states that no text tells apart; states where a rule ends get the highest numbers."""
        _, block = np.unique(self.masks, return_inverse=True)
        block = block.reshape(-1)
        while True:
            _, finer = np.unique(np.column_stack([block, block[self.table]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        one = np.zeros(block.max() + 1, dtype=np.int64)
        one[block] = np.arange(len(block))
        order = np.argsort(self.masks[one] != 0, kind="stable")
        rank = np.argsort(order)
        self.start = int(rank[block[0]])
        self.table = rank[block[self.table[one[order]]]].astype(np.int32)
        self.masks = self.masks[one[order]]
        self.limit = int(np.count_nonzero(self.masks == 0))

    def resets(self) -> np.ndarray:
        """The bytes that lead from every state to the first one."""
        return (self.table == self.start).all(axis=0)[self.classes]


class Scanner:
    """The two automata of a set of rules; small enough to travel with a task."""

    PIECE, FEW = 1024, 24

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.back, self.ahead = Automaton(rules, reverse=True), Automaton(rules, reverse=False)

    def prepare(self) -> None:
        """The arrays by byte, made once in each task: next state times 256, indexed by that plus the byte."""
        back, ahead = self.back, self.ahead
        self.steps = (back.table[:, back.classes] * 256).reshape(-1)
        self.slow = memoryview(self.steps)
        self.resets, self.limit = back.resets(), back.limit * 256
        self.forward = (ahead.table[:, ahead.classes] * 256).reshape(-1).tolist()
        none = np.flatnonzero((ahead.table == np.arange(len(ahead.table))[:, None]).all(axis=1) & (ahead.masks == 0))
        self.dead = int(none[0]) * 256 if len(none) else -1
        self.checks = [re.compile(r.pattern.encode()) for r in self.rules]

    def starts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a match of some rule starts, in order, and the rules' bits."""
        cuts = np.flatnonzero(self.resets[raw])
        wanted = np.searchsorted(cuts, np.arange(self.PIECE, len(raw), self.PIECE))
        cuts = np.unique(np.concatenate([offsets, cuts[wanted[wanted < len(cuts)]]]))
        low, high = cuts[:-1], cuts[1:]
        order = np.argsort(low - high, kind="stable")  # the longest first
        at, size = high[order] - 1, (high - low)[order]
        state = np.full(len(at), self.back.start * 256, dtype=np.int32)
        where, states, done = [], [], 0
        active = int(np.count_nonzero(size))
        while active > self.FEW:
            s = self.steps[state[:active] + raw[at[:active]]]
            state[:active] = s
            hit = np.flatnonzero(s >= self.limit)
            if len(hit):
                where.append(at[hit])
                states.append(s[hit])
            at[:active] -= 1
            done += 1
            while active and size[active - 1] <= done:
                active -= 1
        for i in range(active):  # what is left of the longest pieces
            s, p = int(state[i]), int(at[i])
            hits = []
            for b in raw[p - (int(size[i]) - done) + 1 : p + 1][::-1].tobytes():
                s = self.slow[s + b]
                if s >= self.limit:
                    hits.append((p, s))
                p -= 1
            if hits:
                where.append(np.array([h[0] for h in hits], dtype=np.int64))
                states.append(np.array([h[1] for h in hits], dtype=np.int32))
        if not where:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        where, states = np.concatenate(where), np.concatenate(states)
        order = np.argsort(where, kind="stable")
        return where[order], self.back.masks[states[order] >> 8]

    def end(self, raw: np.ndarray, start: int, stop: int, bit: int) -> int:
        """Where the longest match of a rule from ``start`` on ends; the text is taken in ever longer stretches."""
        s, last, at, reach = self.ahead.start * 256, start, start, 256
        while at < stop:
            for b in raw[at : min(stop, at + reach)].tobytes():
                s = self.forward[s + b]
                at += 1
                if s == self.dead:
                    return last
                if self.ahead.masks[s >> 8] & bit:
                    last = at
            reach *= 4
        return last

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Row -> (start byte, number of the rule, end byte) of its matches, in this order; positions count from the row's text."""
        where, masks = self.starts(raw, offsets)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for number, rule in enumerate(self.rules):
            places = where[(masks >> number) & 1 == 1]
            i = 0
            while i < len(places):
                start = int(places[i])
                row = int(np.searchsorted(offsets, start, side="right")) - 1
                end = self.end(raw, start, int(offsets[row + 1]), 1 << number)
                span = raw[start:end].tobytes()
                group = span if not rule.group else self.checks[number].fullmatch(span)[rule.group]
                if len(group) >= rule.least:
                    base = int(offsets[row])
                    found.setdefault(row, []).append((start - base, number, end - base))
                i = int(np.searchsorted(places, end))
        return {row: sorted(spans) for row, spans in found.items()}


def _code_points(raw: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with positions in code points instead of bytes."""
    ends = sorted({p for s, _, e in spans for p in (s, e)})
    points, last, total = {}, 0, 0
    for p in ends:
        total += int(np.count_nonzero((raw[last:p] & 0xC0) != 0x80))
        points[p], last = total, p
    return [(points[s], k, points[e]) for s, k, e in spans]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The counts and ``base_sha256`` (of kind:start:end of the base spans in order of start, then kind as listed)
    hold the base rules alone; ``spans`` holds those of the ``added`` rules too, which may overlap them.
    Positions are code points of the whole text, ends exclusive; a span is all that the pattern matches. A
    null or empty text has no spans. Rows that repeat an id, or have none, each get a row of their own; an
    empty table gives an empty result; other columns are ignored. No row is shuffled.
    """
    rules = BASE + tuple(added)
    scanner = Scanner(rules)
    base = len(BASE)

    def digest(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner.prepare()
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in sliced(batches):
            raw, offsets = text_bytes(batch.column(1))
            n = batch.num_rows
            counts, sha, shown = np.zeros((base, n), dtype=np.int64), [nothing] * n, [""] * n
            for row, spans in scanner.scan(raw, offsets).items():
                spans = _code_points(raw[offsets[row] : offsets[row + 1]], spans)
                own = [x for x in spans if x[1] < base]
                for _, k, _ in own:
                    counts[k, row] += 1
                sha[row], shown[row] = hashlib.sha256(digest(own).encode()).hexdigest(), digest(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts], pa.array(sha, pa.string()), pa.array(shown, pa.string())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *[f"n_{r.kind}" for r in BASE], "base_sha256", "spans"]
    schema = ", ".join([f"doc_id {kind}", *[f"n_{r.kind} bigint" for r in BASE], "base_sha256 string", "spans string"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, schema)
