"""Secrets in texts, found by one minimised automaton for all rules in a single byte pass.

The rules' regular expressions become one nondeterministic automaton, subset
construction makes it deterministic, partition refinement minimises it, and what is left
is an array: next state by state and byte class. One of its entry states scans: it looks
for every rule at once from every position. For the exact limits of what the scan has found,
each rule has two more entry states: one reads backwards and accepts wherever a match of the
rule begins, the other matches from such a place. So no attempt fails, and the limits take
time in proportion to the text, whatever it holds.

Bytes that send every state back to the scan's first state (line ends, commas, all of
UTF-8 beyond ASCII ...) cannot lie inside a match. Texts are cut behind such bytes into
lanes of a few hundred bytes, and numpy advances all lanes of a chunk by one byte at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as syntax
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nametrail.llm.common import chunks, ship, text_bytes

#: Bytes of a lane, about; lanes end at bytes that no match can hold.
LANE_BYTES = 256
#: When fewer lanes are left, they are scanned one by one.
FEW_LANES = 8


@dataclass(frozen=True)
class Rule:
    """`pattern` is matched leftmost and longest, without overlaps. A match of which the part
    from the first accepted byte on has fewer than `least` bytes is dropped. `seek` is found
    wherever a match stays; short ones keep the automaton of all rules small."""

    kind: str
    pattern: str
    seek: str
    least: int = 1


_KEY = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]" \
       r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?"
BASE_RULES = (
    Rule("assign", _KEY + "[A-Za-z0-9+/_.=-]+", _KEY + "[A-Za-z0-9+/_.=-]", 8),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", 12),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{32,}", 32),
)
MORE_RULES = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36}", "gh[opsur]_"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "eyJ[A-Za-z0-9_-]"),
)


class _Nfa:
    def __init__(self) -> None:
        self.free: list[set[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append(set())
        self.moves.append([])
        return len(self.free) - 1

    def add(self, items, at: int, back: bool = False) -> int:
        """Adds what a parsed expression reads after state `at`, or reads backwards; the state
        it ends in."""
        for op, arg in reversed(items) if back else items:
            if op is syntax.LITERAL:
                at = self._step(at, frozenset([arg]))
            elif op is syntax.IN:
                at = self._step(at, _charset(arg))
            elif op is syntax.SUBPATTERN:
                at = self.add(arg[3], at, back)
            elif op is syntax.BRANCH:
                end = self.state()
                for option in arg[1]:
                    begin = self.state()
                    self.free[at].add(begin)
                    self.free[self.add(option, begin, back)].add(end)
                at = end
            elif op is syntax.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self.add(body, at, back)
                if high is syntax.MAXREPEAT:
                    begin = self.state()
                    self.free[at].add(begin)
                    self.free[self.add(body, begin, back)].add(begin)
                    at = begin
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.free[at].add(end)
                        at = self.add(body, at, back)
                    self.free[at].add(end)
                    at = end
            else:
                raise ValueError(f"a rule uses {op}, which is not supported")
        return at

    def _step(self, at: int, bytes_: frozenset[int]) -> int:
        to = self.state()
        self.moves[at].append((bytes_, to))
        return to

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


def _charset(items) -> frozenset[int]:
    chars: set[int] = set()
    for op, arg in items:
        if op is syntax.LITERAL:
            chars.add(arg)
        elif op is syntax.RANGE:
            chars.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"a rule's character class uses {op}, which is not supported")
    return frozenset(chars)


class Automaton:
    """Transition arrays of all rules. State 0 is dead; accepting scan states come last."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = tuple(rules)
        nfa, accepts, entries = _Nfa(), {}, []
        loop = nfa.state()
        nfa.moves[loop].append((frozenset(range(256)), loop))
        for i, rule in enumerate(rules):
            begin = nfa.state()
            nfa.free[loop].add(begin)
            accepts[nfa.add(parser.parse(rule.seek), begin)] = 1 << i
        for i, rule in enumerate(rules):
            begin = nfa.state()
            entries.append(nfa.closure([begin]))
            accepts[nfa.add(parser.parse(rule.pattern), begin)] = 1 << i
            entries[-1] = nfa.closure([begin])
        for i, rule in enumerate(rules):
            begin = nfa.state()
            nfa.moves[begin].append((frozenset(range(256)), begin))
            accepts[nfa.add(parser.parse(rule.pattern), begin, back=True)] = 1 << (len(rules) + i)
            entries.append(nfa.closure([begin]))
        self._determine(nfa, [nfa.closure([loop]), *entries], accepts)

    def _determine(self, nfa: _Nfa, entries: list[frozenset[int]], accepts: dict[int, int]) -> None:
        sets = list(dict.fromkeys(chars for moves in nfa.moves for chars, _ in moves))
        member = np.array([[b in chars for chars in sets] for b in range(256)])
        _, sample, self.classes = np.unique(member, axis=0, return_index=True, return_inverse=True)
        self.classes = self.classes.reshape(256).astype(np.intp)
        index: dict[frozenset[int], int] = {frozenset(): 0}
        for entry in entries:
            index.setdefault(entry, len(index))
        order, table = list(index), []
        for states in order:  # grows meanwhile
            row = []
            for byte in sample.tolist():
                to = nfa.closure({t for s in states for chars, t in nfa.moves[s] if byte in chars})
                if to not in index:
                    index[to] = len(order)
                    order.append(to)
                row.append(index[to])
            table.append(row)
        flags = np.zeros(len(order), np.int64)
        for i, states in enumerate(order):
            for s in states:
                flags[i] |= accepts.get(s, 0)
        self.states_before = len(order)
        self._minimise(np.array(table), flags, [index[e] for e in entries])

    def _minimise(self, table: np.ndarray, flags: np.ndarray, entries: list[int]) -> None:
        block = np.unique(flags, return_inverse=True)[1].reshape(-1)
        while True:
            finer = np.unique(np.column_stack([block, block[table]]), axis=0,
                              return_inverse=True)[1].reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        n = block.max() + 1
        one = np.zeros(n, np.int64)
        one[block] = np.arange(len(block))
        # The dead state first, then the others, the accepting ones last.
        order = np.argsort(np.where(np.arange(n) == block[0], -1, flags[one] != 0), kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.table = rank[block[table[one[order]]]]
        self.flags = flags[one[order]]
        self.first_accept = int(np.argmax(self.flags != 0))
        self.scan, *others = rank[block[entries]].tolist()
        self.starts, self.backs = others[: len(self.rules)], others[len(self.rules) :]
        width = self.table.shape[1]
        self.flat = (self.table * width).astype(np.int32).ravel()  # states times the width
        self.width = width
        live = np.arange(n) != 0
        home = np.isin(self.table[live], (0, self.scan, *self.backs)).all(axis=0)
        self.resets = home[self.classes]
        self.rows = [row[self.classes].tolist() for row in self.table]

    def lanes(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the lanes begin: at each text, and behind the first reset byte of each stretch."""
        ends = np.flatnonzero(self.resets[raw])
        stretch = ends // LANE_BYTES
        chosen = ends[np.flatnonzero(np.diff(stretch, prepend=-1))] + 1
        return np.unique(np.concatenate([at[:-1], chosen[chosen < len(raw)]]))

    def hits(self, raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Numbers of the lanes in which some rule is found."""
        if not len(begins):
            return np.zeros(0, np.int64)
        classes = self.classes[raw].astype(np.int32)
        sizes = np.diff(np.append(begins, len(raw)))
        order = np.argsort(-sizes, kind="stable")
        start, size = begins[order], sizes[order]
        active = np.searchsorted(-size, -np.arange(size[0]), "left")  # lanes longer than t
        state = np.full(len(order), self.scan * self.width, np.int32)
        found, least, t = np.zeros(len(order), bool), self.first_accept * self.width, 0
        while t < size[0] and active[t] > FEW_LANES:
            k = active[t]
            now = self.flat[state[:k] + classes[start[:k] + t]]
            state[:k] = now
            if now.max() >= least:
                found[:k] |= now >= least
            t += 1
        if t < size[0]:
            for lane in range(active[t]):
                s = int(state[lane]) // self.width
                for byte in raw[start[lane] + t : start[lane] + size[lane]].tolist():
                    s = self.rows[s][byte]
                    if s >= self.first_accept:
                        found[lane] = True
                        break
        return np.sort(order[found])

    def matches(self, lane: bytes) -> list[tuple[int, int, int]]:
        """(start, number of the rule, end) of the matches in a lane that stay."""
        out = []
        for number, rule in enumerate(self.rules):
            state, begins = self.backs[number], []
            for i in range(len(lane) - 1, -1, -1):
                state = self.rows[state][lane[i]]
                if state >= self.first_accept:
                    begins.append(i)
            free = 0
            for at in reversed(begins):
                if at < free:
                    continue
                state, head = self.starts[number], -1
                for i in range(at, len(lane)):
                    state = self.rows[state][lane[i]]
                    if not state:
                        break
                    if state >= self.first_accept:
                        head, free = (i if head < 0 else head), i + 1
                if free - head >= rule.least:
                    out.append((at, number, free))
        return out


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton(rules)


_SPANS = "array<struct<kind: string, `start`: bigint, `end`: bigint>>"


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES,
                 text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per document: doc_id and `spans`, an array of (kind, start, end) by start, then rule.

    Positions count code points, the end is exclusive. Whole texts are scanned, without a
    shuffle. A null or empty text has no spans; ids may be null or repeated; other columns
    are left out.
    """
    ship(docs.sparkSession)
    rules = tuple(rules)
    kinds = [rule.kind for rule in rules]
    made = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(rules)
        for part in chunks(batches):
            raw, at = text_bytes(part.column("text"))
            spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
            if len(raw):
                begins = machine.lanes(raw, at)
                begins = begins[begins < len(raw)]
                ends = np.append(begins[1:], len(raw))
                by_text: dict[int, list[tuple[int, int, int]]] = {}
                hit = machine.hits(raw, begins)
                owners = np.searchsorted(at, begins[hit], "right") - 1
                for lane, owner in zip(hit.tolist(), owners.tolist()):
                    base = int(begins[lane] - at[owner])
                    found = machine.matches(raw[begins[lane] : ends[lane]].tobytes())
                    by_text.setdefault(owner, []).extend(
                        (base + a, rule, base + b) for a, rule, b in found)
                for owner, found in by_text.items():
                    own = raw[at[owner] : at[owner + 1]]
                    points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    spans[owner] = [{"kind": kinds[rule], "start": int(points[a]), "end": int(points[b])}
                                    for a, rule, b in sorted(found)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(spans, made)], names=["doc_id", "spans"])

    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"),
                         docs[text].cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id bigint, spans {_SPANS}")


def reference_spans(text: str) -> list[tuple[int, str, int]]:
    """The base rules by Python's own engine, for tests: (start, kind, end) by start, then rule."""
    patterns = (
        ("assign", re.compile(
            "(?a:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
            "([A-Za-z0-9+/_.=-]+)"), 1, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32))
    found = [(m.start(), order, kind, m.end()) for order, (kind, pattern, group, least)
             in enumerate(patterns) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(a, kind, b) for a, _, kind, b in sorted(found)]
