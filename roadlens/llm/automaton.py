"""Rule regexes compiled into one deterministic automaton over bytes, which finds all rules' matches in one pass.

A rule's matches are leftmost, longest and without overlap, each rule for itself.  Subset construction keeps, for
every rule, the sets of positions in its regex by age: an older set began further left and wins.  A state is
the tuple of all rules' sets; a transition also tells which rules' matches ended just before its byte.  States that
no byte tells apart are merged.  Where a match began is found by the rule's reversed automaton, from the match's
end back to at most the end of the rule's match before, so that all such steps together are linear in the text.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

Sets = tuple[frozenset[int], ...]


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (ASCII regex without anchors or back references) whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


class _Positions:
    """A regex as positions: each takes the bytes of a class and is followed by other positions."""

    def __init__(self, pattern: str):
        self.classes: list[frozenset[int]] = []
        self.follow: list[set[int]] = []
        empty, self.first, self.last = self._of(list(parser.parse(pattern, re.ASCII)), 0)
        if empty:
            raise ValueError(f"{pattern} matches the empty text")

    def _leaf(self, members: set[int], flags: int) -> tuple[bool, set[int], set[int]]:
        if flags & re.IGNORECASE:
            members = members | {ord(c) for m in members if m < 128 and chr(m).isalpha() for c in chr(m).swapcase()}
        if max(members, default=0) > 255:
            raise ValueError("only bytes can be matched")
        self.classes.append(frozenset(members))
        self.follow.append(set())
        return False, {len(self.classes) - 1}, {len(self.classes) - 1}

    def _then(self, a: tuple, b: tuple) -> tuple[bool, set[int], set[int]]:
        for p in a[2]:
            self.follow[p] |= b[1]
        return a[0] and b[0], a[1] | b[1] if a[0] else a[1], a[2] | b[2] if b[0] else b[2]

    def _of(self, nodes: list, flags: int) -> tuple[bool, set[int], set[int]]:
        whole: tuple[bool, set[int], set[int]] = (True, set(), set())
        for kind, value in nodes:
            if kind is op.LITERAL:
                part = self._leaf({value}, flags)
            elif kind is op.IN:
                members: set[int] = set()
                for what, v in value:
                    if what not in (op.LITERAL, op.RANGE):
                        raise ValueError(f"class member {what} is not supported")
                    members |= {v} if what is op.LITERAL else set(range(v[0], v[1] + 1))
                part = self._leaf(members, flags)
            elif kind is op.BRANCH:
                parts = [self._of(list(branch), flags) for branch in value[1]]
                part = any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
            elif kind is op.SUBPATTERN:
                part = self._of(list(value[3]), (flags | value[1]) & ~value[2])
            elif kind is op.MAX_REPEAT:
                least, most, body = value
                part = (True, set(), set())
                for k in range(least if most is op.MAXREPEAT else most):
                    one = self._of(list(body), flags)
                    part = self._then(part, one if k < least else (True, *one[1:]))
                if most is op.MAXREPEAT:
                    one = self._of(list(body), flags)
                    for p in one[2]:
                        self.follow[p] |= one[1]
                    part = self._then(part, (True, *one[1:]))
            else:
                raise ValueError(f"{kind} is not supported")
            whole = self._then(whole, part)
        return whole


def _byte_classes(sets: list[frozenset[int]]) -> np.ndarray:
    """The class of each byte: bytes that the same sets hold share one."""
    member = np.array([[b in s for s in sets] for b in range(256)])
    return np.unique(member, axis=0, return_inverse=True)[1].reshape(256)


class _Walker:
    """One rule's sets of positions, by age, and how a byte moves them."""

    def __init__(self, pattern: str):
        self.pattern, p = pattern, _Positions(pattern)
        self.classes, self.follow, self.first, self.last = p.classes, p.follow, frozenset(p.first), frozenset(p.last)
        self.known: dict[tuple[Sets, int], tuple[Sets, bool]] = {}

    def _move(self, now: frozenset[int] | None, byte: int) -> frozenset[int]:
        reached = self.first if now is None else {q for p in now for q in self.follow[p]}
        return frozenset(q for q in reached if byte in self.classes[q])

    def matched(self, state: Sets) -> bool:
        return bool(state) and bool(state[0] & self.last)

    def step(self, state: Sets, byte: int) -> tuple[Sets, bool]:
        """The sets after a byte, and whether a match ended before it."""
        if (state, byte) not in self.known:
            self.known[state, byte] = self._step(state, byte)
        return self.known[state, byte]

    def _step(self, state: Sets, byte: int) -> tuple[Sets, bool]:
        ended = False
        if self.matched(state):
            further = self._move(state[0], byte)
            if further:
                if not further & self.last:
                    raise ValueError(f"a match of {self.pattern} may go on without a longer one")
                return (further,), False
            state, ended = (), True
        seen: set[int] = set()
        after = []
        for sets in (*state, None):
            moved = self._move(sets, byte) - seen
            seen |= moved
            if moved:
                after.append(moved)
        if any(s & self.last for s in after[1:]):
            raise ValueError(f"a match of {self.pattern} may begin within an unfinished one")
        return tuple(after[:1] if after and after[0] & self.last else after), ended


class _Backwards:
    """A rule's regex read from its end: the furthest start of a match that ends at a given place."""

    def __init__(self, pattern: str, classes: np.ndarray):
        p = _Positions(pattern)
        before: list[set[int]] = [set() for _ in p.follow]
        for k, after in enumerate(p.follow):
            for q in after:
                before[q].add(k)
        samples = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]
        numbers: dict[frozenset[int], int] = {frozenset(p.last): 0}
        self.rows: list[list[int]] = []
        self.starts: list[list[bool]] = []
        queue = [frozenset(p.last)]
        while queue:
            expected = queue.pop(0)
            row, starts = [], []
            for byte in samples:
                taken = {q for q in expected if byte in p.classes[q]}
                further = frozenset(k for q in taken for k in before[q])
                if taken and further not in numbers:
                    numbers[further] = len(numbers)
                    queue.append(further)
                row.append(numbers[further] if taken else -1)
                starts.append(bool(taken & p.first))
            self.rows.append(row)
            self.starts.append(starts)

    def start(self, codes: bytes, end: int, least: int) -> int:
        state, found = 0, -1
        for k in range(end - 1, least - 1, -1):
            c = codes[k]
            if self.starts[state][c]:
                found = k
            state = self.rows[state][c]
            if state < 0:
                break
        return found


def _minimal(table: np.ndarray, ended: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of each state, and a state of each block: states in a block agree on all ended matches and next blocks."""
    block = np.unique(np.column_stack([ended, final]), axis=0, return_inverse=True)[1].reshape(-1)
    while True:
        _, one, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.reshape(-1)
        if len(one) == block.max() + 1:
            return finer, one
        block = finer


class Automaton:
    """All rules in one: ``table`` is states by byte classes, ``ended`` the rules that end, ``final`` those at the text's end."""

    def __init__(self, rules: list[Rule], most_states: int = 50_000):
        self.rules = rules
        walkers = [_Walker(r.pattern) for r in rules]
        self.classes = _byte_classes([c for w in walkers for c in w.classes])
        samples = [int(np.flatnonzero(self.classes == c)[0]) for c in range(self.classes.max() + 1)]
        start: tuple[Sets, ...] = tuple(() for _ in rules)
        numbers, states, table, ended = {start: 0}, [start], [], []
        while len(table) < len(states):
            row, ends = [], []
            for byte in samples:
                moved = [w.step(s, byte) for w, s in zip(walkers, states[len(table)], strict=True)]
                after = tuple(m[0] for m in moved)
                if after not in numbers:
                    numbers[after] = len(states)
                    states.append(after)
                    if len(states) > most_states:
                        raise ValueError(f"the rules need more than {most_states} states")
                row.append(numbers[after])
                ends.append(sum(1 << k for k, m in enumerate(moved) if m[1]))
            table.append(row)
            ended.append(ends)
        final = np.array([sum(1 << k for k, (w, s) in enumerate(zip(walkers, state, strict=True)) if w.matched(s)) for state in states])
        full, ends = np.array(table), np.array(ended)
        block, one = _minimal(full, ends, final)
        self.all_states, self.start = len(states), int(block[0])
        self.table, self.ended, self.final = block[full[one]], ends[one], final[one]


class Scanner:
    """An automaton laid out for a scan; built where it runs."""

    def __init__(self, automaton: Automaton):
        self.rules = automaton.rules
        self.n = automaton.table.shape[1]
        self.translation = bytes(automaton.classes.astype(np.uint8).tolist())
        # Entries are places of rows in the flat table; from ``quiet`` on, places with a match ended before the byte.
        self.quiet = automaton.table.size
        loud = np.where(automaton.ended > 0, self.quiet, 0)
        self.next = (automaton.table * self.n + loud).ravel().tolist()
        self.ended, self.final, self.first = automaton.ended.ravel().tolist(), automaton.final.tolist(), automaton.start * self.n
        self.back = [_Backwards(r.pattern, automaton.classes) for r in self.rules]
        self.exact = [re.compile(r.pattern, re.ASCII) for r in self.rules]

    def _ends(self, codes: bytes) -> tuple[array, array]:
        """Ends of matches, and the sets of rules that end there."""
        places, masks = array("q"), array("q")
        now, moves, quiet, ended = self.first, self.next, self.quiet, self.ended
        for k, c in enumerate(codes):
            at = now + c
            now = moves[at]
            if now >= quiet:
                now -= quiet
                places.append(k)
                masks.append(ended[at])
        if self.final[now // self.n]:
            places.append(len(codes))
            masks.append(self.final[now // self.n])
        return places, masks

    def matches(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by end."""
        codes = data.translate(self.translation)
        before = [0] * len(self.rules)
        for end, mask in zip(*self._ends(codes), strict=True):
            for k, rule in enumerate(self.rules):
                if mask >> k & 1:
                    start = self.back[k].start(codes, end, before[k])
                    before[k] = end
                    found = self.exact[k].fullmatch(data[start:end].decode("ascii"))
                    if found.end(rule.group) - found.start(rule.group) >= rule.least:
                        yield k, start, end
