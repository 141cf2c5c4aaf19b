"""Cheapest edits of many symbol sequences by a shared Re-Pair grammar and min-plus matrices.

A symbol is a turn: its role and whether it must go or ends too early. The target
``(s?(ua)+)?`` is an automaton of four states; a symbol's matrix gives the least cost, and the
edits, from every state to every other. Re-Pair replaces frequent neighbours by rules, a rule's
matrix is the min-plus product of its two halves, computed once and used by all sequences.

The edits of an entry are a rope: a rule keeps the state in its middle only, the text is spelled
out for the answer alone. Equal costs are decided without spelling: edits of the same turns from the
same state never begin with one another (inserts stand before a turn, never at the end), so the left
half decides, and each matrix keeps the order of the entries of a row.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
SYMBOLS = "dsuaxSUAX"  # must go; roles s, u, a, other; the same cut short
NEVER = 1 << 60
PIECE = 1 << 15

_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
FILLED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the next role, by rerole or insert


@dataclass
class Matrix:
    """Costs, middle states (or texts, of a symbol) and order within each row, as lists by 4 * from + to."""

    cost: list[int]
    middle: list
    rank: list[int]


def _ranks(keys: list) -> list[int]:
    """The place of every entry of a row of four among those that are not None."""
    out = [0] * len(keys)
    for row in range(0, len(keys), 4):
        for place, i in enumerate(sorted((i for i in range(row, row + 4) if keys[i] is not None), key=keys.__getitem__)):
            out[i] = place
    return out


def symbol_matrix(symbol: str) -> Matrix:
    best: list = [None] * 16
    late = TRUNCATED if symbol.isupper() else 0
    for begin, inserts in product(range(4), range(3)):
        state = begin
        for _ in range(inserts):
            state = FILLED[state]
        steps = [(DELETE, "D", state)]
        if symbol != "d":
            steps.append((REROLE + late, "R", FILLED[state]))
            if (symbol.lower(), state) in _KEPT:
                steps.append((KEEP + late, "K", _KEPT[symbol.lower(), state]))
        for cost, letter, end in steps:
            entry = (INSERT * inserts + cost, "I" * inserts + letter)
            if best[4 * begin + end] is None or entry < best[4 * begin + end]:
                best[4 * begin + end] = entry
    texts = [b and b[1] for b in best]
    return Matrix([NEVER if b is None else b[0] for b in best], texts, _ranks(texts))


def times(a: Matrix, b: Matrix) -> Matrix:
    cost, middle, order = [NEVER] * 16, [0] * 16, [None] * 16
    for i, j in product(range(4), range(4)):
        at = 4 * i + j
        chosen = min(((a.cost[4 * i + k] + b.cost[4 * k + j], a.rank[4 * i + k], k) for k in range(4)), key=lambda x: x[:2] if x[0] < NEVER else (NEVER, 0))
        if chosen[0] < NEVER:
            cost[at], middle[at] = chosen[0], chosen[2]
            order[at] = (chosen[1], b.rank[4 * chosen[2] + j])
    return Matrix(cost, middle, _ranks(order))


TERMINALS = [symbol_matrix(s) for s in SYMBOLS]


def re_pair(pieces: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules (left, right), numbered from the symbols on, and the pieces rewritten by them until no pair occurs twice.

    A round replaces several frequent pairs that share no symbol.
    """
    flat = np.concatenate([np.r_[p, -1] for p in pieces]) if pieces else np.zeros(0, np.int64)
    rules: list[tuple[int, int]] = []
    while True:
        left, right = flat[:-1], flat[1:]
        code = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)
        pairs, counts = np.unique(code[code >= 0], return_counts=True)
        often = np.flatnonzero(counts >= max(2, counts.max(initial=0) // 2))
        used: set[int] = set()
        before = len(rules)
        for i in often[np.argsort(-counts[often], kind="stable")][:64]:
            a, b = int(pairs[i]) >> 32, int(pairs[i]) & 0xFFFFFFFF
            if a in used or b in used:
                continue
            at = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b))
            if a == b:  # every second one of a run
                run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
                inside = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
                at = at[inside % 2 == 0]
            if len(at) < 2:
                continue
            used |= {a, b}
            flat[at] = len(SYMBOLS) + len(rules)
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            flat = flat[keep]
            rules.append((a, b))
        if len(rules) == before:
            break
    borders = np.flatnonzero(flat == -1)
    return rules, [flat[a:b] for a, b in zip(np.r_[0, borders[:-1] + 1], borders)]


class Solver:
    """Answers one batch of pieces with one grammar."""

    def __init__(self, pieces: list[np.ndarray]):
        self.rules, self.pieces = re_pair(pieces)
        self.matrices = list(TERMINALS)
        for a, b in self.rules:
            self.matrices.append(times(self.matrices[a], self.matrices[b]))

    def spell(self, symbol: int, begin: int, end: int) -> str:
        out, open_ = [], [(symbol, begin, end)]
        while open_:
            s, i, j = open_.pop()
            middle = self.matrices[s].middle[4 * i + j]
            if s < len(SYMBOLS):
                out.append(middle)
            else:
                a, b = self.rules[s - len(SYMBOLS)]
                open_ += [(b, middle, j), (a, i, middle)]
        return "".join(out)

    def advance(self, piece: np.ndarray, cost: list[int], rank: list[int]) -> tuple[list[int], list[int], list[tuple[int, str] | None]]:
        """Costs and order of the four states after the piece; for each, the state it came from and the edits."""
        back = []
        for s in piece.tolist():
            m = self.matrices[s]
            new, order, came = [NEVER] * 4, [None] * 4, [0] * 4
            for j in range(4):
                total, _, k = min((cost[k] + m.cost[4 * k + j], rank[k], k) for k in range(4))
                if total < NEVER:
                    new[j], came[j], order[j] = total, k, (rank[k], m.rank[4 * k + j])
            cost, rank = new, _ranks(order)
            back.append(came)
        texts: list[tuple[int, str] | None] = []
        for j in range(4):
            parts, state = [], j
            for s, came in zip(reversed(piece.tolist()), reversed(back)) if cost[j] < NEVER else ():
                parts.append(self.spell(s, came[state], state))
                state = came[state]
            texts.append((state, "".join(reversed(parts))) if cost[j] < NEVER else None)
        return cost, rank, texts


def solve(sequences: list[str]) -> list[tuple[int, str]]:
    """(cost, edits) of every sequence of symbols; long ones go through in pieces of ``PIECE``, each batch with a grammar of its own."""
    number = {s: i for i, s in enumerate(SYMBOLS)}
    states = [([0, NEVER, NEVER, NEVER], [0] * 4, []) for _ in sequences]
    held: list[tuple[int, np.ndarray]] = []

    def flush():
        solver = Solver([p for _, p in held])
        for (owner, _), piece in zip(held, solver.pieces):
            cost, rank, past = states[owner]
            cost, rank, texts = solver.advance(piece, cost, rank)
            states[owner] = (cost, rank, [*past, texts])
        held.clear()

    size = 0
    for owner, sequence in enumerate(sequences):
        for a in range(0, len(sequence), PIECE):
            held.append((owner, np.array([number[c] for c in sequence[a : a + PIECE]], np.int64)))
            size += len(held[-1][1])
            if size >= PIECE:
                flush()
                size = 0
    if held:
        flush()
    closing = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    out = []
    for cost, rank, past in states:
        ends = [(cost[s] + INSERT * len(tail), rank[s], s) for s, tail in closing.items() if cost[s] < NEVER]
        total, _, state = min(ends)
        parts = [closing[state]]
        for texts in reversed(past):
            state, text = texts[state]
            parts.append(text)
        out.append((total, "".join(reversed(parts))))
    return out
