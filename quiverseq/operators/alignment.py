"""Alignments of one query and one database sequence: end points, start points, edit scripts, statistics, text lines.

The edit script comes from linear-space divide and conquer (Myers and Miller 1988) over the box that the end points
span. Which of several equally good alignments is shown follows fixed rules: the split column of a gapless middle row
is the leftmost best one; a gap through the middle wins ties and takes the rightmost best column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .kernels import end_point, window_scores


@dataclass(frozen=True)
class Scoring:
    """scores is [database code, query code]; a gap of n costs open + n extend."""

    scores: np.ndarray
    gap_open: int
    gap_extend: int


def _reach(a: np.ndarray, b: np.ndarray, s: Scoring, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Best costs of aligning all of a with each prefix of b, free (H) and ending in an open gap in b (E).

    edge is the opening cost of a gap at the very start of a.
    """
    q, r, n = s.gap_open, s.gap_extend, len(b)
    steps = np.arange(1, n + 1, dtype=np.int64) * r
    h = np.concatenate([[0], -q - steps])
    e = h - q
    for i, code in enumerate(a, 1):
        e = np.maximum(e, h - q) - r
        top = -edge - i * r
        t = np.concatenate([[top], np.maximum(h[:-1] + s.scores[b, code], e[1:])])
        run = np.maximum.accumulate(t + np.concatenate([[0], steps]))
        h = t
        h[1:] = np.maximum(t[1:], run[:-1] - q - steps)
    e[0] = h[0]
    return h, e


def edit_script(a: np.ndarray, b: np.ndarray, s: Scoring) -> list[tuple[str, int]]:
    """Global alignment of query part a and database part b: (M pairs, D query residue alone, I database residue alone)."""
    q, r = s.gap_open, s.gap_extend
    ops: list[tuple[str, int]] = []

    def put(op: str, n: int) -> None:
        if n and ops and ops[-1][0] == op:
            ops[-1] = op, ops[-1][1] + n
        elif n:
            ops.append((op, n))

    def single(a: np.ndarray, b: np.ndarray, left: int, right: int) -> None:
        """One query residue: paired with the first best database residue if that beats standing alone."""
        n = len(b)
        alone = -min(left, right) - q - (1 + n) * r
        costs = s.scores[b, a[0]] - r * (n - 1) - q * ((np.arange(n) > 0).astype(np.int64) + (np.arange(n) < n - 1))
        at = int(costs.argmax())
        if costs[at] > alone:
            put("I", at), put("M", 1), put("I", n - 1 - at)
        elif left <= right:
            put("D", 1), put("I", n)
        else:
            put("I", n), put("D", 1)

    todo: list[tuple] = [(a, b, q, q)]
    while todo:
        job = todo.pop()
        if len(job) == 2:
            put(*job)
            continue
        a, b, left, right = job
        if not len(b) or not len(a):
            put("D", len(a)), put("I", len(b))
        elif len(a) == 1:
            single(a, b, left, right)
        else:
            middle = len(a) // 2
            h, e = _reach(a[:middle], b, s, left)
            x, y = _reach(a[middle:][::-1], b[::-1], s, right)
            clean, gapped = h + x[::-1], e + y[::-1] + q
            if gapped.max() >= clean.max():
                at = len(gapped) - 1 - int(gapped[::-1].argmax())
                todo += [(a[middle + 1 :], b[at:], 0, right), ("D", 2), (a[: middle - 1], b[:at], left, 0)]
            else:
                at = int(clean.argmax())
                todo += [(a[middle:], b[at:], q, right), (a[:middle], b[:at], left, q)]
    return ops


def start_point(query: np.ndarray, sequence: np.ndarray, q_end: int, d_end: int, score: int, s: Scoring) -> tuple[int, int]:
    """Where an alignment that ends at the given point and has the score begins: latest in the query, then in the database."""
    q, r = s.gap_open, s.gap_extend
    b = sequence[d_end::-1]
    steps = np.arange(len(b), dtype=np.int64) * r
    low = -(1 << 40)
    h, e = np.full(len(b), low), np.full(len(b), low)
    for i in range(q_end, -1, -1):
        corner = 0 if i == q_end else low
        e = np.maximum(e, h - q) - r
        t = np.maximum(np.concatenate([[corner], h[:-1]]) + s.scores[b, query[i]], e)
        h = t.copy()
        if len(b) > 1:
            h[1:] = np.maximum(h[1:], np.maximum.accumulate(t + steps)[:-1] - q - steps[1:])
        hit = np.flatnonzero(h >= score)
        if len(hit):
            return i, d_end - int(hit[0])
    raise ArithmeticError("the reverse pass does not reach the score of the forward pass")


@dataclass
class Alignment:
    """Coordinates are 0-based and inclusive."""

    score: int
    q_start: int
    q_end: int
    d_start: int
    d_end: int
    ops: list[tuple[str, int]]

    @property
    def script(self) -> str:
        return "".join(f"{op}{n}" for op, n in self.ops)


def align(query: np.ndarray, sequence: np.ndarray, s: Scoring, hinted: bool = True, known: int = 0) -> Alignment:
    """The best local alignment; the score must be positive. An end in the first row or column is looked up unhinted.

    known is the score, or anything below it: what is known to be left to gaps bounds what an alignment spans.
    """
    gain = int(np.maximum(s.scores.max(axis=0)[query], 0).sum())
    reach = len(query) + max(0, gain - s.gap_open - max(known, 0)) // s.gap_extend + 1 if s.gap_extend > 0 else None
    low, high = 0, len(sequence)
    if hinted and reach and high > 2 * reach:
        # The first window that reaches the score holds the least column that does: later windows begin later.
        cuts = [(x, min(x + 2 * reach, high)) for x in range(0, high - reach, reach)]
        low, high = cuts[int(window_scores(query, sequence, cuts, s.scores, s.gap_open, s.gap_extend).argmax())]
    score, q_end, d_end = end_point(query, sequence[low:high], s.scores, s.gap_open, s.gap_extend, hinted)
    d_end += low
    if hinted and score > 0 and (q_end == 0 or d_end == 0):
        score, q_end, d_end = end_point(query, sequence, s.scores, s.gap_open, s.gap_extend, False)
    if score < 1:
        raise ValueError("there is no alignment with a positive score")
    base = max(0, d_end + 1 - reach) if reach else 0
    q_start, d_start = start_point(query, sequence[base : d_end + 1], q_end, d_end - base, score, s)
    d_start += base
    ops = edit_script(query[q_start : q_end + 1], sequence[d_start : d_end + 1], s)
    return Alignment(score, q_start, q_end, d_start, d_end, ops)


def columns(found: Alignment, query: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query and database code of each alignment column, -1 for a gap."""
    left, right, i, j = [], [], found.q_start, found.d_start
    for op, n in found.ops:
        left.append(np.full(n, -1) if op == "I" else query[i : i + n].astype(np.int64))
        right.append(np.full(n, -1) if op == "D" else sequence[j : j + n].astype(np.int64))
        i += n * (op != "I")
        j += n * (op != "D")
    return np.concatenate(left), np.concatenate(right)


def statistics(found: Alignment, query: np.ndarray, sequence: np.ndarray, scores: np.ndarray) -> dict[str, int]:
    """identities, positives, indels (gap residues), gaps (gap runs), aligned (columns).

    Positives look scores up by [query, database], the other way round than scoring does.
    """
    left, right = columns(found, query, sequence)
    paired = (left >= 0) & (right >= 0)
    return {
        "identities": int((paired & (left == right)).sum()),
        "positives": int((scores[left[paired], right[paired]] > 0).sum()),
        "indels": int((~paired).sum()),
        "gaps": sum(op != "M" for op, _ in found.ops),
        "aligned": len(left),
    }


def rescored(found: Alignment, query: np.ndarray, sequence: np.ndarray, s: Scoring) -> int:
    """The score that the edit script stands for."""
    left, right = columns(found, query, sequence)
    paired = (left >= 0) & (right >= 0)
    return int(s.scores[right[paired], left[paired]].sum()) - sum(s.gap_open + n * s.gap_extend for op, n in found.ops if op != "M")


def text_lines(found: Alignment, query: np.ndarray, sequence: np.ndarray, scores: np.ndarray, symbols: str, mark: str = "|") -> tuple[str, str, str]:
    """Query line, middle line and database line; the middle has mark (or the letter, if mark is empty) or + or a blank."""
    left, right = columns(found, query, sequence)
    middle = []
    for q, d in zip(left, right):
        if q >= 0 and q == d:
            middle.append(mark or symbols[q])
        else:
            middle.append("+" if q >= 0 and d >= 0 and scores[q, d] > 0 else " ")
    show = lambda side: "".join(symbols[c] if c >= 0 else "-" for c in side)
    return show(left), "".join(middle), show(right)
