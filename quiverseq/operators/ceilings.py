"""Sequences that reach the highest score a query can have at all: found as words, without dynamic programming.

A query's ceiling is the largest sum, over a stretch of it, of the best score of each residue. Where gaps cost more than
they can save, an alignment has that score exactly if it pairs each residue of the query's core, the shortest such
stretch, with a residue of its best score, side by side. So a word of the core finds all places worth comparing.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np

#: Residues of a core at least, and residues of the word that is looked up, at least and at most.
CORE, LEAST, MOST = 24, 6, 12


@dataclass
class Ceiling:
    """score, the core's codes, and the word of the core that is looked up: its place and length."""

    score: int
    core: np.ndarray
    at: int
    length: int


def classes(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A class below 32 for each code, and which codes have few best partners: those are all of the code's class."""
    top = scores.max(axis=0)
    best = scores == top
    few = (top > 0) & (best.sum(axis=0) <= 4)
    group = np.arange(len(scores))
    for code in np.flatnonzero(few):
        members = np.append(np.flatnonzero(best[:, code]), code)
        group[np.isin(group, group[members])] = group[members].min()
    return group, few


def ceiling(query: np.ndarray, scores: np.ndarray, gap_open: int, gap_extend: int) -> Ceiling | None:
    """The query's ceiling; None where it isn't reached by one stretch alone or the core is too short to be looked up."""
    top = scores.max(axis=0).astype(np.int64)
    if len(query) < CORE or len(scores) > 32 or gap_open < 1 or gap_extend < max(1, -int(top[query].min())):
        return None
    sums = np.append(0, np.cumsum(top[query]))
    score = int((sums - np.minimum.accumulate(sums)).max())
    least = np.minimum.accumulate(sums)
    ends = np.flatnonzero((sums - least == score) & (score > 0))
    if not len(ends):
        return None
    end = int(ends[0])
    starts = np.flatnonzero(sums[:end] == sums[end] - score)
    begin = int(starts[-1])
    # Another stretch with the score must hold this one.
    later = [int(e) for e in ends[1:] if (sums[begin + 1 : e] <= sums[e] - score).any()]
    if later or end - begin < CORE:
        return None
    core = query[begin:end]
    known = classes(scores)[1][core]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(int), [0]])))
    runs = list(zip(edges[::2], edges[1::2]))
    a, b = max(runs, key=lambda x: x[1] - x[0], default=(0, 0))
    return Ceiling(score, core, int(a), min(int(b - a), MOST)) if b - a >= LEAST else None


def _packed(codes: np.ndarray, length: int) -> np.ndarray:
    """The words of so many codes as numbers, one from each place on that has one."""
    n = len(codes) - length + 1
    out = np.zeros(max(n, 0), np.int64)
    for i in range(length if n > 0 else 0):
        out <<= 5
        out |= codes[i : i + n]
    return out


def reaching(ceilings: dict[int, Ceiling], sequences: list[np.ndarray], scores: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(key, ascending numbers of the sequences that reach its ceiling) for each key that some sequence reaches."""
    out: dict[int, list] = defaultdict(list)
    offsets = np.append(0, np.cumsum([len(s) for s in sequences]))
    group, top = classes(scores)[0], scores.max(axis=0)
    by_length: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for key, c in ceilings.items():
        word = int(_packed(group[c.core[c.at : c.at + c.length]], c.length)[0])
        by_length[c.length][word].append(key)
    if not offsets[-1] or not by_length:
        return []
    flat = np.concatenate(sequences)
    mine = group[flat]
    for length, words in by_length.items():
        packed = _packed(mine, length)
        keys = np.sort(np.fromiter(words, np.int64, len(words)))
        mixed = lambda x: (x * np.int64(-7046029254386353131)) >> np.int64(46) & np.int64(0x3FFFF)
        sieve = np.zeros(1 << 18, bool)
        sieve[mixed(keys)] = True
        places = np.flatnonzero(sieve[mixed(packed)])
        at = np.minimum(np.searchsorted(keys, packed[places]), len(keys) - 1)
        equal = keys[at] == packed[places]
        places, at = places[equal], at[equal]
        for number in np.unique(at).tolist():
            spots = places[at == number]
            for key in words[int(keys[number])]:
                c = ceilings[key]
                begin = spots - c.at
                begin = begin[(begin >= 0) & (begin + len(c.core) <= len(flat))]
                owner = np.searchsorted(offsets, begin, "right") - 1
                inside = begin + len(c.core) <= offsets[owner + 1]
                begin, owner = begin[inside], owner[inside]
                for i, code in enumerate(c.core):
                    keep = scores[flat[begin + i], code] == top[code]
                    if not keep.all():
                        begin, owner = begin[keep], owner[keep]
                    if not len(begin):
                        break
                if len(owner):
                    out[key].append(owner)
    return [(key, np.unique(np.concatenate(parts))) for key, parts in out.items()]
