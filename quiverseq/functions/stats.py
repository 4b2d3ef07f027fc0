"""Karlin-Altschul statistics: parameters by scoring system, length adjustment, search space, E-values and bounds."""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNGAPPED = 32767
# Open extend lambda K H alpha beta for BLOSUM62.
BLOSUM62 = """
32767 32767 0.3176 0.134 0.4012 0.7916 -3.2
11 2 0.297 0.082 0.27 1.1 -10
10 2 0.291 0.075 0.23 1.3 -15
9 2 0.279 0.058 0.19 1.5 -19
8 2 0.264 0.045 0.15 1.8 -26
7 2 0.239 0.027 0.10 2.5 -46
6 2 0.201 0.012 0.061 3.3 -58
13 1 0.292 0.071 0.23 1.2 -11
12 1 0.283 0.059 0.19 1.5 -19
11 1 0.267 0.041 0.14 1.9 -30
10 1 0.243 0.024 0.10 2.5 -44
9 1 0.206 0.010 0.052 4.0 -87
"""
# Gap penalties open/extend by default for each matrix name.
DEFAULT_GAPS = {"BLOSUM45": (14, 2), "BLOSUM50": (13, 2), "BLOSUM62": (11, 1), "BLOSUM80": (11, 1), "BLOSUM90": (10, 1), "PAM250": (15, 2), "PAM30": (9, 1), "PAM70": (10, 1), "BLOSUM62_20": (120, 10), "IDENTITY_5_1": (15, 5)}
NUCLEOTIDE_GAPS = (5, 2)
# By match and mismatch: open and extend from which gaps cost as good as infinity, then rows as above.
NUCLEOTIDE = {
    (1, -5): (3, 3, "0 0 1.39 .747 1.38 1 0; 3 3 1.39 .747 1.38 1 0"),
    (1, -4): (2, 2, "0 0 1.383 .738 1.36 1.02 0; 1 2 1.36 .67 1.2 1.1 0; 0 2 1.26 .43 .9 1.4 -1; 2 1 1.35 .61 1.1 1.2 -1; 1 1 1.22 .35 .72 1.7 -3"),
    (2, -7): (4, 4, "0 0 .69 .73 1.34 .515 0; 2 4 .68 .67 1.2 .55 0; 0 4 .63 .43 .9 .7 -1; 4 2 .675 .62 1.1 .6 -1; 2 2 .61 .35 .72 1.7 -3"),
    (1, -3): (2, 2, "0 0 1.374 .711 1.31 1.05 0; 2 2 1.37 .7 1.2 1.1 0; 1 2 1.35 .64 1.1 1.2 -1; 0 2 1.25 .42 .83 1.5 -2; 2 1 1.34 .6 1.1 1.2 -1; 1 1 1.21 .34 .71 1.7 -2"),
    (2, -5): (4, 4, "0 0 .675 .65 1.1 .6 -1; 2 4 .67 .59 1.1 .6 -1; 0 4 .62 .39 .78 .8 -2; 4 2 .67 .61 1 .65 -2; 2 2 .56 .32 .59 .95 -4"),
    (1, -2): (2, 2, "0 0 1.28 .46 .85 1.5 -2; 2 2 1.33 .62 1.1 1.2 0; 1 2 1.3 .52 .93 1.4 -2; 0 2 1.19 .34 .66 1.8 -3; 3 1 1.32 .57 1 1.3 -1; 2 1 1.29 .49 .92 1.4 -1; 1 1 1.14 .26 .52 2.2 -5"),
    (2, -3): (6, 4, "0 0 .55 .21 .46 1.2 -5; 4 4 .63 .42 .84 .75 -2; 2 4 .615 .37 .72 .85 -3; 0 4 .55 .21 .46 1.2 -5; 3 3 .615 .37 .68 .9 -3; 6 2 .63 .42 .84 .75 -2; 5 2 .625 .41 .78 .8 -2; 4 2 .61 .35 .68 .9 -3; 2 2 .515 .14 .33 1.55 -9"),
    (3, -4): (6, 3, "6 3 .389 .25 .56 .7 -5; 5 3 .375 .21 .47 .8 -6; 4 3 .351 .14 .35 1 -9; 6 2 .362 .16 .45 .8 -4; 5 2 .33 .092 .28 1.2 -13; 4 2 .281 .046 .16 1.8 -23"),
    (4, -5): (4, 2, "0 0 .22 .061 .22 1 -15; 6 5 .28 .21 .47 .6 -7; 5 5 .27 .17 .39 .7 -9; 4 5 .25 .1 .31 .8 -10; 3 5 .23 .065 .25 .9 -11"),
    (1, -1): (5, 5, "3 2 1.09 .31 .55 2 -2; 2 2 1.07 .27 .49 2.2 -3; 1 2 1.02 .21 .36 2.8 -6; 0 2 .8 .064 .17 4.8 -16; 4 1 1.08 .28 .54 2 -2; 3 1 1.06 .25 .46 2.3 -4; 2 1 .99 .17 .3 3.3 -10"),
    (3, -2): (12, 8, "5 5 .208 .03 .072 2.9 -47"),
    (5, -4): (25, 10, "10 6 .163 .068 .16 1 -19; 8 6 .146 .039 .11 1.3 -29"),
}


@dataclass(frozen=True)
class Parameters:
    lam: float
    k: float
    h: float
    alpha: float
    beta: float


def _rows(text: str) -> dict[tuple[int, int], Parameters]:
    rows = (line.split() for line in text.replace(";", "\n").splitlines() if line.strip())
    return {(int(r[0]), int(r[1])): Parameters(*map(float, r[2:])) for r in rows}


def parse_parameters(text: str) -> dict[tuple[int, int], Parameters]:
    """Rows of open, extend, lambda, K, H, alpha, beta, for matrices that aren't built in."""
    return _rows(text)


def protein_parameters(matrix: str, gap_open: int, gap_extend: int, rows: dict | None = None) -> Parameters | None:
    """Parameters of a protein scoring system, or None; rows serves matrices other than BLOSUM62."""
    table = rows if rows is not None else _rows(BLOSUM62) if matrix.upper() == "BLOSUM62" else {}
    return table.get((gap_open, gap_extend))


def nucleotide_parameters(match: int, mismatch: int, gap_open: int, gap_extend: int) -> Parameters | None:
    """Parameters of a nucleotide scoring system, or None; very dear gaps take the ungapped row 0 0."""
    if (match, mismatch) not in NUCLEOTIDE:
        return None
    most_open, most_extend, rows = NUCLEOTIDE[match, mismatch]
    if gap_open >= most_open and gap_extend >= most_extend:
        gap_open = gap_extend = 0
    return _rows(rows).get((gap_open, gap_extend))


def length_adjustment(p: Parameters, query: int, total: int, sequences: int) -> int:
    """The largest whole ell with K (m - ell)(n - N ell) >= max(m, n) and ell <= alpha / lambda ln(K (m - ell)(n - N ell)) + beta.

    Both conditions hold up to some ell and for none beyond, so halving finds the last one; 0 if they hold for none.
    """

    def fails(ell: int) -> bool:
        left, rest = query - ell, total - sequences * ell
        space = p.k * left * rest
        return left <= 0 or rest <= 0 or space < max(query, total) or ell > p.alpha / p.lam * math.log(space) + p.beta

    return max(bisect_left(range(query + 1), True, key=fails) - 1, 0)


def search_space(p: Parameters, query: int, total: int, sequences: int, fixed_total: int | None = None) -> float:
    """K m n with both lengths adjusted; a fixed database size is used as it is."""
    ell = length_adjustment(p, query, total, sequences)
    n = fixed_total if fixed_total else total - sequences * ell
    return p.k * (query - ell) * n


def score_bounds(p: Parameters | None, space: float, expect: float = 10.0, least_expect: float = 0.0, lowest: int = 1, highest: int | None = None) -> tuple[int, int | None]:
    """Scores that meet the E-value bounds; without parameters the plain score bounds."""
    if lowest < 1:
        raise ValueError("the least score must be 1 or more")
    if p is None:
        return lowest, highest
    if expect <= 0:
        raise ValueError("the E-value threshold must be above 0")
    lowest = max(lowest, math.ceil(-math.log(expect / space) / p.lam))
    if least_expect > 0:
        top = math.floor(-math.log(least_expect / space) / p.lam)
        highest = top if highest is None else min(highest, top)
    return lowest, highest


def e_value(score: Column, space: Column, p: Parameters) -> Column:
    return space * F.exp(-F.lit(p.lam) * score)


def bit_score(score: Column, p: Parameters) -> Column:
    return (F.lit(p.lam) * score - F.lit(math.log(p.k))) / F.lit(math.log(2))
