"""Smith-Waterman score kernels with affine gaps over lanes of database sequences. NumPy only.

lane_scores takes antidiagonals in 8 or 16 bits, tile_scores columns in any width. A column step handles one database
position of all lanes at once. With T = max(0, diagonal + M, E), the gap along the
query is F[i] = max over k < i of (T[k] + k R) - open - i R, one running maximum, so no loop runs along the query.
Lanes are sorted by descending length and fall away as sequences end.

Sequences longer than a window are cut into overlapping windows. An alignment with a positive score spans at most
span(m) database positions, so each lies whole in some window: the pair's score is the largest over its windows, a
long sequence fills lanes rather than being a serial tail, and memory stays bounded.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

LANES = 512
WINDOW = 4096
#: Cells of a tile's code table at most.
TILE = 1 << 24
#: Steps for which score columns are laid out, cells of a step, and bytes of an array that is held at most.
STRETCH, CELLS, HELD = 512, 1 << 18, 1 << 25


def span(query: int, most: int, gap_open: int, gap_extend: int) -> int | None:
    """Database positions that a positive-scoring alignment of a query covers at most; None if gaps cost nothing."""
    if gap_extend <= 0:
        return None
    return query + max(0, (query * max(most, 0) - gap_open) // gap_extend) + 1


def windows(length: int, reach: int | None) -> list[tuple[int, int]]:
    """(start, end) of windows so that every stretch of reach positions lies in one of them."""
    size = max(WINDOW, 8 * reach) if reach else length
    if length <= size or not reach:
        return [(0, length)]
    step = size - reach
    return [(low, min(low + size, length)) for low in range(0, length - reach, step)]


def score_type(query: int, longest: int, scores: np.ndarray, gap_open: int, gap_extend: int) -> type:
    """The narrowest integer that holds all values of the recurrence."""
    most, least = int(scores.max()), int(scores.min())
    peak = min(query, longest) * max(most, 0) + query * gap_extend + gap_open + gap_extend + abs(least)
    return np.int16 if peak < 32000 else np.int32 if peak < 2_000_000_000 else np.int64


def tile_scores(queries: list[np.ndarray], table: np.ndarray, lengths: np.ndarray, scores: np.ndarray, gap_open: int, gap_extend: int) -> np.ndarray:
    """(queries, lanes) best local scores; table is (positions, lanes) codes, lengths descend.

    Queries of one tile are padded to the longest at their ends. Padding scores too low for any diagonal, and values
    only pass from a query position to later ones, so it changes no score.
    """
    m, count, lanes = max(map(len, queries)), len(queries), table.shape[1]
    if not m or not lanes or not lengths[0]:
        return np.zeros((count, lanes), np.int64)
    kind = score_type(m, int(lengths[0]), scores, gap_open, gap_extend)
    profile = np.full((m, count, scores.shape[0]), int(scores.min()), kind)  # query positions x queries x database codes
    for i, query in enumerate(queries):
        profile[: len(query), i] = scores[:, query].T
        profile[len(query) :, i] = -min(32000 // 2, int(scores.max()) * m + 1)
    ramp = (np.arange(m) * gap_extend).astype(kind)[:, None, None]
    down = ramp + kind(gap_open)
    q, r = kind(gap_open + gap_extend), kind(gap_extend)
    best = np.zeros((count, lanes), kind)
    h = e = t = f = None
    position = 0
    ends = np.unique(lengths)
    for end in ends[ends > 0]:
        active = int(np.searchsorted(-lengths, -end, "right"))
        # Arrays shrink with the lanes, so that they stay contiguous.
        h, e = (np.zeros((m, count, active), kind) if x is None else np.ascontiguousarray(x[:, :, :active]) for x in (h, e))
        t, f = np.empty_like(h), np.empty_like(h)
        top = best[:, :active]
        for j in range(position, int(end)):
            np.take(profile, table[j, :active], axis=2, out=t, mode="clip")
            t[1:] += h[:-1]
            np.maximum(t, e, out=t)
            np.maximum(t, 0, out=t)
            np.add(t, ramp, out=f)
            np.maximum.accumulate(f, axis=0, out=f)
            f[:-1] -= down[1:]
            np.maximum(t[1:], f[:-1], out=h[1:])
            h[0] = t[0]
            np.maximum(top, h.max(axis=0), out=top)
            e -= r
            np.subtract(h, q, out=t)
            np.maximum(e, t, out=e)
        position = int(end)
    return best.astype(np.int64)


def _narrow(kind: type, scores: np.ndarray, gap_open: int, gap_extend: int) -> tuple[int, int, int] | None:
    """(zero, renewal, cap) of lane_scores in this integer, or None if the scoring system doesn't fit it.

    Bytes have no sign, so zero stands so high that nothing falls below 0.
    """
    r, most, least = gap_extend, max(int(scores.max()), 0), int(scores.min())
    if gap_open < 0 or r < 0 or max(gap_open, r, most, -least) > 2048:
        return None
    zero, renewal = (max(gap_open + 2 * r, -least, 8) + 2 * r, 24) if kind is np.uint8 else (0, 4096)
    cap = int(np.iinfo(kind).max) - zero - renewal - 3 * r - most
    return (zero, renewal, cap) if cap >= 64 and 10 * (gap_open + r) < 32767 else None


def lane_scores(queries: list[np.ndarray], table: np.ndarray, ends: np.ndarray, scores: np.ndarray, gap_open: int, gap_extend: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(queries, windows) best local scores, and where they reach the cap of the integer, beyond which they say nothing.

    table is (positions, lanes) codes, longer lanes first. ends has a row for each window: the position past its last
    and its lane. Windows of one lane are apart by the longest query. Queries stand one below the other in rows, each behind a
    row that is always zero. A step takes one antidiagonal, so that no value depends on another of its step: row i of step d is
    database position d - i. Values at step d are kept with d * gap_extend added, which leaves open gaps unchanged
    until all values are renewed. F moves down a row at each step, so its window moves over a buffer instead.
    """
    zero, renewal, cap = _narrow(kind, scores, gap_open, gap_extend)
    r, n, pad, active = gap_extend, scores.shape[0], max(map(len, queries)) - 1, table.shape[1]
    best, over = np.zeros((len(queries), len(ends)), np.int64), np.zeros((len(queries), len(ends)), bool)
    order = np.lexsort((ends[:, 0], ends[:, 1]))  # windows by lane, in their order there
    begun, last_of = np.full(active, -1), np.zeros(active, np.int64)
    following = np.full(len(ends), -1)
    for x in order.tolist():
        lane = ends[x, 1]
        if begun[lane] < 0:
            begun[lane] = x
        else:
            following[last_of[lane]] = x
        last_of[lane] = x
    lengths = ends[last_of, 0]
    events = np.argsort(ends[:, 0], kind="stable").tolist()
    done, current = 0, begun
    used, place = np.unique(np.concatenate(queries), return_inverse=True)
    outside = np.full((len(used), 1), 2 * r - zero if zero else -16000)
    profile = np.append(scores.T[used] + 2 * r, outside, axis=1).astype(kind)  # modulo 256 in bytes
    till = np.cumsum([len(q) for q in queries])
    work = []  # for each query: its number and rows; row codes; positions in the query; the values of the last two steps, E, F
    for k, q in enumerate(queries):
        code, local = np.append(0, place[till[k] - len(q) : till[k]]), np.maximum(np.arange(-1, len(q)), 0)
        work.append([[k], [len(q) + 1], code, local, [np.full((len(q) + 1, active), x, kind) for x in (zero - r, zero - 2 * r, zero - r - gap_open, zero - r - gap_open)], np.zeros((1, active), kind)])
    ramp, stop = zero, int(lengths[0]) + pad
    for low in range(0, stop, STRETCH):
        steps = min(STRETCH, stop - low)
        now = int((lengths + pad > low).sum())
        if now < active:  # arrays shrink with the lanes, so that they stay contiguous
            active = now
            for w in work:
                w[4], w[5] = [np.ascontiguousarray(x[:, :active]) for x in w[4]], w[5][:, :active]
        joined: list[list] = []
        for w in work:
            if joined and (len(joined[-1][2]) + len(w[2])) * active <= CELLS:
                mine = joined[-1]
                joined[-1] = [mine[0] + w[0], mine[1] + w[1], *(np.concatenate(x) for x in zip(mine[2:4], w[2:4])), [np.concatenate(x) for x in zip(mine[4], w[4])], np.concatenate([mine[5], w[5]])]
            else:
                joined.append(w)
        work = joined
        codes = np.full((steps + pad, active), n, np.intp)
        first, last = max(low - pad, 0), min(low + steps, len(table))
        codes[first - low + pad : last - low + pad] = table[first:last, :active]
        columns = np.empty((len(used), steps + pad, active), kind)
        for row, into in zip(profile, columns):
            np.take(row, codes, out=into, mode="clip")
        columns = columns.reshape(-1, active)
        most = max(len(w[2]) for w in work)
        fresh, gains, gap = (np.empty((most, active), kind) for _ in range(3))
        room, floor, reached = np.empty((most + STRETCH, active), kind), np.empty((1, active), kind), ramp
        ahead = done
        for w in work:
            ks, sizes, code, local, (h, before, e, f), own = w
            rows, ramp, done, now = len(code), reached, ahead, current.copy()
            starts = np.cumsum([0, *sizes[:-1]])
            cuts = list(zip(starts.tolist(), (starts + sizes).tolist()))
            at = code * (steps + pad) + (pad - local)
            s, g, t = gains[:rows], gap[:rows], np.empty((rows, active), kind)
            room[STRETCH : STRETCH + rows] = f
            own, top = own.copy(), np.empty((len(ks), active), kind)
            for step in range(steps):
                f = room[STRETCH - step - 1 : STRETCH - step - 1 + rows]
                np.subtract(h, kind(gap_open), out=g)
                np.maximum(e, g, out=e)
                np.maximum(f[1:], g[:-1], out=f[1:])
                np.take(columns, at, axis=0, out=s, mode="clip")
                np.add(s[1:], before[:-1], out=t[1:])
                np.maximum(t, e, out=t)
                np.maximum(t, f, out=t)
                floor.fill(ramp)
                np.maximum(t, floor, out=t)
                t[starts], f[starts] = ramp, ramp - gap_open
                for (a, b), x in zip(cuts, top):
                    np.maximum.reduce(t[a:b], axis=0, out=x)
                top -= kind(ramp)
                np.maximum(own, top, out=own)
                if top.max() >= cap:  # the lane begins anew, so that nothing overflows
                    for i, lane in zip(*np.nonzero(top >= cap)):
                        a, b = cuts[i]
                        over[ks[i], now[lane]] = True
                        t[a:b, lane], h[a:b, lane] = ramp, ramp - r
                        e[a:b, lane] = f[a:b, lane] = ramp - gap_open
                while done < len(events) and ends[events[done], 0] + pad == low + step + 1:  # a window is over in all rows
                    x = events[done]
                    lane = ends[x, 1]
                    best[ks, x], own[:, lane], now[lane] = own[:, lane], 0, following[x]
                    t[:, lane], h[:, lane] = ramp, ramp - r
                    e[:, lane] = f[:, lane] = ramp - gap_open
                    done += 1
                h, before, t = t, h, before
                at += 1
                ramp += r
                if ramp >= zero + renewal:
                    for x in (h, before, e, f):
                        x -= kind(ramp - zero)
                    ramp = zero
            w[4], w[5] = [h, before, e, f.copy()], own
        current = now
    return best, over


def _packed(sequences: list[np.ndarray], cuts: list[tuple[int, int, int]], apart: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(table, ends) of windows sorted by descending length, so dealt to lanes that these are about equally long."""
    total, longest = sum(high - low + apart for _, low, high in cuts), cuts[0][2] - cuts[0][1]
    lanes = max(1, min(len(cuts), most, total // (longest + apart)))
    free = [(0, lane) for lane in range(lanes)]
    places = []
    for _, low, high in cuts:
        used, lane = heappop(free)
        places.append((used, lane))
        heappush(free, (used + high - low + apart, lane))
    rank = {lane: x for x, (_, lane) in enumerate(sorted(free, reverse=True))}
    table = np.full((max(used for used, _ in free) - apart, lanes), 255, np.uint8)  # past any profile: a position outside
    ends = np.empty((len(cuts), 2), np.int64)
    for x, ((i, low, high), (used, lane)) in enumerate(zip(cuts, places)):
        table[used : used + high - low, rank[lane]] = sequences[i][low:high]
        ends[x] = used + high - low, rank[lane]
    return table, ends


def batch_scores(queries: list[np.ndarray], sequences: list[np.ndarray], scores: np.ndarray, gap_open: int, gap_extend: int) -> np.ndarray:
    """(queries, sequences) best local scores, exact.

    Bytes first; the pairs of query and window that reach their cap again in 16 bits, and the few beyond in wide integers.
    """
    out = np.zeros((len(queries), len(sequences)), np.int64)
    filled = [k for k, q in enumerate(queries) if len(q)]
    if not filled or not sequences:
        return out
    best = np.maximum(scores.max(axis=0), 0)
    todo: list[tuple[list[int], list]] = []  # queries of like length, and their windows
    for k in sorted(filled, key=lambda k: -len(queries[k])):
        if not todo or 4 * len(queries[k]) < 3 * len(queries[todo[-1][0][0]]) or sum(len(queries[x]) for x in todo[-1][0]) * LANES > HELD:
            todo.append(([], []))
        todo[-1][0].append(k)
    for ks, mine in todo:
        # Matched residues gain so much at most, which is all that gaps can cost.
        gain = max(int(best[queries[k]].sum()) for k in ks)
        reach = len(queries[ks[0]]) + max(0, gain - gap_open) // gap_extend + 1 if gap_extend > 0 else None
        mine += sorted(((i, low, high) for i, s in enumerate(sequences) for low, high in windows(len(s), reach) if high > low), key=lambda c: c[1] - c[2])
    for kind in (np.uint8, np.int16):
        if _narrow(kind, scores, gap_open, gap_extend) is None:
            continue
        left: dict[int, list] = {}
        for ks, mine in todo:
            if not mine:
                continue
            longest = len(queries[ks[0]])
            table, ends = _packed(sequences, mine, longest, max(1, min(LANES, HELD // (scores.shape[0] * (STRETCH + longest)))))
            found, over = lane_scores([queries[k] for k in ks], table, ends, scores, gap_open, gap_extend, kind)
            owner = np.array([c[0] for c in mine])
            for k, row, beyond in zip(ks, found, over):
                np.maximum.at(out[k], owner[~beyond], row[~beyond])
                if beyond.any():
                    left.setdefault(k, []).extend(mine[x] for x in np.flatnonzero(beyond))
        todo = [([k], mine) for k, mine in left.items()]
    todo = [([k], mine) for ks, mine in todo for k in ks]
    for (k,), mine in todo:
        lanes = max(1, min(LANES, TILE // max(1, mine[0][2] - mine[0][1]))) if mine else 1
        for low in range(0, len(mine), lanes):
            part = mine[low : low + lanes]
            table = np.zeros((part[0][2] - part[0][1], len(part)), np.uint8)
            for lane, (i, first, last) in enumerate(part):
                table[: last - first, lane] = sequences[i][first:last]
            lengths = np.array([last - first for _, first, last in part])
            np.maximum.at(out[k], np.array([c[0] for c in part]), tile_scores([queries[k]], table, lengths, scores, gap_open, gap_extend)[0])
    return out


def window_scores(query: np.ndarray, sequence: np.ndarray, cuts: list[tuple[int, int]], scores: np.ndarray, gap_open: int, gap_extend: int) -> np.ndarray:
    """Best local score of the query within each window of one sequence."""
    out = batch_scores([query], [sequence[low:high] for low, high in cuts], scores, gap_open, gap_extend)
    return out[0]


def _columns(query: np.ndarray, sequence: np.ndarray, scores: np.ndarray, gap_open: int, gap_extend: int):
    """The matrix H column by column (database positions), for one pair."""
    m = len(query)
    ramp = np.arange(m, dtype=np.int64) * gap_extend
    h, e = np.zeros(m, np.int64), np.zeros(m, np.int64)
    rows = scores[:, query].astype(np.int64)
    for code in sequence:
        t = rows[code].copy()
        t[1:] += h[:-1]
        np.maximum(t, e, out=t)
        np.maximum(t, 0, out=t)
        h = t.copy()
        if m > 1:
            np.maximum(h[1:], np.maximum.accumulate(t + ramp)[:-1] - gap_open - ramp[1:], out=h[1:])
        yield h
        e = np.maximum(e - gap_extend, h - gap_open - gap_extend)


def end_point(query: np.ndarray, sequence: np.ndarray, scores: np.ndarray, gap_open: int, gap_extend: int, hinted: bool = True) -> tuple[int, int, int]:
    """(score, query end, database end), ends 0-based.

    Hinted: the least database column that reaches the score, then its least query row. Unhinted: the least query row
    that reaches it, then the least column.
    """
    best, q_end, d_end = 0, -1, -1
    for j, h in enumerate(_columns(query, sequence, scores, gap_open, gap_extend)):
        i = int(h.argmax())
        if h[i] > best or (not hinted and best > 0 and h[i] == best and i < q_end):
            best, q_end, d_end = int(h[i]), i, j
    return best, q_end, d_end


def plain_score(query, sequence, scores, gap_open: int, gap_extend: int) -> int:
    """The textbook recurrence, cell by cell; for tests."""
    best, h, e = 0, [0] * (len(query) + 1), [0] * (len(query) + 1)
    for d in sequence:
        diagonal, f = 0, 0
        for i, q in enumerate(query, 1):
            now = max(0, diagonal + int(scores[d, q]), e[i], f)
            best = max(best, now)
            diagonal, h[i] = h[i], now
            e[i], f = max(e[i] - gap_extend, now - gap_open - gap_extend), max(f - gap_extend, now - gap_open - gap_extend)
    return best
