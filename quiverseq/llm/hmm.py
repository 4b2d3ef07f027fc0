"""Hidden Markov language model over words: Baum-Welch over the whole corpus, exact likelihoods by scaled forward recursion.

Words are lower-cased runs of non-space bytes; a text ends with one end token. All words are counted. The HEAD most
frequent words and the end token are emitted by the states themselves. The other words are dealt by their endings to tail
classes, one for each CLASS_WORDS of them and CLASSES at most, so that what the states learn of rare words grows with
the vocabulary while the model that tasks hold stays bounded. A tail word is emitted as its class and then drawn by its
own count within it, so the model covers any text and sums to 1. Tail counts never reach a task whole: they are joined
to the texts' tail words by word.

Baum-Welch runs over all training texts; those of up to WINDOW tokens are taken whole, longer ones in windows of that
many, so that at most one transition in WINDOW goes uncounted and a later window begins with the state shares within
texts. Each task adds up expected counts, Spark sums them by
symbol, and the driver sees HEAD + CLASSES + a few rows per iteration at most. It starts from a random model and ends when the training
likelihood has settled; every iteration counts all training texts.
Scores are exact for whole texts: texts up to LONG tokens run side by side, longer ones as products of the transfer
matrices of their chunks, which is the same recursion regrouped.

Null and empty texts consist of the end token. Repeated rows are scored each. A null doc_id counts as text "" for the
fold. Without training texts all tokens are unseen and the model falls back on one tail class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .textkernels import U, Words, lists, mix, slices, text_bytes

HEAD, STATES, WINDOW = 1 << 15, 8, 1024
#: Tail words to a class on average, classes at most (symbols are two bytes), and last bytes of a word that name its class.
CLASS_WORDS, CLASSES, ENDING = 64, (1 << 15) - 2, 3
LONG, CHUNK = 4096, 256
#: Training has settled when two iterations in a row gain less than so many nats a token.
SETTLED = 1e-4
#: Lanes that are worked off side by side, symbols that a worker gathers for them, and symbols whose emissions it adds up at once.
LANES, BATCH, PART = 2048, 1 << 21, 1 << 18
#: What a place in a lane begins.
TEXT, LATER = 1, 2
#: Shares of a symbol's count below this are beyond the single precision in which they are added up.
EPSILON = 2.0**-23
#: Pseudo-tokens of unigram mass in each state's emissions, besides one for each symbol that the state emits.
PRIOR = 20.0


def endings(words: Words) -> np.ndarray:
    """A number below 2**31 of each word's last ENDING bytes: words that end alike have the same."""
    key = np.zeros(len(words.end), U)
    for back in range(1, ENDING + 1):
        at = words.end - back
        key = key * U(257) + np.where(at >= words.start, words.data[np.maximum(at, 0)].astype(U) + U(1), U(0))
    return (mix(key) >> U(33)).astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, counts, kinds = (np.concatenate(x) for x in zip(*parts))
    keys, first, at = np.unique(hashes, return_index=True, return_inverse=True)
    return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64), kinds[first]


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c, k): every word of all texts by hash, with its count and the number of its ending; tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flushed() -> pa.RecordBatch:
            keys, counts, kinds = _merged(parts)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts), pa.array(kinds.astype(np.int32))], ["h", "c", "k"])

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(words.hash):
                    continue
                keys, first, counts = np.unique(words.hash, return_index=True, return_counts=True)
                parts.append((keys, counts, endings(words)[first]))
                held += len(keys)
                if held > 1 << 21:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > 1 << 20:
                        yield flushed()
                        parts, held = [], 0
        if parts:
            yield flushed()

    return texts.select("text").mapInArrow(run, "h long, c long, k int").groupBy("h").agg(F.sum("c").alias("c"), F.max("k").alias("k"))


@dataclass
class Symbols:
    """Head words by ascending hash with their counts, tail classes with their tokens and words, and the texts.

    Symbols are the head words, then the tail classes from tail on, then the end.
    """

    words: np.ndarray
    counts: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    texts: int

    @property
    def tail(self) -> int:
        return len(self.words)

    @property
    def end(self) -> int:
        return len(self.words) + len(self.tail_words)

    @property
    def tokens(self) -> int:
        return int(self.counts.sum()) + int(self.tail_tokens.sum()) + self.texts

    @property
    def vocabulary(self) -> int:
        return len(self.words) + int(self.tail_words.sum()) + (self.texts > 0)

    @property
    def tail_mass(self) -> np.ndarray:
        """What the words of each class share: their tokens, one half for each word and for one unseen word."""
        return self.tail_tokens + 0.5 * (self.tail_words + 1)

    def unigram(self) -> np.ndarray:
        mass = np.concatenate([self.counts + 0.5, self.tail_mass, [self.texts + 0.5]])
        return mass / mass.sum()

    def coded(self, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        rare = self.tail + kinds % len(self.tail_words)
        if not len(self.words):
            return rare
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, rare)


def symbols(counts: DataFrame, texts: int, head: int = HEAD, class_words: int = CLASS_WORDS) -> Symbols:
    top = counts.orderBy(F.desc("c"), "h").limit(head).collect()  # head rows
    words, number, own = np.array([r["h"] for r in top], np.int64).view(U), np.array([r["c"] for r in top], np.int64), np.array([r["k"] for r in top], np.int64)
    order = np.argsort(words)
    words, number = words[order], number[order]
    classes = min(max((counts.count() - len(words)) // class_words, 1), CLASSES)
    tokens, kinds = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for name, n, c in counts.groupBy((F.col("k") % classes).alias("class")).agg(F.count("*"), F.sum("c")).collect():  # a row per class
        kinds[name], tokens[name] = n, c
    own = own[order] % classes
    kinds -= np.bincount(own, minlength=classes)
    tokens -= np.bincount(own, weights=number, minlength=classes).astype(np.int64)
    return Symbols(words, number, tokens, kinds, texts)


def _encoded(docs: DataFrame, known) -> DataFrame:
    """(uid, doc_id, held_out, syms, tail_h, tail_n) per row: symbols with the end token, distinct tail words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        book: Symbols = known.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = b - a
                code = book.coded(words.hash, endings(words))
                syms = np.insert(code, words.firsts[1:], book.end).astype(np.uint16)
                edges = words.firsts + np.arange(n + 1)
                at = np.flatnonzero(code >= book.tail)
                order = np.lexsort((words.hash[at], words.row[at]))
                row, h = words.row[at][order], words.hash[at][order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(h)))
                raw = syms.tobytes()
                columns = [
                    pa.array(np.arange(uid, uid + n)), batch.column("doc_id").slice(a, n), batch.column("held_out").slice(a, n),
                    pa.array([raw[2 * x : 2 * y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary()),
                    lists(h[first].view(np.int64), row[first], n, pa.int64()), lists(times, row[first], n, pa.int64()),
                ]
                uid += n
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "held_out", "syms", "tail_h", "tail_n"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, syms binary, tail_h array<bigint>, tail_n array<bigint>")


@dataclass
class Hmm:
    """start (K), move (K x K), emit (symbols x K, columns sum to 1), rest (K): state shares within texts."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    rest: np.ndarray

    def reestimated(self, first: np.ndarray, pairs: np.ndarray, seen: np.ndarray, unigram: np.ndarray, tail: slice = slice(0)) -> Hmm:
        """The maximisation step; every probability stays positive by prior mass, in emissions after Witten and Bell.

        Symbols of the tail are smoothed as one first, and then what they have is shared out among them in the same way.
        """
        k = len(self.start)
        rare, shares = seen[tail], unigram[tail, None]
        types = (seen > 0.5).sum(axis=0) - (rare > 0.5).sum(axis=0) + (rare.sum(axis=0) > 0.5)
        emit = seen + (PRIOR + types) * unigram[:, None]
        if len(rare):
            within = rare + (PRIOR + (rare > 0.5).sum(axis=0)) * shares / shares.sum()
            emit[tail] = within / within.sum(axis=0) * emit[tail].sum(axis=0)
        start, move = first + 1.0, pairs + 0.1 + np.eye(k)
        rest = seen.sum(axis=0) + 1.0
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), rest / rest.sum())


def random_start(unigram: np.ndarray, states: int = STATES, seed: int = 11, tail: slice = slice(0)) -> Hmm:
    """A random model; a state favours all symbols of the tail alike, however many there are."""
    rng = np.random.default_rng(seed)
    several = max(len(unigram[tail]) - 1, 0)
    ratio = rng.gamma(2.0, size=(len(unigram) - several, states))
    emit = unigram[:, None] * np.insert(ratio, [tail.start or 0] * several, ratio[tail.start or 0], axis=0)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    even = np.full(states, 1 / states)
    return Hmm(even, move, emit / emit.sum(axis=0), even)


def windows(syms: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of symbols, and marks of the same shape: TEXT where a text begins, LATER where another window or padding does.

    Texts are cut into windows of WINDOW symbols, and the windows dealt to lanes, the longest first and each to the lane
    that is shortest so far, so that lanes are about equally long; pad fills them up.
    """
    parts = [(s[low : low + WINDOW], LATER if low else TEXT) for s in syms for low in range(0, len(s), WINDOW)]
    parts.sort(key=lambda part: -len(part[0]))
    lanes: list[list] = [[] for _ in range(-(-sum(len(s) for s in syms) // WINDOW))]
    free = [(0, i) for i in range(len(lanes))]
    for part in parts:
        used, i = free[0]
        lanes[i].append(part)
        heapreplace(free, (used + len(part[0]), i))
    steps = max((used for used, _ in free), default=0)
    rows, marks = np.full((len(lanes), steps), pad, np.int32), np.zeros((len(lanes), steps), np.int8)
    for row, mark, lane in zip(rows, marks, lanes):
        at = 0
        for part, kind in lane:
            row[at : at + len(part)] = part
            mark[at] = kind
            at += len(part)
        if at < steps:
            mark[at] = LATER
    return rows, marks


class Counts:
    """What forward-backward over lanes adds up: expected first states, moves, emissions (K x size), and the log-likelihood.

    States come before lanes in memory, so that steps run along lanes; emissions are gathered by symbol, a row each.
    """

    def __init__(self, model: Hmm, size: int):
        k = len(model.start)
        self.model, self.size = model, size
        self.first, self.pairs, self.seen, self.likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((k, size + 1)), 0.0
        self.begin = np.stack([model.start, model.rest], axis=1).astype(np.float32)
        self.emit = np.ones((size + 1, k), np.float32)  # padding says nothing
        self.emit[:size] = model.emit
        self.room = np.empty(0, np.float32)

    def add(self, rows: np.ndarray, marks: np.ndarray) -> None:
        for low in range(0, len(rows), LANES):
            self._add(np.ascontiguousarray(rows[low : low + LANES].T), np.ascontiguousarray(marks[low : low + LANES].T))

    def _add(self, sym: np.ndarray, mark: np.ndarray) -> None:
        k, (steps, lanes), size, emit = len(self.first), sym.shape, self.size, self.emit
        move, ones = self.model.move.astype(np.float32), np.ones((1, k), np.float32)
        into = np.ascontiguousarray(move.T)
        step, lane = np.nonzero(mark)
        kind, edge = mark[step, lane] - TEXT, np.searchsorted(step, np.arange(steps + 1)).tolist()
        if len(self.room) < steps * k * lanes:
            self.room = np.empty(steps * k * lanes, np.float32)
        alpha, scale = self.room[: steps * k * lanes].reshape(steps, k, lanes), np.empty((steps, 1, lanes), np.float32)
        for t in range(steps):
            now = np.matmul(into, alpha[t - 1], out=alpha[t]) if t else alpha[0]
            if edge[t] < edge[t + 1]:
                new = slice(edge[t], edge[t + 1])
                now[:, lane[new]] = self.begin[:, kind[new]]
            now *= emit.take(sym[t], axis=0).T
            now /= np.matmul(ones, now, out=scale[t])
        self.likelihood += float(np.log(scale).sum(dtype=float))
        inside = sym < size
        whole = inside.all(axis=1).tolist()
        pairs, beta, ahead = np.zeros((k, k)), np.ones((k, lanes), np.float32), np.empty((k, lanes), np.float32)
        for t in range(steps - 2, -1, -1):
            np.multiply(beta, emit.take(sym[t + 1], axis=0).T, out=ahead)
            ahead /= scale[t + 1]
            new = lane[edge[t + 1] : edge[t + 2]]
            if len(new):
                ahead[:, new] = 0
            pairs += alpha[t] @ (ahead if whole[t + 1] else ahead * inside[t + 1]).T
            np.matmul(move, ahead, out=beta)
            if len(new):
                beta[:, new] = 1
            alpha[t] *= beta
            if not t % 16:  # single precision drifts
                total = np.matmul(ones, alpha[t])
                alpha[t] /= total
                beta /= total
        self.pairs += pairs * move
        leads = kind == 0
        self.first += alpha[step[leads], :, lane[leads]].sum(axis=0, dtype=float)
        for low in range(0, steps, -(-PART // lanes)):
            part = slice(low, low + -(-PART // lanes))
            flat = sym[part].ravel().astype(np.intp)
            for state in range(k):
                self.seen[state] += np.bincount(flat, weights=alpha[part, state].ravel(), minlength=size + 1)


def expected(model: Hmm, rows: np.ndarray, marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Counts of these lanes alone: first states, moves, emissions (size x K), and the log-likelihood."""
    counts = Counts(model, size)
    counts.add(rows, marks)
    return counts.first, counts.pairs, counts.seen[:, :size].T, counts.likelihood


def shipped(seen: np.ndarray) -> np.ndarray:
    """Expected counts as the shuffle gets them: in single precision, zero where a state's share of its symbol is below that.

    Most symbols belong to few states, so most of what is sent are zeros, and these take next to no room.
    """
    return np.where(seen < EPSILON * seen.sum(axis=1, keepdims=True), 0, seen).astype(np.float32).astype(float)


def _counts_over(encoded: DataFrame, model: Hmm, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One expectation step over all training rows: (first, moves, emissions, log-likelihood), summed by Spark per symbol.

    One task a core, so that a core adds up all its texts before anything is shuffled, and what is summed grows with the
    cluster and not with the input.
    """
    k = len(model.start)
    sc = encoded.sparkSession.sparkContext
    shared = sc.broadcast(model)  # size x K numbers, size <= HEAD + CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, weight = Counts(shared.value, size), [], 0
        for batch in batches:
            for value in batch.column("syms"):
                held.append(np.frombuffer(value.as_buffer(), np.uint16))
                weight += len(held[-1])
                if weight > BATCH:
                    counts.add(*windows(held, size))
                    held, weight = [], 0
        if held:
            counts.add(*windows(held, size))
        seen, likelihood = counts.seen[:, :size].T, np.full(k, counts.likelihood)
        used = np.flatnonzero(seen.sum(axis=1) > 0)
        keys = np.concatenate([used, [-1], -2 - np.arange(k + 1)]).astype(np.int32)
        values = np.vstack([shipped(seen[used]), counts.first[None], counts.pairs, likelihood[None]])
        yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(values[:, i]) for i in range(k)]], ["sym", *[f"s{i}" for i in range(k)]])

    rows = encoded.where("not held_out").select("syms").coalesce(sc.defaultParallelism).mapInArrow(run, "sym int, " + ", ".join(f"s{i} double" for i in range(k)))
    sums = rows.groupBy("sym").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    summed = sums.select("sym", *[F.col(f"s{i}").cast("float").alias(f"s{i}") for i in range(k)], F.when(F.col("sym") == -2 - k, F.col("s0")).alias("whole")).toArrow()  # size + K + 2 rows at most
    shared.destroy()
    keys = summed.column("sym").to_numpy()
    values = np.stack([summed.column(f"s{i}").to_numpy().astype(float) for i in range(k)], axis=1) if len(keys) else np.zeros((0, k))
    first, pairs, seen, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), 0.0
    seen[keys[keys >= 0]] = values[keys >= 0]
    for at in np.flatnonzero(keys < 0).tolist():
        if keys[at] == -1:
            first = values[at]
        elif keys[at] == -2 - k:
            likelihood = summed.column("whole")[at].as_py()
        else:
            pairs[-2 - keys[at]] = values[at]
    return first, pairs, seen, likelihood


def trained(encoded: DataFrame, book: Symbols, states: int = STATES, settled: float = SETTLED) -> Hmm:
    """Baum-Welch from a random start, each iteration over all training rows, until two in a row gain less than settled."""
    unigram, size = book.unigram(), book.end + 1
    tail = slice(book.tail, book.end)
    model, before, small = random_start(unigram, states, tail=tail), -np.inf, 0
    while small < 2:
        first, pairs, seen, likelihood = _counts_over(encoded, model, size)
        model = model.reestimated(first, pairs, seen, unigram, tail)
        small = small + 1 if likelihood - before < settled * book.tokens or not book.tokens else 0
        before = likelihood
    return model


def log_likelihoods(model: Hmm, syms: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each symbol sequence, exact up to rounding."""
    k = len(model.start)
    flat = np.concatenate([np.zeros(0, np.int64), *syms])
    at = np.concatenate([[0], np.cumsum([len(s) for s in syms])]).astype(np.int64)
    owner, begin, length, init = [], [], [], []
    for i, s in enumerate(syms):
        for low in range(0, len(s), CHUNK if len(s) > LONG else max(len(s), 1)):
            high = min(low + CHUNK, len(s)) if len(s) > LONG else len(s)
            for vector in [model.start] if not low else model.move:
                owner.append(i), begin.append(at[i] + low), length.append(high - low), init.append(vector)
    if not owner:
        return np.zeros(len(syms))
    owner, begin, length, now = np.array(owner), np.array(begin), np.array(length), np.array(init)
    order = np.argsort(-length, kind="stable")
    begin, now, size = begin[order], now[order], length[order]
    logs = np.zeros(len(order))
    active = len(order)
    for t in range(int(size[0])):
        while size[active - 1] <= t:
            active -= 1
        part = (now[:active] @ model.move if t else now[:active]) * model.emit[flat[begin[:active] + t]]
        total = part.sum(axis=1)
        now[:active] = part / total[:, None]
        logs[:active] += np.log(total)
    final, scale = np.empty_like(now), np.empty_like(logs)
    final[order], scale[order] = now, logs
    out = np.zeros(len(syms))
    lane = 0
    while lane < len(owner):
        i, vector, total = owner[lane], final[lane], scale[lane]
        lane += 1
        while lane < len(owner) and owner[lane] == i:  # the chunks that follow, as K rows each
            top = scale[lane : lane + k].max()
            vector = (vector * np.exp(scale[lane : lane + k] - top)) @ final[lane : lane + k]
            total += top + np.log(vector.sum())
            vector = vector / vector.sum()
            lane += k
        out[i] = total
    return out


def _head_scores(encoded: DataFrame, book: Symbols, model: Hmm) -> DataFrame:
    """(uid, doc_id, held_out, n_tokens, tail_tokens, head_base, head_score): log10, all but the tail words' own counts."""
    sc = encoded.sparkSession.sparkContext
    nothing = np.zeros(len(book.tail_words))
    base = np.concatenate([np.log10(book.counts + 0.5), nothing, [np.log10(book.texts + 0.5)]])
    drawn = np.concatenate([np.zeros(book.tail), np.log10(book.tail_mass), [0.0]])
    shared = sc.broadcast((model, base, drawn, book.tail, book.end))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    names = ["uid", "doc_id", "held_out", "n_tokens", "tail_tokens", "head_base", "head_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, logs, masses, tail, end = shared.value
        for batch in batches:
            syms = [np.frombuffer(v.as_buffer(), np.uint16).astype(np.int64) for v in batch.column("syms")]
            score, low, weight = [np.zeros(0)], 0, 0
            for i, s in enumerate(syms):
                weight += len(s)
                if weight > 1 << 19:
                    score.append(log_likelihoods(hmm, syms[low : i + 1]))
                    low, weight = i + 1, 0
            score.append(log_likelihoods(hmm, syms[low:]))
            columns = [pa.array([len(s) for s in syms], pa.int64()), pa.array([int(((s >= tail) & (s < end)).sum()) for s in syms], pa.int64()), pa.array([float(logs[s].sum()) for s in syms], pa.float64()), pa.array(np.concatenate(score) / np.log(10) - np.array([float(masses[s].sum()) for s in syms]), pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names)

    return encoded.select("uid", "doc_id", "held_out", "syms").mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, tail_tokens long, head_base double, head_score double")


def scored(docs: DataFrame, head: int = HEAD, states: int = STATES, settled: float = SETTLED, class_words: int = CLASS_WORDS) -> DataFrame:
    """All rows of docs (doc_id, text, held_out), scored by what the rows that are not held out teach.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram, add one half) and score (the HMM),
    both log10 probabilities of the whole text with its end token.
    """
    sc = docs.sparkSession.sparkContext
    learn = docs.where("not held_out")
    counts = written(word_counts(learn), "word-counts")
    book = symbols(counts, learn.count(), head, class_words)
    encoded = written(_encoded(docs, sc.broadcast(book)), "encoded")
    model = trained(encoded, book, states, settled)
    heads = _head_scores(encoded, book, model)
    spread = encoded.where(F.size("tail_h") > 0).select("uid", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("w")).select("uid", F.col("w.tail_h").alias("h"), F.col("w.tail_n").alias("n"))
    rare = spread.join(counts, "h", "left").select("uid", "n", F.coalesce("c", F.lit(0)).alias("c"))
    tails = rare.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("tail_logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    tokens, kinds = book.tokens, book.vocabulary
    all_mass = float(np.log10(tokens + 0.5 * (kinds + 1)))
    own = F.coalesce("tail_logs", F.lit(0.0))
    known = F.col("n_tokens") - F.col("tail_tokens") + F.coalesce("tail_known", F.lit(0)) - F.lit(int(book.texts == 0))
    return heads.join(tails, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + own - F.col("n_tokens") * F.lit(all_mass)).alias("base_score"),
        (F.col("head_score") + own).alias("score"),
    )


def op9_hmm(spark, sf_dir: str) -> DataFrame:
    """All documents scored; those whose crc32(doc_id as text) mod 5 is 1 are held out, the others train."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return scored(docs.select("doc_id", "text", (fold == 1).alias("held_out")))
