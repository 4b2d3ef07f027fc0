"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

The anchors are the most frequent words of the whole corpus, so no language needs a stop-word list. After each anchor
the next content words (those that are no anchors) form a chain; anchor and chain make one signature, and the set of a
text's signatures, 32 bits each, is its fingerprint. Sets are compared by Jaccard similarity, pruned by set length: two
sets whose lengths fall into bands further apart than neighbours, or whose lengths alone rule the threshold out, are
not merged at all.

A stretch of FREE words or more in which no word begins a chain (texts of small languages or with marks stuck to their
words, whose words are none of the corpus's most frequent) has a signature at each of its places instead: of the word
there and the next ones, as many as in a chain. So every FREE words in sequence give a signature of their own, and an
edit changes signatures near it alone. A shorter text without any full anchor but with words has one signature, of its
whole word sequence. Null, empty and blank texts have the empty fingerprint; two empty ones are alike (1), an empty and
another are not (0). Near the end of a text a chain may be shorter. Repeated rows come back once each, empty tables give
empty results, and other columns than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .textkernels import U, Words, distinct, mix, row_sums, slices, text_bytes

BUCKETS = 1 << 16
ANCHORS, CHAIN = 64, 2
#: Words without the start of a chain from which on a stretch has signatures of its own.
FREE = 15
LOWEST = -(1 << 63)


def common_words(docs: DataFrame, n: int = ANCHORS) -> list[tuple[int, str, int]]:
    """Exactly the n most frequent words of all texts: (hash, word, count), ties by hash.

    All words are counted into hash buckets first. Only words of the heaviest buckets are then counted one by one; if
    the last word chosen is no rarer than the heaviest bucket left out, no word there can belong; else more buckets follow.
    """

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in slices(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts += np.bincount((words.hash & U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["bucket", "n"])

    texts = docs.select("text")
    totals = np.zeros(BUCKETS, np.int64)
    for bucket, count in texts.mapInArrow(bucketed, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # at most BUCKETS rows
        totals[bucket] = count
    order = np.argsort(-totals, kind="stable")
    tried = 8 * n
    while True:
        heavy = np.zeros(BUCKETS, bool)
        heavy[order[:tried]] = True

        def counted(batches: Iterator[pa.RecordBatch], heavy=heavy) -> Iterator[pa.RecordBatch]:
            found: dict[int, list] = {}
            for batch in batches:
                data, offsets = text_bytes(batch.column(0))
                for a, b in slices(offsets):
                    words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    at = np.flatnonzero(heavy[(words.hash & U(BUCKETS - 1)).astype(np.int64)])
                    values, first, counts = np.unique(words.hash[at], return_index=True, return_counts=True)
                    for h, i, c in zip(values.view(np.int64).tolist(), at[first].tolist(), counts.tolist()):
                        have = found.get(h)
                        if have is None:
                            found[h] = [words.word(i).decode("utf-8", "replace"), c]
                        else:
                            have[1] += c
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([w for w, _ in found.values()], pa.string()), pa.array([c for _, c in found.values()], pa.int64())], ["h", "word", "n"])

        per = texts.mapInArrow(counted, "h long, word string, n long").groupBy("h").agg(F.min("word").alias("word"), F.sum("n").alias("n"))
        best = [tuple(r) for r in per.orderBy(F.desc("n"), "h").limit(n).collect()]
        if tried >= BUCKETS or len(best) == n and best[-1][2] >= totals[order[tried]]:
            return best
        tried *= 4


def chains(words: Words, anchors: np.ndarray, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), in row order, of each anchor with the content words that follow it, and of free stretches.

    anchors is the sorted array of anchor word hashes.
    """
    n = len(words.hash)
    common = anchors[np.minimum(np.searchsorted(anchors, words.hash), len(anchors) - 1)] == words.hash if len(anchors) else np.zeros(n, bool)
    content = np.append(np.flatnonzero(~common), np.full(chain, n))
    spot = np.flatnonzero(common)
    row_of, hash_of = np.append(words.row, -1), np.append(words.hash, U(0))
    at = np.searchsorted(content[: len(content) - chain], spot)
    h, some = words.hash[spot], np.zeros(len(spot), bool)
    for j in range(chain):
        follow = content[at + j]
        inside = row_of[follow] == words.row[spot]
        h = mix(h + np.where(inside, hash_of[follow], U(0)) + U(j + 1))
        some |= inside
    row, h = words.row[spot][some], h[some]
    free = _free(words, spot[some], chain)
    if len(free):
        own = np.zeros(len(free), U)
        for j in range(chain + 1):
            own = mix(own + words.hash[free + j] + U(j + 1))
        row, h = np.concatenate([row, words.row[free]]), np.concatenate([h, own])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    bare = np.flatnonzero((words.counts > 0) & (np.bincount(row, minlength=words.rows) == 0))
    if len(bare):
        place = np.arange(n) - words.firsts[words.row]
        whole = mix(row_sums(words.row, mix(words.hash + place.astype(U)), words.rows))[bare]
        row, h = np.concatenate([row, bare]), np.concatenate([h, whole])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, h


def _free(words: Words, begins: np.ndarray, chain: int) -> np.ndarray:
    """Places of words that begin a run of chain + 1 words within a stretch of FREE words or more, none of which is in begins."""
    n = len(words.hash)
    breaks = np.zeros(n + 1, bool)
    breaks[words.firsts] = True
    apart = np.zeros(n, bool)
    apart[begins] = True
    # A stretch is what lies between two chain starts or row edges; a chain start is a stretch of one word.
    breaks[:-1] |= apart
    breaks[begins + 1] = True
    edge = np.flatnonzero(breaks)
    size = np.diff(edge)
    wide = size >= max(FREE, chain + 1)
    first, runs = edge[:-1][wide], size[wide] - chain
    return np.repeat(first - np.append(0, np.cumsum(runs)[:-1]), runs) + np.arange(runs.sum())


def signatures(column: pa.Array, anchors: np.ndarray, chain: int = CHAIN) -> list[np.ndarray]:
    """Per row the sorted distinct 32-bit signatures; anchors is the sorted array of anchor word hashes."""
    data, offsets = text_bytes(column)
    out: list[np.ndarray] = []
    for a, b in slices(offsets):
        row, h = chains(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), anchors, chain)
        row, h = distinct(row, h >> U(32))
        out += np.split(h.astype(np.uint32), np.searchsorted(row, np.arange(1, b - a)))
    return out


def near_duplicates(docs: DataFrame, anchors: list[int] | None = None, chain: int = CHAIN, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_signatures, component_id: classes of documents whose signature sets reach num / den.

    The join is the pruned one of the jaccard module, over signatures instead of shingles: lists partitioned by set
    length, pairs pruned by length and parity bitmaps, and verified exactly.
    """
    from .jaccard import near_components

    known = np.sort(np.array(anchors if anchors is not None else [h for h, _, _ in common_words(docs)], np.int64).view(U))
    found = near_components(docs, chain + 1, num, den, partial(chains, anchors=known, chain=chain))
    return found.withColumnRenamed("n_shingles", "n_signatures")


def fingerprint(sigs: np.ndarray) -> str:
    """The set as text: base64 of the ascending big-endian 32-bit signatures."""
    return base64.b64encode(sigs.astype(">u4").tobytes()).decode()


def band(size: int, least: float) -> int:
    """The length partition of a set: sets at Jaccard least or more lie in the same or neighbouring bands."""
    return int(math.log(max(size, 1)) / -math.log(least)) if 0 < least < 1 else 0


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets, or 0 as soon as it is known to lie under least."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if least > 0 and (abs(band(len(a), least) - band(len(b), least)) > 1 or min(len(a), len(b)) < least * max(len(a), len(b))):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    shared = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    found = shared / (len(a) + len(b) - shared)
    return found if found >= least else 0.0


def _splits(docs: DataFrame) -> list[int]:
    """Doc-id bounds of ranges with about equal numbers of rows, descending ranges; as many as shuffle partitions."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    shares = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx("key", F.array(*map(F.lit, shares)), 20 * n)).first()[0]
    return sorted(set(found or []))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, range, tail) in the order that pairs each document with the next one, by descending doc_id.

    Rows are dealt by ranges of doc_id and sorted within; a range's last document finds its follower as an extra row
    (tail = 1), a copy of the first document of the next range that has any. The last document's next is the first.
    Equal doc_ids follow in order of text hash; null ones come last.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(LOWEST)).alias("key"), "text")
    bounds = _splits(keyed)
    spot = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x > F.col("key"))) if bounds else F.lit(0)
    ranged = keyed.withColumn("range", spot)
    heads = ranged.groupBy("range").agg(F.max("key").alias("key")).orderBy("range").collect()  # one row per range
    if not heads:
        return ranged.withColumn("tail", F.lit(0))
    before = [heads[i - 1]["range"] for i in range(len(heads))]
    # A head that ends several ranges cannot occur: ranges are disjoint and heads are in their own.
    ends = F.create_map(*[F.lit(x) for h, r in zip(heads, before) for x in (h["key"], r)])
    tails = keyed.where(F.col("key").isin([h["key"] for h in heads])).withColumn("range", F.element_at(ends, F.col("key")))
    rows = ranged.withColumn("tail", F.lit(0)).unionByName(tails.withColumn("tail", F.lit(1)))
    dealt = rows.repartition(max(len(heads), 1), "range")
    return dealt.sortWithinPartitions("range", "tail", F.desc("key"), F.xxhash64("text")).select("doc_id", "text", "range", "tail")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the following one."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, anchors: list[int], chain: int = CHAIN) -> DataFrame:
    """Per document of (doc_id, text) its fingerprint, that of its edited text, and their likeness."""
    known = np.sort(np.array(anchors, np.int64).view(U))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"

    def results(ids: list, texts: list[str], follows: list[str], sets: list, next_sets: list) -> pa.RecordBatch:
        changed = [edited(t, f) for t, f in zip(texts, follows)]
        changed_sets = signatures(pa.array(changed, pa.large_string()), known, chain)
        columns = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(map(fingerprint, sets), pa.string()), pa.array(map(fingerprint, changed_sets), pa.string()),
            pa.array(map(likeness, sets, changed_sets), pa.float64()), pa.array(map(likeness, sets, next_sets), pa.float64()), pa.array(map(len, sets), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, which waits for its follower: range, tail, id, text, signatures
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets):
                part = batch.slice(a, b - a)
                ids, ranges, tails = (part.column(c).to_pylist() for c in ("doc_id", "range", "tail"))
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = list(zip(ranges, tails, ids, texts, signatures(part.column("text"), known, chain)))
                rows = [held, *rows] if held else rows
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
                held = rows[-1]
                if pairs:
                    yield results([x[2] for x, _ in pairs], [x[3] for x, _ in pairs], [y[3] for _, y in pairs], [x[4] for x, _ in pairs], [y[4] for _, y in pairs])

    return with_next(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, schema)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents by the 64 most frequent words of the corpus as anchors and chains of two content words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints(docs, [h for h, _, _ in common_words(docs)])


def spotsigs_classes(spark, sf_dir: str) -> DataFrame:
    """All documents by the length-partitioned, pruned join of their signature sets at a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
