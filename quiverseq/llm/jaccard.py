"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order, that of their 64-bit hashes, and the order is cut into fragments: coarse ones for
counting, finer ones for finding candidates. A document's set falls apart into one segment per fragment.

Candidates. Sets of a and b n-grams at similarity t or more differ in at most h = (1 - t) / (1 + t) (a + b) n-grams, and each
of these spoils one fragment only. So of any h + 1 fragments one at least holds equal segments, and a signature for each
segment finds the pair. Lists are partitioned by set length: the order is cut for the lengths of one band, and a set
takes part in the band of its own length and in those that a longer partner may lie in. Segments of one n-gram or of
common n-grams alone (whose hash bucket stands out in a frequency sketch) meet by chance, so a set gives the first h + 1
segments that are better than that, however many fragments this takes; two such sets still share one of them. Sets that
have too few get, in a list of signatures of their own, the first h + 1 of two n-grams or more, and if these are too few,
too, all of the first h + 1 segments, empty ones included. So no pair at t or above is lost at any level.

Verification. Candidates pass the length bound, a bound by the n-grams that each of the two has alone, and have parity
bitmaps (folded ones first) that differ in few enough bits; each of these tests is one that every pair at t or above passes. Their overlaps
are counted fragment by fragment and summed per pair, so no task holds whole sets.

Groups of near copies would give a number of pairs that grows with the square of the group. Components need no more
than a spanning set of links, so every list of documents behind a shared signature is worked off by hubs: the member
with the least n-grams of its own (an original has none that its copies lack, while an edited copy has its edits) is
compared with the others; then members in random order, in growing blocks, but only with later ones that are still in
another component. Each pair of a list is thus either compared or already connected; no link is lost. Lists are never
brought together in one task: hubs come from partial aggregates and are joined to the members.

Documents with equal sets are one class from the start. n-grams and sets are known by 64 hash bits: that any two of a
billion different sets count as equal has a chance of about 0.03.

Empty tables give empty results; other columns than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, drop_paths, noted, table, written
from .components import components
from .textkernels import U, Words, distinct, lists, mix, row_sums, shingles, slices, text_bytes

#: Hash buckets of the frequency sketch (2**16 longs reach driver and executors, whatever the input).
SKETCH = 1 << 16
#: Bits of the filters that spare shuffles, at most; what passes by chance costs work, never a result.
FILTER = 1 << 27
#: Bits of the parity bitmap of a set: toggled once per n-gram, so two bitmaps differ in no more bits than two sets in n-grams.
PARITY = 1024
#: Words of the folded bitmap that lists carry.
FOLD = 4
#: Fragments that overlaps are counted in, as a power of two.
FRAGMENT_BITS = 3
#: Lengths of a band: the next band begins at so many times its least length.
BAND = 1.5
#: Hubs per round grow by this factor.
GROWTH = 8


def bands(most: int) -> np.ndarray:
    """Least lengths of the bands, up to the one that holds most, and the bound of the last."""
    least = [1]
    while least[-1] <= most:
        least.append(max(least[-1] + 1, int(least[-1] * BAND)))
    return np.array(least, np.int64)


def _sets(column: pa.Array, cut: Callable) -> Iterator[tuple]:
    """For slices of rows: first and end row, row and code of the distinct n-grams (ascending), size and class of each set.

    cut makes (row, hash) of the n-grams of Words.
    """
    data, offsets = text_bytes(column)
    for a, b in slices(offsets):
        row, code = distinct(*cut(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
        size = np.bincount(row, minlength=b - a)
        own = mix(row_sums(row, mix(code ^ U(0x5851F42D4C957F2D)), b - a) ^ mix(size.astype(U)))
        yield a, b, row, code, size, own.view(np.int64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & U(SKETCH - 1)).astype(np.int64)


def _profile(docs: DataFrame, cut: Callable) -> DataFrame:
    """Rows (doc_id, n, cls) of documents, and rows (bucket, n) with each task's sketch counts."""
    names = ["doc_id", "bucket", "n", "cls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            sizes, classes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, _, code, size, own in _sets(batch.column("text"), cut):
                counts += np.bincount(_bucket(code), minlength=SKETCH)
                sizes.append(size)
                classes.append(own)
            n, cls = np.concatenate(sizes), np.concatenate(classes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.nulls(len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(cls, pa.int64(), mask=n == 0)], names)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()), pa.nulls(len(used), pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, bucket int, n long, cls long")


def _common(profile: DataFrame) -> np.ndarray:
    """Which buckets of the sketch stand out from its noise."""
    counts = np.zeros(SKETCH, np.int64)
    found = profile.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most SKETCH rows
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    middle = np.median(counts)
    return counts > middle + 4 * np.sqrt(middle + 1)


def _emitted(row: np.ndarray, code: np.ndarray, size: np.ndarray, common: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all sets, sorted by row: in each band of theirs, enough segments that partners at t share one."""
    rows, sigs = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    if not len(row):
        return rows[0], sigs[0]
    least = bands(int(size.max()) * den // max(num, 1) + 1)
    partner = size * den // num
    own, last = (np.searchsorted(least, x, "right") - 1 for x in (size, partner))
    rare = ~common[_bucket(code)]
    value = mix(code ^ U(0xC2B2AE3D27D4EB4F))
    for step in range(int((last - own)[size > 0].max(initial=0)) + 1):
        band = own + step
        longest = least[np.minimum(band + 1, len(least) - 1)] - 1
        need = (den - num) * (size + np.minimum(partner, longest)) // (den + num) + 1
        most = (den - num) * 2 * longest // (den + num)
        parts = most + 1 + -(-most // 4)
        # Sets with need 1 have no partners but equal ones, which are of their class.
        takes = (size > 0) & (band <= last) & (need > 1)
        at = np.flatnonzero(takes[row])
        r = row[at]
        part = ((code[at] >> U(32)) * parts[r].astype(U) >> U(32)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        segment = np.append(first, len(at))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(value[at], dtype=U)])
        held = sums[segment[1:]] - sums[segment[:-1]]
        several = np.diff(segment) > 1
        rarest = np.concatenate([[0], np.cumsum(rare[at])])
        r, part = r[first], part[first]
        mark = lambda r, part: mix((band[r].astype(U) << U(40)) ^ part.astype(U))
        left = takes
        for level, fit in enumerate((several & (np.diff(rarest[segment]) > 0), several)):
            use = np.flatnonzero(fit & left[r])
            owner = r[use]
            place = np.arange(len(use)) - np.searchsorted(owner, owner)
            use = use[place < need[owner]]
            rows.append(r[use])
            sigs.append(mix(held[use] + mark(r[use], part[use]) + U(level)))
            left = left & (np.bincount(owner, minlength=len(size)) < need)
        poor = np.flatnonzero(left)  # all of the first segments, empty ones included
        if len(poor):
            begin = np.concatenate([[0], np.cumsum(need[poor])])
            whole = np.repeat(poor, need[poor])
            place = np.arange(len(whole)) - np.repeat(begin[:-1], need[poor])
            content = np.zeros(len(whole), U)
            use = np.flatnonzero(left[r] & (part < need[r]))
            content[begin[np.searchsorted(poor, r[use])] + part[use]] = held[use]
            rows.append(whole)
            sigs.append(mix(content + mark(whole, place) + U(2)))
    out, sig = np.concatenate(rows), np.concatenate(sigs)
    order = np.argsort(out, kind="stable")
    return out[order], sig[order]


class _Fresh:
    """Which rows bring a class that the task has not met; a task that has met very many begins anew."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, own: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        fresh = np.zeros(len(own), bool)
        for i in np.flatnonzero(wanted):
            if own[i] not in self.seen:
                fresh[i] = True
                self.seen.add(int(own[i]))
        if len(self.seen) > 1 << 18:
            self.seen.clear()
        return fresh


def _signed(docs: DataFrame, cut: Callable, common, num: int, den: int, shared=None) -> DataFrame:
    """(sig, cls) of all classes; with a filter of shared signatures those alone, and n and degree, how many a class has.

    A class may come once from each task.
    """
    names = ["sig", "cls"] if shared is None else ["sig", "cls", "n", "degree"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for batch in batches:
            for _, _, row, code, size, own in _sets(batch.column("text"), cut):
                keep = fresh(own, size > 0)
                at = keep[row]
                r, sig = _emitted(row[at], code[at], np.where(keep, size, 0), common.value, num, den)
                if shared is not None:
                    pick = _passes(shared.value, sig.view(np.int64))
                    r, sig = r[pick], sig[pick]
                columns = [sig.view(np.int64), own[r], size[r], np.bincount(r, minlength=len(size))[r]][: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select("text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _segments(docs: DataFrame, cut: Callable, wanted) -> DataFrame:
    """(cls, fragment, grams) of all classes that pass the filter; fragment -1 is the parity bitmap.

    A class may come once from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for batch in batches:
            for _, _, row, code, size, own in _sets(batch.column("text"), cut):
                keep = fresh(own, (size > 0) & _passes(wanted.value, own))
                row, code = row[keep[row]], code[keep[row]]
                cells, first = np.unique((row << FRAGMENT_BITS) + (code >> U(64 - FRAGMENT_BITS)).astype(np.int64), return_index=True)
                grams = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(code.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(own[cells >> FRAGMENT_BITS], pa.int64()), pa.array((cells & (1 << FRAGMENT_BITS) - 1).astype(np.int32)), grams], ["cls", "fragment", "grams"])
                rows = np.flatnonzero(keep)
                parity = _parity(np.searchsorted(rows, row), code, len(rows))
                grams = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (PARITY // 64)), pa.array(parity.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(own[rows], pa.int64()), pa.array(np.full(len(rows), -1, np.int32)), grams], ["cls", "fragment", "grams"])

    return docs.select("text").mapInArrow(run, "cls long, fragment int, grams array<bigint>")


def _parity(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """(rows, PARITY / 64) words of the sets' parity bitmaps."""
    bits = np.bincount(row * PARITY + ((h >> U(20)) & U(PARITY - 1)).astype(np.int64), minlength=rows * PARITY) & 1
    return np.packbits(bits.astype(np.uint8).reshape(rows, PARITY), axis=1).view(np.int64)


def _filter(rows: DataFrame, column: str = "cls") -> np.ndarray:
    """A bit for each value by its hash, 16 bits a row but FILTER at most; so many bits reach the driver as 64-bit words."""
    size = 1 << 12
    most = rows.count()
    while size < min(16 * most, FILTER):
        size *= 2
    at = F.col(column).bitwiseAND(F.lit(size - 1))
    words = rows.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(U)


def _passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (64 * len(bits) - 1)
    return (bits[at >> 6] >> (at & 63).astype(U)) & U(1) > 0


def _passing(rows: DataFrame, wanted) -> DataFrame:
    """The rows whose class passes the filter; nothing is shuffled for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_passes(wanted.value, batch.column("cls").to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls"))


def _pairs(joined: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b, na, nb) of joined rows (x, y, nx, ny, px, py, fx, fy) that may reach t.

    n is a set's length and p how many of its n-grams no other class has, so the overlap is n - p at most for either set,
    and the sets differ in both p at least. They also differ in as many n-grams as their folded bitmaps f in bits.
    """
    length = F.lit(den) * F.least("nx", "ny") >= F.lit(num) * F.greatest("nx", "ny")
    overlap = F.lit(den + num) * F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= F.lit(num) * (F.col("nx") + F.col("ny"))
    bits = reduce(Column.__add__, [F.bit_count(F.col("fx")[f"f{i}"].bitwiseXOR(F.col("fy")[f"f{i}"])) for i in range(FOLD)])
    apart = F.lit(den + num) * F.greatest(F.col("px") + F.col("py"), bits.cast("long")) <= F.lit(den - num) * (F.col("nx") + F.col("ny"))
    swap = F.col("x") > F.col("y")
    return joined.where(length & overlap & apart).select(*[F.when(swap, F.col(v)).otherwise(F.col(u)).alias(name) for name, u, v in (("a", "x", "y"), ("b", "y", "x"), ("na", "nx", "ny"), ("nb", "ny", "nx"))]).distinct()


def _near_enough(pairs: DataFrame, parity: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose parity bitmaps differ in no more bits than the sets may in n-grams; no pair at or above t is lost."""
    left, right = parity.select(F.col("cls").alias("a"), F.col("grams").alias("ba")), parity.select(F.col("cls").alias("b"), F.col("grams").alias("bb"))
    apart = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    met = pairs.join(left, "a").join(right, "b")
    return met.where(F.lit(den + num) * apart <= F.lit(den - num) * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, na, nb, overlap): partial overlaps are counted in each fragment and summed per pair."""
    left = segments.select(F.col("cls").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("cls").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))


def _links(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) of the pairs at t or above, written."""
    met = written(pairs, "met")
    sc = pairs.sparkSession.sparkContext
    parity = _passing(segments.where("fragment = -1"), sc.broadcast(_filter(_ends(met)))).dropDuplicates(["cls"])
    near = written(_near_enough(met, parity, num, den), "pairs")
    own = _passing(segments.where("fragment >= 0"), sc.broadcast(_filter(_ends(near)))).dropDuplicates(["cls", "fragment"])
    found = _overlaps(near, own).where(F.lit(den) * F.col("overlap") >= F.lit(num) * (F.col("na") + F.col("nb") - F.col("overlap")))
    links = written(found.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    drop(met, near)
    return links


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(cls, root) by all links so far: those behind labels, and new ones. Drops the tables given."""
    edges = links if labels is None else links.unionByName(labels.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    with noted() as paths:
        roots = components(edges)
    found = written(roots.select(F.col("node").alias("cls"), "root"), "labels")
    drop(links, *([labels] if labels is not None else []))
    drop_paths(found.sparkSession, paths)
    return found


def linked_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, cut: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, cls) and roots (cls, root) of classes that have a link; t = num / den.

    cut replaces the k-word shingles by other n-grams. Two written tables stay behind the result; all others are dropped.
    """
    cut = cut or partial(shingles, k=k)
    sc = docs.sparkSession.sparkContext
    profile = written(_profile(docs, cut), "sets")
    common = sc.broadcast(_common(profile))
    twice = _signed(docs, cut, common, num, den).groupBy("sig").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("sig")
    shared = written(twice, "shared")
    live = written(_signed(docs, cut, common, num, den, sc.broadcast(_filter(shared, "sig"))).dropDuplicates(["sig", "cls"]), "live")
    drop(shared)
    listed = written(live.join(live.groupBy("sig").count().where("count > 1").select("sig"), "sig"), "listed")
    drop(live)
    own = profile.where("bucket is null").select("doc_id", "n", "cls")
    known = _filter(listed)
    if not known.any():
        drop(listed)
        return own, docs.sparkSession.createDataFrame([], "cls long, root long")
    segments = written(_segments(docs, cut, sc.broadcast(known)), "segments")
    hopeful = written(_hopeful(listed, segments, num, den), "hopeful")
    drop(listed)
    hub = F.max(F.struct((-F.col("alone") / F.col("n")).alias("kin"), "degree", F.xxhash64("cls").alias("tie"), "cls", "n", "alone", "fold")).alias("hub")
    heads = hopeful.groupBy("sig").agg(hub, F.count("*").alias("size")).where("size > 1").select("sig", "size", F.col("hub.cls").alias("x"), F.col("hub.n").alias("nx"), F.col("hub.alone").alias("px"), F.col("hub.fold").alias("fx"))
    members = written(hopeful.drop("degree").join(heads, "sig").where("cls <> x"), "members")
    drop(hopeful)
    links = _links(_pairs(members.withColumnsRenamed({"cls": "y", "n": "ny", "alone": "py", "fold": "fy"}), num, den), segments, num, den)
    labels = _joined(None, links)
    # From here on lists are without their first hubs, which have met all others.
    place = F.abs(F.shiftright(F.xxhash64("cls", F.lit(1)), 1)) / F.lit(float(1 << 62)) * F.col("size")
    left, bound, before = members.where("size > 2").select("sig", "cls", "n", "alone", "fold", "size", place.alias("place")), 1, members
    while True:
        left = written(_spanning(left, labels), "left")
        drop(before)
        longest = left.agg(F.max("size")).first()[0] or 0  # 0 if no list is left
        if longest > bound:
            bound *= GROWTH
            hubs = left.where(F.col("place") < bound).select("sig", *[F.col(c).alias(x) for c, x in (("cls", "x"), ("n", "nx"), ("alone", "px"), ("fold", "fx"), ("comp", "cx"), ("place", "at"))])
            others = left.withColumnsRenamed({"cls": "y", "n": "ny", "alone": "py", "fold": "fy", "comp": "cy"})
            met = hubs.join(others, "sig").where("cx <> cy and (place > at or place = at and y > x)")
            links = _links(_pairs(met, num, den), segments, num, den)
            labels = labels if links.isEmpty() else _joined(labels, links)
        if longest <= bound:
            drop(left, segments)
            return own, labels
        before, left = left, left.where(F.col("place") >= bound).drop("comp")


def _hopeful(listed: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """listed with alone and fold, less classes that have no partner.

    alone is the number of a class's n-grams that no other listed class has. A class that links to any is in a list with
    it, so these n-grams are missing from all that it may link to. fold is the parity bitmap folded to FOLD words.
    """
    spread = segments.where("fragment >= 0").select("cls", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("cls").alias("cls"), F.max("cls").alias("last"))
    alone = spread.where("cls = last").groupBy("cls").agg(F.count("*").alias("alone"))
    words = [reduce(Column.bitwiseXOR, [F.col("grams")[j] for j in range(i, PARITY // 64, FOLD)]).alias(f"f{i}") for i in range(FOLD)]
    folded = segments.where("fragment = -1").dropDuplicates(["cls"]).select("cls", F.struct(*words).alias("fold"))
    counted = listed.join(folded.join(alone, "cls", "left"), "cls").withColumn("alone", F.coalesce("alone", F.lit(0)))
    return counted.where(F.lit(den) * (F.col("n") - F.col("alone")) >= F.lit(num) * F.col("n"))


def _spanning(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that span two components, each member with its component."""
    with_comp = lists.join(labels, "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
    open_ = with_comp.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    return with_comp.join(open_, "sig")


def near_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, cut: Callable | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included).

    docs has doc_id and text. Two documents link when den x intersection >= num x union of their k-word shingle sets; a
    text of fewer words has its whole sequence as one shingle. Null or empty texts have size 0 and no links. Repeated
    rows come back once each. A null doc_id stays null unless linked.
    """
    own, roots = linked_classes(docs, k, num, den, cut)
    classes = own.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("cls", "component_id")
    joined = own.join(named, "cls", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    """All documents by 3-word shingles at a Jaccard similarity of 0.9 or more."""
    return near_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) c USING (doc_id)
"""
