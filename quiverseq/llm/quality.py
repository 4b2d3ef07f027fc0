"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j | text) = logistic(threshold_j - w . x): one weight vector over hashed text for all grades, and ordered
thresholds. The model gives the expected grade and the tail probability P(grade >= least), by which documents are kept.

x holds, for the whole text: each distinct lower-cased word (hashed, 1 if present), the shares of words by shape
(capitals, digits, punctuation, length), and classes of text length and of word repetition.

The model is fitted on a bounded sample of rated documents (PER_GRADE of each grade, those with the least hashes of
doc_id), weighted back to the grades' true shares over all ratings. Documents whose ratings differ count with their least grade;
null ratings are left out. Without two grades there is nothing to learn and every document is kept; if no rating reaches
the least grade to keep, the highest rated grade takes its place. Words in fewer than LEAST_DOCS sampled documents, or
less than LEAST_SHARE of them, get no weight: they are too few to tell grades apart. Null text is empty text.
Empty tables give empty results; repeated rows are judged alike; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .textkernels import U, Words, distinct, slices, text_bytes

#: Weights of words; the dense features follow them.
DIM = 1 << 16
SHAPES, CLASSES = 32, 8
DENSE = SHAPES + 2 * CLASSES
PER_GRADE = 6_000
#: Documents of the sample, and their share of it, that a word needs for a weight.
LEAST_DOCS, LEAST_SHARE = 3, 1 / 900
STEPS, L2, RATE = 250, 2e-4, 0.05

UPPER, DIGIT, PUNCT = (np.zeros(256, np.int64) for _ in range(3))
UPPER[65:91] = 1
DIGIT[48:58] = 1
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of rows: row and slot of each distinct word, and the dense features of each row."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets):
        raw = data[offsets[a] : offsets[b]]
        words = Words(raw, offsets[a : b + 1] - offsets[a])
        row, slot = distinct(words.row, words.hash & U(DIM - 1))
        n = b - a
        dense = np.zeros((n, DENSE))
        total = np.maximum(words.counts, 1)
        if len(words.start):
            length = words.end - words.start
            upper, digit, punct = (np.diff(np.concatenate([[0], np.cumsum(t[raw])])[np.stack([words.start, words.end])], axis=0)[0] for t in (UPPER, DIGIT, PUNCT))
            shape = (upper >= 2) + 2 * (digit >= 1) + 4 * (punct >= 2) + 8 * (punct == length) + 16 * (length > 16)
            dense[:, :SHAPES] = np.bincount(words.row * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES) * 8.0 / total[:, None]
        own = np.bincount(row, minlength=n)
        dense[np.arange(n), SHAPES + np.minimum(np.log2(total).astype(int) // 2, CLASSES - 1)] = 1
        dense[np.arange(n), SHAPES + CLASSES + np.minimum((own / total * CLASSES).astype(int), CLASSES - 1)] = 1
        yield row, slot.astype(np.int64), dense


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class CumulativeLink:
    """Weights (DIM + DENSE) and ascending thresholds, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... in columns."""
        return _sigmoid(z[:, None] - self.thresholds[None, :])

    def linear(self, row: np.ndarray, slot: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=self.weights[slot], minlength=len(dense)) + dense @ self.weights[DIM:]


def fit(row: np.ndarray, slot: np.ndarray, dense: np.ndarray, grade: np.ndarray, share: np.ndarray) -> CumulativeLink:
    """Maximum penalised likelihood by Adam on the full sample; share is each row's weight."""
    grades = int(grade.max()) + 1
    common = np.bincount(slot, minlength=DIM) >= max(LEAST_DOCS, len(dense) * LEAST_SHARE)
    row, slot = row[common[slot]], slot[common[slot]]
    share = share / share.sum()
    w, base = np.zeros(DIM + DENSE), np.zeros(grades - 1)
    below = np.array([np.clip(share[grade <= j].sum(), 1e-3, 1 - 1e-3) for j in range(grades - 1)])
    start = np.log(below / (1 - below))
    base[0], base[1:] = start[0], np.log(np.maximum(np.diff(start), 1e-2))  # gaps are positive by exponentials
    m, v = np.zeros(len(w) + len(base)), np.zeros(len(w) + len(base))
    for step in range(1, STEPS + 1):
        gaps = np.exp(base[1:])
        cuts = np.concatenate([[-np.inf], base[0] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        z = np.bincount(row, weights=w[slot], minlength=len(dense)) + dense @ w[DIM:]
        high, low = _sigmoid(cuts[grade + 1] - z), _sigmoid(cuts[grade] - z)
        p = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        gz = share * (dh - dl)  # of the negative log-likelihood by z
        gw = np.concatenate([np.bincount(slot, weights=gz[row], minlength=DIM), dense.T @ gz]) + L2 * w
        gc = np.zeros(grades - 1)
        for j in range(grades - 1):
            gc[j] = -(share * dh)[grade == j].sum() + (share * dl)[grade == j + 1].sum()
        gb = np.concatenate([[gc.sum()], gaps * np.cumsum(gc[::-1])[::-1][1:]])
        g = np.concatenate([gw, gb])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, base = w - move[: len(w)], base - move[len(w) :]
    return CumulativeLink(w, base[0] + np.concatenate([[0.0], np.cumsum(np.exp(base[1:]))]))


def trained(docs: DataFrame, ratings: DataFrame, per_grade: int = PER_GRADE) -> CumulativeLink | None:
    """The model from docs (doc_id, text) and ratings (doc_id, grade 0, 1, ...)."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sizes = {r[0]: r[1] for r in rated.groupBy("grade").count().collect()}  # one row per grade
    if len(sizes) < 2:
        return None
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = [rated.where(F.col("grade") == g).orderBy(*order).limit(per_grade) for g in sorted(sizes)]
    sample = picked[0]
    for more in picked[1:]:
        sample = sample.unionByName(more)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")  # per_grade rows of each grade at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, dense = [], []
            for row, slot, shape in features(batch.column("text")):
                slots += np.split(slot.astype(np.uint16), np.searchsorted(row, np.arange(1, len(shape))))
                dense += list(shape.astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([s.tobytes() for s in slots], pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary())], ["doc_id", "grade", "slots", "dense"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"doc_id {kind}, grade int, slots binary, dense binary").toArrow()  # per_grade rows of each grade, of 2 x DIM bytes at most
    ids, grade, packed = found.column("doc_id").to_pylist(), found.column("grade").to_pylist(), found.column("slots").to_pylist()
    rows = sorted(range(len(ids)), key=lambda i: (ids[i], grade[i], packed[i]))  # so that the order of tasks changes nothing
    grade = np.array(grade, np.int64)[rows]
    if len(set(grade.tolist())) < 2:
        return None
    slots = [np.frombuffer(packed[i], np.uint16) for i in rows]
    dense = np.stack([np.frombuffer(x, np.float32) for x in found.column("dense").to_pylist()]).astype(float)[rows]
    counts = np.bincount(grade)
    share = np.array([sizes[g] / counts[g] for g in grade])
    return fit(np.repeat(np.arange(len(rows)), [len(s) for s in slots]), np.concatenate(slots).astype(np.int64), dense, grade, share)


def rated(docs: DataFrame, model: CumulativeLink | None, least: int = 2, cut: float = 0.5) -> DataFrame:
    """All rows and columns of docs, with expected_grade, tail = P(grade >= least), and keep = tail >= cut.

    least is the highest rated grade if that is lower. Without a model: null, null and true. Columns of these names are replaced.
    """
    docs = docs.drop("expected_grade", "tail", "keep")
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail": F.lit(None).cast("double"), "keep": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM + DENSE weights, whatever the input
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<expected_grade:double,tail:double>")
    def judge(column: pa.Array) -> pa.Array:
        expected, tail = [], []
        for row, slot, dense in features(column):
            tails = shared.value.tails(shared.value.linear(row, slot, dense))
            expected.append(tails.sum(axis=1))
            tail.append(tails[:, min(least, tails.shape[1]) - 1])
        columns = [pa.array(np.round(np.concatenate(x), 6) if x else [], pa.float64()) for x in (expected, tail)]
        return pa.StructArray.from_arrays(columns, ["expected_grade", "tail"])

    judged = docs.withColumn("_judged", judge(F.col("text")))
    return judged.withColumns({"expected_grade": F.col("_judged.expected_grade"), "tail": F.col("_judged.tail"), "keep": F.col("_judged.tail") >= cut}).drop("_judged")


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from labels: toxic is 0, low quality 1, good quality 2."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1), 2)
    return labels.select("doc_id", grade.cast("int").alias("grade"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """All documents rated by the model that is fitted on labels: doc_id, expected_grade, tail, keep."""
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, grades(table(spark, sf_dir, "labels")))
    return rated(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "tail", "keep")
