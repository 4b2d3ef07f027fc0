"""Exact local-alignment search: frames, scores, top hits, alignments, as one DataFrame plan.

Queries are few: their frames reach the driver, behind a check of their total size, and are broadcast. The database
is scanned once, filtered before the kernel; each task keeps the best K hits of each query and emits no more, so the
one shuffle (the final ranking) carries at most tasks x queries x K rows. Sequences are fetched again for shown hits alone.

Where only hits are asked for, a first scan looks for sequences with the highest score that a query can have at all. A
query with K of them needs no dynamic programming, since no other sequence can be among its hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverseq.functions import stats
from quiverseq.functions.alphabets import DIFFERENCES, encode, residues, reverse_complement, translated
from quiverseq.functions.matrices import matrix, nucleotide_matrix
from quiverseq.operators.alignment import Scoring, align, rescored, statistics, text_lines
from quiverseq.operators.ceilings import ceiling, reaching
from quiverseq.operators.kernels import batch_scores
from quiverseq.plans.store import discarded, stored

PROGRAMS = ("blastn", "blastp", "blastx", "tblastn", "tblastx", "sound")
#: Residues of all query frames together that are broadcast at most; split larger query sets over several searches.
MOST_QUERY = 50_000_000
HIT = "qno int, seqno long, qstrand int, qframe int, dstrand int, dframe int, score long"
#: Residues that are searched for ceilings at once.
SLICE = 1 << 21
RANKING = ("score desc", "seqno desc", "qstrand", "qframe", "dstrand", "dframe")


@dataclass(frozen=True)
class Options:
    """All options of a search; None means the default of the scoring system."""

    program: str = "blastp"
    matrix: str = "BLOSUM62"
    match: int = 1
    mismatch: int = -3
    gap_open: int | None = None
    gap_extend: int | None = None
    strands: int = 3
    query_code: int = 1
    db_code: int = 1
    expect: float = 10.0
    min_expect: float = 0.0
    min_score: int = 1
    max_score: int | None = None
    descriptions: int = 250
    alignments: int = 100
    db_size: int | None = None
    parameters: dict | None = None

    def __post_init__(self):
        if self.program not in PROGRAMS:
            raise ValueError(f"no program {self.program!r}")
        if self.strands not in (1, 2, 3):
            raise ValueError("strands must be 1 (plus), 2 (minus) or 3 (both)")
        if self.strands == 2 and self.program in ("blastp", "tblastn", "sound"):
            raise ValueError("protein queries have no minus strand")
        if not {self.query_code, self.db_code} <= set(DIFFERENCES):
            raise ValueError("no such genetic code")
        if min(self.gap_open or 0, self.gap_extend or 0) < 0 or self.min_score < 1 or self.descriptions < 0 or self.alignments < 0:
            raise ValueError("an option is below its least value")
        if self.max_score is not None and self.max_score < self.min_score or self.min_expect < 0 or self.min_expect > self.expect or self.expect <= 0:
            raise ValueError("the bounds exclude every hit")
        self.gaps()

    def gaps(self) -> tuple[int, int]:
        if self.program == "blastn":
            default = stats.NUCLEOTIDE_GAPS
        else:
            default = stats.DEFAULT_GAPS.get("IDENTITY_5_1" if self.program == "sound" else self.matrix.upper())
        if default is None and None in (self.gap_open, self.gap_extend):
            raise ValueError(f"matrix {self.matrix!r} has no default gap penalties")
        return default[0] if self.gap_open is None else self.gap_open, default[1] if self.gap_extend is None else self.gap_extend

    def scoring(self) -> Scoring:
        scores = nucleotide_matrix(self.match, self.mismatch) if self.program == "blastn" else matrix("IDENTITY_5_1" if self.program == "sound" else self.matrix)
        return Scoring(scores, *self.gaps())

    def statistics(self) -> stats.Parameters | None:
        """tblastx takes the ungapped parameters although its search is gapped."""
        if self.program == "blastn":
            return stats.nucleotide_parameters(self.match, self.mismatch, *self.gaps())
        gaps = (stats.UNGAPPED, stats.UNGAPPED) if self.program == "tblastx" else self.gaps()
        return None if self.program == "sound" else stats.protein_parameters(self.matrix, *gaps, self.parameters)

    @property
    def kind(self) -> str:
        return {"blastn": "nucleotide", "sound": "sound"}.get(self.program, "protein")

    @property
    def query_kind(self) -> str:
        return "nucleotide" if self.program in ("blastn", "blastx", "tblastx") else self.kind

    @property
    def db_kind(self) -> str:
        return "nucleotide" if self.program in ("blastn", "tblastn", "tblastx") else self.kind


def query_frames(queries: DataFrame, options: Options) -> DataFrame:
    """(qno, qstrand, qframe, residues, nt_length) of the strands and frames that the program compares."""
    base = queries.select("qno", F.length("residues").alias("nt_length"), "residues")
    strands = [s for s in (0, 1) if options.strands >> s & 1]
    one = F.array(F.struct(F.lit(0).alias("qstrand"), F.lit(0).alias("qframe")))
    if options.program == "blastn":
        rows = base.withColumn("qstrand", F.explode(F.array(*map(F.lit, strands)))).withColumn("qframe", F.lit(0))
        return rows.withColumn("residues", F.when(F.col("qstrand") == 1, reverse_complement(F.col("residues"))).otherwise(F.col("residues")))
    if options.program in ("blastx", "tblastx"):
        return _six_frames(base, "q", strands, options.query_code)
    return base.withColumn("f", F.explode(one)).select("qno", "f.qstrand", "f.qframe", "residues", "nt_length")


def db_frames(db: DataFrame, options: Options) -> DataFrame:
    """(seqno, dstrand, dframe, residues, nt_length) likewise; a database is translated in all six frames."""
    base = db.select("seqno", F.length("residues").alias("nt_length"), "residues")
    if options.program in ("tblastn", "tblastx"):
        return _six_frames(base, "d", [0, 1], options.db_code)
    return base.withColumns({"dstrand": F.lit(0), "dframe": F.lit(0)})


def _six_frames(rows: DataFrame, side: str, strands: list[int], code: int) -> DataFrame:
    frames = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f).alias("f")) for s in strands for f in range(3)])
    framed = rows.withColumn("_f", F.explode(frames)).withColumns({f"{side}strand": F.col("_f.s"), f"{side}frame": F.col("_f.f")}).drop("_f")
    return framed.withColumn("residues", translated(F.col("residues"), F.col(f"{side}strand"), F.col(f"{side}frame"), code))


def db_info(db: DataFrame) -> DataFrame:
    """One row: sequences, residues, longest."""
    length = F.length("residues")
    return db.agg(F.count("*").alias("sequences"), F.coalesce(F.sum(length), F.lit(0)).alias("residues"), F.coalesce(F.max(length), F.lit(0)).alias("longest"))


def bounds(queries: list[tuple[int, int]], sequences: int, symbols: int, options: Options) -> dict[int, tuple[int, int | None, float | None]]:
    """Least score, highest score and search space of each (qno, query length)."""
    p, out = options.statistics(), {}
    thirds = options.program in ("tblastn", "tblastx")
    for qno, length in queries:
        m = length // 3 if options.program in ("blastx", "tblastx") else length
        space = None
        if p is not None and m and symbols:
            space = stats.search_space(p, m, symbols // 3 if thirds else symbols, sequences, options.db_size)
        out[qno] = (*stats.score_bounds(p if space and space > 0 else None, space or 1.0, options.expect, options.min_expect, options.min_score, options.max_score), space)
    return out


def _spread(db: DataFrame) -> DataFrame:
    """As many partitions as there are cores at least; a table of many files stays as it is."""
    cores = db.sparkSession.sparkContext.defaultParallelism
    return db if db.rdd.getNumPartitions() >= cores else db.repartition(cores)


def scores(frames: list, db: DataFrame, limits: dict, keep: int, options: Options) -> DataFrame:
    """Hits within the bounds, the best keep per task and query; and rows with qno, total and obvious counts."""
    s = options.scoring()
    coded = [(r["qno"], r["qstrand"], r["qframe"], encode(r["residues"], options.kind)) for r in frames]
    if sum(len(c[3]) for c in coded) > MOST_QUERY:
        raise ValueError("the query set is too large for one search; split it")
    shared = db.sparkSession.sparkContext.broadcast(coded)
    minus = options.program == "blastn"
    names = [f.split()[0] for f in HIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        counted: dict[int, list[int]] = {}
        for batch in batches:
            sequences = [encode(x or "", options.kind) for x in batch.column("residues").to_pylist()]
            seqno, dstrand, dframe = (batch.column(c).to_numpy().astype(np.int64) for c in ("seqno", "dstrand", "dframe"))
            found = batch_scores([c[3] for c in shared.value], sequences, s.scores, s.gap_open, s.gap_extend)
            for (qno, qstrand, qframe, _), row in zip(shared.value, found):
                low, high, _ = limits[qno]
                tally = counted.setdefault(qno, [0, 0])
                tally[0] += int((row >= low).sum())
                tally[1] += int((row > high).sum()) if high is not None else 0
                at = np.flatnonzero((row >= low) & (row <= high) if high is not None else row >= low)
                n = len(at)
                turned = np.full(n, qstrand)
                more = np.stack([row[at], seqno[at], np.zeros(n, np.int64) if minus else turned, np.full(n, qframe), turned if minus else dstrand[at], dframe[at]])
                merged = np.concatenate([best[qno], more], axis=1) if qno in best else more
                order = np.lexsort((merged[5], merged[4], merged[3], merged[2], -merged[1], -merged[0]))[:keep]
                best[qno] = merged[:, order]
        for qno, rows in best.items():
            n = rows.shape[1]
            columns = [np.full(n, qno), rows[1], rows[2], rows[3], rows[4], rows[5], rows[0]]
            kinds = [pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], [*names, "total", "obvious"])
        if counted:
            blank = [pa.nulls(len(counted), k) for k in (pa.int64(), *[pa.int32()] * 4, pa.int64())]
            tallies = [pa.array([t[i] for t in counted.values()], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.int32()), *blank, *tallies], [*names, "total", "obvious"])

    rows = _spread(db_frames(db, options).select("seqno", "dstrand", "dframe", "residues"))
    return rows.mapInArrow(run, HIT + ", total long, obvious long")


def ceiling_hits(frames: list, ceilings: list, db: DataFrame, keep: int, options: Options) -> DataFrame:
    """HIT rows of the frames' ceilings: for each query the first keep rows of a task in the order of hits."""
    s = options.scoring()
    shared = db.sparkSession.sparkContext.broadcast(({i: c for i, c in enumerate(ceilings)}, [(r["qno"], r["qstrand"], r["qframe"]) for r in frames]))
    minus = options.program == "blastn"
    names = [f.split()[0] for f in HIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, owners = shared.value
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            sequences = [encode(x or "", options.kind) for x in batch.column("residues").to_pylist()]
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("seqno", "dstrand", "dframe")])
            ends = np.cumsum([len(x) for x in sequences])
            low = 0
            while low < len(sequences):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")))
                for i, at in reaching(tops, sequences[low:high], s.scores):
                    qno, qstrand, qframe = owners[i]
                    seqno, dstrand, dframe = place[:, low + at]
                    n = len(at)
                    turned = np.full(n, qstrand)
                    more = np.stack([seqno, np.zeros(n, np.int64) if minus else turned, np.full(n, qframe), turned if minus else dstrand, dframe, np.full(n, tops[i].score)])
                    merged = np.concatenate([best[qno], more], axis=1) if qno in best else more
                    best[qno] = merged[:, np.lexsort((merged[4], merged[3], merged[2], merged[1], -merged[0]))[:keep]]
                low = high
        kinds = [pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.int64()]
        for qno, rows in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([np.full(rows.shape[1], qno), *rows], kinds)], names)

    return _spread(db_frames(db, options).select("seqno", "dstrand", "dframe", "residues")).mapInArrow(run, HIT)


@dataclass
class Search:
    """A prepared search: queries (qno, description, residues) against db (seqno, residues, and what else it has).

    masked_totals replaces the database totals in the statistics, as an alias file does; a taxid filter never changes them.
    """

    queries: DataFrame
    db: DataFrame
    options: Options
    masked_totals: tuple[int, int] | None = None

    def __post_init__(self):
        info = db_info(self.db).first()
        self.sequences, self.symbols = self.masked_totals or (info["sequences"], info["residues"])
        frames = query_frames(self.queries, self.options)
        if (frames.agg(F.sum(F.length("residues"))).first()[0] or 0) > MOST_QUERY:
            raise ValueError("the query set is too large for one search; split it")
        self.frames = frames.collect()  # MOST_QUERY symbols at most
        self.limits = bounds(sorted({(r["qno"], r["nt_length"]) for r in self.frames}), self.sequences, self.symbols, self.options)
        self.keep = max(self.options.descriptions, self.options.alignments)
        self._scored, self._found, self._certain, self._settled = None, None, None, None

    def scored(self) -> DataFrame:
        """The kernel's rows, stored: hits and counters are read from them without scoring twice."""
        if self._scored is None:
            self._scored = stored(scores(self.frames, self.db, self.limits, self.keep, self.options), "scores")
        return self._scored

    def ceilings(self) -> tuple[list, list]:
        """Frames that can have the highest score of their query, and their ceilings; no frame of a query without one."""
        s, out = self.options.scoring(), {}
        for r in self.frames:
            c = ceiling(encode(r["residues"], self.options.kind), s.scores, s.gap_open, s.gap_extend)
            out.setdefault(r["qno"], []).append((r, c))
        rows = []
        for qno, pairs in out.items():
            low, high, _ = self.limits[qno]
            if all(c for _, c in pairs) and low <= (top := max(c.score for _, c in pairs)) and (high is None or top <= high):
                rows += [(r, c) for r, c in pairs if c.score == top]
        return [r for r, _ in rows], [c for _, c in rows]

    def found(self) -> DataFrame:
        """HIT rows, stored, with all hits that rank up to keep; scored() has them too, but must score every pair."""
        if self._scored is not None:
            return self._scored.where("score is not null").drop("total", "obvious")
        if self._found is None:
            settled: set = set()
            frames, tops = self.ceilings()
            if frames:
                self._certain = stored(ceiling_hits(frames, tops, self.db, self.keep, self.options), "ceilings")
                settled = {r["qno"] for r in self._certain.groupBy("qno").count().where(F.col("count") >= self.keep).collect()}  # a row per query
            rest = [r for r in self.frames if r["qno"] not in settled]
            self._found = stored(scores(rest, self.db, self.limits, self.keep, self.options).where("score is not null").drop("total", "obvious"), "found")
            if settled:
                known = self._certain.sparkSession.createDataFrame([(q,) for q in settled], "qno int")
                self._settled = self._certain.join(F.broadcast(known), "qno", "left_semi")  # a row per query
        return self._found.unionByName(self._settled) if self._settled is not None else self._found

    def hits(self) -> DataFrame:
        """The best hits of each query: HIT and rn, in the total order of score, seqno, strands and frames."""
        ranked = Window.partitionBy("qno").orderBy(F.desc("score"), F.desc("seqno"), "qstrand", "qframe", "dstrand", "dframe")
        found = self.found()
        return self.with_statistics(found.withColumn("rn", F.row_number().over(ranked)).where(F.col("rn") <= self.keep))

    def close(self) -> None:
        """Discards the stored rows; what hits() and alignments() returned must be consumed before."""
        for rows in (self._scored, self._found, self._certain):
            if rows is not None:
                discarded(rows)
        self._scored, self._found, self._certain, self._settled = None, None, None, None

    def counts(self) -> DataFrame:
        """Per query: total_hits (scores from the lower bound on) and obvious_hits (above the upper bound)."""
        return self.scored().where("total is not null").groupBy("qno").agg(F.sum("total").alias("total_hits"), F.sum("obvious").alias("obvious_hits"))

    def with_statistics(self, hits: DataFrame) -> DataFrame:
        p = self.options.statistics()
        if p is None:
            return hits.withColumns({"evalue": F.lit(None).cast("double"), "bits": F.lit(None).cast("double")})
        spaces = hits.sparkSession.createDataFrame([(q, float(x[2]) if x[2] else None) for q, x in self.limits.items()], "qno int, _space double")
        joined = hits.join(F.broadcast(spaces), "qno", "left")  # a row per query
        return joined.withColumns({"evalue": stats.e_value(F.col("score"), F.col("_space"), p), "bits": stats.bit_score(F.col("score"), p)}).drop("_space")

    def alignments(self) -> DataFrame:
        """Hits up to the alignment limit with coordinates, edit script, statistics and text lines.

        Shown hits (queries x alignments rows at most) are broadcast to the database scan when that is below a million
        rows; else Spark joins as it sees fit.
        """
        o = self.options
        shown = self.hits().where(F.col("rn") <= o.alignments)
        if len(self.limits) * o.alignments <= 1_000_000:
            shown = F.broadcast(shown)
        fetched = self.db.select("seqno", "residues").join(shown, "seqno")
        frames = self._subject(fetched)
        s = o.scoring()
        own = {(r["qno"], r["qstrand"], r["qframe"]): (encode(r["residues"], o.kind), r["nt_length"]) for r in self.frames}
        forward = {r["qno"]: encode(r["residues"], o.kind) for r in query_frames(self.queries, Options(program="blastn", strands=1)).collect()} if o.program == "blastn" else {}
        shared = self.db.sparkSession.sparkContext.broadcast((own, forward))
        symbols = {"nucleotide": "-acmgrsvtwyhkdbn", "protein": "-ABCDEFGHIKLMNPQRSTVWXYZU*OJ", "sound": "-ABCDEFGHIJKLMNOPQRSTUVWXYZabcde"}[o.kind]
        hinted = not (o.program == "blastn" and o.strands == 2)
        fields = "q_start int, q_end int, d_start int, d_end int, ops string, identities int, positives int, indels int, gaps int, aligned int, rescore long, q_line string, a_line string, d_line string"
        names = [f.split()[0] for f in fields.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, plus = shared.value
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    q = plus[r["qno"]] if o.program == "blastn" else queries[r["qno"], r["qstrand"], r["qframe"]][0]
                    d = encode(r["residues"], o.kind)
                    found = align(q, d, s, hinted, r["score"])
                    counts = statistics(found, q, d, s.scores)
                    lines = text_lines(found, q, d, s.scores, symbols)
                    rows.append((found.q_start, found.q_end, found.d_start, found.d_end, found.script, *(counts[n] for n in ("identities", "positives", "indels", "gaps", "aligned")), rescored(found, q, d, s), *lines))
                kept = [n for n in batch.schema.names if n != "residues"]
                kinds = [pa.string() if f.endswith("string") else pa.int64() if f.endswith("long") else pa.int32() for f in fields.split(", ")]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns], kept + names)

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema if f.name != "residues")
        aligned = frames.repartition(self.db.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, f"{schema}, {fields}")
        return self._coordinates(aligned.join(F.broadcast(self.queries.select("qno", "description", F.length("residues").alias("q_nt"))), "qno"))

    def _subject(self, fetched: DataFrame) -> DataFrame:
        """The strand or frame of each hit's sequence that is aligned, and its whole length as d_nt."""
        o, text = self.options, F.col("residues")
        whole = fetched.withColumn("d_nt", F.length("residues"))
        if o.program == "blastn":
            text = F.when(F.col("dstrand") == 1, reverse_complement(text)).otherwise(text)
        elif o.program in ("tblastn", "tblastx"):
            text = translated(text, F.col("dstrand"), F.col("dframe"), o.db_code)
        return whole.withColumn("residues", text)

    def _coordinates(self, rows: DataFrame) -> DataFrame:
        """q_first, q_last, d_first, d_last: 1-based positions on the sequences as given, reversed on minus strands."""
        o = self.options

        def placed(start: str, end: str, strand: str, frame: str, whole: str, three: bool, flipped: bool):
            first, last = F.col(start), F.col(end)
            if three:
                plus = first * 3 + F.col(frame), last * 3 + F.col(frame) + 2
                minus = F.col(whole) - 1 - first * 3 - F.col(frame), F.col(whole) - 1 - last * 3 - F.col(frame) - 2
            else:
                plus, minus = (first, last), (F.col(whole) - 1 - first, F.col(whole) - 1 - last) if flipped else (first, last)
            return [(F.when(F.col(strand) == 1, m).otherwise(p) + 1).cast("int") for p, m in zip(plus, minus)]

        q = placed("q_start", "q_end", "qstrand", "qframe", "q_nt", o.program in ("blastx", "tblastx"), False)
        d = placed("d_start", "d_end", "dstrand", "dframe", "d_nt", o.program in ("tblastn", "tblastx"), o.program == "blastn")
        return rows.withColumns({"q_first": q[0], "q_last": q[1], "d_first": d[0], "d_last": d[1]})


def chunk_plan(sizes: list[int], workers: int, channels: int = 16) -> list[int]:
    """Chunks for each volume: the largest is split until none exceeds the limit and every worker has one."""
    total = sum(sizes)
    chunks = [int(n > 0) for n in sizes]
    limit = channels * (math.isqrt(total // (channels * workers)) if total >= 4 * channels * workers else 1)
    size = lambda i: -(-sizes[i] // chunks[i]) if chunks[i] else 0
    while total:
        widest = max(range(len(sizes)), key=lambda i: (size(i), -i))
        if size(widest) <= limit and sum(chunks) >= min(total, workers):
            break
        chunks[widest] += 1
    return chunks
