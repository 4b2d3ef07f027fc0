import numpy as np
import pytest

from quiverseq.functions.alphabets import codon_table, encode, reverse_complement_text, translate_text
from quiverseq.operators.kernels import plain_score
from quiverseq.plans import report
from quiverseq.plans.search import Options, Search, chunk_plan


def random_sequences(n, letters, low, high, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), rng.integers(low, high))) for _ in range(n)]


def searched(spark, queries, subjects, **options):
    q = spark.createDataFrame([(i, f"q{i} query", s) for i, s in enumerate(queries)], "qno int, description string, residues string")
    d = spark.createDataFrame(list(enumerate(subjects)), "seqno long, residues string")
    return Search(q, d, Options(**options))


def titles(spark, subjects):
    return spark.createDataFrame([(i, f"s{i} & <title>") for i in range(len(subjects))], "seqno long, subject_id string")


def brute(queries, subjects, options):
    """All positive scores in the total order of hits."""
    s, table = options.scoring(), codon_table(1)
    strands = [x for x in (0, 1) if options.strands >> x & 1]
    rows = []
    for qno, q in enumerate(queries):
        if options.program == "blastn":
            own = [(t, 0, reverse_complement_text(q) if t else q) for t in strands]
        elif options.program in ("blastx", "tblastx"):
            own = [(t, f, translate_text(q, t, f, table)) for t in strands for f in range(3)]
        else:
            own = [(0, 0, q)]
        for seqno, d in enumerate(subjects):
            theirs = [(t, f, translate_text(d, t, f, table)) for t in (0, 1) for f in range(3)] if options.program in ("tblastn", "tblastx") else [(0, 0, d)]
            for qs, qf, a in own:
                for ds, df, b in theirs:
                    score = plain_score(encode(a, options.kind), encode(b, options.kind), s.scores, s.gap_open, s.gap_extend)
                    if score > 0:
                        rows.append((qno, seqno, 0, qf, qs, df, score) if options.program == "blastn" else (qno, seqno, qs, qf, ds, df, score))
    return sorted(rows, key=lambda r: (r[0], -r[6], -r[1], *r[2:6]))


@pytest.mark.parametrize("program", ["blastn", "blastp", "blastx", "tblastn", "tblastx", "sound"])
def test_hits_are_those_of_brute_force(spark, program):
    o = Options(program=program, expect=1e12)
    letters = {"nucleotide": "ACGTN", "protein": "ACDEFGHIKLW", "sound": "ABCabc"}
    queries = random_sequences(3, letters[o.query_kind], 12, 30, 1)
    subjects = random_sequences(20, letters[o.db_kind], 0, 40, 2) + random_sequences(3, letters[o.db_kind], 5, 6, 3) * 2
    found = searched(spark, queries, subjects, program=program, expect=1e12, descriptions=9, alignments=9)
    low = {q: x[0] for q, x in found.limits.items()}
    expected = [r for r in brute(queries, subjects, o) if r[6] >= low[r[0]]]
    got = [tuple(r)[:7] for r in found.hits().select("qno", "seqno", "qstrand", "qframe", "dstrand", "dframe", "score", "rn").orderBy("qno", "rn").collect()]
    assert got == [r for q in range(3) for r in [x for x in expected if x[0] == q][:9]]
    counts = {r["qno"]: r["total_hits"] for r in found.counts().collect()}
    assert counts == {q: sum(r[0] == q for r in expected) for q in range(3)}
    for r in found.alignments().collect():
        assert r["rescore"] == r["score"]
        assert r["ops"][0] == "M"


def test_coordinates_of_strands_and_frames(spark):
    subject = "AAAACCCGGTACGATTTT"
    minus = searched(spark, [reverse_complement_text("CCCGGTACGA")], [subject], program="blastn", expect=1e9).alignments().orderBy("rn").first()
    assert (minus["dstrand"], minus["q_first"], minus["q_last"], minus["d_first"], minus["d_last"]) == (1, 1, 10, 14, 5)
    protein = "MKWYH"
    dna = "C" + "ATGAAATGGTACCAC" + "GG"
    for given, strand, first, last in ((dna, 0, 2, 16), (reverse_complement_text(dna), 1, 17, 3)):
        row = searched(spark, [given], [protein], program="blastx", expect=1e9).alignments().orderBy("rn").first()
        assert (row["qstrand"], row["score"] > 20, row["q_first"], row["q_last"]) == (strand, True, first, last)
        row = searched(spark, [protein], [given], program="tblastn", expect=1e9).alignments().orderBy("rn").first()
        assert (row["dstrand"], row["d_first"], row["d_last"]) == (strand, first, last)


def test_bounds_and_counts(spark):
    subjects = random_sequences(30, "ACDEFGHIKLW", 10, 40, 8)
    found = searched(spark, subjects[:2], subjects, program="blastp", expect=1e9, min_score=12, max_score=30, descriptions=3, alignments=0)
    expected = brute(subjects[:2], subjects, Options())
    for r in found.counts().collect():
        scores = [x[6] for x in expected if x[0] == r["qno"]]
        assert (r["total_hits"], r["obvious_hits"]) == (sum(s >= 12 for s in scores), sum(s > 30 for s in scores))
    assert {r["score"] for r in found.hits().collect()} <= set(range(12, 31))


def test_ties_prefer_later_sequences(spark):
    found = searched(spark, ["WWWW"], ["WWWW", "WWWW", "WWWWW", "WWWW"], program="blastp", expect=1e9, descriptions=3, alignments=1)
    assert [r["seqno"] for r in found.hits().orderBy("rn").collect()] == [3, 2, 1]


def test_empty_query_and_database(spark):
    assert searched(spark, [""], ["ACDE"], program="blastp").hits().count() == 0
    empty = spark.createDataFrame([], "seqno long, residues string")
    q = spark.createDataFrame([(0, "q", "ACD")], "qno int, description string, residues string")
    assert Search(q, empty, Options()).hits().count() == 0


def test_reports(spark):
    subjects = ["MKWYHMKWYH", "AAAAA", "MKWYAMKWYH"]
    found = searched(spark, ["MKWYHMKWYH"], subjects, program="blastp", expect=1e9, alignments=1, descriptions=2)
    t = titles(spark, subjects)
    (line,) = report.tsv_lines(found, t).collect()
    assert line["line"].split("\t")[:10] == ["q0", "s0 & <title>", "100.00", "10", "0", "0", "1", "10", "1", "10"]
    assert len(report.tsv_lines(found, t, comments=True).collect()) == 5
    xml = [r["xml"] for r in report.xml_hits(found, t).orderBy("rn").collect()]
    assert len(xml) == 2 and "<alignment>M10</alignment>" in xml[0] and "<alignment>" not in xml[1]
    assert "<name>s0 &amp; &lt;title&gt;</name>" in xml[0]
    summary = [r["line"] for r in report.summary_lines(found, t).orderBy("rn").collect()]
    assert summary[0].startswith("s0 & <title>") and len(summary) == 2
    block = [r["line"] for r in report.alignment_lines(found, t).orderBy("line_no").collect()]
    assert block[2].startswith(" Identities = 10/10 (100%), Positives = 10/10 (100%)")
    assert block[4].split() == ["Query:", "1", "MKWYHMKWYH"]


def test_options_are_validated():
    for bad in ({"program": "x"}, {"strands": 0}, {"program": "blastp", "strands": 2}, {"query_code": 7}, {"matrix": "UNKNOWN"}, {"min_score": 0}, {"expect": 0}, {"min_score": 5, "max_score": 4}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert Options(program="tblastx", strands=2).strands == 2
    assert Options(gap_open=0).gaps() == (0, 1)


def test_chunk_plan():
    assert chunk_plan([1000], 4) == [21]
    assert chunk_plan([3, 0, 5], 4) == [2, 0, 2]
    assert chunk_plan([600, 400], 4) == [13, 9]
    assert chunk_plan([], 4) == []
