import numpy as np

from quiverseq.functions.alphabets import encode
from quiverseq.functions.matrices import blosum62
from quiverseq.operators.ceilings import ceiling, reaching
from quiverseq.operators.kernels import batch_scores, lane_scores, plain_score
from quiverseq.plans.search import Options, Search


def test_lanes_hold_several_windows_and_tell_where_bytes_end():
    rng, scores = np.random.default_rng(3), blosum62()
    queries = [rng.integers(1, 24, n) for n in (41, 30, 9)]
    subjects = [rng.integers(1, 24, n) for n in (90, 70, 1, 50, 41)]
    subjects[1][5:35], subjects[4] = queries[1], queries[0].copy()
    lanes, ends, table = [[0, 2, 4], [1, 3]], np.zeros((5, 2), int), np.full((250, 2), 255, np.uint8)
    for lane, members in enumerate(lanes):
        at = 0
        for x in members:
            table[at : at + len(subjects[x]), lane] = subjects[x]
            at += len(subjects[x])
            ends[x] = at, lane
            at += 41
    expected = np.array([[plain_score(q, s, scores, 11, 1) for s in subjects] for q in queries])
    for kind, cap in ((np.uint8, 202), (np.int16, 32767)):
        got, over = lane_scores(queries, table, ends, scores, 11, 1, kind)
        assert (over == (expected >= cap)).all() and over.any() == (kind is np.uint8)
        assert (over | (got == expected)).all()
    assert (batch_scores(queries, subjects, scores, 11, 1) == expected).all()


def test_ceilings_are_where_the_kernel_finds_them():
    rng, scores = np.random.default_rng(4), blosum62()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    query = "OU" + "".join(rng.choice(list(letters), 60)) + "WHATEVERITISX"
    q = encode(query, "protein")
    partner = {"B": "D", "Z": "E", "J": "L", "O": "A", "U": "W", "X": "K"}
    texts = [query, "XX" + query[2:-1] + "AA", "".join(partner.get(c, c) for c in query), query[:30] + "A" + query[31:], query[5:], query[:40] + query[41:], "", "ABC", query + query]
    subjects = [encode(t, "protein") for t in texts]
    c = ceiling(q, scores, 11, 1)
    found = batch_scores([q], subjects, scores, 11, 1)[0]
    ((key, at),) = reaching({7: c}, subjects, scores)
    assert key == 7 and c.score == found.max()
    assert at.tolist() == np.flatnonzero(found == c.score).tolist()
    assert {0, 1, 2, 8} <= set(at.tolist()) and not {4, 5, 6, 7} & set(at.tolist())
    assert ceiling(q[:20], scores, 11, 1) is None and ceiling(q, scores, 11, 0) is None


def test_queries_at_their_ceiling_are_not_scored(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), n))
    often, once = word(50), word(50)
    subjects = [word(20) + often + word(9) for _ in range(4)] + [once, often[:30], word(70)] + [often] * 2
    q = spark.createDataFrame([(0, "often", often), (1, "once", once)], "qno int, description string, residues string")
    d = spark.createDataFrame(list(enumerate(subjects)), "seqno long, residues string")
    pruned, whole = (Search(q, d, Options(expect=1e9, descriptions=3, alignments=3)) for _ in range(2))
    whole.scored()
    rows = lambda s: sorted(tuple(r) for r in s.hits().collect())
    assert rows(pruned) == rows(whole)
    assert [r["seqno"] for r in pruned.hits().where("qno = 0").orderBy("rn").collect()] == [8, 7, 3]
    assert {r["qno"] for r in pruned._found.collect()} == {1}
    pruned.close()
    assert rows(pruned) == rows(whole)
