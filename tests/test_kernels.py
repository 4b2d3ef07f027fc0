import numpy as np
import pytest

from quiverseq.functions.alphabets import encode
from quiverseq.functions.matrices import blosum62, nucleotide_matrix
from quiverseq.operators import kernels
from quiverseq.operators.alignment import Scoring, align, rescored, statistics, text_lines
from quiverseq.operators.kernels import batch_scores, plain_score


def aligned(q, d, match, mismatch, gap_open, gap_extend, hinted=True):
    s = Scoring(nucleotide_matrix(match, mismatch), gap_open, gap_extend)
    a, b = encode(q, "nucleotide"), encode(d, "nucleotide")
    f = align(a, b, s, hinted)
    return f, statistics(f, a, b, s.scores)


def test_score_and_script():
    f, _ = aligned("ACGTACGT", "TTACGTACGTTT", 1, -3, 5, 2)
    assert (f.score, f.q_start, f.q_end, f.d_start, f.d_end, f.script) == (8, 0, 7, 2, 9, "M8")


def test_end_point_rules():
    f, _ = aligned("AAAACCCC", "CCCCTTTTTTTTAAAA", 1, -3, 5, 2)
    assert (f.q_start, f.d_start) == (4, 0)
    f, _ = aligned("AAAACCCC", "CCCCTTTTTTTTAAAA", 1, -3, 5, 2, hinted=False)
    assert (f.q_start, f.d_start) == (0, 12)


def test_shortest_start_wins():
    f, _ = aligned("AAACGGGG", "AAATGGGG", 1, -3, 5, 2)
    assert (f.q_start, f.d_start, f.script) == (4, 4, "M4")


@pytest.mark.parametrize(
    "q, d, gap_open, score, script, counts",
    [
        ("ACGTTTACG", "ACGTTACG", 1, 38, "M3D1M5", (9, 8, 1, 1)),
        ("ACGTTACG", "ACGTTTACG", 1, 38, "M5I1M3", (9, 8, 1, 1)),
        ("ACGTACGTTTTTACGACG", "ACGTACGTACGACG", 3, 63, "M8D4M6", (18, 14, 4, 1)),
        ("GATTACAGATTACA", "GATTAGATTACA", 3, 55, "M4D2M8", (14, 12, 2, 1)),
    ],
)
def test_gap_placement(q, d, gap_open, score, script, counts):
    f, c = aligned(q, d, 5, -4, gap_open, 1)
    assert (f.score, f.script) == (score, script)
    assert (c["aligned"], c["identities"], c["indels"], c["gaps"]) == counts


@pytest.mark.parametrize("window", [16, 4096])
def test_kernel_and_scripts_against_the_textbook(monkeypatch, window):
    monkeypatch.setattr(kernels, "WINDOW", window)
    rng = np.random.default_rng(window)
    systems = [(nucleotide_matrix(1, -3), 5, 2, 16), (nucleotide_matrix(5, -4), 0, 1, 16), (blosum62(), 11, 1, 26), (rng.integers(-5, 6, (32, 32)).astype(np.int32), 3, 0, 26)]
    for trial in range(120):
        scores, gap_open, gap_extend, top = systems[trial % 4]
        q = rng.integers(1, top, rng.integers(1, 20))
        ds = [rng.integers(1, top, rng.integers(0, 80)) for _ in range(4)]
        ds[0] = np.concatenate([ds[0], q, ds[1]])
        got = batch_scores([q, q[:3]], ds, scores, gap_open, gap_extend)
        s = Scoring(scores, gap_open, gap_extend)
        for i, d in enumerate(ds):
            expected = plain_score(q, d, scores, gap_open, gap_extend)
            assert got[0, i] == expected
            if expected:
                for hinted in (True, False):
                    f = align(q, d, s, hinted)
                    assert f.score == expected == rescored(f, q, d, s)
                    assert f.ops[0][0] == f.ops[-1][0] == "M"
                    assert sum(n for op, n in f.ops if op != "I") == f.q_end - f.q_start + 1
                    assert sum(n for op, n in f.ops if op != "D") == f.d_end - f.d_start + 1
                    c = statistics(f, q, d, scores)
                    assert c["aligned"] == sum(n for _, n in f.ops)


def test_scores_beyond_16_bits():
    q = np.full(9000, 1)
    assert batch_scores([q], [q], nucleotide_matrix(5, -4), 5, 2)[0, 0] == 45000
    assert batch_scores([np.full(20, 1)], [np.full(20, 1)], nucleotide_matrix(10_000, -4), 5, 2)[0, 0] == 200_000


def test_text_lines():
    s = Scoring(nucleotide_matrix(5, -4), 1, 1)
    a, b = encode("ACGTTTACG", "nucleotide"), encode("ACGTTACG", "nucleotide")
    assert text_lines(align(a, b, s), a, b, s.scores, "-acmgrsvtwyhkdbn") == ("acgtttacg", "||| |||||", "acg-ttacg")


def test_empty_inputs():
    assert batch_scores([], [], blosum62(), 11, 1).shape == (0, 0)
    assert batch_scores([np.zeros(0, int)], [np.zeros(0, int)], blosum62(), 11, 1)[0, 0] == 0
    with pytest.raises(ValueError):
        align(encode("AAAA", "nucleotide"), encode("CCCC", "nucleotide"), Scoring(nucleotide_matrix(1, -3), 5, 2))
