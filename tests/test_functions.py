import random

import pytest
from pyspark.sql import functions as F

from quiverseq.functions import alphabets, matrices, stats
from quiverseq.plans import report


def test_encoding_drops_what_the_alphabet_lacks():
    assert alphabets.encode(alphabets.clean("a1 B-*J?", "protein"), "protein").tolist() == [1, 2, 0, 25, 27]
    assert alphabets.encode(alphabets.clean("aU-nX", "nucleotide"), "nucleotide").tolist() == [1, 8, 0, 15]


def test_columns_agree_with_python(spark):
    texts = ["a1 B-*J?", "aU-nX", "", None, "acgtRYMKswbdhvn", "ATGGCCTAA!", "é\x00z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind in ("protein", "nucleotide", "sound"):
        got = [r[0] for r in rows.select(alphabets.residues(F.col("t"), kind)).collect()]
        assert got == [None if t is None else alphabets.clean(t, kind) for t in texts]


def test_reverse_complement():
    assert alphabets.reverse_complement_text("ACGTRYMKSWBDHVN") == "NBDHVWSMKRYACGT"


def test_translation():
    table = alphabets.codon_table(1)
    assert "".join(table[c] for c in "ATG TAA TGA RAY SAR NNN GCN YTR MGR".split()) == "M**BZXALR"
    frames = [alphabets.translate_text("ATGGCCTAA", s, f, table) for s in (0, 1) for f in (0, 1, 2)]
    assert frames == ["MA*", "WP", "GL", "LGH", "*A", "RP"]
    assert len(alphabets.DIFFERENCES) == 17
    with pytest.raises(ValueError):
        alphabets.genetic_code(7)


def test_translation_as_a_column(spark):
    random.seed(3)
    texts = ["".join(random.choice("ACGTNRY-") for _ in range(random.randint(0, 40))) for _ in range(30)]
    rows = spark.createDataFrame([(t, s, f) for t in texts for s in (0, 1) for f in (0, 1, 2)], "t string, s int, f int")
    for code in (1, 2, 22):
        table = alphabets.codon_table(code)
        for r in rows.select("*", alphabets.translated(F.col("t"), F.col("s"), F.col("f"), code).alias("a")).collect():
            assert r["a"] == alphabets.translate_text(r["t"], r["s"], r["f"], table)


def test_matrix_text():
    m = matrices.parse_matrix("# comment\n   A  R\nA  4 -1\nR -2  5\n")
    a, r = (alphabets.PROTEIN.index(x) for x in "AR")
    assert (m[a, a], m[a, r], m[r, a], m[r, r], m[0, 0]) == (4, -1, -2, 5, -1)
    b = matrices.blosum62()
    place = alphabets.PROTEIN.index
    assert [b[place(x), place(y)] for x, y in ("WW", "BN", "ZC", "JM", "XX", "**", "A*", "UA")] == [11, 4, -3, 2, -1, 1, -4, -1]
    n = matrices.nucleotide_matrix(1, -3)
    assert (n[15, 15], n[1, 2], n[0, 1]) == (1, -3, -1)


def test_statistics():
    p = stats.protein_parameters("BLOSUM62", 11, 1)
    assert stats.length_adjustment(p, 184, 1844909, 1000) == 82
    space = stats.search_space(p, 184, 1844909, 1000)
    assert round(space, 3) == 7372485.438
    assert stats.score_bounds(p, space) == (51, None)
    assert stats.score_bounds(p, space, 10, 1e-5) == (51, 102)
    assert stats.length_adjustment(p, 1, 10, 1) == 0
    assert stats.nucleotide_parameters(1, -3, 5, 2).lam == 1.374
    assert stats.nucleotide_parameters(1, -3, 0, 1) is None
    assert stats.nucleotide_parameters(7, -3, 5, 2) is None
    with pytest.raises(ValueError):
        stats.score_bounds(p, space, 0)


def test_expect_text(spark):
    values = {1e-200: "0.0  ", 3e-120: "e-120", 2e-50: "2e-50", 0.05: "0.050", 0.5: "0.50 ", 5.0: "5.0  ", 50.0: "   50"}
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in rows.select(report.expect_text(F.col("v"))).collect()] == list(values.values())


def test_two_digits_follow_printf(spark):
    random.seed(5)
    values = [0.0, 1.0, 9.96, 99.4, 99.6, 100.0, 0.1, 0.00012, 0.000099, 12.0, 5e-324] + [10 ** random.uniform(-30, 6) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(report.two_digits(F.col("v"))).collect()]
    wrong = [(v, g) for v, g in zip(values, got) if g != f"{v:.2g}" and v != 5e-324]
    assert not wrong


def test_defline_split(spark):
    row = spark.createDataFrame([("gi|7|gb|A.1|N some title",), ("plain title",)], "d string").select(report.defline_split(F.col("d")).alias("x")).collect()
    assert tuple(row[0]["x"]) == ("7", "gb|A.1|N", "some title")
    assert tuple(row[1]["x"]) == ("", "plain", "title")


def test_expect_text_never_cuts_wide_values(spark):
    from quiverseq.plans.report import expect_text

    values = {0.0: "0.0  ", 3e-150: "e-150", 2e-7: "2e-07", 0.0625: "0.062", 0.5: "0.50 ", 2.25: "2.2  ", 12.0: "   12", 510000.0: "510000"}
    rows = spark.createDataFrame([(e,) for e in values], "e double")
    assert {r["e"]: r["text"] for r in rows.select("e", expect_text(rows["e"]).alias("text")).collect()} == values
