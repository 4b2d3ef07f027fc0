"""Every operator and stage over nulls, empty and long texts, repeated rows, clashing columns, and empty tables."""

import pytest
from pyspark.sql import functions as F

from quiverseq.llm import bpe, hmm, jaccard, linededup, media, mixing, quality, registry, sharding, spotsigs, urlfilter

LONG = " ".join(f"word{i % 977} and the {i}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and the dog lay by the door", "en", "a", 50),
    (2, "the cat sat on the mat and the dog lay by the door", "en", "b", 50),
    (2, "the cat sat on the mat and the dog lay by the door", "en", "b", 50),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "en", "", 4),
    (None, "a text without any id", "en", "a", 21),
    (6, LONG, "en", "c", len(LONG)),
    (7, "one", None, "c", 3),
    (8, "No capital LETTERS\nno capital letters\nšč ≠ 😀 \u3000x", "xx", None, 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["size", "shard", "slot", "keep", "tail", "n", "cls", "_key", "key", "ids", "h", "g", "n_lines", "row", "range", "digest", "copies", "_judged"]
PAGES = [(1, "https://www.example.com/en/1", None), (1, "https://www.example.com/en/1", None), (2, None, "<p>x"), (None, "no scheme", ""), (3, "ftp://HOST.Net/es/a?b#c", "y"), (4, "", None), (5, "x://y.org", ""), (6, "https://a.com/" + "z" * 50_000, "")]


def write(spark, folder, documents, pages, labels):
    spark.createDataFrame(documents, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING}).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "rule", "score", "seen")}).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), ROWS, PAGES, [(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 0), (7, None, None), (8, 0, 0), (99, 1, 1)])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n != "pipeline"])
def test_odd_tables_give_a_row_per_row(spark, odd, name):
    rows = registry.QUERIES[name](spark, odd).collect()
    key = "page_id" if name in ("op1_url_filter", "page_sequences") else "doc_id"
    given = [r[0] for r in (PAGES if key == "page_id" else ROWS)]
    assert sorted(map(str, (r[key] for r in rows))) == sorted(map(str, given))
    twins = [tuple(v for k, v in r.asDict().items() if k not in ("slot", "taken", "near_next", "near_edited", "edited_sha256", "edited_fingerprint")) for r in rows if r[key] == (1 if key == "page_id" else 2)]
    assert len(twins) == 2 and twins[0] == twins[1]


@pytest.mark.parametrize("name", [*registry.QUERIES])
def test_empty_tables_give_empty_results(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


def test_odd_tables_pass_the_pipeline(spark, odd):
    import corpus_pipeline

    docs = corpus_pipeline.table(spark, odd, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, odd), name)
        assert docs.columns == columns
        assert {r[0] for r in docs.select("size").distinct().collect()} <= {"clash"}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, odd)
    assert all(r["round_trip"] for r in out.collect())


def test_single_functions_on_edges():
    assert bpe.encode_tree("", lambda t: [9]) == [9] and bpe.decode_tree([], lambda ids: b"") == b""
    assert media.parse(None) == [] and media.padded(b"") == b"\xff" * 576 and len(media.padded(b"x" * 577)) == 1152
    assert spotsigs.likeness(*[__import__("numpy").zeros(0)] * 2) == 1.0
    assert hmm.log_likelihoods(hmm.random_start(__import__("numpy").ones(3) / 3), []).shape == (0,)
    assert [m.__doc__ is not None for m in (bpe, hmm, jaccard, linededup, media, mixing, quality, sharding, spotsigs, urlfilter)]
