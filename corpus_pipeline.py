"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of documents. Stages work on all rows that their predecessors kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverseq.llm import bpe, jaccard, linededup, mixing, quality
from quiverseq.llm.common import boxed, drop, drop_paths, noted, table, unboxed, word_count, written

#: SQL has no counterpart of a fitted classifier. Of the stages, near_duplicates is tested against plain Python for passages; the
#: others only for columns, odd rows and empty tables, and some of the operators below them against brute force.
ORACLE_SQL = None


#: Working tables behind the result of the stage before.
_earlier: list[str] = []


def _stage(function: Callable) -> Callable:
    """The stage; it begins by dropping the working tables of the one before, unless docs still reads them."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        if not any(path.partition(":")[2].lstrip("/") in file for path in _earlier for file in read):
            drop_paths(spark, _earlier)
            _earlier.clear()
        with noted() as paths:
            out = function(spark, docs, sf_dir)
        _earlier.extend(paths)
        return out

    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of a good rating is under one half; without ratings it keeps all."""
    model = quality.trained(docs, quality.grades(table(spark, sf_dir, "labels")))
    judged = quality.rated(docs.withColumn("_columns", F.struct(*docs.columns)), model)
    return judged.where("keep").select("_columns.*")


@_stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of all but one document; every document stays, n_chars follows its text."""
    used = ["doc_id", "text", "source"]
    out = linededup.dedup_lines(boxed(docs, used))
    length = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[length if c == "n_chars" else x for c, x in zip(docs.columns, unboxed(out, docs.columns, used))])


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group linked by five-word shingles at a similarity of 0.8 or more.

    Equal rows count once. Documents without words form no groups and stay. Of those kept, the one of least doc_id also
    keeps each line of over 50 words that several share; n_chars follows the text of the others. This comes after the
    groups, for a near copy without its passages would no longer be known as one.
    """
    found = jaccard.near_components(docs.select("doc_id", "text"))
    keep = written(found.where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept_id")).distinct(), "kept")
    lost = linededup.lost_passages(docs.select("doc_id", "text"), keep).withColumnRenamed("doc_id", "_lost_id")
    kept = keep.join(lost, F.col("_kept_id").eqNullSafe(F.col("_lost_id")), "left").select("_kept_id", "lost")
    used = ["doc_id", "text"]
    same = {"_hash": F.xxhash64("text"), "_crc": F.crc32(F.encode("text", "UTF-8")), "_size": F.length("text")}
    rows = boxed(docs, used).withColumns(same).join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id"))).dropDuplicates(["doc_id", *same])
    out = linededup.without_passages(rows)
    given = F.col("_rest").getField("n_chars")
    length = F.when(F.col("cut"), F.length("text")).otherwise(given).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[length if c == "n_chars" else x for c, x in zip(docs.columns, unboxed(out, docs.columns, used))])


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources reach their target weights; a document taken twice comes twice."""
    used = ["doc_id", "text", "source"]
    sized = boxed(docs, used).withColumn("size", word_count())
    mixed = mixing.systematic_copies(sized, mixing.source_targets(sized)).where("n_copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select(*unboxed(mixed, docs.columns, used))


@_stage
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    import public_tokenizers

    return bpe.coded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "lang", "source"])


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; only the last one's table stays."""
    docs = given = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not given:
            drop(before)
    return docs
