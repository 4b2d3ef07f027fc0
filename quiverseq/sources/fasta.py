"""FASTA text to sequences and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverseq.functions.alphabets import residues


def read_fasta(spark: SparkSession, path: str, kind: str = "protein") -> DataFrame:
    """(description, residues) per record of a sequence collection; every file begins with ">".

    Records are split where they begin, so a large file is read in parallel; descriptions may be of any length.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    return _records(records.select(F.regexp_replace("value", r"^>", "").alias("record")), kind)


def read_queries(spark: SparkSession, path: str, kind: str = "protein") -> DataFrame:
    """(description, residues) per record of query files, each read whole; a body before the first ">" has an empty description."""
    return split_queries(spark.read.text(path, wholetext=True), "value", kind)


def split_queries(texts: DataFrame, column: str, kind: str) -> DataFrame:
    """read_queries() for texts in a column."""
    parts = F.split(F.regexp_replace(column, r"\r", ""), r"(?:^|\n)>")
    records = texts.select(F.posexplode(parts).alias("place", "record"))
    records = records.where("place > 0 or length(trim(record)) > 0")
    return _records(records.select(F.when(F.col("place") == 0, F.concat(F.lit("\n"), F.col("record"))).otherwise(F.col("record")).alias("record")), kind)


def _records(records: DataFrame, kind: str) -> DataFrame:
    """A record is its description, a line break, and its body."""
    record = F.regexp_replace("record", r"\r", "")
    return records.where("length(trim(record)) > 0").select(F.regexp_extract(record, r"^([^\n]*)", 1).alias("description"), residues(F.regexp_replace(record, r"^[^\n]*", ""), kind).alias("residues"))


def wrapped(column, width: int = 80):
    """Text broken into lines of width characters, each ended by a newline."""
    return F.regexp_replace(F.regexp_replace(column, rf"(.{{{width}}})", "$1\n"), r"([^\n])\z", "$1\n")


def fasta(sequences: DataFrame, title: str = "title", symbols: str = "residues") -> DataFrame:
    """Adds record: >title, newline, the symbols in lines of 80."""
    return sequences.withColumn("record", F.concat(F.lit(">"), F.col(title), F.lit("\n"), wrapped(F.col(symbols))))
