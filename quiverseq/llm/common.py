"""What the operators share: written intermediate tables, and reading a table of the input folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir for this application; in local mode without that setting, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quiverseq-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/quiverseq-{spark.sparkContext.applicationId}"


#: For each noted() that is open, the paths that written() has used since.
_notes: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    for paths in _notes:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quiverseq_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that written() returned; results that read them must be consumed before."""
    for table_ in tables:
        drop_paths(table_.sparkSession, [table_._quiverseq_path])


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables that written() makes meanwhile, for drop_paths() once what reads them is consumed."""
    paths: list[str] = []
    _notes.append(paths)
    try:
        yield paths
    finally:
        _notes[:] = [x for x in _notes if x is not paths]


def boxed(docs: DataFrame, used: list[str]) -> DataFrame:
    """The columns used, and all others in one struct, so that names of working columns clash with none of them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*(rest or [F.lit(True)])).alias("_rest"))


def unboxed(df: DataFrame, columns: list[str], used: list[str]) -> list:
    """Expressions that restore the given columns from boxed rows."""
    return [F.col(c) if c in used else F.col("_rest").getField(c).alias(c) for c in columns]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text"):
    """Number of words; null text has none."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")
