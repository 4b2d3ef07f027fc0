"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table under spark.checkpoint.dir (in local mode, if unset, under a temporary folder)."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quiverseq-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/quiverseq-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quiverseq_path = path
    return out


def discarded(df: DataFrame) -> None:
    """Removes a table that stored() returned; results that read it must be consumed before."""
    sc = df.sparkSession.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(df._quiverseq_path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
