"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARQUET = "{}/{}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(PARQUET.format(sf_dir, name))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that the session names in spark.checkpoint.dir.

    Where the session names none, a local master, whose one machine is all there is, gets a
    folder of its own; a cluster is an error, not a reason to write to one machine's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "patternmill-scratch")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the table read back.

    This cuts the lineage: lost executors cost a reread, not the work before it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    # Shuffle files of the finished job go once the driver has collected its garbage.
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more: what was made of them is stored itself."""
    for df in tables:
        remove(df.sparkSession, df._stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whichever store it lies."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def digest_of(*columns: Column) -> Column:
    """128 bits of a hash that tell rows apart; null is unlike any text."""
    return F.unhex(F.md5(F.concat(*[F.concat(F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit(""))) for c in (x.cast("string") for x in columns)])))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
