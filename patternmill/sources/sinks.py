"""Sinks for output rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text(lines: DataFrame, path: str, column: str = "value", mode: str = "overwrite") -> None:
    """Lines as text files; one writer a partition, committed as a whole."""
    lines.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def write_by_destination(rows: DataFrame, path: str, dest: str = "dest", column: str = "value", append: bool = False) -> None:
    """print > name: a folder for each destination below path."""
    rows.select(dest, F.col(column).cast("string").alias("value")).write.mode("append" if append else "overwrite").partitionBy(dest).text(path)
