"""Shared pieces: staged tables in the shared folder, row keys, input columns, DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import delete, discard, new_folder, shared_folder, staged

__all__ = ["delete", "discard", "keyed", "lower_ascii", "new_folder", "plainly", "read", "shared_folder", "staged"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Columns that name a row for good: its file and its place in the file.
ROW_KEY = ("_file", "_place")


def plainly(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by place, so that none clashes with an operator's, and the names."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with columns named by place and ROW_KEY, which every run of a plan gives alike.

    A table of Parquet files has such keys; rows of any other plan are written first.
    """
    plain, _ = plainly(docs)
    straight = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if not straight or "_metadata" in (c.lower() for c in docs.columns):
        docs = plain = staged(plain, "keyed")
    key = [F.col("_metadata.file_path").alias(ROW_KEY[0]), F.col("_metadata.row_index").alias(ROW_KEY[1])]
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, plain.columns, strict=True)], *key)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text):
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)
