"""The stored inverted index of a table's texts, built once and searched often."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..operators import sparse
from ..sources import vectors
from ..sources.staging import new_folder, shared_folder

TERMS = "split at all but letters and digits, 1"


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of a table's place, files, bytes and time of change."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    sums, status = fs.getContentSummary(place), fs.getFileStatus(place)
    told = (str(status.getPath()), sums.getFileCount(), sums.getLength(), status.getModificationTime(), TERMS)
    return hashlib.sha256(repr(told).encode()).hexdigest()[:24]


def built_index(spark: SparkSession, path: str, id_col: str, text_col: str, to: str) -> None:
    texts = spark.read.parquet(path)
    sparse.write_index(vectors.text_triples(texts, id_col, text_col, "doc_id"), texts.count(), to)


def stored_index(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of the table at ``path``, built if the shared folder has none of the table as it is now.

    It is written beside its place and renamed, so an index is there whole or not at all.
    """
    to = f"{shared_folder(spark)}/lodestone/index-{state_of(spark, path)}"
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(to).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(make(to)):
        pending = new_folder(spark, "pending-index")
        built_index(spark, path, id_col, text_col, pending)
        if fs.exists(make(to)) or not fs.rename(make(pending), make(to)):
            fs.delete(make(pending), True)
    return spark.read.parquet(to)
