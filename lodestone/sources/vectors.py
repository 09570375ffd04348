"""Loading and checking sparse triples and dense vectors.

A sparse matrix is a table (row id, term, weight) plus its shape, as empty rows and unused
columns leave no triple. Rows always carry an id; there is no row order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import split_terms
from ..operators.ranges import running_total
from .staging import staged


class Shape(NamedTuple):
    rows: int
    cols: int


def csr_to_triples(spark: SparkSession, indptr: list[int], indices: list[int], data: list[float], shape: Shape) -> DataFrame:
    """(row_id, term, weight) from compressed rows; repeated terms of a row are summed."""
    if len(indptr) != shape.rows + 1:
        raise ValueError("indptr must have one entry more than rows")
    if len(indices) != len(data):
        raise ValueError("indices and data differ in length")
    rows = [(r, int(indices[i]), float(data[i])) for r in range(shape.rows) for i in range(indptr[r], indptr[r + 1])]
    return summed(spark.createDataFrame(rows, "row_id long, term int, weight double"))


def csr_table_to_triples(rows: DataFrame) -> DataFrame:
    """Triples from a table with one row for each matrix row: (row_id, indices, data)."""
    aligned = rows.select("row_id", F.assert_true(F.size("indices") == F.size("data"), "indices and data differ in length").alias("ok"), F.posexplode(F.arrays_zip("indices", "data")).alias("at", "e"))
    return summed(aligned.where("ok is null").select("row_id", F.col("e.indices").alias("term"), F.col("e.data").cast("double").alias("weight")))


def summed(triples: DataFrame) -> DataFrame:
    """One triple for each row and term."""
    return triples.groupBy("row_id", "term").agg(F.sum("weight").alias("weight"))


def text_triples(texts: DataFrame, id_col: str, text_col: str, out_id: str) -> DataFrame:
    """(out_id, term, weight): how often each term occurs in each text.

    Texts are dealt by id before they are cut: the count, and later sums by (query, id), then
    find all rows of an id in one partition and need no shuffle of their own.
    """
    dealt = texts.select(F.col(id_col).alias(out_id), F.col(text_col).alias("text")).repartition(out_id)
    terms = dealt.select(out_id, F.explode(split_terms(F.col("text"))).alias("term")).where("term <> ''")
    return terms.groupBy(out_id, "term").agg(F.count("*").cast("double").alias("weight"))


# ---------------------------------------------------------------- compressed rows


def write_csr(triples: DataFrame, shape: Shape, path: str, row: str = "row_id") -> None:
    """Store (row, term, weight) as compressed rows under ``path``: ``indptr``, ``entries`` and ``shape``.

    Rows 0..rows-1 follow each other in ``entries``, their terms in order.
    """
    spark = triples.sparkSession
    sizes = triples.groupBy(F.col(row).cast("long").alias("i")).agg(F.count("*").alias("n"))
    every = staged(spark.range(shape.rows).withColumnRenamed("id", "i").join(sizes, "i", "left").na.fill(0, ["n"]), "row-sizes")
    ends = staged(running_total(every, ["i"], "n", "value"), "row-ends")
    first = spark.createDataFrame([(0, 0)], "i long, value long")
    ends.select((F.col("i") + 1).alias("i"), "value").unionByName(first).write.parquet(f"{path}/indptr")
    nth = F.row_number().over(Window.partitionBy("i").orderBy("term")) - 1
    entries = triples.select(F.col(row).cast("long").alias("i"), F.col("term").cast("int").alias("term"), F.col("weight").cast("double").alias("weight"))
    placed = entries.withColumn("nth", nth).join(ends, "i").select((F.col("value") - F.col("n") + F.col("nth")).alias("at"), F.col("term").alias("index"), F.col("weight").alias("data"))
    placed.write.parquet(f"{path}/entries")
    spark.createDataFrame([(shape.rows, shape.cols)], "rows long, cols long").write.parquet(f"{path}/shape")


def read_shape(spark: SparkSession, path: str) -> Shape:
    """The stored shape; raises where it isn't one row."""
    rows = spark.read.parquet(f"{path}/shape").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} needs one shape, not {len(rows)}")
    return Shape(rows[0]["rows"], rows[0]["cols"])


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, term, weight) from stored compressed rows; raises where they don't fit together."""
    shape = read_shape(spark, path)
    indptr, entries = spark.read.parquet(f"{path}/indptr"), spark.read.parquet(f"{path}/entries")
    known, low, high, last = indptr.agg(F.count_distinct("i"), F.min("i"), F.max("i"), F.max("value")).first()
    n, first, end = entries.agg(F.count_distinct("at"), F.min("at"), F.max("at")).first()
    if known != shape.rows + 1 or low != 0 or high != shape.rows:
        raise ValueError("indptr must have one entry more than rows")
    if n != last or n and (first, end) != (0, n - 1) or n != entries.count():
        raise ValueError("entries must be as many as indptr says")
    begins, ends = indptr.select("i", F.col("value").alias("begin")), indptr.select((F.col("i") - 1).alias("i"), F.col("value").alias("end"))
    rows = begins.join(ends, "i").withColumn("fine", F.assert_true(F.col("begin") <= F.col("end"), "indptr must not fall"))
    places = rows.where("fine is null and begin < end").select(F.col("i").alias("row_id"), F.explode(F.sequence("begin", F.col("end") - 1)).alias("at"))
    return summed(validate_terms(places.join(entries, "at").select("row_id", F.col("index").alias("term"), F.col("data").alias("weight")), shape.cols))


def validate_terms(triples: DataFrame, cols: int) -> DataFrame:
    """``triples``, with an error at run time for a term outside 0..cols-1."""
    fine = F.col("term").between(0, cols - 1)
    return triples.withColumn("term", F.when(fine, F.col("term")).otherwise(F.raise_error(F.lit(f"term outside 0..{cols - 1}")).cast("int")))


def known_terms(queries: DataFrame, cols: int) -> DataFrame:
    """Query triples without terms that the corpus can't have."""
    return queries.where(F.col("term").between(0, cols - 1))


def same_width(a: Shape, b: Shape) -> None:
    if a.cols != b.cols:
        raise ValueError(f"corpus has {a.cols} columns, queries have {b.cols}")


def dense_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int | None = None) -> DataFrame:
    """(id, embedding array<float>); with ``width``, an error at run time for another length."""
    v = F.col(vector_col).cast("array<float>")
    if width is not None:
        v = F.when(F.size(v) == width, v).otherwise(F.raise_error(F.lit(f"a vector is not {width} long")).cast("array<float>"))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("embedding"))
