"""Profiles of sparse and dense data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .ranges import RANGE_ROWS, running_total


def weight_range(triples: DataFrame) -> DataFrame:
    return triples.agg(F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))


def negative_rows(triples: DataFrame, id_col: str) -> DataFrame:
    return triples.groupBy(id_col).agg(F.min("weight").alias("min_weight")).where("min_weight < 0")


def nnz_stats(triples: DataFrame, id_col: str) -> DataFrame:
    return triples.groupBy(id_col).count().agg(F.avg("count").alias("avg_nnz"), F.min("count").alias("min_nnz"), F.max("count").alias("max_nnz"))


def neighbor_frequency(results: DataFrame) -> DataFrame:
    """(doc_id, n): how often each document is returned, most often first."""
    return results.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id")


def histogram(values: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, n) over equal widths from the smallest to the largest value, which belongs to the last bin."""
    low, high = values.agg(F.min(value), F.max(value)).first()
    if low is None:
        return values.sparkSession.createDataFrame([], "bin int, n long")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return values.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def moving_average(values: DataFrame, order: str, value: str, width: int, by: str) -> DataFrame:
    """(by, order, avg) over full windows of ``width`` rows, within each group of ``by``."""
    rows = Window.partitionBy(by).orderBy(order).rowsBetween(-(width - 1), 0)
    out = values.select(by, order, F.avg(value).over(rows).alias("avg"), F.count(value).over(rows).alias("_n"))
    return out.where(F.col("_n") == width).drop("_n")


def max_normalize(triples: DataFrame, id_col: str) -> DataFrame:
    top = F.max("weight").over(Window.partitionBy(id_col))
    return triples.withColumn("weight", F.try_divide("weight", top))


def term_offsets(df: DataFrame, terms: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(term, offset_end): running sum of document frequencies over all ``terms`` in order, absent ones too."""
    known = staged(terms.join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df")), "terms")
    return running_total(known, ["term"], "df", "offset_end", range_rows).select("term", "offset_end")


def sample_rows(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return rows.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n)


def gather_rows(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return rows.join(ids.select(id_col).distinct(), id_col)


def sanity_checks(n_rows: int, n_cols: int, n_queries: int, rows: tuple[int, int] = (55_000, 60_000), cols: int = 30_000, queries: int = 3_000) -> dict[str, bool]:
    return {"rows_ok": rows[0] <= n_rows <= rows[1], "cols_ok": n_cols >= cols, "queries_ok": n_queries >= queries}
