"""One top-k for all searches: score descending, then id ascending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topk(scores: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", score: str = "score") -> DataFrame:
    """(query, rank, doc, score) with ranks from 1. Spark keeps k rows of each query before the shuffle."""
    best = Window.partitionBy(query).orderBy(F.desc(score), F.asc(doc))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query, "rank", doc, score)


def wide(results: DataFrame) -> DataFrame:
    """(query_id, knns, dists) in rank order, with ids from 1 as results are stored."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))
    rows = results.groupBy("query_id").agg(ordered.alias("r"))
    return rows.select("query_id", F.transform("r", lambda x: x["doc_id"] + 1).alias("knns"), F.transform("r", lambda x: x["score"]).alias("dists"))


def padded(results: DataFrame, query_ids: DataFrame, k: int) -> DataFrame:
    """(query_id, knns, dists) of length ``k`` for all queries; missing places are id 0 and score 0."""
    return query_ids.select("query_id").join(wide(results), "query_id", "left").select(
        "query_id",
        F.slice(F.concat(F.coalesce("knns", F.array().cast("array<long>")), F.array_repeat(F.lit(0).cast("long"), k)), 1, k).alias("knns"),
        F.slice(F.concat(F.coalesce("dists", F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), k)), 1, k).alias("dists"),
    )
