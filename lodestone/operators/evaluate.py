"""Recall of results against ground truth, both (query_id, rank, doc_id) with ranks from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits_per_query(results: DataFrame, truth: DataFrame, k: int, query_ids: DataFrame) -> DataFrame:
    """(query_id, hits): distinct documents in the first k of both; queries without any count too."""
    first = lambda df: df.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    hits = first(results).join(first(truth), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    return query_ids.select("query_id").join(hits, "query_id", "left").na.fill(0, ["hits"])


def recall_at_k(results: DataFrame, truth: DataFrame, k: int, query_ids: DataFrame) -> DataFrame:
    """One row: hits over queries x k, also where the truth has fewer than k."""
    return hits_per_query(results, truth, k, query_ids).agg((F.sum("hits") / (F.count("*") * F.lit(k))).alias("recall"))


def wide_recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Recall of (query_id, knns) arrays; raises where k exceeds the columns or the queries differ in number."""
    columns, n = results.agg(F.min(F.size("knns")), F.count("*")).first()
    if k > (columns or 0):
        raise ValueError(f"k={k} exceeds the {columns} columns of the results")
    if n != truth.count():
        raise ValueError("results and ground truth differ in their number of queries")
    pairs = results.select("query_id", F.slice("knns", 1, k).alias("a")).join(truth.select("query_id", F.slice("knns", 1, k).alias("b")), "query_id")
    return pairs.agg((F.sum(F.size(F.array_intersect("a", "b"))) / (F.count("*") * F.lit(k))).alias("recall"))


def runs_known(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """Runs of a known (dataset, task)."""
    return runs.join(configs.select("dataset", "task").distinct(), ["dataset", "task"], "left_semi")
