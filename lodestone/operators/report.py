"""Frontiers and operating points over run records (see ``sources.tasks.RUN``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import params_control

TOLERANCE = 1e-6


def distinct_datasets(runs: DataFrame, task: str) -> DataFrame:
    return runs.where(F.col("task") == task).select("dataset").distinct()


def only_dataset(runs: DataFrame, task: str) -> str:
    """The data set of a task's runs; raises where there is none or more than one."""
    names = sorted(r["dataset"] for r in distinct_datasets(runs, task).limit(100).collect())
    if len(names) != 1:
        raise ValueError(f"runs of {task} name {names or 'no data set'}; give one")
    return names[0]


def runs_for(runs: DataFrame, task: str, dataset: str | None = None) -> DataFrame:
    found = runs.where(F.col("task") == task)
    return found if dataset is None else found.where(F.col("dataset") == dataset)


def qps(runs: DataFrame, query_counts: DataFrame) -> DataFrame:
    """Runs with ``ctrl`` and queries per second; a run without a time has none and is left out."""
    joined = runs.join(query_counts, ["dataset", "task"])
    return joined.withColumns({"qps": F.try_divide("n_queries", "querytime"), "ctrl": params_control(F.col("params"))}).where("qps is not null")


def pareto_frontier(points: DataFrame) -> DataFrame:
    """(algo, qps, recall, ctrl) of the runs that no faster run reaches in recall; recall 0 never counts."""
    faster = Window.partitionBy("dataset", "task", "algo").orderBy(F.desc("qps"), F.desc("recall"), F.desc("ctrl")).rowsBetween(Window.unboundedPreceding, -1)
    best = points.withColumn("_best", F.coalesce(F.max("recall").over(faster), F.lit(0.0)))
    return best.where("recall > _best").select("dataset", "task", "algo", "qps", "recall", "ctrl")


def fastest_above(runs: DataFrame, threshold: float) -> DataFrame:
    return runs.where(F.col("recall") > threshold).groupBy("algo", "dataset").agg(F.min("querytime").alias("querytime"))


def best_below(runs: DataFrame, threshold: float) -> DataFrame:
    """For groups without a run above: largest recall and largest time, each on its own."""
    groups = runs.groupBy("algo", "dataset").agg(F.max("recall").alias("recall"), F.max("querytime").alias("querytime"))
    return groups.where(F.col("recall") <= threshold)


def passing(runs: DataFrame, threshold: float) -> DataFrame:
    return runs.where(F.col("recall") >= threshold - TOLERANCE).orderBy("dataset", "algo", "querytime")


def failing(runs: DataFrame, threshold: float) -> DataFrame:
    return runs.where(F.col("recall") < threshold - TOLERANCE).orderBy("dataset", "algo", "querytime")


def scaling_regression(times: DataFrame, size: float, x: str = "n", y: str = "seconds") -> DataFrame:
    """One row: slope, intercept and the time predicted for ``size``."""
    fit = times.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return fit.withColumn("predicted", F.col("intercept") + F.col("slope") * size)
