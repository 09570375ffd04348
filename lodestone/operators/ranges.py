"""Running sums in sorted order without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

RANGE_ROWS = 250_000


def running_total(rows: DataFrame, by: list[str | Column], value: str, total: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``total``: the sum of ``value`` over all rows up to and including each, ordered ``by``.

    Rows that are equal in ``by`` come in any order; ``rows`` must be cheap to read twice (a staged table).
    Rows are cut into ranges of about ``range_rows``; each is summed by itself and then moved by
    the ranges before it (one row for each range). The ranges are written before they are
    used, so both uses see the same ones, however often a task runs.
    """
    parts = max(1, -(-rows.count() // range_rows))
    ranged = staged(rows.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn(total, F.sum(value).over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    return inside.join(F.broadcast(before), "_part").withColumn(total, F.col(total) + F.col("_before")).drop("_part", "_before")
