"""Ordered operators over step, epoch and run sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from samplewright.functions.columns import every_k, int_div
from samplewright.operators.rank import dense_index, running
from samplewright.session import broadcast_if_small, settled

__all__ = [
    "byte_offsets", "drop_warmup", "every_k", "new_best", "running_mean", "running_metrics", "speedup_first",
]


def running_mean(df: DataFrame, keys: Sequence[str], index: str, value: str, every: int) -> DataFrame:
    """Mean so far and last value, reported at every ``every``-th row of a run.

    ``index`` numbers the rows of a run 1, 2, 3, … . Rows are first summed between
    two reports (map-side), so the cumulative step sees one row per report.
    """
    keys = list(keys)
    report = int_div(F.col(index) + (every - 1), every)
    parts = df.groupBy(*keys, report.alias("_report")).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n"),
        F.max(F.when(F.col(index) % every == 0, F.col(index))).alias("_at"),
        F.max(F.when(F.col(index) % every == 0, F.col(value))).alias("last_value"),
    )
    total = running(parts, keys, "_report", {"_total": ("_sum", "sum"), "_count": ("_n", "sum")})
    return total.where("_at is not null").select(
        *keys, F.col("_at").alias(index), F.try_divide("_total", "_count").alias("mean_so_far"), "last_value"
    )


def running_metrics(df: DataFrame, keys: Sequence[str], index: str, every: int, n: str = "n",
                    loss: str = "loss", corrects: str = "corrects") -> DataFrame:
    """Sample-weighted loss and accuracy so far at every ``every``-th batch (``index`` from 0)."""
    keys = list(keys)
    report = int_div(F.col(index), every)
    at = every_k(index, every)
    parts = df.groupBy(*keys, report.alias("_report")).agg(
        F.sum(F.col(loss) * F.col(n)).alias("_l"), F.sum(corrects).alias("_c"), F.sum(n).alias("_n"),
        F.max(F.when(at, F.col(index))).alias("_at"),
    )
    total = running(parts, keys, "_report", {"_loss": ("_l", "sum"), "_correct": ("_c", "sum"), "_samples": ("_n", "sum")})
    return total.where("_at is not null").select(
        *keys, F.col("_at").alias(index),
        F.try_divide("_loss", "_samples").alias("current_loss"),
        F.try_divide(F.lit(100.0) * F.col("_correct"), F.col("_samples")).alias("current_acc"),
    )


def new_best(df: DataFrame, keys: Sequence[str], order: str, value: str, initial: float = 0.0) -> DataFrame:
    """Rows whose value is strictly above everything before it (and above ``initial``)."""
    seen = running(df, keys, order, {"_best": (value, "max")}, inclusive=False)
    bar = F.greatest(F.coalesce("_best", F.lit(initial)), F.lit(initial))
    return seen.where(F.col(value) > bar).drop("_best")


def drop_warmup(df: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """Leave out the first ``k`` rows of each run (``order`` is unique in a run).

    Only the ``k``-th order value of each run is found - Spark keeps ``k`` rows per
    run and task for that - and used as a filter.
    """
    keys = list(keys)
    if k <= 0:
        return df
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    first = df.select(*keys, order).withColumn("_place", place).where(F.col("_place") <= k)
    bound = first.groupBy(*keys).agg(F.max(order).alias("_until"))
    bound = settled(bound.withColumnsRenamed({c: f"_run_{c}" for c in keys}))
    match = F.lit(True)
    for c in keys:
        match = match & df[c].eqNullSafe(bound[f"_run_{c}"])
    joined = df.join(broadcast_if_small(bound), match)
    return joined.where(F.col(order) > F.col("_until")).select(*[df[c] for c in df.columns])


def speedup_first(df: DataFrame, series: str, order: str = "workers", value: str = "throughput") -> DataFrame:
    """Each value of a series divided by the value at its smallest ``order``."""
    first = df.groupBy(series).agg(F.min_by(value, order).alias("_first")).withColumnRenamed(series, "_series")
    first = settled(first)
    joined = df.join(broadcast_if_small(first), df[series].eqNullSafe(first["_series"]))
    return joined.select(*[df[c] for c in df.columns], F.try_divide(value, "_first").alias("speedup"))


def byte_offsets(df: DataFrame, shard: str, order: str, length: str) -> DataFrame:
    """``start`` and ``end`` of each record in its shard (a shard has a bounded number of records)."""
    so_far = Window.partitionBy(shard).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(length).over(so_far)
    return df.withColumn("end", end).withColumn("start", F.col("end") - F.col(length))


def index_rows(df: DataFrame, keys: Sequence[str], order: str, out: str = "idx", start: int = 0) -> DataFrame:
    """Number the rows of each run in ``order``."""
    return dense_index(df, keys, order, out, start)
