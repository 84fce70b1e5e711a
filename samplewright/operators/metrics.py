"""Statistics of runs: stages, workers, queues, throughput, scaling, training logs.

Everything is a map-side combined aggregation; medians and percentiles come from
``rank.order_statistics``, which does not gather a group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from samplewright.functions.columns import as_col, pct, safe_ratio, to_ms
from samplewright.functions.fixed import PROJECTION_EPOCHS, PROJECTION_IMAGES, STAGES
from samplewright.operators.rank import medians
from samplewright.session import broadcast_if_small, same_keys, settled


def _std(column: str | Column) -> Column:
    """Sample standard deviation, 0 for a single row."""
    return F.coalesce(F.stddev_samp(column), F.lit(0.0))


def stage_stats(df: DataFrame, stages: Sequence[str] = STAGES, keys: Sequence[str] = (), stage: str = "stage",
                seconds: str = "seconds", weight: str | None = None) -> DataFrame:
    """``count, mean_ms, std_ms, total_s`` of every stage in ``stages``, zeros where it has no rows.

    ``weight`` names a size column: each row then stands for that many samples
    which share its seconds equally.
    """
    keys = list(keys)
    if weight is None:
        n, mean, std = F.count(seconds), F.avg(seconds), _std(seconds)
    else:
        each = F.col(seconds) / F.col(weight)
        n, total = F.sum(weight), F.sum(seconds)
        mean = total / n
        spread = F.greatest(F.sum(F.col(seconds) * each) - n * mean * mean, F.lit(0.0))
        std = F.when(n > 1, F.sqrt(spread / F.nullif(n - 1, F.lit(0)))).otherwise(F.lit(0.0))
    found = df.where(F.col(stage).isin(*stages)).groupBy(*keys, stage).agg(
        n.alias("_count"), mean.alias("_mean"), std.alias("_std"), F.sum(seconds).alias("_total")
    )
    listed = F.explode(F.array(*[F.lit(s) for s in stages])).alias(stage)
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    wanted = groups.select(*keys, listed)
    joined = wanted.join(found, same_keys(wanted, found, [*keys, stage]), "left")
    zero = F.lit(0.0)
    return joined.select(
        *[wanted[k] for k in [*keys, stage]],
        F.coalesce("_count", F.lit(0).cast("bigint")).cast("bigint").alias("count"),
        F.coalesce(to_ms("_mean"), zero).alias("mean_ms"),
        F.coalesce(to_ms("_std"), zero).alias("std_ms"),
        F.coalesce(F.bround("_total", 3), zero).alias("total_s"),
    )


def amortised_wait(df: DataFrame, keys: Sequence[str], seconds: str = "seconds", size: str = "size",
                   weighting: str = "chunk") -> DataFrame:
    """``num_puts, mean_put_ms, put_us_per_sample`` of chunk hand-overs.

    ``chunk`` averages ``seconds/size`` over chunks, ``sample`` over samples.
    """
    if weighting == "chunk":
        per_sample = F.avg(F.col(seconds) / F.col(size))
    elif weighting == "sample":
        per_sample = F.sum(seconds) / F.sum(size)
    else:
        raise ValueError(f"unknown weighting {weighting!r}")
    return df.groupBy(*keys).agg(
        F.count(seconds).alias("num_puts"),
        (F.avg(seconds) * 1000).alias("mean_put_ms"),
        (per_sample * 1_000_000).alias("put_us_per_sample"),
    )


def worker_snapshot(df: DataFrame, keys: Sequence[str] = ("worker_id",), busy: str = "busy_s",
                    idle: str = "idle_s", samples: str | None = None) -> DataFrame:
    """``samples_processed, busy_time_s, idle_time_s, utilization_pct`` per worker."""
    done = F.count(busy) if samples is None else F.sum(samples)
    sums = df.groupBy(*keys).agg(
        done.alias("samples_processed"),
        F.coalesce(F.sum(busy), F.lit(0.0)).alias("_busy"),
        F.coalesce(F.sum(idle), F.lit(0.0)).alias("_idle"),
    )
    return sums.select(
        *keys, "samples_processed",
        F.bround("_busy", 4).alias("busy_time_s"),
        F.bround("_idle", 4).alias("idle_time_s"),
        pct("_busy", "_idle").alias("utilization_pct"),
    )


def queue_counters(events: DataFrame, keys: Sequence[str] = ("name",), kind: str = "kind",
                   wait: str = "wait_s") -> DataFrame:
    """Counters per queue from its events (``put``, ``get``, ``empty``, ``full``)."""
    def waited(which: str) -> Column:
        return F.bround(F.coalesce(F.sum(F.when(F.col(kind) == which, F.col(wait))), F.lit(0.0)), 4)

    return events.groupBy(*keys).agg(
        F.count_if(F.col(kind) == "put").alias("put_count"),
        F.count_if(F.col(kind) == "get").alias("get_count"),
        F.count_if(F.col(kind) == "empty").alias("empty_events"),
        F.count_if(F.col(kind) == "full").alias("full_events"),
        waited("put").alias("total_put_wait_s"),
        waited("get").alias("total_get_wait_s"),
    )


def run_summary(workers: DataFrame, runs: DataFrame, queues: DataFrame | None = None,
                stages: DataFrame | None = None, key: str = "run_id") -> DataFrame:
    """One nested row per run: epoch time, workers, aggregate, queue and stage blocks.

    ``workers`` is a snapshot per (run, worker), ``runs`` has ``epoch_time_s`` and
    ``batches_produced`` per run, ``queues`` has counters per (run, name) and
    ``stages`` statistics per (run, stage). All are summary tables: a run has as
    many rows as it has workers, queues or stages.
    """
    snapshot = F.struct("worker_id", "samples_processed", "busy_time_s", "idle_time_s", "utilization_pct")
    rolled = workers.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("num_workers"),
        F.array_sort(F.collect_list(snapshot)).alias("workers"),
        F.sum("busy_time_s").alias("_busy"), F.sum("idle_time_s").alias("_idle"),
    ).select(
        key, "num_workers", "workers",
        F.struct(
            F.bround("_busy", 4).alias("total_busy_time_s"),
            F.bround("_idle", 4).alias("total_idle_time_s"),
            pct("_busy", "_idle").alias("avg_utilization_pct"),
        ).alias("aggregate"),
    )
    out = runs.select(key, F.bround("epoch_time_s", 2).alias("epoch_time_s"), "batches_produced").join(rolled, key, "left")
    if queues is not None:
        block = F.struct(*[c for c in queues.columns if c != key])
        for name in ("staging", "batch"):
            one = queues.where(F.col("name") == name).select(key, block.alias(f"{name}_queue"))
            out = out.join(one, key, "left")
    if stages is not None:
        entry = F.struct("stage", F.struct("count", "mean_ms", "std_ms", "total_s"))
        blocks = stages.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("stage_times"))
        out = out.join(blocks, key, "left")
    return out


def throughput(df: DataFrame, keys: Sequence[str], count_mode: str = "actual", batch_size: int | None = None,
               n: str = "n", elapsed: str = "elapsed_s") -> DataFrame:
    """``samples, batches, elapsed_s, throughput`` of runs given one row per batch.

    ``nominal`` counts every batch as full, ``actual`` counts its rows.
    """
    if count_mode == "actual":
        samples = F.sum(n)
    elif count_mode == "nominal":
        samples = F.count(n) * batch_size
    else:
        raise ValueError(f"unknown count_mode {count_mode!r}")
    runs = df.groupBy(*keys).agg(
        samples.alias("samples"), F.count(n).alias("batches"), F.max(elapsed).alias("elapsed_s")
    )
    return runs.withColumn("throughput", safe_ratio("samples", "elapsed_s"))


def timing_summary(df: DataFrame, keys: Sequence[str], batch_size: int | str, time_ms: str = "time_ms",
                   digits: int | None = 2) -> DataFrame:
    """``num_batches_completed, mean/std/median/min/max_ms, throughput_img_s`` per key."""
    keys = list(keys)
    batch = F.col(batch_size) if isinstance(batch_size, str) else F.lit(batch_size)
    sums = df.groupBy(*keys).agg(
        F.count(time_ms).alias("num_batches_completed"), F.avg(time_ms).alias("_mean"), _std(time_ms).alias("_std"),
        F.min(time_ms).alias("_min"), F.max(time_ms).alias("_max"),
    ).where("num_batches_completed > 0")
    middle = medians(df, keys, time_ms, "_median")
    joined = sums.join(middle, same_keys(sums, middle, keys))

    def shown(name: str, places: int | None = digits) -> Column:
        return F.col(name) if digits is None else F.bround(name, places)

    speed = batch / F.col("_mean") * 1000
    return joined.select(
        *[sums[k] for k in keys], "num_batches_completed",
        shown("_mean").alias("mean_ms"), shown("_std").alias("std_ms"), shown("_median").alias("median_ms"),
        shown("_min").alias("min_ms"), shown("_max").alias("max_ms"),
        (speed if digits is None else F.bround(speed, 1)).alias("throughput_img_s"),
    )


def anomalies(df: DataFrame, keys: Sequence[str], value: str = "time_ms", k: float = 1.5) -> DataFrame:
    """``n, mean, cv_pct, anomaly_count, anomaly_pct``: values strictly above ``k`` times the mean."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), _std(value).alias("_std")
    )
    base = settled(base.withColumnsRenamed({c: f"_key_{c}" for c in keys}))
    match = F.lit(True)
    for c in keys:
        match = match & df[c].eqNullSafe(base[f"_key_{c}"])
    counted = df.join(broadcast_if_small(base), match).groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("_std").alias("_std"),
        F.count_if(F.col(value) > F.col("mean") * k).alias("anomaly_count"),
    )
    return counted.select(
        *keys, "n", "mean", (F.try_divide("_std", "mean") * 100).alias("cv_pct"),
        "anomaly_count", (F.try_divide("anomaly_count", "n") * 100).alias("anomaly_pct"),
    )


def delay_config(df: DataFrame, gpu: str = "gpu", model: str = "model", digits: int | None = 2) -> DataFrame:
    """Per device: a map of model means, their unweighted mean, and the model count."""
    def shown(column: str | Column) -> Column:
        return F.bround(column, digits) if digits is not None else as_col(column)

    by_model = df.groupBy(gpu, model).agg(F.avg("mean_ms").alias("_mean"), F.avg("std_ms").alias("_std"))
    entry = F.struct(model, F.struct(shown("_mean").alias("mean_ms"), shown("_std").alias("std_ms")))
    return by_model.groupBy(gpu).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("models"),
        shown(F.avg("_mean")).alias("default_mean_ms"),
        shown(F.avg("_std")).alias("default_std_ms"),
        F.count(F.lit(1)).cast("int").alias("num_models_benchmarked"),
    )


def delay_config_long(config: DataFrame, gpu: str = "gpu") -> DataFrame:
    """One row per device and model (a device without models keeps one row)."""
    rows = config.select(
        F.col(gpu).alias("gpu"), F.explode_outer("models").alias("model", "_entry"),
        "default_mean_ms", "default_std_ms", "num_models_benchmarked",
    )
    return rows.select(
        "gpu", "model", F.col("_entry.mean_ms").alias("mean_ms"), F.col("_entry.std_ms").alias("std_ms"),
        "default_mean_ms", "default_std_ms", "num_models_benchmarked",
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def scaling_table(df: DataFrame, mode: str = "mode", workers: str = "workers", value: str = "throughput",
                  cpu: str = "cpu_cores") -> DataFrame:
    """Per (mode, workers): mean and std over repeats, mean cores, speed-up against one worker."""
    rows = df.groupBy(mode, workers).agg(
        F.avg(value).alias("mean_throughput"), _std(value).alias("std_throughput"), F.avg(cpu).alias("mean_cpu_cores")
    )
    # Summary rows: one per worker count.
    single = F.max(F.when(F.col(workers) == 1, F.col("mean_throughput"))).over(Window.partitionBy(mode))
    return rows.withColumn("speedup_vs_1", F.try_divide(F.col("mean_throughput"), single))


def best_config(df: DataFrame, mode: str = "mode", workers: str = "workers", value: str = "mean_throughput") -> DataFrame:
    """The worker count with the largest mean per mode (the smaller count on a tie)."""
    best = F.max_by(F.struct(workers, value), F.struct(F.col(value), -F.col(workers)))
    return df.groupBy(mode).agg(best.alias("_best")).select(
        mode, F.col(f"_best.{workers}").alias("best_workers"), F.col(f"_best.{value}").alias("best_throughput")
    )


def load_balance(df: DataFrame, keys: Sequence[str] = ("mode", "workers", "repeat"), seconds: str = "seconds",
                 samples: str = "samples", wall: str | None = None, cpu: str | None = None) -> DataFrame:
    """Throughput and spread of worker times given one row per worker; ``tail_ratio = max/mean``.

    The wall time of a run is its ``wall`` column, or the slowest worker.
    """
    elapsed = F.max(seconds if wall is None else wall)
    columns = [
        F.try_divide(F.sum(samples).cast("double"), elapsed).alias("throughput"),
        F.min(seconds).alias("worker_min_s"), F.avg(seconds).alias("worker_mean_s"),
        F.max(seconds).alias("worker_max_s"), _std(seconds).alias("worker_std_s"),
        F.try_divide(F.max(seconds), F.avg(seconds)).alias("tail_ratio"),
    ]
    if cpu is not None:
        columns.append(F.try_divide(F.sum(cpu), elapsed).alias("cpu_cores"))
    return df.groupBy(*keys).agg(*columns)


def repeat_means(df: DataFrame, keys: Sequence[str], values: Sequence[str] = ("throughput",)) -> DataFrame:
    """Mean over repeats of each configuration."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(f"mean_{v}") for v in values], F.count(F.lit(1)).alias("repeats"))


def stage_share(df: DataFrame, keys: Sequence[str], stage: str = "stage", value: str = "mean_ms",
                weights: dict[str, float] | None = None) -> DataFrame:
    """``share_pct`` of each stage in the sum over stages; ``weights`` multiplies stages first.

    The input is a summary with one row per key and stage.
    """
    amount = F.col(value)
    if weights:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        amount = amount * F.coalesce(F.try_element_at(table, F.col(stage)), F.lit(1.0))
    rows = df.withColumn("_amount", amount)
    total = F.sum("_amount").over(Window.partitionBy(*keys))
    return rows.withColumns({"total": total, "share_pct": F.try_divide(F.col("_amount"), total) * 100}).drop("_amount")


def top_stages(df: DataFrame, k: int = 30, stage: str = "stage", seconds: str = "seconds") -> DataFrame:
    """The ``k`` stages with the largest total time."""
    totals = df.groupBy(stage).agg(F.sum(seconds).alias("total_s"), F.count(seconds).alias("calls"))
    return totals.orderBy(F.desc("total_s"), stage).limit(k)


def ideal_scaling(df: DataFrame, series: str, workers: str = "workers", value: str = "throughput") -> DataFrame:
    """``ideal = one-worker value * workers`` and ``efficiency = value/ideal`` on a summary table."""
    base = F.max(F.when(F.col(workers) == 1, F.col(value))).over(Window.partitionBy(series))
    return df.withColumn("ideal", base * F.col(workers)).withColumn("efficiency", F.try_divide(value, "ideal"))


def loading_report(df: DataFrame, batch_size: int, epoch: str = "epoch", data: str = "data_time",
                   compute: str = "compute_time") -> DataFrame:
    """Per epoch, and overall (``epoch`` NULL): mean data and compute time, wait share, throughput.

    The overall row averages the epoch means and carries the projected hours.
    """
    epochs = df.groupBy(epoch).agg(F.avg(data).alias("avg_data_time"), F.avg(compute).alias("avg_compute_time"))
    overall = epochs.agg(
        F.avg("avg_data_time").alias("avg_data_time"), F.avg("avg_compute_time").alias("avg_compute_time")
    ).where("avg_data_time is not null").select(
        F.lit(None).cast(df.schema[epoch].dataType).alias(epoch), "avg_data_time", "avg_compute_time"
    )
    rows = epochs.unionByName(overall).withColumn("avg_total_time", F.col("avg_data_time") + F.col("avg_compute_time"))
    rows = rows.withColumns({
        "gpu_wait_pct": safe_ratio(100.0 * F.col("avg_data_time"), "avg_total_time"),
        "throughput_img_s": safe_ratio(F.lit(float(batch_size)), "avg_total_time"),
    })
    hours = F.when(F.col(epoch).isNull(), PROJECTION_IMAGES / F.nullif("throughput_img_s", F.lit(0.0)) / 3600)
    return rows.withColumns({"hours_per_epoch": hours, "hours_total": hours * PROJECTION_EPOCHS})


def epoch_metrics(df: DataFrame, by_rank: bool = False, epoch: str = "epoch", rank: str = "rank",
                  n: str = "n", loss: str = "loss", corrects: str = "corrects") -> DataFrame:
    """Sample-weighted loss and accuracy per epoch, over all replicas or per replica."""
    keys = [epoch, rank] if by_rank else [epoch]
    return df.groupBy(*keys).agg(
        F.sum(n).alias("samples"),
        F.try_divide(F.sum(F.col(loss) * F.col(n)), F.sum(n)).alias("loss"),
        F.try_divide(F.sum(corrects) * F.lit(100.0), F.sum(n)).alias("accuracy"),
    )
