"""Queries over run metrics. ``events`` stands for timing rows: ``event_type`` is the
stage, mode or device, ``user_id`` the worker or model, ``value`` milliseconds.

Values have two decimals, so their sums often end in exactly 5 at the digit a
half-even rounding looks at; queries that round take ``sqrt(value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions import columns as C
from samplewright.operators import lookup, metrics, series
from samplewright.operators import rank as ranks
from samplewright.plans.registry import query, table


def _events(spark, sf_dir, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*columns)


def _r(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- coverage and lookups -------------------------------------------------------

GRID_TYPES = ("click", "error", "purchase", "signup", "view")
_GRID_SQL = """
    grid AS (SELECT device, batch_size, 'm' || m::VARCHAR AS model, optimizer
        FROM (SELECT DISTINCT event_type AS device FROM events), (VALUES (32), (64), (128), (256)) b(batch_size),
        (SELECT unnest(range(16)) AS m), (VALUES ('adam'), ('sgd')) o(optimizer)),
    seen AS (SELECT DISTINCT event_type AS device, (32 * (1 << (event_id % 4)::INT))::INT AS batch_size,
        'm' || (user_id % 16)::VARCHAR AS model, CASE WHEN user_id % 2 = 0 THEN 'sgd' ELSE 'adam' END AS optimizer
        FROM events),
    gap AS (SELECT * FROM grid EXCEPT SELECT * FROM seen)
"""
GRID_KEYS = ("device", "batch_size", "model", "optimizer")


def _grid(spark, sf_dir) -> DataFrame:
    devices = _events(spark, sf_dir, F.col("event_type").alias("device")).distinct()
    grid = devices.withColumn("batch_size", F.explode(F.array(*[F.lit(b) for b in (32, 64, 128, 256)])))
    grid = grid.withColumn("model", F.explode(F.array(*[F.lit(f"m{m}") for m in range(16)])))
    return grid.withColumn("optimizer", F.explode(F.array(F.lit("adam"), F.lit("sgd"))))


def _runs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("device"),
        F.expr("shiftleft(32, int(event_id % 4))").alias("batch_size"),
        F.concat(F.lit("m"), (F.col("user_id") % 16).cast("string")).alias("model"),
        F.when(F.col("user_id") % 2 == 0, "sgd").otherwise("adam").alias("optimizer"),
    )


@query(f"WITH {_GRID_SQL} SELECT * FROM gap")
def coverage_gap(spark, sf_dir):
    return lookup.coverage_gap(_grid(spark, sf_dir), _runs(spark, sf_dir), GRID_KEYS)


@query(f"WITH {_GRID_SQL} SELECT * FROM gap")
def coverage_except(spark, sf_dir):
    """The same gap as a set difference."""
    return _grid(spark, sf_dir).subtract(lookup.observed_configs(_runs(spark, sf_dir), GRID_KEYS).select(*GRID_KEYS))


@query(f"""
    WITH {_GRID_SQL} SELECT d.device, count(gap.device) AS missing
    FROM (SELECT DISTINCT event_type AS device FROM events UNION SELECT 'unused') d LEFT JOIN gap ON gap.device = d.device
    GROUP BY d.device
""")
def coverage_gap_counts(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    gap = lookup.coverage_gap(grid, _runs(spark, sf_dir), GRID_KEYS)
    devices = grid.select("device").unionByName(spark.createDataFrame([("unused",)], "device string"))
    return lookup.coverage_counts(gap, devices)


@query(f"WITH {_GRID_SQL} SELECT * FROM seen")
def observed_configs(spark, sf_dir):
    return lookup.observed_configs(_runs(spark, sf_dir), GRID_KEYS)


_CONFIG_SQL = """
    models AS (SELECT event_type AS gpu, user_id % 16 AS model, avg(value) AS mean, avg(value / 10) AS std FROM events GROUP BY ALL),
    devices AS (SELECT gpu, CASE WHEN gpu = 'signup' THEN 0 ELSE avg(mean) END AS mean, avg(std) AS std FROM models GROUP BY gpu)
"""


def _timings(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("gpu"), (F.col("user_id") % 16).alias("model"),
        F.col("value").alias("mean_ms"), (F.col("value") / 10).alias("std_ms"),
    )


def _config(spark, sf_dir) -> DataFrame:
    """All devices and models measured; one device without a default."""
    config = metrics.delay_config_long(metrics.delay_config(_timings(table(spark, sf_dir, "events")), digits=None))
    return config.withColumn("default_mean_ms", F.when(F.col("gpu") == "signup", 0.0).otherwise(F.col("default_mean_ms")))


@query(f"""
    WITH {_CONFIG_SQL},
    asked AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'new ' || event_type ELSE event_type END AS gpu, user_id % 20 AS model FROM events)
    SELECT event_id,
        round(CASE WHEN m.gpu IS NOT NULL THEN m.mean WHEN d.mean <> 0 THEN d.mean ELSE 500 END / 1000, 12) AS delay_s,
        round(CASE WHEN m.gpu IS NOT NULL THEN m.std WHEN d.mean <> 0 THEN d.std ELSE 0 END / 1000, 12) AS std_s,
        CASE WHEN m.gpu IS NOT NULL THEN 'model' WHEN d.mean <> 0 THEN 'device' ELSE 'fallback' END AS tier
    FROM asked LEFT JOIN models m ON m.gpu = asked.gpu AND m.model = asked.model
    LEFT JOIN devices d ON d.gpu = asked.gpu
""")
def tiered_lookup(spark, sf_dir):
    """Every event asks for a device and model; some devices and some models were not measured."""
    device = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("new "), "event_type")).otherwise(F.col("event_type"))
    asked = _events(spark, sf_dir, "event_id", device.alias("gpu"), (F.col("user_id") % 20).alias("model"))
    return _r(lookup.tiered_lookup(asked, _config(spark, sf_dir)).drop("gpu", "model"), 12, "delay_s", "std_s")


@query("""
    WITH m AS (SELECT event_type AS gpu, user_id % 16 AS model, avg(value) AS mean, avg(value / 10) AS std FROM events GROUP BY ALL)
    SELECT gpu, model, round(mean, 9) AS mean_ms, round(std, 9) AS std_ms,
        round(avg(mean) OVER g, 9) AS default_mean_ms, round(avg(std) OVER g, 9) AS default_std_ms,
        (count(*) OVER g)::INT AS num_models_benchmarked
    FROM m WINDOW g AS (PARTITION BY gpu)
""")
def delay_config(spark, sf_dir):
    config = metrics.delay_config(_timings(table(spark, sf_dir, "events")), digits=None)
    return _r(metrics.delay_config_long(config), 9, "mean_ms", "std_ms", "default_mean_ms", "default_std_ms")


@query("""
    WITH s AS (SELECT user_id % 16 AS workers, avg(value) FILTER (event_type = 'click') AS a,
        avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)
    SELECT workers, round(a, 9) AS a_value, round(b, 9) AS b_value, round(b / a, 9) AS ratio,
        round((b / a - 1) * 100, 7) AS change_pct FROM s WHERE a IS NOT NULL AND b IS NOT NULL
""")
def ab_compare(spark, sf_dir):
    e = _events(spark, sf_dir, (F.col("user_id") % 16).alias("workers"), "event_type", "value")
    out = lookup.compare(e, "event_type", ["workers"], "value", "click", "view")
    return _r(_r(out, 9, "a_value", "b_value", "ratio"), 7, "change_pct")


@query("""
    WITH s AS (SELECT user_id % 16 AS workers, avg(value) FILTER (event_type = 'click') AS a,
        avg(value) FILTER (event_type = 'error') AS b FROM events WHERE event_type IN ('click', 'error') GROUP BY 1)
    SELECT workers, round(a, 9) AS base_mean, round(b, 9) AS other_mean, round((1 - b / a) * 100, 7) AS overhead_pct FROM s
""")
def overhead(spark, sf_dir):
    e = _events(spark, sf_dir, (F.col("user_id") % 16).alias("workers"), "event_type", "value")
    out = lookup.overhead(e, "event_type", ["workers"], "value", "click", "error")
    return _r(_r(out, 9, "base_mean", "other_mean"), 7, "overhead_pct")


@query("""
    SELECT event_type AS phase, user_id % 16 AS workers, count(*) AS n FROM events GROUP BY ALL
""")
def union_results(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [
        metrics.value_counts(e.where(F.col("event_type") == p).select(F.lit(p).alias("phase"), (F.col("user_id") % 16).alias("workers")),
                             ["phase", "workers"])
        for p in ("click", "error", "purchase", "signup", "view")
    ]
    return lookup.union_results(*parts)


# --- stages, workers, queues, runs ------------------------------------------------

QUERY_STAGES = ("click", "error", "purchase", "signup", "view", "unused")
_STAGES_SQL = "(VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('unused')) s(stage)"


@query(f"""
    WITH t AS (SELECT event_type AS stage, count(*) AS n, avg(sqrt(value) / 1000) AS mean, coalesce(stddev_samp(sqrt(value) / 1000), 0) AS std,
        sum(sqrt(value) / 1000) AS total FROM events GROUP BY 1)
    SELECT s.stage, coalesce(n, 0) AS count, coalesce(round_even(mean * 1000, 3), 0) AS mean_ms,
        coalesce(round_even(std * 1000, 3), 0) AS std_ms, coalesce(round_even(total, 3), 0) AS total_s
    FROM {_STAGES_SQL} LEFT JOIN t ON t.stage = s.stage
""")
def stage_stats(spark, sf_dir):
    e = _events(spark, sf_dir, F.col("event_type").alias("stage"), (F.sqrt("value") / 1000).alias("seconds"))
    return metrics.stage_stats(e, QUERY_STAGES)


@query(f"""
    WITH x AS (SELECT event_type AS stage, user_id % 4 AS run_id, sqrt(value) / 1000 AS sec, 1 + event_id % 32 AS size FROM events),
    u AS (SELECT stage, run_id, sum(size) AS n, sum(sec) / sum(size) AS mean, sum(sec) AS total FROM x GROUP BY ALL),
    v AS (SELECT x.stage, x.run_id, sum(size * (sec / size - mean) ** 2) AS ss FROM x JOIN u ON u.stage = x.stage AND u.run_id = x.run_id GROUP BY ALL)
    SELECT r.run_id, s.stage, coalesce(n, 0)::BIGINT AS count, coalesce(round_even(mean * 1000, 3), 0) AS mean_ms,
        coalesce(round_even(CASE WHEN n > 1 THEN sqrt(ss / (n - 1)) ELSE 0 END * 1000, 3), 0) AS std_ms,
        coalesce(round_even(total, 3), 0) AS total_s
    FROM (SELECT DISTINCT user_id % 4 AS run_id FROM events) r CROSS JOIN {_STAGES_SQL}
    LEFT JOIN u ON u.stage = s.stage AND u.run_id = r.run_id LEFT JOIN v ON v.stage = s.stage AND v.run_id = r.run_id
""")
def stage_stats_per_sample(spark, sf_dir):
    """Chunk timings weighted by the samples of a chunk, per run."""
    e = _events(spark, sf_dir, F.col("event_type").alias("stage"), (F.col("user_id") % 4).alias("run_id"),
                (F.sqrt("value") / 1000).alias("seconds"), (1 + F.col("event_id") % 32).alias("size"))
    return metrics.stage_stats(e, QUERY_STAGES, keys=["run_id"], weight="size")


@query("""
    WITH x AS (SELECT user_id % 16 AS workers, sqrt(value) / 1000 AS sec, 1 + event_id % 32 AS size FROM events)
    SELECT workers, count(*) AS num_puts, round(avg(sec) * 1000, 9) AS mean_put_ms,
        round(avg(sec / size) * 1e6, 6) AS chunk_us, round(sum(sec) / sum(size) * 1e6, 6) AS sample_us
    FROM x GROUP BY 1
""")
def amortised_wait(spark, sf_dir):
    e = _events(spark, sf_dir, (F.col("user_id") % 16).alias("workers"), (F.sqrt("value") / 1000).alias("seconds"),
                (1 + F.col("event_id") % 32).alias("size"))
    by_chunk = metrics.amortised_wait(e, ["workers"]).withColumnRenamed("put_us_per_sample", "chunk_us")
    by_sample = metrics.amortised_wait(e, ["workers"], weighting="sample").select("workers", F.col("put_us_per_sample").alias("sample_us"))
    return _r(_r(by_chunk.join(by_sample, "workers"), 9, "mean_put_ms"), 6, "chunk_us", "sample_us")


_WORKERS_SQL = """
    w AS (SELECT {keys}, count(busy) AS samples_processed, coalesce(sum(busy), 0) AS b, coalesce(sum(idle), 0) AS i
        FROM (SELECT *, user_id % 4 AS run_id, user_id % 16 AS worker_id,
            CASE WHEN event_type IN ('click', 'view', 'purchase') THEN sqrt(value) / 1000 END AS busy,
            CASE WHEN event_type IN ('error', 'signup') THEN sqrt(value) / 1000 END AS idle FROM events) GROUP BY ALL),
    snap AS (SELECT {keys}, samples_processed, round_even(b, 4) AS busy_time_s, round_even(i, 4) AS idle_time_s,
        round_even(100 * b / (b + i + 1e-8), 2) AS utilization_pct FROM w)
"""


def _worker_rows(spark, sf_dir) -> DataFrame:
    seconds = F.sqrt("value") / 1000
    return _events(
        spark, sf_dir, (F.col("user_id") % 4).alias("run_id"), (F.col("user_id") % 16).alias("worker_id"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), seconds).alias("busy_s"),
        F.when(F.col("event_type").isin("error", "signup"), seconds).alias("idle_s"),
    )


@query("WITH " + _WORKERS_SQL.format(keys="worker_id") + " SELECT * FROM snap")
def worker_snapshot(spark, sf_dir):
    return metrics.worker_snapshot(_worker_rows(spark, sf_dir))


_QUEUE_KIND = "CASE event_type WHEN 'click' THEN 'put' WHEN 'view' THEN 'get' WHEN 'purchase' THEN 'full' WHEN 'error' THEN 'empty' END"
_QUEUE_SQL = f"""
    q AS (SELECT *, user_id % 4 AS run_id, CASE WHEN event_id % 2 = 0 THEN 'staging' ELSE 'batch' END AS name,
        {_QUEUE_KIND} AS kind FROM events),
    counters AS (SELECT {{keys}}, count(*) FILTER (kind = 'put') AS put_count, count(*) FILTER (kind = 'get') AS get_count,
        count(*) FILTER (kind = 'empty') AS empty_events, count(*) FILTER (kind = 'full') AS full_events,
        round_even(coalesce(sum(sqrt(value) / 1000) FILTER (kind = 'put'), 0), 4) AS total_put_wait_s,
        round_even(coalesce(sum(sqrt(value) / 1000) FILTER (kind = 'get'), 0), 4) AS total_get_wait_s FROM q GROUP BY ALL)
"""


def _queue_rows(spark, sf_dir) -> DataFrame:
    return _events(
        spark, sf_dir, (F.col("user_id") % 4).alias("run_id"),
        F.when(F.col("event_id") % 2 == 0, "staging").otherwise("batch").alias("name"),
        F.expr(_QUEUE_KIND).alias("kind"), (F.sqrt("value") / 1000).alias("wait_s"),
    )


@query("WITH " + _QUEUE_SQL.format(keys="name") + " SELECT * FROM counters")
def queue_counters(spark, sf_dir):
    return metrics.queue_counters(_queue_rows(spark, sf_dir))


@query("WITH " + _WORKERS_SQL.format(keys="run_id, worker_id") + "," + _QUEUE_SQL.format(keys="run_id, name") + """,
    runs AS (SELECT user_id % 4 AS run_id, max(value) AS epoch_time_s, count(*) // 32 AS batches_produced FROM events GROUP BY 1),
    st AS (SELECT user_id % 4 AS run_id, round_even(avg(sqrt(value) / 1000) * 1000, 3) AS click_ms FROM events WHERE event_type = 'click' GROUP BY 1),
    agg AS (SELECT run_id, count(*)::INT AS num_workers, round_even(sum(busy_time_s), 4) AS busy, round_even(sum(idle_time_s), 4) AS idle,
        round_even(100 * sum(busy_time_s) / (sum(busy_time_s) + sum(idle_time_s) + 1e-8), 2) AS util,
        string_agg(worker_id::VARCHAR || '=' || samples_processed::VARCHAR, ',' ORDER BY worker_id) AS workers
        FROM snap GROUP BY run_id)
    SELECT runs.run_id, round_even(epoch_time_s, 2) AS epoch_time_s, batches_produced, num_workers, workers,
        busy AS total_busy_time_s, idle AS total_idle_time_s, util AS avg_utilization_pct,
        s.put_count AS staging_puts, b.get_count AS batch_gets, click_ms
    FROM runs JOIN agg ON agg.run_id = runs.run_id JOIN st ON st.run_id = runs.run_id
    JOIN counters s ON s.run_id = runs.run_id AND s.name = 'staging'
    JOIN counters b ON b.run_id = runs.run_id AND b.name = 'batch'
""")
def run_summary(spark, sf_dir):
    """The nested summary, flattened for comparison."""
    workers = metrics.worker_snapshot(_worker_rows(spark, sf_dir), ("run_id", "worker_id"))
    queues = metrics.queue_counters(_queue_rows(spark, sf_dir), ("run_id", "name"))
    e = _events(spark, sf_dir, (F.col("user_id") % 4).alias("run_id"), F.col("event_type").alias("stage"),
                (F.sqrt("value") / 1000).alias("seconds"), "value")
    stages = metrics.stage_stats(e, QUERY_STAGES, keys=["run_id"])
    runs = e.groupBy("run_id").agg(F.max("value").alias("epoch_time_s"), C.int_div(F.count(F.lit(1)), 32).alias("batches_produced"))
    out = metrics.run_summary(workers, runs, queues, stages)
    return out.select(
        "run_id", "epoch_time_s", "batches_produced", "num_workers",
        F.array_join(F.transform("workers", lambda w: F.concat_ws("=", w["worker_id"].cast("string"), w["samples_processed"].cast("string"))), ",").alias("workers"),
        "aggregate.*", F.col("staging_queue.put_count").alias("staging_puts"), F.col("batch_queue.get_count").alias("batch_gets"),
        F.col("stage_times")["click"]["mean_ms"].alias("click_ms"),
    )


@query("""
    WITH b AS (SELECT user_id % 16 AS run_id, 1 + event_id % 256 AS n, value AS elapsed FROM events)
    SELECT run_id, 'actual' AS count_mode, sum(n)::BIGINT AS samples, count(*) AS batches, max(elapsed) AS elapsed_s,
        round(sum(n) / max(elapsed), 9) AS throughput FROM b GROUP BY 1
    UNION ALL SELECT run_id, 'nominal', count(*) * 256, count(*), max(elapsed), round(count(*) * 256 / max(elapsed), 9) FROM b GROUP BY 1
""")
def throughput(spark, sf_dir):
    e = _events(spark, sf_dir, (F.col("user_id") % 16).alias("run_id"), (1 + F.col("event_id") % 256).alias("n"),
                F.col("value").alias("elapsed_s"))
    parts = [metrics.throughput(e, ["run_id"], mode, 256).withColumn("count_mode", F.lit(mode)) for mode in ("actual", "nominal")]
    return _r(lookup.union_results(*parts), 9, "throughput")


# --- timings ------------------------------------------------------------------------

@query("""
    SELECT event_type AS gpu, user_id % 16 AS model, count(*) AS num_batches_completed, round(avg(value), 9) AS mean_ms,
        round(coalesce(stddev_samp(value), 0), 9) AS std_ms, round(median(value), 9) AS median_ms, min(value) AS min_ms,
        max(value) AS max_ms, round(256 / avg(value) * 1000, 6) AS throughput_img_s
    FROM events GROUP BY ALL
""")
def timing_summary(spark, sf_dir):
    e = _events(spark, sf_dir, F.col("event_type").alias("gpu"), (F.col("user_id") % 16).alias("model"), F.col("value").alias("time_ms"))
    out = metrics.timing_summary(e, ["gpu", "model"], 256, digits=None)
    return _r(_r(out, 9, "mean_ms", "std_ms", "median_ms"), 6, "throughput_img_s")


@query("""
    WITH m AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, m.n, round(mean, 9) AS mean, round(std / mean * 100, 7) AS cv_pct,
        count(*) FILTER (value > 1.5::DOUBLE * mean) AS anomaly_count,
        round(count(*) FILTER (value > 1.5::DOUBLE * mean) * 100.0::DOUBLE / m.n, 9) AS anomaly_pct
    FROM events JOIN m USING (event_type) GROUP BY event_type, m.n, mean, std
""")
def anomalies(spark, sf_dir):
    out = metrics.anomalies(_events(spark, sf_dir, "event_type", "value"), ["event_type"], "value")
    return _r(_r(out, 9, "mean", "anomaly_pct"), 7, "cv_pct")


@query("""
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
        count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, n, value AS p95 FROM r WHERE i = round_even((n - 1) * 0.95::DOUBLE, 0)::BIGINT
""")
def nearest_rank_p95(spark, sf_dir):
    return ranks.nearest_rank(_events(spark, sf_dir, "event_type", "value"), ["event_type"], "value", 0.95, "p95")


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def value_counts(spark, sf_dir):
    return metrics.value_counts(table(spark, sf_dir, "events"), ["event_type", "user_id"])


_SCALING_SQL = """
    s AS (SELECT event_type AS mode, (1 << (user_id % 5)::INT)::INT AS workers, avg(value) AS m, stddev_samp(value) AS sd, avg(value / 10) AS cpu
        FROM events GROUP BY ALL)
"""


def _scaling(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir, F.col("event_type").alias("mode"), F.expr("shiftleft(1, int(user_id % 5))").alias("workers"),
                F.col("value").alias("throughput"), (F.col("value") / 10).alias("cpu_cores"))
    return metrics.scaling_table(e)


@query(f"""
    WITH {_SCALING_SQL}
    SELECT s.mode, s.workers, round(s.m, 9) AS mean_throughput, round(coalesce(s.sd, 0), 9) AS std_throughput,
        round(s.cpu, 9) AS mean_cpu_cores, round(s.m / b.m, 9) AS speedup_vs_1
    FROM s LEFT JOIN s b ON b.mode = s.mode AND b.workers = 1
""")
def scaling_table(spark, sf_dir):
    return _r(_scaling(spark, sf_dir), 9, "mean_throughput", "std_throughput", "mean_cpu_cores", "speedup_vs_1")


@query(f"""
    WITH {_SCALING_SQL}
    SELECT mode, arg_max(workers, m) AS best_workers, round(max(m), 9) AS best_throughput FROM s GROUP BY mode
""")
def best_config(spark, sf_dir):
    return _r(metrics.best_config(_scaling(spark, sf_dir)), 9, "best_throughput")


@query("""
    WITH w AS (SELECT event_type AS mode, event_id % 3 AS repeat, user_id % 16 AS worker, sum(value / 1000) AS seconds, count(*) AS samples
        FROM events GROUP BY ALL)
    SELECT mode, repeat, round(sum(samples) / max(seconds), 7) AS throughput, round(min(seconds), 9) AS worker_min_s,
        round(avg(seconds), 9) AS worker_mean_s, round(max(seconds), 9) AS worker_max_s,
        round(coalesce(stddev_samp(seconds), 0), 9) AS worker_std_s, round(max(seconds) / avg(seconds), 9) AS tail_ratio
    FROM w GROUP BY ALL
""")
def load_balance(spark, sf_dir):
    e = _events(spark, sf_dir, F.col("event_type").alias("mode"), (F.col("event_id") % 3).alias("repeat"),
                (F.col("user_id") % 16).alias("worker"), (F.col("value") / 1000).alias("seconds"))
    workers = e.groupBy("mode", "repeat", "worker").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("samples"))
    out = metrics.load_balance(workers, ("mode", "repeat"))
    return _r(_r(out, 9, "worker_min_s", "worker_mean_s", "worker_max_s", "worker_std_s", "tail_ratio"), 7, "throughput")


@query("""
    SELECT event_type AS backend, user_id % 4 AS workers, event_id % 2 AS chunk, user_id % 3 AS capacity,
        round(avg(value), 9) AS mean_value, count(*) AS repeats FROM events GROUP BY ALL
""")
def repeat_means(spark, sf_dir):
    e = _events(spark, sf_dir, F.col("event_type").alias("backend"), (F.col("user_id") % 4).alias("workers"),
                (F.col("event_id") % 2).alias("chunk"), (F.col("user_id") % 3).alias("capacity"), "value")
    return _r(metrics.repeat_means(e, ["backend", "workers", "chunk", "capacity"], ["value"]), 9, "mean_value")


@query("""
    WITH s AS (SELECT user_id % 16 AS workers, event_type AS stage, avg(value) AS mean_ms FROM events GROUP BY ALL)
    SELECT workers, stage, round(mean_ms, 9) AS mean_ms, round(sum(mean_ms) OVER w, 7) AS total,
        round(mean_ms / sum(mean_ms) OVER w * 100, 7) AS share_pct,
        round(mean_ms * CASE stage WHEN 'view' THEN 256 ELSE 1 END
            / sum(mean_ms * CASE stage WHEN 'view' THEN 256 ELSE 1 END) OVER w * 100, 7) AS weighted_pct
    FROM s WINDOW w AS (PARTITION BY workers)
""")
def stage_share(spark, sf_dir):
    e = _events(spark, sf_dir, (F.col("user_id") % 16).alias("workers"), F.col("event_type").alias("stage"), "value")
    means = e.groupBy("workers", "stage").agg(F.avg("value").alias("mean_ms"))
    plain = metrics.stage_share(means, ["workers"])
    weighted = metrics.stage_share(plain.drop("total"), ["workers"], weights={"view": 256.0}).select(
        "workers", "stage", F.col("share_pct").alias("weighted_pct"))
    return _r(_r(plain.join(weighted, ["workers", "stage"]), 9, "mean_ms"), 7, "total", "share_pct", "weighted_pct")


@query(f"""
    WITH {_SCALING_SQL}
    SELECT s.mode, s.workers, round(s.m, 9) AS throughput, round(b.m * s.workers, 7) AS ideal, round(s.m / (b.m * s.workers), 9) AS efficiency
    FROM s LEFT JOIN s b ON b.mode = s.mode AND b.workers = 1
""")
def ideal_scaling(spark, sf_dir):
    means = _scaling(spark, sf_dir).select("mode", "workers", F.col("mean_throughput").alias("throughput"))
    return _r(_r(metrics.ideal_scaling(means, "mode"), 9, "throughput", "efficiency"), 7, "ideal")


@query("SELECT event_type AS stage, round(sum(value), 6) AS total_s, count(*) AS calls FROM events GROUP BY 1 ORDER BY sum(value) DESC LIMIT 3")
def top_stages(spark, sf_dir):
    e = _events(spark, sf_dir, F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return _r(metrics.top_stages(e, 3), 6, "total_s")


@query("""
    SELECT user_id % 16 AS workers, round(sum(value) / (max(value) + 1), 9) AS cpu_core_equiv FROM events GROUP BY 1
""")
def core_equivalents(spark, sf_dir):
    e = _events(spark, sf_dir, (F.col("user_id") % 16).alias("workers"), "value")
    sums = e.groupBy("workers").agg(F.sum("value").alias("cpu"), (F.max("value") + 1).alias("wall"))
    return sums.select("workers", F.round(C.core_equivalents("cpu", "wall"), 9).alias("cpu_core_equiv"))


# --- training logs --------------------------------------------------------------------

@query("""
    WITH e AS (SELECT dayofmonth(ts) AS epoch, avg(value / 1000) AS d, avg((user_id + 1) / 1000.0::DOUBLE) AS c FROM events GROUP BY 1),
    r AS (SELECT epoch::INT AS epoch, d, c FROM e UNION ALL SELECT NULL, avg(d), avg(c) FROM e)
    SELECT epoch, round(d, 9) AS avg_data_time, round(c, 9) AS avg_compute_time, round(d + c, 9) AS avg_total_time,
        round(100 * d / (d + c), 7) AS gpu_wait_pct, round(256 / (d + c), 6) AS throughput_img_s,
        CASE WHEN epoch IS NULL THEN round(1281167 / (256 / (d + c)) / 3600, 6) END AS hours_per_epoch,
        CASE WHEN epoch IS NULL THEN round(90 * 1281167 / (256 / (d + c)) / 3600, 6) END AS hours_total
    FROM r
""")
def epoch_report(spark, sf_dir):
    e = _events(spark, sf_dir, F.dayofmonth("ts").alias("epoch"), (F.col("value") / 1000).alias("data_time"),
                ((F.col("user_id") + 1) / 1000.0).alias("compute_time"))
    out = _r(metrics.loading_report(e, 256), 9, "avg_data_time", "avg_compute_time", "avg_total_time")
    return _r(_r(out, 7, "gpu_wait_pct"), 6, "throughput_img_s", "hours_per_epoch", "hours_total")


def _steps(spark, sf_dir) -> DataFrame:
    size = 1 + F.col("event_id") % 256
    return _events(spark, sf_dir, "event_id", F.dayofmonth("ts").alias("epoch"), (F.col("user_id") % 4).alias("rank"),
                   size.alias("n"), F.col("value").alias("loss"), (F.col("event_id") % size).alias("corrects"))


_STEPS_SQL = """
    steps AS (SELECT event_id, dayofmonth(ts)::INT AS epoch, user_id % 4 AS rank, 1 + event_id % 256 AS n, value AS loss,
        event_id % (1 + event_id % 256) AS corrects FROM events)
"""


@query(f"""
    WITH {_STEPS_SQL}
    SELECT epoch, rank, sum(n)::BIGINT AS samples, round(sum(loss * n) / sum(n), 9) AS loss, round(100.0::DOUBLE * sum(corrects) / sum(n), 9) AS accuracy
    FROM steps GROUP BY epoch, rank
    UNION ALL SELECT epoch, NULL, sum(n)::BIGINT, round(sum(loss * n) / sum(n), 9), round(100.0::DOUBLE * sum(corrects) / sum(n), 9) FROM steps GROUP BY epoch
""")
def epoch_accuracy(spark, sf_dir):
    """Per replica, and over all replicas (``rank`` NULL)."""
    steps = _steps(spark, sf_dir)
    out = lookup.union_results(metrics.epoch_metrics(steps, by_rank=True), metrics.epoch_metrics(steps))
    return _r(out, 9, "loss", "accuracy")


@query("""
    SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS predicted,
        (list_position(embedding, list_max(embedding)) - 1) = label AS correct FROM embeddings
""")
def predict_argmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", C.argmax("embedding").alias("predicted"), (C.argmax("embedding") == F.col("label")).alias("correct"))


@query("""
    WITH x AS (SELECT vec_id, label, embedding, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT vec_id, round(ln(sum(exp(x))) - any_value(embedding[label + 1])::DOUBLE, 9) AS loss FROM x GROUP BY vec_id
""")
def cross_entropy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(C.cross_entropy("embedding", "label"), 9).alias("loss"))


# --- ordered series ---------------------------------------------------------------------

@query("""
    WITH i AS (SELECT event_type, sqrt(value) AS value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS batch_index FROM events),
    r AS (SELECT *, avg(value) OVER (PARTITION BY event_type ORDER BY batch_index) AS m FROM i)
    SELECT event_type, batch_index, round(m, 9) AS mean_so_far, value AS last_value FROM r WHERE batch_index % 100 = 0
""")
def running_mean(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id", "event_type", F.sqrt("value").alias("value"))
    e = series.index_rows(e, ["event_type"], "event_id", "batch_index", 1)
    return _r(series.running_mean(e, ["event_type"], "batch_index", "value", 100), 9, "mean_so_far")


@query(f"""
    WITH {_STEPS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY event_id) - 1 AS batch_idx FROM steps),
    r AS (SELECT epoch, batch_idx, sum(loss * n) OVER w / sum(n) OVER w AS l, 100.0::DOUBLE * sum(corrects) OVER w / sum(n) OVER w AS a
        FROM i WINDOW w AS (PARTITION BY epoch ORDER BY batch_idx))
    SELECT epoch, batch_idx, round(l, 9) AS current_loss, round(a, 9) AS current_acc FROM r WHERE (batch_idx + 1) % 50 = 0
""")
def running_accuracy(spark, sf_dir):
    steps = series.index_rows(_steps(spark, sf_dir), ["epoch"], "event_id", "batch_idx")
    return _r(series.running_metrics(steps, ["epoch"], "batch_idx", 50), 9, "current_loss", "current_acc")


@query("""
    WITH b AS (SELECT event_type, event_id, value,
        max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events)
    SELECT event_type, event_id, value FROM b WHERE value > greatest(coalesce(best, 0), 0)
""")
def new_best(spark, sf_dir):
    return series.new_best(_events(spark, sf_dir, "event_type", "event_id", "value"), ["event_type"], "event_id", "value")


@query("""
    SELECT event_type, idx, event_id FROM (
        SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx FROM events)
    WHERE (idx + 1) % 10 = 0
""")
def periodic_rows(spark, sf_dir):
    e = series.index_rows(_events(spark, sf_dir, "event_type", "event_id"), ["event_type"], "event_id")
    return e.where(series.every_k("idx", 10)).select("event_type", "idx", "event_id")


@query("SELECT event_id, round(0.1::DOUBLE * pow(0.1::DOUBLE, (event_id % 90) // 30), 12) AS lr FROM events")
def lr_schedule(spark, sf_dir):
    return _events(spark, sf_dir, "event_id", F.round(C.step_lr(F.col("event_id") % 90, 0.1, 30, 0.1), 12).alias("lr"))


@query("""
    SELECT event_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 16 ORDER BY event_id) AS i FROM events) WHERE i > 50
""")
def warmup_drop(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id", "event_type", "value", (F.col("user_id") % 16).alias("model"))
    return series.drop_warmup(e, ["event_type", "model"], "event_id", 50).drop("model")


@query(f"""
    WITH {_SCALING_SQL}
    SELECT mode, workers, round(m, 9) AS throughput, round(m / first_value(m) OVER (PARTITION BY mode ORDER BY workers), 9) AS speedup FROM s
""")
def speedup_first(spark, sf_dir):
    means = _scaling(spark, sf_dir).select("mode", "workers", F.col("mean_throughput").alias("throughput"))
    return _r(series.speedup_first(means, "mode"), 9, "throughput", "speedup")
