from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from samplewright.operators import metrics
from samplewright.sinks.tables import csv_text


def test_stage_stats(spark):
    df = spark.createDataFrame([("collate", 0.1), ("collate", 0.3), ("batch_put", 0.2)], "stage string, seconds double")
    got = {r.stage: r for r in metrics.stage_stats(df).collect()}
    assert set(got) == {"total_sample", "staging_put", "staging_put_chunk", "collate", "batch_put"}
    assert (got["collate"]["count"], got["collate"].mean_ms, got["collate"].total_s) == (2, 200.0, 0.4)
    assert got["collate"].std_ms == pytest.approx(round(statistics.stdev([0.1, 0.3]) * 1000, 3))
    assert got["batch_put"].std_ms == 0.0
    assert (got["staging_put"]["count"], got["staging_put"].mean_ms) == (0, 0.0)


def test_weighted_stage_stats_equal_the_expanded_rows(spark):
    chunks = [(0.064, 32), (0.01, 5), (0.2, 32), (0.003, 1)]
    df = spark.createDataFrame([("s", a, b) for a, b in chunks], "stage string, seconds double, size int")
    row = metrics.stage_stats(df, ["s"], weight="size").first()
    each = [sec / n for sec, n in chunks for _ in range(n)]
    assert row["count"] == len(each)
    assert row.mean_ms == pytest.approx(statistics.mean(each) * 1000, abs=1e-3)
    assert row.std_ms == pytest.approx(statistics.stdev(each) * 1000, abs=1e-3)
    one = metrics.stage_stats(df.where("size = 1"), ["s"], weight="size").first()
    assert (one["count"], one.std_ms) == (1, 0.0)


def test_amortised_wait(spark):
    df = spark.createDataFrame([(1, 0.064, 32), (1, 0.01, 5)], "w int, seconds double, size int")
    by_chunk = metrics.amortised_wait(df, ["w"]).first()
    by_sample = metrics.amortised_wait(df, ["w"], weighting="sample").first()
    assert by_chunk.put_us_per_sample == pytest.approx(2000) and by_chunk.num_puts == 2
    assert by_sample.put_us_per_sample == pytest.approx(0.074 / 37 * 1e6)


def test_worker_snapshot_without_idle(spark):
    df = spark.createDataFrame([(0, 0.5, None), (0, 0.25, 0.25)], "worker_id int, busy_s double, idle_s double")
    row = metrics.worker_snapshot(df).first()
    assert tuple(row) == (0, 2, 0.75, 0.25, 75.0)


def test_timing_summary_and_anomalies(spark):
    rows = [("one", 5.0)] + [("flat", 2.0)] * 4 + [("edge", v) for v in (1.0, 1.0, 1.0, 3.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "run string, time_ms double")
    got = {r.run: r for r in metrics.timing_summary(df, ["run"], 256).collect()}
    assert (got["one"].std_ms, got["one"].median_ms, got["flat"].std_ms) == (0.0, 5.0, 0.0)
    assert got["flat"].throughput_img_s == 128000.0 and got["edge"].median_ms == 1.0
    found = {r.run: r for r in metrics.anomalies(df, ["run"]).collect()}
    assert (found["flat"].anomaly_count, found["edge"].anomaly_count) == (0, 1)
    exact = spark.createDataFrame([("r", v) for v in (1.0, 1.0, 3.0, 3.0)], "run string, time_ms double")
    assert metrics.anomalies(exact, ["run"]).first().anomaly_count == 0  # 3.0 is exactly 1.5 x mean


def test_delay_config_follows_from_its_models(spark):
    # Published step times of one device and the defaults they must give.
    models = {"swin_t": (723.95, .77), "resnet50": (280.75, .32), "resnet101": (437.88, .6), "resnet34": (155.64, .33),
              "vit_b_16": (1784.59, 1.56), "swin_v2_t": (889.73, .92), "vit_b_32": (449.45, .47), "resnet18": (97.26, .16),
              "vit_l_32": (1495.3, 1.84)}
    runs = [("A100-40GB", m, a, s) for m, (a, s) in models.items()]
    config = metrics.delay_config(spark.createDataFrame(runs, "gpu string, model string, mean_ms double, std_ms double"))
    row = config.first()
    assert abs(row.default_mean_ms - 701.62) <= 0.011 and abs(row.default_std_ms - 0.77) <= 0.011
    assert row.num_models_benchmarked == 9 and row.models["resnet50"].mean_ms == 280.75
    assert metrics.delay_config_long(config).count() == 9


def test_delay_config_is_unweighted_over_models(spark):
    runs = [("g", "a", 10.0, 1.0)] * 9 + [("g", "b", 30.0, 3.0)]
    row = metrics.delay_config(spark.createDataFrame(runs, "gpu string, model string, mean_ms double, std_ms double")).first()
    assert (row.default_mean_ms, row.default_std_ms) == (20.0, 2.0)


def test_scaling(spark):
    rows = [("m", w, r, v) for w, base in ((1, 100.0), (2, 180.0), (4, 150.0)) for r, v in ((1, base), (2, base + 10))]
    df = spark.createDataFrame(rows, "mode string, workers int, repeat int, throughput double").withColumn("cpu_cores", F.lit(1.0))
    table = metrics.scaling_table(df)
    got = {r.workers: r.speedup_vs_1 for r in table.collect()}
    assert got[1] == 1.0 and got[2] == pytest.approx(185 / 105)
    assert tuple(metrics.best_config(table).first()) == ("m", 2, 185.0)
    ideal = {r.workers: r for r in metrics.ideal_scaling(table.withColumnRenamed("mean_throughput", "throughput"), "mode").collect()}
    assert ideal[4].ideal == 420.0 and ideal[4].efficiency == pytest.approx(155 / 420)


def test_stage_share_published_numbers(spark):
    # Stage means at 32 workers; decode and collate make up 53.8 % and 45.3 %.
    stages = {"io": .077, "decode": 7.058, "preprocess": .01, "staging_put": .01, "collate": 5.934, "batch_put": .018}
    df = spark.createDataFrame([(32, s, v) for s, v in stages.items()], "workers int, stage string, mean_ms double")
    got = {r.stage: round(r.share_pct, 1) for r in metrics.stage_share(df, ["workers"]).collect()}
    assert (got["decode"], got["collate"]) == (53.8, 45.3)
    weighted = {r.stage: r.share_pct for r in metrics.stage_share(df, ["workers"], weights={"decode": 256.0}).collect()}
    assert weighted["decode"] > 99


def test_load_balance(spark):
    df = spark.createDataFrame([("static", 2, 1, 1.0, 50), ("static", 2, 1, 3.0, 50)], "mode string, workers int, repeat int, seconds double, samples int")
    row = metrics.load_balance(df).first()
    assert (row.throughput, row.worker_min_s, row.worker_max_s, row.tail_ratio) == (100 / 3, 1.0, 3.0, 1.5)


def test_loading_report(spark):
    df = spark.createDataFrame([(1, 0.1, 0.3), (1, 0.3, 0.3), (2, 0.0, 0.4)], "epoch int, data_time double, compute_time double")
    got = {r.epoch: r for r in metrics.loading_report(df, 256).collect()}
    assert got[1].gpu_wait_pct == pytest.approx(40) and got[1].throughput_img_s == pytest.approx(512)
    assert got[None].avg_data_time == pytest.approx(0.1) and got[1].hours_total is None
    assert got[None].hours_per_epoch == pytest.approx(1281167 / (256 / 0.45) / 3600)
    assert metrics.loading_report(df.where("epoch > 9"), 256).count() == 0


def test_epoch_metrics(spark):
    df = spark.createDataFrame([(0, 0, 10, 1.0, 5), (0, 1, 30, 2.0, 30)], "epoch int, rank int, n int, loss double, corrects int")
    assert tuple(metrics.epoch_metrics(df).first()) == (0, 40, 1.75, 87.5)
    assert metrics.epoch_metrics(df, by_rank=True).count() == 2


def test_throughput_modes(spark):
    df = spark.createDataFrame([(1, 256, 1.0), (1, 100, 2.0)], "run int, n int, elapsed_s double")
    assert metrics.throughput(df, ["run"]).first().throughput == 178.0
    assert metrics.throughput(df, ["run"], "nominal", 256).first().throughput == 256.0
    zero = df.withColumn("elapsed_s", F.lit(0.0))
    assert metrics.throughput(zero, ["run"]).first().throughput == 0.0


def test_queue_counters_and_top(spark):
    df = spark.createDataFrame([("staging", "put", .5), ("staging", "put", .25), ("staging", "full", 0.0), ("batch", "empty", 0.0)],
                               "name string, kind string, wait_s double")
    got = {r.name: r for r in metrics.queue_counters(df).collect()}
    assert (got["staging"].put_count, got["staging"].full_events, got["staging"].total_put_wait_s) == (2, 1, 0.75)
    assert (got["batch"].empty_events, got["batch"].total_get_wait_s) == (1, 0.0)
    top = metrics.top_stages(df.select(F.col("name").alias("stage"), F.col("wait_s").alias("seconds")), 1)
    assert [r.stage for r in top.collect()] == ["staging"]


def test_csv_text_rounds_half_even(spark):
    row = csv_text(spark.createDataFrame([(0.125, 1.0 / 3, 80.0)], "mean_ms double, time_s double, gpu_mem_gb double")).first()
    assert tuple(row) == ("0.12", "0.333333", "80.0")
    assert csv_text(spark.createDataFrame([(None,)], "mean_ms double")).first().mean_ms is None
