from __future__ import annotations

from pyspark.sql import functions as F

from samplewright.streaming import batches as streams


def arrivals(spark, path, n=1000, files=3):
    spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 4).alias("worker_id"), F.lit(0.5).alias("busy_s")).repartition(files).write.parquet(path)
    return streams.read_sample_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)


def test_one_lane(spark, tmp_path):
    stream = streams.with_lane(arrivals(spark, str(tmp_path / "in")), "k", 1)
    rows = streams.run_to_files(streams.stream_batches(stream, "k", 64)).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.batch_id, set()).add(r.slot)
    assert sorted(sizes) == list(range(15)) and all(s == set(range(64)) for s in sizes.values())
    assert len({r.k for r in rows}) == len(rows) == 960


def test_lanes_keep_their_own_remainder(spark, tmp_path):
    stream = streams.with_lane(arrivals(spark, str(tmp_path / "in")), "k", 5)
    rows = streams.run_to_files(streams.stream_batches(stream, "k", 32)).collect()
    lanes = {r.lane: r.n for r in streams.with_lane(spark.range(1000), "id", 5).groupBy("lane").agg(F.count("*").alias("n")).collect()}
    for lane, n in lanes.items():
        mine = [r for r in rows if r.lane == lane]
        assert len({r.batch_id for r in mine}) == n // 32 and len(mine) == n - n % 32


def test_restart_continues_from_the_state(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = streams.with_lane(arrivals(spark, path, 100, 1), "k", 1)
    first = streams.run_to_files(streams.stream_batches(stream, "k", 64), out).count()
    spark.range(100, 128).select(F.col("id").alias("k"), F.lit(0).cast("bigint").alias("worker_id"), F.lit(0.5).alias("busy_s")).write.mode("append").parquet(path)
    rows = streams.run_to_files(streams.stream_batches(stream, "k", 64), out).collect()
    assert first == 64 and len(rows) == 128 and {r.batch_id for r in rows} == {0, 1} and len({r.k for r in rows}) == 128


def test_counters(spark, tmp_path):
    out = streams.run_updates(streams.stream_counters(arrivals(spark, str(tmp_path / "in"))), ("worker_id",)).collect()
    assert {(r.worker_id, r.samples_processed, r.busy_time_s) for r in out} == {(w, 250, 125.0) for w in range(4)}


def test_counters_with_batches(spark, tmp_path):
    counted = streams.stream_counters(arrivals(spark, str(tmp_path / "in")), batch_size=60)
    assert {(r.worker_id, r.samples_processed, r.batches_produced) for r in streams.run_updates(counted, ("worker_id",)).collect()} == {(w, 250, 4) for w in range(4)}


def more(spark, path, first, last):
    spark.range(first, last).select(F.col("id").alias("k"), F.lit(0).cast("bigint").alias("worker_id"), F.lit(0.5).alias("busy_s")).write.mode("append").parquet(path)


def test_restart_under_another_shuffle_setting(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = streams.with_lane(arrivals(spark, path, 1000, 1), "k")
    streams.run_to_files(streams.stream_batches(stream, "k", 10), out)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        more(spark, path, 1000, 1500)
        rows = streams.run_to_files(streams.stream_batches(stream, "k", 10), out).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    lanes = {r.lane: r.n for r in streams.with_lane(spark.range(1500), "id").groupBy("lane").agg(F.count("*").alias("n")).collect()}
    assert len({r.k for r in rows}) == len(rows) == sum(n // 10 * 10 for n in lanes.values())
    assert {(r.lane, r.batch_id) for r in rows} == {(lane, b) for lane, n in lanes.items() for b in range(n // 10)}
