from __future__ import annotations

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from samplewright import EpochPlan
from samplewright.functions import columns as C
from samplewright.operators import collate as gather
from samplewright.operators import sampler
from samplewright.sinks.tables import write_batches


@pytest.fixture(scope="module")
def samples(spark):
    return spark.range(103).select(
        F.col("id").alias("k"), F.array(*[(F.col("id") + i).cast("smallint") for i in range(3)]).alias("t"), F.col("id").alias("y")
    )


@pytest.mark.parametrize("options", [{}, {"partitions": 3}, {"bucket_hex": 1, "partitions": 50}, {"drop_last": False}, {"interleave": True, "n_workers": 3, "chunk": 4}])
def test_collated_equals_sorted_batches(spark, samples, options):
    plan = EpochPlan("k", 10, **options)
    want = {}
    for r in plan.batches(samples).orderBy("batch_id", "slot").collect():
        want.setdefault(r.batch_id, []).append(r.k)
    got = {r.batch_id: r for r in plan.collated(samples, "t", "y").collect()}
    assert {b: r.labels for b, r in got.items()} == want
    for r in got.values():
        assert r.size == len(r.labels)
        assert r["images"] == [[(k + i) / 255.0 for i in range(3)] for k in r.labels]


def test_raw_collate_keeps_integers(samples):
    row = EpochPlan("k", 10).collated(samples, "t", "y", scale=False).first()
    assert row["images"][0] == [row.labels[0] + i for i in range(3)]


def test_scaling_gives_the_same_values_wherever_it_is_done(samples):
    plan = EpochPlan("k", 10)
    per_sample = plan.collated(samples.withColumn("t", C.scale_255("t")), "t", "y", scale=False)
    per_batch = plan.collated(samples, "t", "y")
    after = plan.collated(samples, "t", "y", scale=False).withColumn("images", C.scale_255("images", depth=2))
    want = {r.batch_id: r["images"] for r in per_batch.collect()}
    assert want == {r.batch_id: r["images"] for r in per_sample.collect()} == {r.batch_id: r["images"] for r in after.collect()}


def test_unequal_shapes_raise(spark):
    df = spark.createDataFrame([(0, [1], 0), (1, [1, 2], 0)], "k bigint, t array<int>, y int")
    with pytest.raises(SparkRuntimeException, match="unequal length"):
        EpochPlan("k", 2).collated(df, "t", "y").collect()


def test_text_labels_become_numbers(spark, samples):
    named = samples.withColumn("y", F.concat(F.lit("n"), F.lpad(F.col("k").cast("string"), 8, "0")))
    plan = EpochPlan("k", 10)
    want = {r.batch_id: r.labels for r in plan.collated(samples, None, "y").collect()}
    assert {r.batch_id: r.labels for r in plan.collated(named, None, "y").collect()} == want
    kept = plan.collated(named, None, "y", parse_labels=False).first().labels
    assert all(label.startswith("n") for label in kept)


def test_empty(spark, samples):
    assert EpochPlan("k", 10).collated(samples.where("k < 0"), "t", "y").count() == 0
    assert EpochPlan("k", 1000).collated(samples, "t", "y").count() == 0


def test_user_collate_sees_slot_order(samples):
    placed = sampler.assign_batches(sampler.shuffle(samples, "k"), 10)

    def check(frame):
        assert list(frame.slot) == list(range(10))
        return frame[["batch_id"]].head(1).assign(total=int(frame.y.sum()))

    rows = gather.collate_with(placed, check, "batch_id bigint, total bigint").collect()
    assert len(rows) == 10


@pytest.mark.parametrize("ordered", (True, False))
def test_written_batches_are_in_order(spark, samples, tmp_path, ordered):
    plan = EpochPlan("k", 10, partitions=4 if ordered else None)
    if ordered:
        plan.write(samples, str(tmp_path / "out"))
    else:
        write_batches(plan.batches(samples), str(tmp_path / "out"), 3)
    read = []
    for part in sorted((tmp_path / "out").glob("part-*")):
        read += [(r.batch_id, r.slot) for r in spark.read.parquet(str(part)).collect()]
    assert read == sorted(read) and len(read) == 100
