from __future__ import annotations

import hashlib
from math import ceil

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from samplewright import EpochPlan
from samplewright.operators import rank, sampler

SIZES = (0, 1, 5, 10, 37, 100, 257)


def order(n, seed=42):
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def slices(n, workers):
    size = n // workers
    return [list(range(w * size, (w + 1) * size if w < workers - 1 else n)) for w in range(workers)]


def arrival(n, workers, chunk):
    parts = [[s[i:i + chunk] for i in range(0, len(s), chunk)] for s in slices(n, workers)]
    out = []
    for turn in range(max(map(len, parts), default=0)):
        for part in parts:
            if turn < len(part):
                out += part[turn]
    return out


@pytest.mark.parametrize("n", SIZES)
def test_shuffle_is_the_hash_order(spark, n):
    rows = sampler.shuffle(spark.range(n), "id").orderBy("pos").collect()
    assert [r.id for r in rows] == order(n)
    assert [r.pos for r in rows] == list(range(n))
    assert {r.n_total for r in rows} <= {n}


def test_seeds(spark):
    one = [r.id for r in sampler.shuffle(spark.range(200), "id", 1).orderBy("pos").collect()]
    again = [r.id for r in sampler.shuffle(spark.range(200).repartition(7), "id", 1).orderBy("pos").collect()]
    other = [r.id for r in sampler.shuffle(spark.range(200), "id", 2).orderBy("pos").collect()]
    assert one == again != other and sorted(other) == list(range(200))
    assert sampler.next_seed(42) == 43 and sampler.next_seed(42, 7) == 7


@pytest.mark.parametrize("digits", (1, 2, 5))
def test_bucket_size_does_not_change_the_order(spark, digits):
    rows = sampler.shuffle(spark.range(300), "id", bucket_hex=digits).orderBy("pos").collect()
    assert [r.id for r in rows] == order(300)


def test_ordered_layout(spark):
    placed = sampler.shuffle(spark.range(1000), "id", partitions=5)
    assert placed.rdd.getNumPartitions() == 5
    assert [r.pos for r in placed.collect()] == list(range(1000))


def test_duplicate_keys_raise(spark):
    with pytest.raises(SparkRuntimeException, match="key is not unique"):
        sampler.shuffle(spark.range(10).union(spark.range(3)), "id").collect()


def test_composite_key(spark):
    df = spark.range(20).select((F.col("id") % 4).alias("a"), (F.col("id") / 4).cast("int").alias("b"))
    rows = sampler.shuffle(df, ["a", "b"]).collect()
    assert sorted(r.pos for r in rows) == list(range(20))


def test_epochs(spark):
    rows = sampler.shuffle_epochs(spark.range(50), "id", (42, 43)).orderBy("epoch", "pos").collect()
    assert [r.id for r in rows] == order(50, 42) + order(50, 43)


def test_workers_and_arrival_match_brute_force(spark):
    cases = [(n, w, c) for n in SIZES for w in (1, 2, 3, 7, 16) for c in (1, 4, 32)]
    table = spark.createDataFrame(cases, "n bigint, w int, c int").where("n > 0")
    rows = table.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).cache()
    parts_of = []
    for workers in (1, 2, 3, 7, 16):
        for chunk in (1, 4, 32):
            mine = rows.where((F.col("w") == workers) & (F.col("c") == chunk))
            placed = sampler.assign_workers(mine, workers, "n")
            placed = placed.withColumn("seq", sampler.interleaved(F.col("pos"), F.col("n"), workers, chunk))
            parts_of.append(sampler.assign_chunks(placed, chunk, "n", workers))
    got = {}
    for placed in parts_of:
        got |= {(r.n, r.w, r.c, r.pos): (r.worker_id, r.seq, r.chunk_id) for r in placed.collect()}
    for n, w, c in cases:
        parts, sequence = slices(n, w), arrival(n, w, c)
        assert sorted(sequence) == list(range(n))
        for worker, part in enumerate(parts):
            for i, pos in enumerate(part):
                assert got[(n, w, c, pos)] == (worker, sequence.index(pos), i // c)


def test_replicas_10_4(spark):
    rows = sampler.replica_shards(spark.range(10), "id", 4, shuffled=False).collect()
    shares = {r: [x.id for x in sorted(rows, key=lambda x: x.local_idx) if x.rank == r] for r in range(4)}
    assert shares == {0: [0, 4, 8], 1: [1, 5, 9], 2: [2, 6, 0], 3: [3, 7, 1]}


@pytest.mark.parametrize("n,replicas", [(2, 5), (1, 3), (12, 4), (37, 8)])
def test_replicas_have_equal_shares(spark, n, replicas):
    rows = sampler.replica_shards(spark.range(n), "id", replicas, seed=3, epoch=2).collect()
    padded = (order(n, 5) * replicas)[:ceil(n / replicas) * replicas]
    assert {(r.rank, r.local_idx): r.id for r in rows} == {(s % replicas, s // replicas): i for s, i in enumerate(padded)}
    assert len(rows) == len(padded)


@pytest.mark.parametrize("size", (1, 10, 64))
def test_batches(spark, size):
    for n in (0, 5, 100, 257):
        kept = sampler.assign_batches(sampler.shuffle(spark.range(n), "id", bucket_hex=2), size, drop_last=False).collect()
        assert len(kept) == n == len({(r.batch_id, r.slot) for r in kept})
        dropped = sampler.assign_batches(spark.range(n).withColumnRenamed("id", "pos"), size, n).collect()
        assert len(dropped) == n - n % size and len({r.batch_id for r in dropped}) == n // size


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        EpochPlan("id", 0)
    with pytest.raises(ValueError):
        EpochPlan("id", 1, n_workers=0)
    with pytest.raises(ValueError):
        sampler.assign_batches(spark.range(1), 0)
    with pytest.raises(ValueError):
        sampler.assign_workers(spark.range(1), 2, mode="other")


def test_plan_of_next_epoch():
    plan = EpochPlan("id", 4, seed=9)
    assert plan.next_epoch().seed == 10 and plan.next_epoch(3).seed == 3


def test_bucket_digits():
    assert rank.bucket_digits(10) == 2
    assert rank.bucket_digits(10 ** 8) == 4
    assert rank.bucket_digits(10 ** 13) == 5
