from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from samplewright.operators import rank, series


@pytest.fixture(scope="module")
def skewed():
    """One group holds nine tenths of the rows; values repeat and include zero and negatives."""
    rng = np.random.default_rng(1)
    n = 5000
    value = np.round(rng.normal(0, 50, n), 1)
    value[:1500] = 7.5
    return pd.DataFrame({
        "g": np.where(np.arange(n) % 10 == 0, "small", "hot"), "i": rng.permutation(n) * 3, "v": value,
    })


def test_running_sum_and_max(spark, skewed):
    df = spark.createDataFrame(skewed)
    out = rank.running(df, ["g"], "i", {"s": ("v", "sum"), "m": ("v", "max"), "lo": ("v", "min")}, block=64).toPandas()
    want = skewed.sort_values("i")
    grouped = want.groupby("g").v
    want = want.assign(s=grouped.cumsum(), m=grouped.cummax(), lo=grouped.cummin())
    merged = out.merge(want, on=["g", "i"], suffixes=("", "_w"))
    assert len(merged) == len(skewed)
    assert np.allclose(merged.s, merged.s_w) and (merged.m == merged.m_w).all() and (merged.lo == merged.lo_w).all()


def test_running_exclusive_and_null_group(spark):
    df = spark.createDataFrame([(None, 1, 5.0), (None, 2, 3.0), ("a", 1, 1.0)], "g string, i bigint, v double")
    rows = rank.running(df, ["g"], "i", {"m": ("v", "max")}, block=1, inclusive=False).collect()
    assert {(r.g, r.i): r.m for r in rows} == {(None, 1): None, (None, 2): 5.0, ("a", 1): None}


def test_dense_index(spark, skewed):
    out = rank.dense_index(spark.createDataFrame(skewed), ["g"], "i", block=100).toPandas()
    want = skewed.assign(idx=skewed.groupby("g").i.rank().astype(int) - 1)
    assert out.set_index(["g", "i"]).idx.sort_index().equals(want.set_index(["g", "i"]).idx.sort_index().astype("int64"))


def test_order_statistics(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = {r.g: r for r in rank.medians(df, ["g"], "v").collect()}
    for g, part in skewed.groupby("g"):
        assert got[g]["median"] == pytest.approx(part.v.median())
    for p in (0.0, 0.5, 0.95, 1.0):
        for r in rank.nearest_rank(df, ["g"], "v", p).collect():
            values = sorted(skewed[skewed.g == r.g].v)
            assert r.percentile == values[round((len(values) - 1) * p)]


@pytest.mark.parametrize("n,index", [(11, 10), (31, 28), (1, 0)])
def test_nearest_rank_rounds_half_even(spark, n, index):
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
    assert rank.nearest_rank(df, ["g"], "v", 0.95).first().percentile == index


def test_order_statistics_odd_values(spark):
    values = [float("-inf"), -1e300, -2.5, -0.0, 0.0, 5e-324, 1.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(1, v) for v in reversed(values)] + [(1, None), (2, None)], "g int, v double")
    for i, want in enumerate(values):
        found = rank.order_statistics(df, ["g"], "v", {"x": lambda n, i=i: F.lit(i)}).collect()
        assert len(found) == 1
        assert found[0].x == want or (np.isnan(want) and np.isnan(found[0].x))
    assert {r.g: r.percentile for r in rank.nearest_rank(df, ["g"], "v", 0.5).collect()}[2] == 0.0


def test_order_image_is_the_stored_bits(spark):
    rng = np.random.default_rng(0)
    powers = 2.0 ** np.arange(-1074, 1024)
    values = np.unique(np.concatenate([np.abs(rng.normal(0, 1, 500)), rng.lognormal(0, 20, 500), powers, np.nextafter(powers, np.inf), np.nextafter(powers, 0), [np.inf]]))
    values = np.concatenate([-values[::-1], values[values > 0]])
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(values)), "v": values}))
    image = np.array([r.b for r in df.select("i", rank.order_image(F.col("v")).alias("b")).orderBy("i").collect()])
    bits = np.abs(values).view(np.int64)
    assert (image == np.where(values < 0, -bits, bits)).all() and (np.diff(image) > 0).all()
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "v double").select(rank.order_image(F.col("v")).alias("b")).collect()
    assert [r.b for r in zeros] == [0, 0]


def test_selection_narrows_to_few_rows(spark, monkeypatch):
    """300,000 values that share their first 14 bits: each task gets a bounded number of them."""
    monkeypatch.setattr(rank, "RANKED_ROWS", 2000)
    seen = []
    with_prefix = rank._with_prefix
    monkeypatch.setattr(rank, "_with_prefix", lambda *a: seen.append((with_prefix(*a), a[4])) or seen[-1][0])
    df = spark.range(300_000).select(F.lit("hot").alias("g"), (F.lit(1.7e9) + F.col("id") * 7919 % 300_000 / 8).alias("v"))
    found = rank.order_statistics(df, ["g"], "v", {"x": lambda n: F.bround((n - 1) * F.lit(0.95), 0), "y": lambda n: F.lit(3), "z": lambda n: n - 1}).collect()
    assert [(r.x, r.y, r.z) for r in found] == [(1.7e9 + 284_999 / 8, 1.7e9 + 3 / 8, 1.7e9 + 299_999 / 8)]
    assert len(seen) > 1
    close = [rows for rows, columns in seen if columns]
    assert max(r["count"] for r in close[0].groupBy("g", "_prefix").count().collect()) <= 2000


def test_selection_of_equal_and_long_values(spark, monkeypatch):
    monkeypatch.setattr(rank, "RANKED_ROWS", 10)
    big = (1 << 62) + 5
    df = spark.range(1000).select(F.when(F.col("id") < 600, F.lit(big)).otherwise(F.lit(big) + F.col("id") % 7).alias("v"), F.lit(None).cast("string").alias("g"))
    want = sorted([big] * 600 + [big + i % 7 for i in range(600, 1000)])
    for at in (0, 599, 700, 999):
        assert [r.x for r in rank.order_statistics(df, ["g"], "v", {"x": lambda n, at=at: F.lit(at)}).collect()] == [want[at]]


def test_running_over_a_sparse_order(spark):
    """Steps of a million: blocks hold as many rows as asked for, not one each."""
    df = spark.range(4000).select(F.when(F.col("id") % 8 > 0, "hot").otherwise("other").alias("g"), (F.col("id") * 1_000_000).alias("i"), F.lit(1).alias("one"))
    out = rank.running(df, ["g"], "i", {"n": ("one", "sum"), "before": ("i", "max")}, block=250)
    sizes = [r["count"] for r in df.repartitionByRange(16, "g", "i").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) <= 16 and max(sizes) <= 1000
    for r in out.collect():
        k = r.i // 1_000_000
        assert r.before == r.i and r.n == (k // 8 + 1 if r.g == "other" else k - k // 8)
    dates = df.select("g", F.date_add(F.lit("2000-01-01").cast("date"), (F.col("i") / 1_000_000).cast("int")).alias("day"), "one")
    assert rank.running(dates, [], "day", {"n": ("one", "sum")}, block=500).agg(F.max("n")).first()[0] == 4000


@pytest.mark.parametrize("block", [1, 1000])
def test_repeated_order_raises(spark, block):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 2, 3.0), ("b", 2, 3.0)], "g string, i int, v double")
    with pytest.raises(PySparkException):
        rank.running(df, ["g"], "i", {"s": ("v", "sum")}, block=block).collect()


def test_partitions_follow_the_bytes(spark):
    """Twice the bytes, twice the partitions; each begins with a batch and holds about what was asked for."""
    def parts(n, width):
        df = spark.range(n).select("id", F.repeat(F.lit("x"), F.lit(width)).alias("payload"))
        rows = rank.hashed_position(df, "id", part_bytes=20_000, align=16, keep_part=True).groupBy("_part").agg(
            F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).orderBy("_part").collect()
        assert all(r.first % 16 == 0 and r.last - r.first + 1 == r.n for r in rows) and sum(r.n for r in rows) == n
        assert [r.first for r in rows[1:]] == [r.last + 1 for r in rows[:-1]] and max(r.n * (width + 8) for r in rows) < 40_000
        return len(rows)

    assert parts(2000, 92) == pytest.approx(10, abs=1) and parts(4000, 92) == pytest.approx(20, abs=1) and parts(2000, 192) == pytest.approx(20, abs=1)


def test_border_rows_are_found_in_the_digit_tree(spark, monkeypatch):
    """Few buckets with many rows: borders inside them are narrowed down by digits, and positions stay the hash ranks."""
    df = spark.range(3000)
    want = {r.id: r.pos for r in rank.hashed_position(df, "id").collect()}
    for ranked in (5, 100_000):
        monkeypatch.setattr(rank, "RANKED_ROWS", ranked)
        got = rank.hashed_position(df, "id", bucket_hex=1, partitions=7, align=10, keep_part=True).collect()
        assert {r.id: r.pos for r in got} == want and {r._part for r in got} == set(range(7))
        assert all(r.pos // 430 == r._part for r in got)


def test_rows_are_shuffled_once_each(spark):
    from tests.test_plans import plan_of

    rows = rank.hashed_position(spark.range(5000), "id", bucket_hex=1, partitions=9)
    assert rows.count() == 5000 and "Generate explode" not in plan_of(rows)


def test_ordered_position(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("c"))
    rows = rank.ordered_position(df.repartition(6), ["c", "k"], total="n").collect()
    assert all(r.pos == r.k and r.n == 1000 for r in rows) and len(rows) == 1000
    assert rank.ordered_position(df.where("k < 0"), ["k"]).count() == 0


def test_running_mean_report(spark):
    df = spark.range(1, 11).select(F.lit("r").alias("run"), F.col("id").alias("i"), (F.col("id") * 1.0).alias("v"))
    rows = series.running_mean(df, ["run"], "i", "v", 4).orderBy("i").collect()
    assert [(r.i, r.mean_so_far, r.last_value) for r in rows] == [(4, 2.5, 4.0), (8, 4.5, 8.0)]


def test_running_metrics(spark):
    df = spark.createDataFrame([(0, 0, 10, 2.0, 5), (0, 1, 30, 1.0, 30), (0, 2, 10, 0.0, 0)],
                               "epoch int, b int, n int, loss double, corrects int")
    row = series.running_metrics(df, ["epoch"], "b", 2).collect()
    assert [(r.b, r.current_loss, r.current_acc) for r in row] == [(1, 50 / 40, 87.5)]


def test_new_best_is_strict_and_starts_above_zero(spark):
    values = [-1.0, 0.0, 1.0, 1.0, 3.0, 2.0, 3.5]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, i bigint, v double")
    assert [r.i for r in series.new_best(df, ["run"], "i", "v").orderBy("i").collect()] == [2, 4, 6]


def test_drop_warmup(spark, skewed):
    out = series.drop_warmup(spark.createDataFrame(skewed), ["g"], "i", 600).toPandas()
    want = skewed[skewed.groupby("g").i.rank() > 600]
    assert sorted(out.i) == sorted(want.i)
    assert "small" not in set(out.g)


def test_speedup_first(spark):
    df = spark.createDataFrame([("a", 4, 8.0), ("a", 1, 2.0), ("b", 2, 3.0)], "s string, workers int, throughput double")
    assert {(r.s, r.workers): r.speedup for r in series.speedup_first(df, "s").collect()} == {("a", 4): 4.0, ("a", 1): 1.0, ("b", 2): 1.0}
