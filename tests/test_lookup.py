from __future__ import annotations

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from samplewright.functions import columns as C
from samplewright.functions import fixed
from samplewright.operators import lookup
from samplewright.sources.tables import cyclic_indices, random_indices


def test_fetch_by_index(spark):
    samples = spark.range(10).select(F.col("id").alias("sample_idx"), (F.col("id") * 2).alias("v"))
    asked = spark.createDataFrame([(3,), (3,), (9,)], "sample_idx bigint")
    assert sorted(r.v for r in lookup.fetch_by_index(samples, asked).collect()) == [6, 6, 18]
    outside = spark.createDataFrame([(3,), (10,), (-1,)], "sample_idx bigint")
    with pytest.raises(SparkRuntimeException, match="out of range"):
        lookup.fetch_by_index(samples, outside).collect()
    assert lookup.fetch_by_index(samples, outside, on_missing="drop").count() == 1


def test_indices(spark):
    draws = random_indices(spark, 500, 7, 3).collect()
    assert {r.sample_idx for r in draws} == set(range(7)) and len(draws) == 500
    assert [r.sample_idx for r in cyclic_indices(spark, 5, 2).orderBy("op").collect()] == [0, 1, 0, 1, 0]


def test_locate_shard_with_unequal_and_empty_shards(spark):
    sizes = {0: 3, 1: 0, 2: 100, 5: 1, 7: 9}
    counts = spark.createDataFrame(list(sizes.items()), "shard_id int, n bigint")
    where = [(s, i) for s, n in sizes.items() for i in range(n)]
    asked = spark.range(len(where)).select(F.col("id").alias("sample_idx"))
    got = {r.sample_idx: (r.shard_id, r.local_idx) for r in lookup.locate_shard(asked, counts).collect()}
    assert got == dict(enumerate(where))
    with pytest.raises(SparkRuntimeException, match="out of range"):
        lookup.locate_shard(spark.range(len(where) + 1).withColumnRenamed("id", "sample_idx"), counts).collect()


def test_normalise_names(spark):
    names = ["NVIDIA A40", "nvidia  a40 rev2", "NVIDIA H100 NVL", "NVIDIA H100 PCIe", "My NVIDIA H100 NVL x", "NVIDIA_A100-SXM4-80GB", "Some GPU 1", None]
    df = spark.createDataFrame([(n,) for n in names], "gpu string")
    got = {r.gpu: r.clean_name for r in lookup.normalise_names(df, "gpu", fixed.DEVICE_NAMES).collect()}
    assert got == {
        "NVIDIA A40": "A40", "nvidia  a40 rev2": "A40", "NVIDIA H100 NVL": "H100", "NVIDIA H100 PCIe": "H100-PCI",
        "My NVIDIA H100 NVL x": "H100", "NVIDIA_A100-SXM4-80GB": "NVIDIA_A100-SXM4-80GB", "Some GPU 1": "Some_GPU_1", None: None,
    }


def test_coverage_of_the_fixed_grid(spark):
    grid = lookup.expected_grid(spark, fixed.EXPECTED_BATCH_SIZES, fixed.EXPECTED_MODELS, fixed.EXPECTED_OPTIMIZERS)
    assert grid.count() == sum(map(len, fixed.EXPECTED_BATCH_SIZES.values())) * 16 * 2
    runs = spark.createDataFrame([("NVIDIA H200 NVL", "swin_t", 64, "sgd"), ("NVIDIA H200 NVL", "swin_t", 64, "sgd"),
                                  ("NVIDIA A100 80GB PCIe", "swin_t", 64, "sgd")],
                                 "gpu string, model string, batch_size int, optimizer string")
    names = spark.createDataFrame(list(fixed.COVERAGE_NAMES), "gpu string, device string")
    seen = runs.join(names, "gpu")
    keys = ["device", "model", "batch_size", "optimizer"]
    gap = lookup.coverage_gap(grid, seen, keys)
    assert gap.exceptAll(grid.select(*keys).subtract(lookup.observed_configs(seen, keys))).count() == 0
    missing = {r.device: r.missing for r in lookup.coverage_counts(gap, grid).collect()}
    assert missing["H200"] == 10 * 32 - 1 and missing["A100-80GB"] == 10 * 32


def test_coverage_counts_keep_zeros(spark):
    gap = spark.createDataFrame([("a",)], "device string")
    devices = spark.createDataFrame([("a",), ("b",)], "device string")
    assert {r.device: r.missing for r in lookup.coverage_counts(gap, devices).collect()} == {"a": 1, "b": 0}


def test_tiered_lookup(spark):
    config = spark.createDataFrame(
        [("g", "m", 10.0, 1.0, 20.0, 2.0), ("z", "m", 5.0, 0.5, 0.0, 0.0), ("e", None, None, None, None, None)],
        "gpu string, model string, mean_ms double, std_ms double, default_mean_ms double, default_std_ms double")
    asked = spark.createDataFrame([("g", "m"), ("g", "x"), ("z", "x"), ("e", "x"), ("q", "x")], "gpu string, model string")
    got = {(r.gpu, r.model): (r.delay_s, r.std_s, r.tier) for r in lookup.tiered_lookup(asked, config).collect()}
    assert got == {
        ("g", "m"): (0.01, 0.001, "model"), ("g", "x"): (0.02, 0.002, "device"),
        ("z", "x"): (0.5, 0.0, "fallback"), ("e", "x"): (0.5, 0.0, "fallback"), ("q", "x"): (0.5, 0.0, "fallback"),
    }


def test_labels(spark):
    good = spark.createDataFrame([("n01443537",), ("n00000000",)], "l string")
    assert [r.x for r in good.select(C.parse_label("l").alias("x")).collect()] == [1443537, 0]
    for bad in ("cat", "", None):
        df = spark.createDataFrame([(bad,)], "l string")
        assert df.select(C.parse_label("l", "null").alias("x")).first().x is None
        with pytest.raises(SparkRuntimeException):
            df.select(C.parse_label("l").alias("x")).collect()


def test_names_and_paths(spark):
    df = spark.createDataFrame([("a/b/x.JPEG",), ("a/b/x.jpeg",), ("x.png",)], "p string")
    rows = df.select(C.has_extension("p").alias("e"), C.label_from_path("p").alias("d"), C.label_from_path("p", "first").alias("f")).collect()
    assert [tuple(r) for r in rows] == [(True, "b", "a"), (False, "b", "a"), (True, None, "x.png")]
    names = spark.createDataFrame([("summary_vit_b_16_bs256_sgd_NVIDIA_A100-SXM4-80GB_20250101_101010.csv",),
                                   ("calib_summary_resnet50_bs32_nb1000_adam_L40S_20250101_101010.csv",), ("other.csv",)], "f string")
    got = [tuple(r) for r in names.select(*[C.parse_run_name("f", x) for x in ("model", "batch_size", "optimizer", "gpu", "ts")]).collect()]
    assert got == [("vit_b_16", 256, "sgd", "NVIDIA_A100-SXM4-80GB", "20250101_101010"),
                   ("resnet50", 32, "adam", "L40S", "20250101_101010"), (None,) * 5]


def test_class_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "label string")
    assert {(r.label, r.class_idx) for r in lookup.class_index(df).collect()} == {("a", 0), ("b", 1), ("c", 2), (None, None)}


def test_compare_and_overhead(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0), ("a", 2, 5.0)], "s string, w int, v double")
    row = lookup.compare(df, "s", ["w"], "v", "a", "b").collect()
    assert [(r.w, r.ratio, r.change_pct) for r in row] == [(1, 1.5, 50.0)]
    assert {r.w: r.overhead_pct for r in lookup.overhead(df, "s", ["w"], "v", "b", "a").collect()}[1] == pytest.approx(100 / 3)


def test_scalars(spark):
    df = spark.createDataFrame([(0.0125, 3.0, 0.0)], "a double, b double, c double")
    row = df.select(C.to_ms("a", 0).alias("ms"), C.rounded(F.lit(2.5), 0).alias("r"), C.pct("b", "c").alias("p"), C.pct("c", "c").alias("z"),
                    C.safe_ratio("a", "c").alias("s"), C.core_equivalents("b", F.lit(2.0)).alias("k"),
                    C.step_lr(F.lit(65), 0.1, 30, 0.1).alias("lr")).first()
    assert (row.ms, row.r, row.p, row.z, row.s, row.k) == (12.0, 2.0, 100.0, 0.0, 0.0, 1.5)
    assert row.lr == pytest.approx(0.001)


def test_names_are_matched_without_a_nested_loop(spark):
    import random

    from tests.test_plans import plan_of

    rng = random.Random(6)
    names = {"".join(rng.choices("abAB ", k=rng.randint(0, 12))) for _ in range(150)} | {"", " ", "aa", "É b"}
    mapping = [("".join(rng.choices("abA ", k=rng.randint(1, 5))), f"m{i}") for i in range(25)] + [("É", "e"), ("a" * 40, "long")]
    df = spark.createDataFrame([(n,) for n in sorted(names)] + [(None,)], "name string")
    found = lookup.normalise_names(df, "name", mapping)

    def plain(name):
        exact = [clean for raw, clean in mapping if raw == name]
        inside = [clean for raw, clean in mapping if raw.lower().replace(" ", "") in name.lower().replace(" ", "")]
        return exact[-1] if exact else inside[0] if inside else name.replace(" ", "_")

    assert {r.name: r.clean_name for r in found.collect()} == {n: plain(n) for n in names} | {None: None}
    held = spark.createDataFrame([(n, n.lower()) for n in names], "_name string, _text string")
    entries = spark.createDataFrame([(i, clean, raw.lower()) for i, (raw, clean) in enumerate(mapping)], "ord int, clean string, _raw string")
    assert "NestedLoop" not in plan_of(lookup._contained(held, entries)) and "Cartesian" not in plan_of(lookup._contained(held, entries))
    assert lookup.normalise_names(df, "name", spark.createDataFrame([], "ord int, raw string, clean string")).where("clean_name is null").count() == 1
