"""File order, key checks, archive methods, lanes and image edges that small tables do not show."""

from __future__ import annotations

import zipfile
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from samplewright.operators.images import batch_tensors, eval_crop, raw_decoder, tensor_values
from samplewright.operators.rank import hashed_position
from samplewright.session import is_small, qualified
from samplewright.sinks.tables import storage_overhead
from samplewright.sources.archives import read_archive
from samplewright.sources.ranges import known_scheme
from samplewright.sources.tables import fetch_rows, read_parquet_table, with_sample_idx, write_order
from samplewright.streaming.batches import with_lane


def test_positions_past_a_thousand_files_of_a_task(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1100, 1, 1).write.option("maxRecordsPerFile", 1).parquet(path)
    assert with_sample_idx(spark.read.parquet(path)).where("id <> sample_idx").count() == 0


def test_write_order_reads_numbers(spark):
    names = ["d/part-99999-u-c000.x", "d/part-100000-u-c000.x", "d/part-00001-u-c1000.x", "d/part-00001-u-c999.x", "d/plain.x", "c/part-00009-u.x"]
    rows = [r.p for r in spark.createDataFrame([(n,) for n in names], "p string").orderBy(*write_order("p")).collect()]
    assert rows == ["c/part-00009-u.x", "d/plain.x", "d/part-00001-u-c999.x", "d/part-00001-u-c1000.x", "d/part-99999-u-c000.x", "d/part-100000-u-c000.x"]


def test_write_order_is_not_read_from_an_identifier(spark):
    name = "d/part-00000-9d1f2a3b-c1f0-4c22-8a00-c12aa0b1c2d3-c{:03d}.snappy.parquet"
    rows = spark.createDataFrame([(name.format(i), i) for i in range(1100)], "p string, i int").orderBy(*write_order("p")).collect()
    assert [r.i for r in rows] == list(range(1100))


def test_a_prefix_opens_only_its_files(spark, tmp_path):
    path = str(tmp_path / "a b%20c")
    spark.range(0, 3000, 1, 1).withColumn("v", F.col("id") * 2).write.option("maxRecordsPerFile", 10).parquet(path)
    rows = read_parquet_table(spark, path, "id bigint, v bigint", 95)
    assert len(rows.inputFiles()) == 10 and sorted((r.sample_idx, r.id) for r in rows.collect()) == [(i, i) for i in range(95)]
    for n in (0, 10, 2999, 5000):
        rows = read_parquet_table(spark, path, "id bigint, v bigint", n)
        assert len(rows.inputFiles()) == min(300, -(-n // 10)) or n == 0
        assert rows.where("id = sample_idx").count() == rows.count() == min(n, 3000)
    wanted = spark.createDataFrame([(2999, "a"), (7, "b"), (7, "c"), (1504, "d")], "sample_idx bigint, tag string")
    found = fetch_rows(spark, path, wanted)
    assert sorted((r.tag, r.sample_idx, r.id, r.v) for r in found.collect()) == [("a", 2999, 2999, 5998), ("b", 7, 7, 14), ("c", 7, 7, 14), ("d", 1504, 1504, 3008)]
    assert sum(f.endswith(".parquet") for f in found.inputFiles()) == 3
    beyond = wanted.union(spark.createDataFrame([(3000, "x"), (-1, "y")], "sample_idx bigint, tag string"))
    with pytest.raises(PySparkException):
        fetch_rows(spark, path, beyond).collect()
    assert fetch_rows(spark, path, beyond, on_missing="drop").count() == 4


def test_plain_paths_belong_to_the_default_file_system(spark, tmp_path):
    class Cluster:
        sparkContext = SimpleNamespace(master="spark://m:7077", getCheckpointDir=lambda: "hdfs://x/c", setCheckpointDir=print)

        def __getattr__(self, name):
            return getattr(spark, name)

    assert qualified(spark, f"{tmp_path}/a b") == f"file:{tmp_path}/a b"
    with pytest.raises(ValueError):
        qualified(Cluster(), f"{tmp_path}/a")
    assert qualified(Cluster(), f"file:{tmp_path}/a") == f"file:{tmp_path}/a"
    below = spark.conf.get("spark.checkpoint.dir") + "/shards"
    assert qualified(Cluster(), below).endswith(below.removeprefix("file:"))


def test_null_keys_repeat(spark):
    one = spark.createDataFrame([(1,), (None,)], "k long")
    assert sorted(r.pos for r in hashed_position(one, "k").collect()) == [0, 1]
    with pytest.raises(PySparkException):
        hashed_position(one.union(one), "k").collect()


def test_size_check_stops_early(spark):
    assert is_small(spark.range(10), 10) and not is_small(spark.range(11), 10)


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_zip_methods(spark, tmp_path, method):
    data = bytes(range(256)) * 20
    with zipfile.ZipFile(tmp_path / "a.zip", "w", method) as archive:
        archive.writestr("cat/one.jpg", data)
    (row,) = read_archive(spark, str(tmp_path / "a.zip")).collect()
    assert bytes(row.image) == data


def test_damaged_and_encrypted_members_raise(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("cat/one.jpg", b"0123456789")
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(whole.replace(b"0123456789", b"0123456780"))
    with pytest.raises(PySparkException):
        read_archive(spark, str(tmp_path / "a.zip")).collect()
    locked = bytearray(whole)
    at = locked.index(b"PK\x01\x02")
    locked[at + 8] |= 1
    (tmp_path / "a.zip").write_bytes(bytes(locked))
    with pytest.raises(PySparkException):
        read_archive(spark, str(tmp_path / "a.zip")).collect()


def test_object_store_names():
    assert known_scheme("s3a://bucket/a b/c=1") == "s3://bucket/a%20b/c=1"
    assert known_scheme("/plain/path") == "/plain/path" and known_scheme("gs://b/x") == "gs://b/x"


def test_sizes_of_either_side_stay(spark):
    left = spark.createDataFrame([("zip", 10)], "container string, length long")
    right = spark.createDataFrame([("tar", 10)], "container string, length long")
    assert {r.container: r.overhead_pct for r in storage_overhead(left, right).collect()} == {"zip": None, "tar": None}


def test_lanes_are_many(spark):
    assert with_lane(spark.range(1000), "id", 16).select("lane").distinct().count() == 16
    assert with_lane(spark.range(1000), "id").select("lane").distinct().count() > 1


def _raw(spark, sizes):
    rows = [(i, h, w, 3, bytes(np.full(h * w * 3, i + 1, np.uint8)), "1") for i, (h, w) in enumerate(sizes)]
    return spark.createDataFrame(rows, "sample_idx long, height int, width int, channels int, image binary, label string")


def test_crop_larger_than_the_image(spark):
    columns = ("height", "width", "channels", "image")
    (row,) = eval_crop(_raw(spark, [(8, 8)]), 6, 10, decoder=raw_decoder, decoder_columns=columns).collect()
    plane = np.frombuffer(row.data, np.uint8).reshape(3, 10, 10)
    assert (plane[:, 2:8, 2:8] == 1).all() and plane.sum() == 3 * 36


def test_shapes_of_a_batch_must_agree(spark):
    columns = ["height", "width", "channels", "image"]
    batch = _raw(spark, [(2, 2), (3, 3)]).groupBy(F.lit(0).alias("batch_id")).agg(*[F.collect_list(c).alias(c) for c in columns])
    with pytest.raises(PySparkException):
        batch_tensors(batch, None, decoder=raw_decoder, decoder_columns=columns).collect()


def test_large_tensors_read_out(spark):
    blob = bytes(range(256)) * (224 * 224 * 3 // 256)
    df = spark.createDataFrame([(blob,), (None,)], "data binary")
    rows = [r.v for r in df.select(tensor_values("data").alias("v")).collect()]
    assert rows[0] == list(blob) and rows[1] is None
