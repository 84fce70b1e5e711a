from __future__ import annotations

import io
import json
import os
import re
import tarfile
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from samplewright.operators import images, metrics
from samplewright.plans import file_queries
from samplewright.sinks import shards as shard_sinks
from samplewright.sinks import tables as table_sinks
from samplewright.sources import archives, folders, ranges, runs, shards, tables
from tests.pictures import picture, png


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("folder")
    for name in ("b", "a"):
        (root / name).mkdir()
    (root / "a" / "2.png").write_bytes(png(picture(1)))
    (root / "a" / "10.JPEG").write_bytes(png(picture(2)))
    (root / "b" / "1.jpg").write_bytes(b"not an image")
    (root / "b" / "g.png").write_bytes(png(picture(3)[:, :, 0]))
    (root / "b" / "note.txt").write_text("no")
    (root / "b" / "x.jpeg").write_bytes(b"no")
    (root / "top.png").write_bytes(png(picture(4)))
    (root / "b" / "deep").mkdir()
    (root / "b" / "deep" / "d.png").write_bytes(png(picture(5)))
    return str(root)


def blobs(spark, n, empty=7):
    return spark.range(n).select(
        F.col("id").alias("sample_idx"),
        F.when(F.col("id") == empty, F.lit(b"")).otherwise(F.encode(F.repeat(F.col("id").cast("string"), 5), "UTF-8")).alias("image"),
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("label"),
        F.concat(F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(".jpg")).alias("filename"),
    )


def test_class_folder(spark, folder):
    rows = folders.read_class_folder(spark, folder).orderBy("sample_idx").collect()
    assert [(r.sample_idx, r.label, r.filename) for r in rows] == [(0, "a", "10.JPEG"), (1, "a", "2.png"), (2, "b", "1.jpg"), (3, "b", "g.png")]
    assert all(len(r.image) == r.length for r in rows)
    assert folders.read_class_folder(spark, folder, max_samples=3, with_content=False).count() == 3
    assert folders.read_class_folder(spark, folder, max_samples=0, with_content=False).count() == 0
    assert "image" not in folders.read_class_folder(spark, folder, with_content=False).columns


def test_decoded_folder(spark, folder):
    decoded = folders.read_decoded_folder(spark, folder).withColumn("name", F.element_at(F.split("path", "/"), -1))
    out = images.image_tensors(decoded, size=None, decoder=images.spark_image_decoder,
                               decoder_columns=("height", "width", "channels", "image"), keep=("name", "label"))
    rows = {r.name: r for r in out.collect()}
    for name, seed in (("2.png", 1), ("10.JPEG", 2)):
        assert (np.frombuffer(rows[name].data, np.uint8).reshape(3, 6, 4).transpose(1, 2, 0) == picture(seed)).all()
    grey = np.frombuffer(rows["g.png"].data, np.uint8).reshape(3, 6, 4)
    assert (grey[0] == picture(3)[:, :, 0]).all() and (grey[0] == grey[2]).all()
    assert rows["1.jpg"].error is not None and rows["1.jpg"].data is None
    profile = {(r.kind, r.width, r.channels): r.n for r in images.image_profile(decoded.where("height > 0")).collect()}
    assert profile[("mode", None, 1)] == 1 and profile[("size", 4, None)] == 3


def test_image_table(spark, tmp_path):
    path = str(tmp_path / "t")
    table_sinks.write_image_table(blobs(spark, 95).repartitionByRange(3, "sample_idx").sortWithinPartitions("sample_idx"), path, rows_per_file=20)
    rows = tables.read_image_table(spark, path).orderBy("sample_idx").collect()
    assert [r.filename for r in rows] == [f"{i:04d}.jpg" for i in range(95)]
    assert [r.sample_idx for r in rows] == list(range(95))
    assert tables.read_image_table(spark, path, max_samples=33).count() == 33
    assert tables.read_image_table(spark, path, max_samples=0).count() == 0


def test_shards_25_10(spark, tmp_path):
    root = str(tmp_path / "s")
    (tmp_path / "s" / "notes").mkdir(parents=True)
    report = shard_sinks.write_shards(blobs(spark, 25).repartition(5), root, "sample_idx", "image", 10, tasks=2).collect()
    assert sorted((r.shard_id, r.records) for r in report) == [(0, 10), (1, 10), (2, 5)]
    assert not list(tmp_path.glob("s/*/*.tmp"))
    offsets = np.load(tmp_path / "s" / "0" / "offsets.npy")
    assert offsets.dtype == np.int64 and offsets.shape == (10, 2) and (offsets[7, 0] == offsets[7, 1])
    assert (tmp_path / "s" / "2" / "data.bin").stat().st_size == np.load(tmp_path / "s" / "2" / "offsets.npy")[-1, 1]
    manifest = shards.read_manifest(spark, root)
    back = {r.sample_idx: bytes(r.payload) for r in shards.read_shards(manifest).collect()}
    assert back == {r.sample_idx: bytes(r.image) for r in blobs(spark, 25).collect()}
    assert {r.sample_idx: bytes(r.payload) for r in shards.read_all_shards(spark, root).collect()} == back
    some = shards.read_shards(manifest.where("sample_idx % 2 = 0")).collect()
    assert len(some) == 13
    planned = shard_sinks.shard_manifest(blobs(spark, 25), "sample_idx", "image", 10).select("sample_idx", "start", "end")
    assert planned.exceptAll(manifest.select("sample_idx", "start", "end")).count() == 0


def test_shards_reject_text(spark):
    with pytest.raises(TypeError):
        shard_sinks.write_shards(spark.createDataFrame([(0, "x")], "i bigint, p string"), "/tmp/none", "i", "p")
    with pytest.raises(TypeError):
        shard_sinks.shard_manifest(spark.createDataFrame([(0, 1)], "i bigint, p int"), "i", "p", 3)


def test_truncated_shard_raises(spark, tmp_path):
    root = str(tmp_path / "s")
    shard_sinks.write_shards(blobs(spark, 5), root, "sample_idx", "image", 10, tasks=1).collect()
    data = tmp_path / "s" / "0" / "data.bin"
    data.write_bytes(data.read_bytes()[:-1])
    with pytest.raises(PythonException, match="ends early"):
        shards.read_shards(shards.read_manifest(spark, root)).collect()


@pytest.mark.parametrize("kind", ("zip", "tar"))
def test_archives_round_trip(spark, tmp_path, kind):
    root = str(tmp_path / "a")
    report = shard_sinks.write_archives(blobs(spark, 25), root, kind, "sample_idx", max_members=10, tasks=3).collect()
    assert sorted(r.records for r in report) == [5, 10, 10]
    rows = archives.read_archive(spark, f"{root}/*.{kind}", kind).collect()
    assert {r.member: bytes(r.image) for r in rows} == {f"{r.label}/{r.filename}": bytes(r.image) for r in blobs(spark, 25).collect()}
    assert {r.label for r in rows} == {"c0", "c1", "c2"}


def test_foreign_archives(spark, tmp_path):
    """Files made by the standard tools: directories, other extensions, compressed members."""
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("n1")
        z.writestr("n1/b.png", b"b" * 1000)
        z.writestr("n1/deep/a.jpg", b"a")
        z.writestr("n1/readme.txt", b"t")
    rows = archives.read_archive(spark, str(tmp_path / "x.zip"), "zip").orderBy("member").collect()
    assert [(r.member, r.label, bytes(r.image)) for r in rows] == [("n1/b.png", "n1", b"b" * 1000), ("n1/deep/a.jpg", "n1", b"a")]
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        for name, data in (("n1/b.png", b"bb"), ("n2/" + "l" * 150 + ".jpg", b"a"), ("n1/readme.txt", b"t")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        folder = tarfile.TarInfo("n3.png")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
    rows = archives.read_archive(spark, str(tmp_path / "x.tar"), "tar").orderBy("member").collect()
    assert [(r.label, bytes(r.image)) for r in rows] == [("n1", b"bb"), ("n2", b"a")]


def test_one_archive_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "TASK_BYTES", 100)
    shard_sinks.write_archives(blobs(spark, 200), str(tmp_path), "tar", "sample_idx", max_members=1000, tasks=1).collect()
    read = archives.read_archive(spark, str(tmp_path / "0.tar"), "tar")
    parts = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 4 and read.count() == 200


@pytest.mark.parametrize("form", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT, tarfile.USTAR_FORMAT])
def test_a_long_tar_is_listed_by_ranges(spark, tmp_path, monkeypatch, form):
    """Members that are tar archives themselves, long names and members longer than a range do not mislead the walks."""
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w", format=form) as archive:
        for i in range(12):
            info = tarfile.TarInfo(f"fake/{i}.jpg")
            info.size = 600
            archive.addfile(info, io.BytesIO(bytes([i]) * 600))
    long_name = "x" * (90 if form == tarfile.USTAR_FORMAT else 180)
    with tarfile.open(tmp_path / "a.tar", "w", format=form) as archive:
        for i in range(60):
            data = inner.getvalue() if i % 7 == 3 else b"y" * (5 * i) if i % 11 else b"z" * 9000
            info = tarfile.TarInfo(f"c{i % 3}/{i}{long_name if i % 5 == 0 else ''}.jpg")
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    (tmp_path / "b.tar").write_bytes(inner.getvalue())

    def listed():
        rows = archives.list_archives(spark, str(tmp_path / "*.tar"), "tar").collect()
        return sorted((r.path, r.member, r.start, r.length, r.label) for r in rows)

    wanted = listed()
    assert len(wanted) == 72
    for step in (1024, 2560, 30_000):
        monkeypatch.setattr(archives, "RANGE_BYTES", step)
        assert listed() == wanted


def test_storage_overhead(spark):
    packed = spark.createDataFrame([("zip", 1048576 * 3)], "container string, length bigint")
    raw = spark.createDataFrame([("zip", 1048576), ("zip", 1048576)], "container string, length bigint")
    assert tuple(table_sinks.storage_overhead(packed, raw).first()) == ("zip", 3.0, 2.0, 50.0)


def test_keyed_table(spark):
    records = table_sinks.keyed_records(blobs(spark, 20))
    table_sinks.write_keyed(records, "keyed_test", 4, mode="overwrite")
    back = spark.table("keyed_test")
    assert bytes(back.where("key = '13'").first().image) == b"13" * 5 and back.count() == 20
    asked = spark.createDataFrame([("3",), ("3",)], "key string")
    assert asked.join(back, "key").count() == 2


def test_keyed_lookups_stay_in_their_buckets(spark):
    from tests.test_plans import plan_of

    table_sinks.write_keyed(table_sinks.keyed_records(blobs(spark, 50)), "keyed_plan", 8, mode="overwrite")
    asked = spark.createDataFrame([("3", 1), ("3", 2), ("49", 3), ("50", 4), (None, 5)], "key string, tag int")
    joined = table_sinks.read_keyed(spark, "keyed_plan", asked)
    assert sorted((r.key, r.tag, bytes(r.image)) for r in joined.collect()) == [("3", 1, b"3" * 5), ("3", 2, b"3" * 5), ("49", 3, b"49" * 5)]
    text = plan_of(table_sinks.read_keyed(spark, "keyed_plan", asked))
    # one exchange, of the keys; the store's side is read bucket by bucket
    assert len(re.findall(r"\bExchange ", text)) == 1 and "Bucketed: true" in text[text.rindex("FileScan"):] and "SortMergeJoin" in text
    assert table_sinks.read_keyed(spark, "keyed_plan", ["13", "none"]).select("key").collect() == [("13",)]
    (held,) = (r[0] for r in table_sinks.read_keyed(spark, "keyed_plan", ["13"]).select(F.input_file_name()).collect())
    others = [f for f in spark.table("keyed_plan").inputFiles() if f.rsplit("/", 1)[1] != held.rsplit("/", 1)[1]]
    for file in others:  # a bucket that a key does not belong to is not opened
        Path(re.sub("^file:/*", "/", file)).write_bytes(b"")
    spark.catalog.refreshTable("keyed_plan")
    assert len(others) >= 7 and bytes(table_sinks.read_keyed(spark, "keyed_plan", ["13"]).first().image) == b"13" * 5
    with pytest.raises(ValueError):
        spark.range(3).write.mode("overwrite").saveAsTable("not_keyed")
        table_sinks.bucket_count(spark, "not_keyed")


def test_run_files(spark, tmp_path):
    header = "model,batch_size,optimizer,gpu,gpu_mem_gb,num_batches_completed,mean_ms,std_ms,median_ms,min_ms,max_ms,throughput_img_s\n"
    good = "resnet50,256,sgd,NVIDIA L40S,48.0,200,444.45,0.25,444.4,443.0,446.0,576.0\n"
    (tmp_path / "summary_resnet50_bs256_sgd_NVIDIA_L40S_20250101_101010.csv").write_text(header + good)
    (tmp_path / "summary_broken_bs256_sgd_X_20250101_101010.csv").write_text(header + "resnet50,many,sgd\n")
    (tmp_path / "bench_resnet50.csv").write_text("ignored\n1\n")
    rows = runs.read_run_summaries(spark, str(tmp_path), "batch_size = 256 and optimizer = 'sgd'")
    row = runs.with_run_name(rows).first()
    assert rows.count() == 1 and (row.gpu, row.mean_ms, row.name_gpu, row.name_batch_size) == ("NVIDIA L40S", 444.45, "NVIDIA_L40S", 256)
    _, bad = runs.split_corrupt(runs.read_run_files(spark, str(tmp_path)))
    assert bad.count() == 1


def test_delay_config_file(spark, tmp_path):
    config = {"A": {"models": {"m1": {"mean_ms": 1.5, "std_ms": .5}, "m2": {"mean_ms": 2.5, "std_ms": .1}}, "default_mean_ms": 2.0,
                    "default_std_ms": .3, "num_models_benchmarked": 2},
              "B": {"models": {}, "default_mean_ms": None, "default_std_ms": None, "num_models_benchmarked": 0}}
    (tmp_path / "c.json").write_text(json.dumps(config, indent=2))
    rows = runs.read_delay_config(spark, str(tmp_path / "c.json")).collect()
    assert {(r.gpu, r.model, r.mean_ms, r.default_mean_ms) for r in rows} == {("A", "m1", 1.5, 2.0), ("A", "m2", 2.5, 2.0), ("B", None, None, None)}


def test_run_summary_json(spark, tmp_path):
    workers = spark.createDataFrame([(1, 0, 10, 1.0, 0.5, 66.67), (1, 1, 12, 2.0, 0.0, 100.0)],
                                    "run_id int, worker_id int, samples_processed bigint, busy_time_s double, idle_time_s double, utilization_pct double")
    run = spark.createDataFrame([(1, 3.14159, 7)], "run_id int, epoch_time_s double, batches_produced bigint")
    stage = metrics.stage_stats(spark.createDataFrame([(1, "collate", 0.5)], "run_id int, stage string, seconds double"), keys=["run_id"])
    summary = metrics.run_summary(workers, run, stages=stage).withColumns({"batch_size": F.lit(256), "chunk_size": F.lit(32)})
    table_sinks.write_run_summary(summary, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("num_workers=2/batch_size=256/chunk_size=32/*.json"))
    record = json.loads(files[0].read_text())
    assert record["epoch_time_s"] == 3.14 and [w["worker_id"] for w in record["workers"]] == [0, 1]
    assert record["aggregate"] == {"total_busy_time_s": 3.0, "total_idle_time_s": 0.5, "avg_utilization_pct": 85.71}
    assert record["stage_times"]["collate"]["mean_ms"] == 500.0 and record["stage_times"]["batch_put"]["count"] == 0


def test_timing_csv(spark, tmp_path):
    df = spark.createDataFrame([("m", 256, "sgd", "g", 80.0, 1, 0.1234567, 123.4567)], runs.BATCH_TIMES).coalesce(1)
    table_sinks.write_timings_csv(df, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_text().splitlines()
    assert text == ["model,batch_size,optimizer,gpu,gpu_mem_gb,batch_index,time_s,time_ms", "m,256,sgd,g,80.0,1,0.123457,123.46"]


def test_a_folder_of_small_files_is_read_by_few_tasks(spark, tmp_path):
    """Not by one for every 32 files; by more where the bytes ask for them."""
    for i in range(900):
        (tmp_path / f"c{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"c{i % 3}" / f"{i:04d}.png").write_bytes(b"x" * (1 + i % 7))
    few = folders.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for files in (folders.list_class_folder(spark, str(tmp_path)), folders.read_decoded_folder(spark, str(tmp_path))):
        assert files.count() == 900 and files.rdd.getNumPartitions() <= few
    read = folders.read_class_folder(spark, str(tmp_path))
    assert [(r.sample_idx, r.filename, len(r.image)) for r in read.orderBy("sample_idx").collect()[:3]] == [(0, "0000.png", 1), (1, "0003.png", 4), (2, "0006.png", 7)]
    assert folders._folder_bytes(spark, str(tmp_path)) == sum(1 + i % 7 for i in range(900))


def odd_folder(root: Path) -> str:
    """Hidden names, other levels and suffixes, links, empty files and classes, and names that are no plain words."""
    for label in ("b c", "a", "_gone", "_k=1", ".dot", "_metadata_x", "empty", "\u00fc%20"):
        (root / label).mkdir(parents=True)
        for i, name in enumerate(("2.png", "10.JPEG", "_x.jpg", "_x=1.jpg", ".y.jpg", "_metadata.jpg", "z.jpg._COPYING_", "n.PNG", "no.txt", "p q%41.jpg", "\u00e9+#.png", "e.jpg")):
            if label != "empty":
                (root / label / name).write_bytes(b"x" * (3 * i % 31 + 1) if name != "e.jpg" else b"")
    (root / "a" / "deep.png").mkdir()
    (root / "a" / "deep.png" / "d.png").write_bytes(b"d")
    (root / "top.png").write_bytes(b"t")
    (root / "a" / "broken.png").symlink_to(root / "nowhere")
    (root / "a" / os.fsdecode(b"bad\xff.png")).write_bytes(b"no name")
    (root / "linked").symlink_to(root / "b c")
    (root / "a" / "link.png").symlink_to(root / "top.png")
    return str(root)


def test_a_class_folder_is_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The driver holds no file of it, and the rows are those of Spark's own source."""
    plain = odd_folder(tmp_path / "odd")
    assert not folders.list_class_folder(spark, plain).inputFiles() and not folders.read_class_folder(spark, plain).inputFiles()
    root = odd_folder(tmp_path / "odd [1] {x}")

    def rows(**how):
        read = folders.read_class_folder(spark, root, **how)
        return read.columns, read.dtypes, sorted(map(tuple, read.collect()))

    monkeypatch.setattr(folders, "LISTED_ROWS", 2)
    monkeypatch.setattr(folders, "READ_BYTES", 20)
    mine = [rows(), rows(with_content=False), rows(max_samples=5), rows(exts=("txt",))]
    assert {r[1] for r in mine[0][2]} == {"a", "b c", "linked", "_k=1", "_metadata_x", "\u00fc%20"}
    assert sorted(r[4] for r in mine[0][2]) == list(range(6 * 5 + 1)) and all(len(r[5]) == r[3] for r in mine[0][2])
    monkeypatch.setattr(folders, "_task_root", lambda *_: None)
    monkeypatch.setattr(folders, "_in_few_tasks", lambda files, total_bytes=0: files)
    again, root = root, plain  # Spark's source takes brackets for patterns
    for (names, types, want), how in zip(mine, ({}, {"with_content": False}, {"max_samples": 5}, {"exts": ("txt",)})):
        theirs = rows(**how)
        assert (names, types) == theirs[:2]
        assert [(r[0].replace(again, plain), *r[1:]) for r in want] == theirs[2]


def test_a_folder_that_is_not_there(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert folders.read_class_folder(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        folders.list_class_folder(spark, str(tmp_path / "other"))


def test_texts_are_shuffled_to_their_writers_only_where_tasks_are_uneven(spark, tmp_path):
    for files, shuffled in ((4, False), (1, True)):
        path = str(tmp_path / str(files))
        blobs(spark, 400).coalesce(files).write.parquet(path)
        dealt = file_queries._dealt(spark.read.parquet(path), "sample_idx")
        assert ("Exchange" in dealt._jdf.queryExecution().toString()) == shuffled
        shard_sinks.write_class_folder(dealt, f"{path}-folder").collect()
        read = folders.read_class_folder(spark, f"{path}-folder")
        assert read.count() == 399 and {r.filename for r in read.collect()} == {f"{i:04d}.jpg" for i in range(400) if i != 7}
    assert file_queries._dealt(spark.read.parquet(path).limit(0), "sample_idx").count() == 0
