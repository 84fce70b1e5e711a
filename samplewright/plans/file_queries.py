"""Queries that write a whole table in one of the formats and read it back, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions.columns import file_name
from samplewright.operators import images, metrics
from samplewright.plans.epoch import EpochPlan
from samplewright.plans.registry import positions_sql, query, table
from samplewright.session import scratch_path
from samplewright.sinks import shards as shard_sinks
from samplewright.sinks import tables as table_sinks
from samplewright.sources import archives, folders, runs, shards
from samplewright.sources import tables as sources
from samplewright.streaming import batches as streams


def _blobs(spark, sf_dir) -> DataFrame:
    """Documents as labelled blobs."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("sample_idx"), F.encode("text", "UTF-8").alias("image"), F.col("lang").alias("label"),
        F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".jpg")).alias("filename"),
    )


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows for tasks that write files: as they are read where no task holds more than a core's share, otherwise shuffled."""
    held = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    most, total = held.agg(F.max("n"), F.sum("n")).first()
    return rows if total and most * rows.sparkSession.sparkContext.defaultParallelism <= total else rows.repartition(key)


def _run(report: DataFrame) -> None:
    report.write.format("noop").mode("overwrite").save()


@query("""
    SELECT doc_id AS sample_idx, (doc_id // 100)::INT AS shard_id, doc_id % 100 AS local_idx,
        strlen(text) AS length, md5(text) AS digest FROM documents
""")
def shard_roundtrip(spark, sf_dir):
    root = scratch_path(spark, "shards")
    _run(shard_sinks.write_shards(_blobs(spark, sf_dir), root, "sample_idx", "image", 100))
    records = shards.read_all_shards(spark, root)
    return records.select("sample_idx", "shard_id", "local_idx", "length", F.md5("payload").alias("digest"))


@query("""
    SELECT row_number() OVER (ORDER BY lang, lpad(doc_id::VARCHAR, 8, '0')) - 1 AS sample_idx, lang AS label,
        lpad(doc_id::VARCHAR, 8, '0') || '.jpg' AS filename, strlen(text) AS length, md5(text) AS digest FROM documents
""")
def class_folder_scan(spark, sf_dir):
    """Documents as files in one directory per language, numbered by directory and name."""
    root = scratch_path(spark, "folder")
    _run(shard_sinks.write_class_folder(_dealt(_blobs(spark, sf_dir), "sample_idx"), root))
    files = folders.read_class_folder(spark, root)
    return files.select("sample_idx", "label", "filename", "length", F.md5("image").alias("digest"))


_ARCHIVE_SQL = """
    SELECT lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.jpg' AS member, lang AS label,
        lpad(doc_id::VARCHAR, 8, '0') || '.jpg' AS filename, md5(text) AS digest FROM documents
"""


def _archive(spark, sf_dir, kind: str) -> DataFrame:
    root = scratch_path(spark, kind)
    _run(shard_sinks.write_archives(_blobs(spark, sf_dir), root, kind, "sample_idx", max_members=250))
    members = archives.read_archive(spark, f"{root}/*.{kind}", kind)
    return members.select("member", "label", "filename", F.md5("image").alias("digest"))


@query(_ARCHIVE_SQL)
def zip_roundtrip(spark, sf_dir):
    return _archive(spark, sf_dir, "zip")


@query(_ARCHIVE_SQL)
def tar_roundtrip(spark, sf_dir):
    return _archive(spark, sf_dir, "tar")


@query("""
    SELECT doc_id AS sample_idx, lang AS label, lpad(doc_id::VARCHAR, 8, '0') || '.jpg' AS filename, md5(text) AS digest
    FROM documents
""")
def image_table_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "images")
    blobs = _blobs(spark, sf_dir).repartitionByRange("sample_idx").sortWithinPartitions("sample_idx")
    table_sinks.write_image_table(blobs, path, rows_per_file=100)
    read = sources.read_image_table(spark, path)
    return read.select("sample_idx", "label", "filename", F.md5("image").alias("digest"))


_LEVEL = "floor(abs(e::DOUBLE) * 1000)::BIGINT % 256"
_SHAPES_SQL = """
    shapes AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 3 END AS channels, 2 + vec_id % 4 AS height, 5 - vec_id % 2 AS width, embedding FROM embeddings)
"""


def _png_folder(spark, sf_dir) -> str:
    """Vectors as PNG files of eight shapes, grey and in colour, in one directory per label."""
    root = scratch_path(spark, "png")
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    shaped = e.select(
        F.concat("vec_id", F.lit(".png")).alias("filename"), F.col("label").cast("string").alias("label"),
        (2 + F.col("vec_id") % 4).cast("int").alias("height"), (5 - F.col("vec_id") % 2).cast("int").alias("width"),
        F.when(F.col("vec_id") % 3 == 0, 1).otherwise(3).alias("channels"),
        F.transform("embedding", lambda x: F.lpad(F.hex((F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("int")), 2, "0")).alias("levels"))
    raw = shaped.withColumn("image", F.unhex(F.array_join(F.slice("levels", F.lit(1), F.col("height") * F.col("width") * F.col("channels")), "")))
    _run(shard_sinks.write_class_folder(images.png_files(raw), root))
    return root


@query(f"""
    WITH {_SHAPES_SQL},
    levels AS (SELECT vec_id, label, channels, height, width, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS e FROM shapes),
    pixels AS (SELECT *, {_LEVEL} AS v, i // channels AS p FROM levels WHERE i < height * width * channels)
    SELECT label::VARCHAR AS label, vec_id || '.png' AS filename, height::INT AS height, width::INT AS width,
        c * height * width + p AS dim, v::SMALLINT AS value
    FROM pixels JOIN (SELECT unnest(range(3)) AS c) ON channels = 1 OR c = i % channels
""")
def decode_files(spark, sf_dir):
    """Image files decoded by Spark's image source; grey ones get three equal channels."""
    files = folders.read_decoded_folder(spark, _png_folder(spark, sf_dir), ("png",))
    tensors = images.image_tensors(files, size=None, decoder=images.spark_image_decoder, decoder_columns=("height", "width", "channels", "image"),
                                   keep=("path", "label"), on_bad="error")
    values = F.posexplode(images.tensor_values("data")).alias("dim", "value")
    return tensors.select("label", file_name("path").alias("filename"), "height", "width", values).withColumn("dim", F.col("dim").cast("bigint"))


@query(f"""
    WITH {_SHAPES_SQL}
    SELECT 'size' AS kind, width::INT AS width, height::INT AS height, NULL::INT AS channels, count(*) AS n FROM shapes GROUP BY width, height
    UNION ALL SELECT 'mode', NULL, NULL, channels, count(*) FROM shapes GROUP BY channels
""")
def image_file_profile(spark, sf_dir):
    """Sizes and channels of image files as the image source finds them."""
    return images.image_profile(folders.read_decoded_folder(spark, _png_folder(spark, sf_dir), ("png",)))


@query("""
    SELECT o_orderkey, doc_id::VARCHAR AS key, lang AS label, md5(text) AS digest
    FROM orders JOIN documents ON doc_id = o_orderkey % (SELECT 2 * count(*) FROM documents)
""")
def keyed_lookup(spark, sf_dir):
    """Records written to a keyed table, and looked up by a table of keys, half of which it lacks."""
    docs = table(spark, sf_dir, "documents")
    name = f"keyed_{uuid.uuid4().hex}"
    table_sinks.write_keyed(table_sinks.keyed_records(docs, "doc_id", "text", "lang"), name, 16)
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % (2 * docs.count())).cast("string").alias("key"))
    return table_sinks.read_keyed(spark, name, asked).select("o_orderkey", "key", "label", F.md5("image").alias("digest"))


@query(f"""
    SELECT pos, pos // 64 AS batch_id, o_orderkey FROM ({positions_sql('orders', 'o_orderkey', 42, 'o_orderkey')})
    WHERE pos // 64 < n // 64
""")
def batches_written(spark, sf_dir):
    """An epoch written in order; positions are read back from the storage order."""
    path = scratch_path(spark, "epoch")
    EpochPlan("o_orderkey", 64).write(table(spark, sf_dir, "orders").select("o_orderkey"), path)
    schema = "o_orderkey bigint, batch_id bigint"
    return sources.read_parquet_table(spark, path, schema).select(F.col("sample_idx").alias("pos"), "batch_id", "o_orderkey")


@query("""
    SELECT event_type AS gpu, ('m' || (user_id % 16)::VARCHAR) AS model, count(*)::INT AS num_batches_completed,
        round_even(avg(sqrt(value)), 2) AS mean_ms, round_even(coalesce(stddev_samp(sqrt(value)), 0), 2) AS std_ms,
        round_even(median(sqrt(value)), 2) AS median_ms, round_even(256 / avg(sqrt(value)) * 1000, 1) AS throughput_img_s
    FROM events GROUP BY ALL
""")
def summary_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "summaries")
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("gpu"), F.concat(F.lit("m"), (F.col("user_id") % 16).cast("string")).alias("model"),
        F.sqrt("value").alias("time_ms"),
    )
    stats = metrics.timing_summary(e, ["gpu", "model"], 256, digits=None)
    rows = stats.select(
        "model", F.lit(256).alias("batch_size"), F.lit("sgd").alias("optimizer"), "gpu", F.lit(80.0).alias("gpu_mem_gb"),
        "num_batches_completed", "mean_ms", "std_ms", "median_ms", "min_ms", "max_ms", "throughput_img_s",
    )
    table_sinks.write_timings_csv(rows, path)
    good, _ = runs.split_corrupt(runs.read_run_files(spark, path, "*.csv"))
    return good.where("batch_size = 256 and optimizer = 'sgd'").select(
        "gpu", "model", "num_batches_completed", "mean_ms", "std_ms", "median_ms", "throughput_img_s"
    )


@query("""
    SELECT (user_id % 4)::INT AS num_workers, 256 AS batch_size, 32 AS chunk_size, event_type AS stage, count(*) AS n
    FROM events GROUP BY ALL
""")
def summary_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "run-json")
    e = table(spark, sf_dir, "events")
    counts = e.groupBy((F.col("user_id") % 4).cast("int").alias("num_workers"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    nested = counts.groupBy("num_workers").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("stage_times"))
    table_sinks.write_run_summary(nested.withColumns({"batch_size": F.lit(256), "chunk_size": F.lit(32)}), path)
    schema = "num_workers int, batch_size int, chunk_size int, stage_times map<string, bigint>"
    back = spark.read.schema(schema).json(path)
    return back.select("num_workers", "batch_size", "chunk_size", F.explode("stage_times").alias("stage", "n"))


@query("""
    WITH m AS (SELECT event_type AS gpu, 'm' || (user_id % 16)::VARCHAR AS model, avg(sqrt(value)) AS mean, avg(sqrt(value) / 7) AS std
        FROM events GROUP BY ALL)
    SELECT gpu, model, round_even(mean, 2) AS mean_ms, round_even(std, 2) AS std_ms,
        round_even(avg(mean) OVER g, 2) AS default_mean_ms, round_even(avg(std) OVER g, 2) AS default_std_ms,
        (count(*) OVER g)::INT AS num_models_benchmarked
    FROM m WINDOW g AS (PARTITION BY gpu)
""")
def delay_config_roundtrip(spark, sf_dir):
    """The device configuration written as JSON and read back as a long table."""
    path = scratch_path(spark, "delays")
    timings = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("gpu"), F.concat(F.lit("m"), (F.col("user_id") % 16).cast("string")).alias("model"),
        F.sqrt("value").alias("mean_ms"), (F.sqrt("value") / 7).alias("std_ms"),
    )
    table_sinks.write_delay_config(metrics.delay_config(timings), path)
    return runs.read_delay_config(spark, path)


# --- streams ------------------------------------------------------------------------

def _event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return streams.read_sample_stream(spark, sf_dir, schema, glob="events.parquet")


_LANES = 16


@query(f"""
    WITH l AS (SELECT (('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % {_LANES})::INT AS lane, count(*) AS n FROM events GROUP BY 1)
    SELECT lane, unnest(range(n // 64)) AS batch_id, 64::BIGINT AS members, 64::BIGINT AS own, 0 AS first_slot, 63 AS last_slot FROM l
""")
def stream_batches(spark, sf_dir):
    """Full batches of every lane: as many as fit, of distinct keys that belong to the lane, in slots 0 to 63."""
    stream = streams.stream_batches(streams.with_lane(_event_stream(spark, sf_dir), "event_id", _LANES), "event_id", 64)
    rows = streams.with_lane(streams.run_to_files(stream).withColumnRenamed("lane", "given"), "event_id", _LANES)
    return rows.groupBy(F.col("given").alias("lane"), "batch_id").agg(
        F.countDistinct("event_id").alias("members"), F.count(F.when(F.col("given") == F.col("lane"), 1)).alias("own"),
        F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


@query("""
    SELECT user_id % 16 AS worker_id, count(*) AS samples_processed, count(*) // 32 AS batches_produced, round(sum(value / 1000), 6) AS busy_time_s FROM events GROUP BY 1
""")
def stream_counters(spark, sf_dir):
    stream = _event_stream(spark, sf_dir).select((F.col("user_id") % 16).alias("worker_id"), (F.col("value") / 1000).alias("busy_s"))
    out = streams.run_updates(streams.stream_counters(stream, batch_size=32), ("worker_id",))
    return out.withColumn("busy_time_s", F.round("busy_time_s", 6))


