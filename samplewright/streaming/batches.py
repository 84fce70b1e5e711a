"""Batches and counters over arriving samples (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from samplewright.functions.columns import int_div
from samplewright.session import scratch_path


# Assemblers of a stream unless it names their number.
LANES = 64


def read_sample_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None,
                       glob: str | None = None) -> DataFrame:
    """Samples as their Parquet files arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def with_lane(df: DataFrame, key: str, lanes: int = LANES) -> DataFrame:
    """Spread samples evenly over ``lanes`` assemblers, whatever their key distribution.

    A lane is one state group. Their number belongs to the stream, not to the session: a restart must find every key's
    state in the lane it was left in, so it takes the same number.
    """
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    return df.withColumn("lane", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % lanes).cast("int"))


def stream_batches(samples: DataFrame, key: str, batch_size: int, lane: str = "lane") -> DataFrame:
    """``lane, batch_id, slot, key`` of full batches as samples arrive.

    Each lane carries fewer than ``batch_size`` keys over to the next trigger; what
    is left when the stream ends is dropped. Join pixels to the keys afterwards.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    schema = f"{lane} int, batch_id bigint, slot int, {key} bigint"
    lanes = samples.select(lane, F.col(key).cast("bigint").alias(key)).groupBy(lane)

    def assemble(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, next_batch = state.get if state.exists else ([], 0)
        held = list(held)
        for frame in frames:
            held.extend(frame[key].tolist())
            full = len(held) // batch_size
            if full:
                used = full * batch_size
                place = pd.RangeIndex(used)
                yield pd.DataFrame({
                    lane: group[0], "batch_id": next_batch + place // batch_size,
                    "slot": (place % batch_size).astype("int32"), key: held[:used],
                })
                held, next_batch = held[used:], next_batch + full
        state.update((held, next_batch))

    return lanes.applyInPandasWithState(assemble, schema, "held array<bigint>, next_batch bigint", "append", GroupStateTimeout.NoTimeout)


def stream_counters(events: DataFrame, keys: tuple[str, ...] = ("worker_id",), busy: str = "busy_s",
                    batch_size: int | None = None) -> DataFrame:
    """Samples and busy time so far per worker, and with a ``batch_size`` the batches they filled."""
    counted = F.count(F.lit(1))
    batches = [int_div(counted, batch_size).alias("batches_produced")] if batch_size else []
    return events.groupBy(*keys).agg(counted.alias("samples_processed"), *batches, F.sum(busy).alias("busy_time_s"))


def run_to_files(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Run an append stream over everything that has arrived and return what it wrote."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream-out")
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}.checkpoint")
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, keys: tuple[str, ...], path: str | None = None) -> DataFrame:
    """Run an update-mode aggregation over everything that has arrived; the last row of each key.

    Every trigger writes its changed rows under its own number, so a repeated
    trigger overwrites itself.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream-updates")
    schema = T.StructType([*stream.schema.fields, T.StructField("trigger_id", T.LongType())])

    def keep(changed: DataFrame, trigger: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/trigger_id={trigger}")

    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}.checkpoint")
        .foreachBatch(keep).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    written = spark.read.schema(schema).option("basePath", path).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "trigger_id").alias("_newest"))
    return newest.select(*keys, "_newest.*").select(*stream.columns)
