"""Registry, scratch tables and Arrow slices shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Text bytes that one step inside a Python task works on at a time. A single longer text is a step of its own.
SLAB_BYTES = 1 << 20

# Bits of a filter of ids: about 64 for each id, at most 16 MB whatever the number of ids.
FILTER_BITS = 1 << 27


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL where SQL can say it."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Arrow batches bounded by bytes for tables of texts (a setting of the session, read when a plan runs)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def release_memory() -> None:
    """Give back what Arrow keeps of freed batches; a Python worker calls it at the end of a task.

    Spark keeps workers for later tasks, several for each core where a stage runs Python twice, and all of them count with
    the executor's memory.
    """
    pa.default_memory_pool().release_unused()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared scratch folder and read back: lineage ends there, columns stay prunable."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished steps now and not at its next periodic collection.

    Spark gives them back when the driver collects the plans that made them. Results of these steps are written tables, so
    nothing needs the files again, also when an executor is lost.
    """
    spark._jvm.java.lang.System.gc()


def perhaps_among(column: str, ids: DataFrame):
    """Condition that holds wherever ``column`` (a long) is one of the ids ``ids.<column>``, and for few other values.

    A bit for each hash of an id goes to all tasks, so that most rows without a partner need not be shuffled to an exact
    join. Null holds or not.
    """
    size = min(FILTER_BITS, 1 << max(20, (64 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(size))
    held = ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")).toArrow()
    words = np.zeros(size // 64, dtype=np.int64)
    words[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def among(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return among(place)


def text_of(docs: DataFrame, column: str = "text"):
    """The text column with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls and the ``n + 1`` offsets of its values in them."""
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slabs(batch: pa.RecordBatch, column: str = "text", size: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``size`` bytes of text each."""
    _, offsets = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="left"))
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last
