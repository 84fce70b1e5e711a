"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_image_table(df: DataFrame, path: str, rows_per_file: int = 100_000,
                      row_group_bytes: int = 64 << 20, mode: str = "error") -> None:
    """``image, label, filename`` as Parquet with bounded files and row groups."""
    (
        df.select("image", "label", "filename").write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file).option("parquet.block.size", row_group_bytes)
        .parquet(path)
    )


def write_batches(df: DataFrame, path: str, partitions: int | None = None, mode: str = "error") -> None:
    """Rows in ``batch_id, slot`` order across the written files.

    Leave ``partitions`` unset for rows a shuffle with ``partitions`` laid out:
    they are in order already. Otherwise they are range-partitioned first.
    """
    order = [c for c in ("batch_id", "slot") if c in df.columns]
    laid_out = df if partitions is None else df.repartitionByRange(partitions, *order)
    laid_out.sortWithinPartitions(*order).write.mode(mode).parquet(path)


def keyed_records(df: DataFrame, idx: str = "sample_idx", payload: str = "image", label: str = "label") -> DataFrame:
    """``key, image, label`` with the index as text key."""
    return df.select(F.col(idx).cast("string").alias("key"), F.col(payload).alias("image"), F.col(label).alias("label"))


def write_keyed(df: DataFrame, table: str, buckets: int = 64, mode: str = "error") -> None:
    """Keyed records as a table bucketed and sorted by key; a key lookup reads one bucket."""
    df.write.mode(mode).format("parquet").bucketBy(buckets, "key").sortBy("key").saveAsTable(table)


def bucket_count(spark: SparkSession, table: str) -> int:
    """Buckets of a keyed table."""
    described = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    if described is None:
        raise ValueError(f"{table} has no buckets")
    return int(described.data_type)


def read_keyed(spark: SparkSession, table: str, keys: Sequence[str] | DataFrame) -> DataFrame:
    """Records of a keyed table by key; keys it does not have give no row.

    A list of keys opens only the buckets they belong to. A table with a column ``key`` is dealt like the buckets, so the
    records are not shuffled; each of its rows gets its record, repeated keys too.
    """
    store = spark.table(table)
    if isinstance(keys, DataFrame):
        asked = keys.repartition(bucket_count(spark, table), "key")
        # sorted buckets meet sorted keys
        return asked.join(store.hint("merge"), "key")
    return store.where(F.col("key").isin(list(keys)))


def write_run_summary(df: DataFrame, path: str, mode: str = "error") -> None:
    """Nested summaries as JSON, one directory per run configuration."""
    df.write.mode(mode).partitionBy("num_workers", "batch_size", "chunk_size").json(path)


# Digits after the point of the timing columns.
CSV_DIGITS = {
    "gpu_mem_gb": 1, "time_s": 6, "time_ms": 2, "mean_ms": 2, "std_ms": 2, "median_ms": 2, "min_ms": 2,
    "max_ms": 2, "coeff_var_pct": 2, "throughput_img_s": 1, "anomaly_pct": 1,
}


def csv_text(df: DataFrame, digits: dict[str, int] = CSV_DIGITS) -> DataFrame:
    """Timing columns as text with a fixed number of digits."""
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits[c]}f", F.bround(F.col(c).cast("double"), digits[c])))
        for c in df.columns if c in digits
    })


def write_timings_csv(df: DataFrame, path: str, digits: dict[str, int] = CSV_DIGITS, mode: str = "error") -> None:
    """Per-batch or summary timings as CSV with a header."""
    csv_text(df, digits).write.mode(mode).option("header", True).csv(path)


def write_delay_config(config: DataFrame, path: str, gpu: str = "gpu", mode: str = "error") -> None:
    """The device configuration as one JSON document (one entry per device)."""
    entry = F.struct(gpu, F.struct(*[c for c in config.columns if c != gpu]))
    document = config.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    document.coalesce(1).write.mode(mode).text(path)


def storage_overhead(containers: DataFrame, raw: DataFrame, key: str = "container", length: str = "length") -> DataFrame:
    """``container_mb, raw_mb, overhead_pct`` per container kind; inputs are file listings.

    A kind that only one listing has keeps its row, with nulls for the other side.
    """
    mb = 1024.0 * 1024.0
    packed = containers.groupBy(key).agg(F.sum(length).alias("_packed"))
    plain = raw.groupBy(key).agg(F.sum(length).alias("_raw"))
    return packed.join(plain, key, "full").select(
        key, (F.col("_packed") / mb).alias("container_mb"), (F.col("_raw") / mb).alias("raw_mb"),
        ((F.try_divide("_packed", "_raw") - 1) * 100).alias("overhead_pct"),
    )
