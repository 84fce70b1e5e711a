"""Run files: timing summaries (CSV) and the delay configuration (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions.columns import parse_run_name
from samplewright.operators.metrics import delay_config_long

BATCH_TIMES = (
    "model string, batch_size int, optimizer string, gpu string, gpu_mem_gb double, "
    "batch_index int, time_s double, time_ms double"
)
RUN_SUMMARY = (
    "model string, batch_size int, optimizer string, gpu string, gpu_mem_gb double, num_batches_completed int, "
    "mean_ms double, std_ms double, median_ms double, min_ms double, max_ms double, throughput_img_s double"
)
CALIBRATION_SUMMARY = (
    "model string, batch_size int, optimizer string, gpu string, gpu_mem_gb double, num_batches int, "
    "mean_ms double, std_ms double, coeff_var_pct double, median_ms double, min_ms double, max_ms double, "
    "throughput_img_s double, anomaly_count int, anomaly_pct double, anomaly_threshold string"
)
DELAY_CONFIG = (
    "map<string, struct<models: map<string, struct<mean_ms: double, std_ms: double>>, default_mean_ms: double, "
    "default_std_ms: double, num_models_benchmarked: int>>"
)


def read_run_files(spark: SparkSession, root: str, glob: str = "summary_*.csv",
                   schema: str = RUN_SUMMARY) -> DataFrame:
    """CSV rows with the file name and, for malformed lines, the text in ``corrupt``."""
    rows = (
        spark.read.schema(f"{schema}, corrupt string").option("header", True).option("pathGlobFilter", glob)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").csv(root)
    )
    named = rows.select("*", F.col("_metadata.file_name").alias("file_name"))
    # Needs every column, so that none is pruned from the scan: a value that is not
    # parsed is not found malformed either.
    return named.where(F.length(F.concat_ws("", *[F.col(c).cast("string") for c in rows.columns])) >= 0)


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-formed rows and rejected lines."""
    return rows.where("corrupt is null").drop("corrupt"), rows.where("corrupt is not null").select("file_name", "corrupt")


def read_run_summaries(spark: SparkSession, root: str, where: str | Column | None = None) -> DataFrame:
    """Well-formed summary rows, filtered."""
    good, _ = split_corrupt(read_run_files(spark, root))
    return good if where is None else good.where(where)


def with_run_name(df: DataFrame, column: str = "file_name") -> DataFrame:
    """Add the fields a summary file name holds as ``name_*`` columns."""
    return df.withColumns({
        f"name_{field}": parse_run_name(column, field) for field in ("model", "batch_size", "optimizer", "gpu", "ts")
    })


def read_delay_config(spark: SparkSession, path: str) -> DataFrame:
    """The nested device configuration as a long table."""
    text = spark.read.text(path, wholetext=True)
    devices = text.select(F.explode(F.from_json("value", DELAY_CONFIG)).alias("gpu", "_c"))
    return delay_config_long(devices.select("gpu", "_c.*"))
