"""Session settings, checkpoint folder and size checks shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A dimension table is broadcast only up to this many rows and bytes; past them the
# join is left to Spark (sort-merge, with AQE splitting skewed partitions).
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def build_session(app: str = "samplewright", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Summaries kept in the checkpoint folder go with the DataFrames that hold them.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Python tasks receive blobs: bound an Arrow batch by bytes, not only by rows.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Only a local master without the setting gets a folder of its own; a cluster
    must name one that every executor can reach.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="samplewright-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and host: a plain one belongs to the default file system of the cluster.

    Tasks write below it on their own machines, so on a cluster a plain path that means the local disk raises, unless it
    lies in the shared checkpoint folder. A path with ``file:`` is taken at its word, as a mount that all machines have.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    local = full.startswith("file:") and not path.startswith("file:")
    if local and not spark.sparkContext.master.startswith("local") and not path.startswith(checkpoint_dir(spark)):
        raise ValueError(f"{path} is on each machine's own disk; name a folder all executors share")
    return full


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/samplewright/{uuid.uuid4().hex}/{name}"


# Bytes that a value of a type takes, for estimates.
_WIDTHS = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, estimated from its type and its length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.ArrayType):
        inner = _WIDTHS.get(type(kind.elementType), 8)
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            size = F.aggregate(value, F.lit(0).cast("bigint"), lambda total, x: total + value_bytes(x, kind.elementType))
        else:
            size = F.size(value) * inner
    elif isinstance(kind, T.MapType):
        size = value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((value_bytes(value[field.name], field.dataType) for field in kind), F.lit(0))
    else:
        size = F.lit(_WIDTHS.get(type(kind), 8))
    return F.coalesce(size, F.lit(0)).cast("bigint")


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row, estimated from the types and lengths of its values."""
    return sum((value_bytes(F.col(f"`{field.name}`"), field.dataType) for field in df.schema), F.lit(0).cast("bigint"))


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a count that stops past ``max_rows`` proves the table small, in rows and in bytes."""
    first = df.select(row_bytes(df).alias("bytes")).limit(max_rows + 1)
    rows, size = first.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a table proved small; leave any other to Spark."""
    return F.broadcast(dim) if is_small(dim, max_rows) else dim


def settled(summary: DataFrame) -> DataFrame:
    """Compute a summary of a large table once and keep the result in the checkpoint folder.

    For summaries that are looked at twice (their size, then their rows), so that
    the large table is not scanned again for the second look.
    """
    checkpoint_dir(summary.sparkSession)
    return summary.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """Rows written once to the checkpoint folder as Parquet and read back; columns stay prunable."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]):
    """Null-safe equality on ``keys``, so that rows with NULL keys are kept."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition
