"""Samples of a batch gathered into one row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from samplewright.functions.columns import parse_label, scale_255



def gather(df: DataFrame, fields: Sequence[str], batch: str = "batch_id", slot: str = "slot",
           within: Sequence[str] = ()) -> DataFrame:
    """One row per batch: ``batch_id, size`` and an array in slot order for each field.

    ``within`` names columns the rows are partitioned by such that no batch
    straddles two partitions; the batches are then gathered without a shuffle.
    """
    items = df.groupBy(*within, batch).agg(F.array_sort(F.collect_list(F.struct(slot, *fields))).alias("_items"))
    return items.select(
        batch, F.size("_items").alias("size"),
        *[F.col("_items").getField(f).alias(f) for f in fields],
    )


def with_numeric_label(df: DataFrame, label: str) -> DataFrame:
    """Class ids as numbers; a label column that is not text is left alone."""
    return df.withColumn(label, parse_label(label)) if isinstance(df.schema[label].dataType, StringType) else df


def collate(df: DataFrame, tensor: str | None, label: str, scale: bool = True, batch: str = "batch_id",
            slot: str = "slot", within: Sequence[str] = (), parse_labels: bool = True, dtype: str = "double") -> DataFrame:
    """One row per batch: ``batch_id, size, images, labels`` in slot order.

    Text labels are class ids and become numbers, unless ``parse_labels`` is off.
    ``scale`` turns 0..255 into 0..1 after the shuffle, once per batch, as numbers of
    ``dtype``: ``float`` takes half the bytes of ``double``. Tensors of unequal length raise. ``tensor=None`` gathers the labels alone.
    """
    if dtype not in ("float", "double"):
        raise ValueError(f"unknown dtype {dtype!r}")
    if parse_labels:
        df = with_numeric_label(df, label)
    labels = F.col(label).alias("labels")
    if tensor is None:
        return gather(df, [label], batch, slot, within).select(batch, "size", labels)
    packed = isinstance(df.schema[tensor].dataType, BinaryType)
    if packed and scale:
        raise TypeError("scale works on array tensors; decode with scale=True for binary ones")
    gathered = gather(df, [tensor, label], batch, slot, within)
    lengths = F.transform(tensor, F.octet_length if packed else F.size)
    uneven = F.array_max(lengths) != F.array_min(lengths)
    images = F.col(tensor)
    if scale:
        images = scale_255(images, depth=2).cast(f"array<array<{dtype}>>")
    element = f"array<array<{dtype}>>" if scale else gathered.schema[tensor].dataType.simpleString()
    problem = F.raise_error(F.concat(F.lit("tensors of unequal length in batch "), F.col(batch).cast("string")))
    return gathered.select(batch, "size", F.when(uneven, problem.cast(element)).otherwise(images).alias("images"), labels)


def collate_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                 batch: str = "batch_id", slot: str = "slot", within: Sequence[str] = ()) -> DataFrame:
    """Apply a user collate function to the slot-ordered samples of each batch."""

    def run(samples: pd.DataFrame) -> pd.DataFrame:
        return fn(samples.drop(columns=list(within)).sort_values(slot, ignore_index=True))

    return df.groupBy(*within, batch).applyInPandas(run, schema)
