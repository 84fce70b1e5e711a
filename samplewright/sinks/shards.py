"""Sharded exports: blob shards with offset indexes, zip and tar archives.

Records of a shard stream through one task in index order; a task holds one
Arrow batch at a time, not the shard.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions.columns import int_div
from samplewright.operators.series import byte_offsets
from samplewright.session import qualified
from samplewright.sinks.files import replacing

_REPORT = "shard_id bigint, path string, records bigint, bytes bigint"


def shard_manifest(df: DataFrame, idx: str, payload: str, max_shard_size: int) -> DataFrame:
    """Add ``shard_id, local_idx, start, end``: shards of ``max_shard_size`` records in index order.

    ``idx`` is dense from 0. A shard without its payload is at most
    ``max_shard_size`` small rows, so only the lengths are shuffled.
    """
    if max_shard_size <= 0:
        raise ValueError("max_shard_size must be > 0")
    field = df.schema[payload].dataType.simpleString()
    if field not in ("binary", "string"):
        raise TypeError(f"payload must be bytes, not {field}")
    sized = df.select(
        idx, int_div(F.col(idx), max_shard_size).alias("shard_id"), (F.col(idx) % max_shard_size).alias("local_idx"),
        F.coalesce(F.octet_length(payload), F.lit(0)).cast("bigint").alias("length"),
    )
    return byte_offsets(sized, "shard_id", "local_idx", "length").select(
        idx, "shard_id", "local_idx", "start", "end"
    )


class _BlobShard:
    def __init__(self, root: str, shard: int, stack: ExitStack):
        self.path = f"{root}/{shard}"
        self.stream = stack.enter_context(replacing(f"{self.path}/data.bin"))
        self.ends: list[int] = []
        self.size = 0

    def add(self, row) -> None:
        if not isinstance(row.payload, (bytes, bytearray)):
            raise TypeError("payload must be bytes")
        self.stream.write(row.payload)
        self.size += len(row.payload)
        self.ends.append(self.size)

    def finish(self) -> None:
        ends = np.array(self.ends, dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        index = io.BytesIO()
        np.save(index, np.stack([starts, ends], axis=1))
        with replacing(f"{self.path}/offsets.npy") as out:
            out.write(index.getvalue())

    @property
    def count(self) -> int:
        return len(self.ends)


class _Archive:
    def __init__(self, root: str, shard: int, stack: ExitStack, kind: str):
        self.path = f"{root}/{shard}.{kind}"
        stream = stack.enter_context(replacing(self.path))
        if kind == "zip":
            self.archive = stack.enter_context(zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED))
        else:
            self.archive = stack.enter_context(tarfile.open(fileobj=stream, mode="w|"))
        self.kind, self.size, self.count = kind, 0, 0

    def add(self, row) -> None:
        name, data = f"{row.label}/{row.filename}", bytes(row.payload)
        if self.kind == "zip":
            self.archive.writestr(zipfile.ZipInfo(name), data)
        else:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            self.archive.addfile(info, io.BytesIO(data))
        self.size += len(data)
        self.count += 1

    def finish(self) -> None:
        pass


def _shard_tasks(rows: DataFrame) -> int:
    """A task for about every shard, as shards are what a task can write alone; one pass over the shard numbers."""
    return int(rows.agg(F.max("shard_id")).first()[0] or 0) + 1


def _write_grouped(rows: DataFrame, order: str, tasks: int, make: Callable) -> DataFrame:
    laid_out = rows.repartition(tasks, "shard_id").sortWithinPartitions("shard_id", order)

    def report(shard: int, writer) -> dict:
        return {"shard_id": shard, "path": writer.path, "records": writer.count, "bytes": writer.size}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, writer, done = None, None, []
        with ExitStack() as last:
            stack = last.enter_context(ExitStack())
            for frame in frames:
                for row in frame.itertuples(index=False):
                    if row.shard_id != current:
                        if writer is not None:
                            writer.finish()
                            stack.close()
                            done.append(report(current, writer))
                        current, writer = row.shard_id, make(row.shard_id, stack)
                    writer.add(row)
            if writer is not None:
                writer.finish()
                stack.close()
                done.append(report(current, writer))
        if done:
            yield pd.DataFrame(done)

    return laid_out.mapInPandas(run, _REPORT)


def write_shards(df: DataFrame, root: str, idx: str, payload: str, max_shard_size: int = 10_000,
                 tasks: int | None = None) -> DataFrame:
    """Write ``<root>/<shard>/data.bin`` and ``offsets.npy``; returns one report row per shard (lazy: run it)."""
    if df.schema[payload].dataType.simpleString() != "binary":
        raise TypeError("payload must be bytes")
    root = qualified(df.sparkSession, root)
    rows = df.select(
        int_div(F.col(idx), max_shard_size).alias("shard_id"), F.col(idx).alias("_order"), F.col(payload).alias("payload")
    )
    return _write_grouped(rows, "_order", tasks or _shard_tasks(rows), lambda shard, stack: _BlobShard(root, shard, stack))


def write_archives(df: DataFrame, root: str, kind: str, idx: str, payload: str = "image",
                   max_members: int = 10_000, tasks: int | None = None) -> DataFrame:
    """Write ``<root>/<shard>.zip`` (stored) or ``.tar`` with members ``label/filename``."""
    if kind not in ("zip", "tar"):
        raise ValueError(f"unknown archive kind {kind!r}")
    root = qualified(df.sparkSession, root)
    rows = df.select(
        int_div(F.col(idx), max_members).alias("shard_id"), F.col(idx).alias("_order"),
        "label", "filename", F.col(payload).alias("payload"),
    )
    return _write_grouped(rows, "_order", tasks or _shard_tasks(rows), lambda shard, stack: _Archive(root, shard, stack, kind))


def write_class_folder(df: DataFrame, root: str, payload: str = "image") -> DataFrame:
    """Write every row as ``<root>/<label>/<filename>``; returns the number of files per task (lazy: run it)."""
    root = qualified(df.sparkSession, root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        written = 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                with replacing(f"{root}/{row.label}/{row.filename}") as out:
                    out.write(row.payload)
                written += 1
        yield pd.DataFrame({"files": [written]})

    return df.select("label", "filename", F.col(payload).alias("payload")).mapInPandas(run, "files bigint")
