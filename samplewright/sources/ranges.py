"""Byte-range reads on executors, through any file system pyarrow knows."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator
from math import ceil
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplewright.functions.columns import int_div

TASK_BYTES = 128 << 20
READ_BYTES = 16 << 20
GAP_BYTES = 64 << 10


def known_scheme(path: str) -> str:
    """The URI with the scheme pyarrow has for it: Hadoop's names of the object store are one store."""
    scheme, mark, rest = path.partition("://")
    return f"s3://{quote(rest, safe='/=+-._~%')}" if mark and scheme in ("s3a", "s3n") else path


def open_input(path: str):
    """A seekable file for a plain path or a URI."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, name = fs.FileSystem.from_uri(known_scheme(path))
    return system.open_input_file(name)


def _runs(paths: pd.Series, offsets: pd.Series, lengths: pd.Series) -> Iterator[tuple[str, int, int, int, int]]:
    """``path, first row, last row + 1, start, end`` of the reads that fetch sorted ranges.

    Neighbouring ranges share one read of up to ``READ_BYTES``; gaps of ``GAP_BYTES`` are read over.
    """
    first, path, start, end = 0, None, 0, 0
    for i, (name, offset, length) in enumerate(zip(paths, offsets, lengths)):
        close = name == path and 0 <= offset - end <= GAP_BYTES and offset + length - start <= READ_BYTES
        if not close:
            if i > first:
                yield path, first, i, start, end
            first, path, start, end = i, name, int(offset), int(offset)
        end = int(offset + length)
    if len(paths) > first:
        yield path, first, len(paths), start, end


def _unpacked(data: bytes, method: int, name: str) -> bytes:
    """Content of a zip member from its stored bytes."""
    if method == 0:
        return data
    if method == 8:
        return zlib.decompress(data, -15)
    if method == 12:
        return bz2.decompress(data)
    if method == 14:
        # a version, the size of the filter properties and these come before the raw stream
        size = int.from_bytes(data[2:4], "little")
        properties, body = data[4:4 + size], data[4 + size:]
        rest, place = divmod(properties[0], 9)
        chain = [{"id": lzma.FILTER_LZMA1, "lc": place, "lp": rest % 5, "pb": rest // 5, "dict_size": int.from_bytes(properties[1:5], "little")}]
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=chain).decompress(body)
    raise ValueError(f"{name}: compression method {method} is not supported")


def read_ranges(manifest: DataFrame, path: str = "path", offset: str = "start", length: str = "length",
                method: str | None = None, out: str = "payload", total_bytes: int | None = None,
                crc: str | None = None) -> DataFrame:
    """Add the bytes ``[offset, offset+length)`` of each row's file.

    Rows are spread by file and 128 MB block, so one large file is read by many
    tasks; a task reads its ranges in file order through one open handle.
    ``method`` names a column with the zip compression method (0 stored, 8 deflate,
    12 bzip2, 14 LZMA; any other raises), ``crc`` one with the checksum that the
    content must have where it is not null. Without
    ``total_bytes`` (about what will be read) the manifest is summed first.
    """
    total = (manifest.agg(F.sum(length)).first()[0] or 0) if total_bytes is None else total_bytes
    tasks = max(1, ceil(total / TASK_BYTES), min(manifest.sparkSession.sparkContext.defaultParallelism, ceil(total / (1 << 20))))
    spread = (
        manifest.repartition(tasks, F.col(path), int_div(F.col(offset), max(1, min(TASK_BYTES, ceil(total / tasks)))))
        .sortWithinPartitions(path, offset)
    )
    schema = T.StructType([*manifest.schema.fields, T.StructField(out, T.BinaryType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, handle = None, None
        try:
            for frame in frames:
                methods = frame[method].to_numpy() if method else None
                sums = frame[crc].to_numpy() if crc else None
                for name, first, last, start, end in _runs(frame[path], frame[offset], frame[length]):
                    if name != opened:
                        if handle is not None:
                            handle.close()
                        opened, handle = name, open_input(name)
                    handle.seek(start)
                    data = handle.read(end - start)
                    if len(data) != end - start:
                        raise EOFError(f"{name}: range {start}+{end - start} ends early")
                    piece = frame.iloc[first:last]
                    blobs = [data[s - start:s - start + n] for s, n in zip(piece[offset], piece[length])]
                    if methods is not None:
                        blobs = [_unpacked(b, how, name) for b, how in zip(blobs, methods[first:last])]
                    if sums is not None:
                        for blob, wanted in zip(blobs, sums[first:last]):
                            if not pd.isna(wanted) and zlib.crc32(blob) != int(wanted):
                                raise ValueError(f"{name}: a member does not match its checksum")
                    yield piece.assign(**{out: blobs})
        finally:
            if handle is not None:
                handle.close()

    return spread.mapInPandas(run, schema)
