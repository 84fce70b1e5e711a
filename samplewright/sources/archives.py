"""Zip and tar archives as tables of members.

A table function lists the members of an archive by reading only its directory
(zip) or its headers (tar); payloads are then byte ranges, read in parallel even
when one archive holds everything.
"""

from __future__ import annotations

import struct
import tarfile
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions.columns import file_name, has_extension, label_from_path
from samplewright.functions.fixed import IMAGE_EXTENSIONS
from samplewright.session import broadcast_if_small, kept
from samplewright.sources.ranges import READ_BYTES, open_input, read_ranges

# Bytes of a tar archive that one task lists.
RANGE_BYTES = 256 << 20
_MEMBER = "member string, start bigint, length bigint, method int, crc bigint"


class ZipMembers:
    """Files of a zip archive with the byte range of their data."""

    def eval(self, path: str):
        with open_input(path) as raw, zipfile.ZipFile(raw) as archive:
            for info in archive.infolist():
                if info.is_dir():
                    continue
                # The data follows the local header, whose two variable fields
                # may differ from those in the directory.
                raw.seek(info.header_offset + 26)
                name, extra = struct.unpack("<HH", raw.read(4))
                if info.flag_bits & 1:
                    raise ValueError(f"{path}: member {info.filename} is encrypted")
                yield info.filename, info.header_offset + 30 + name + extra, info.compress_size, info.compress_type, info.CRC


class TarMembers:
    """Regular files of an uncompressed tar archive with the byte range of their data."""

    def eval(self, path: str):
        with open_input(path) as raw, tarfile.open(fileobj=raw, mode="r:") as archive:
            for info in archive:
                if info.isfile():
                    yield info.name, info.offset_data, info.size, 0, None


class TarRange:
    """Members of a tar archive whose headers begin in a byte range, and last a row without a name: where the next one does.

    ``known`` says that a header begins at ``start``; otherwise the first block that is one is looked for. ``first`` is the
    header that the walk began at.
    """

    def eval(self, path: str, start: int, stop: int, length: int, known: bool):
        with open_input(path) as raw:
            first = start if known else _first_header(raw, start, min(stop, length))
            if first is None:
                return
            raw.seek(first)
            after = length
            with tarfile.open(fileobj=raw, mode="r:") as archive:
                for info in archive:
                    if info.offset >= stop:
                        after = info.offset
                        break
                    if info.isfile():
                        yield info.name, info.offset_data, info.size, first
            yield None, after, 0, first


def _first_header(raw, start: int, stop: int) -> int | None:
    """The first block from ``start`` on that has the mark and the checksum of a tar header."""
    start = -(-start // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
    for at in range(start, stop, READ_BYTES):
        raw.seek(at)
        data = raw.read(min(READ_BYTES, stop - at))
        blocks = np.frombuffer(data[:len(data) // 512 * 512], dtype=np.uint8).reshape(-1, 512)
        for i in np.flatnonzero((blocks[:, 257:262] == np.frombuffer(b"ustar", np.uint8)).all(axis=1)):
            header = blocks[i].tobytes()
            try:
                if tarfile.nti(header[148:156]) in tarfile.calc_chksums(header):
                    return at + int(i) * 512
            except tarfile.HeaderError:
                pass
    return None


_LISTERS = {"zip": ZipMembers, "tar": TarMembers}
_WALKED = "member string, start bigint, length bigint, first bigint"


def _long_tars(spark: SparkSession, archives: DataFrame, step: int) -> DataFrame:
    """``path, member, start, length, method, crc`` of the members of tar archives (``path, length``) by ranges of ``step`` bytes.

    All ranges are walked at once from what looks like a header. A member may hold such blocks itself, and a long name is
    two headers, so the walks are then chained: one counts only if it began where the one before it ended. Where the
    chain breaks, a walk from the right place is added. The driver holds two numbers for each range.
    """
    walk = F.udtf(TarRange, returnType=_WALKED)
    length = {r.path: r.length for r in archives.collect()}  # archives of more than a range each
    ranges = archives.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(step).cast("bigint"))))
    ranges = ranges.select("path", "at", (F.col("at") + step).alias("stop"), "length", (F.col("at") == 0).alias("known"))
    at = dict.fromkeys(length, 0)
    after: dict[tuple[str, int], int] = {}
    trusted: list[tuple[str, int]] = []
    walked = None
    while True:
        spread = ranges.withColumnRenamed("length", "total").repartition(max(1, ranges.count()))
        found = kept(spread.lateralJoin(walk(*[F.col(c).outer() for c in ("path", "at", "stop", "total", "known")])).select(
            "path", "member", "start", "length", "first"), "tar")
        after |= {(r.path, r.first): r.start for r in found.where("member is null").collect()}
        walked = found if walked is None else walked.union(found)
        missing = []
        for path, total in length.items():
            while at[path] < total and (path, at[path]) in after:
                trusted.append((path, at[path]))
                at[path] = after[path, at[path]]
            if at[path] < total:
                missing.append((path, at[path], (at[path] // step + 1) * step, total, True))
        if not missing:
            break
        ranges = spark.createDataFrame(missing, "path string, at bigint, stop bigint, length bigint, known boolean")
    counted = spark.createDataFrame(trusted, "path string, first bigint")
    return walked.where("member is not null").join(broadcast_if_small(counted), ["path", "first"], "left_semi").select(
        "path", "member", "start", "length", F.lit(0).alias("method"), F.lit(None).cast("bigint").alias("crc"))


def list_archives(spark: SparkSession, path_glob: str, kind: str = "zip",
                  exts: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """``path, member, label, filename, start, length, method, crc`` of the matching members."""
    members = F.udtf(_LISTERS[kind], returnType=_MEMBER)
    archives = spark.read.format("binaryFile").load(path_glob).select("path", F.col("length").alias("_bytes"))
    # a zip archive has a directory; a long tar archive is listed by many tasks
    whole = archives.where(F.col("_bytes") <= RANGE_BYTES) if kind == "tar" else archives
    listed = whole.lateralJoin(members(F.col("path").outer())).drop("_bytes")
    if kind == "tar":
        long = archives.where(F.col("_bytes") > RANGE_BYTES).withColumnRenamed("_bytes", "length")
        if not long.isEmpty():
            listed = listed.unionByName(_long_tars(spark, long, RANGE_BYTES))
    return listed.where(has_extension("member", exts)).select(
        "path", "member", label_from_path("member", "first").alias("label"), file_name("member").alias("filename"),
        "start", "length", "method", "crc",
    )


def read_archive(spark: SparkSession, path_glob: str, kind: str = "zip",
                 exts: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """``path, member, label, filename, image``; order by ``member`` for the listing order."""
    # Sized by the archives themselves, so that their members are listed once.
    total = spark.read.format("binaryFile").load(path_glob).agg(F.sum("length")).first()[0] or 0
    members = list_archives(spark, path_glob, kind, exts)
    return read_ranges(members, method="method", crc="crc", out="image", total_bytes=total).select(
        "path", "member", "label", "filename", "image"
    )
