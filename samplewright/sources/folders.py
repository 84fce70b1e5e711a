"""Class folders: ``root/<class>/<file>``.

Spark's file sources hold every file's status on the driver. A folder in a file system that pyarrow knows is listed and
read by tasks instead; any other is left to Spark's source.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice
from math import ceil

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplewright.functions.columns import file_name, label_from_path
from samplewright.functions.fixed import IMAGE_EXTENSIONS
from samplewright.operators.images import spark_image_blobs
from samplewright.operators.rank import ordered_position
from samplewright.session import broadcast_if_small
from samplewright.sinks.files import output_system
from samplewright.sources.ranges import READ_BYTES, TASK_BYTES
from samplewright.sources.tables import take_prefix

# Tasks for each core that a folder of small files is read by.
TASKS_PER_CORE = 4
# Names of one batch that a listing task hands on.
LISTED_ROWS = 10_000


def _two_levels_below(root: str):
    """Condition: ``path`` is a file of a direct subdirectory of ``root``."""
    bare = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/")
    return F.regexp_replace("path", "^[a-z0-9]+:/*", "/").rlike(f"{re.escape(bare)}/[^/]+/[^/]+$")


def _in_few_tasks(files: DataFrame, total_bytes: int = 0) -> DataFrame:
    """Files in tasks by their bytes: Spark counts each as 4 MB, so that small ones would take a task for every 32."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(TASKS_PER_CORE * cores, ceil(total_bytes / TASK_BYTES)))


def _folder_bytes(spark: SparkSession, root: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def _task_root(spark: SparkSession, root: str) -> str | None:
    """The folder's full name, where pyarrow finds it too, so that tasks can list and read it themselves."""
    from pyarrow import fs

    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    try:
        full = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
        system, bare = output_system(full)
        return full.rstrip("/") if system.get_file_info(bare).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError, Py4JJavaError):
        return None


def _hidden(name: str, directory: bool) -> bool:
    """Names that Spark's sources pass over, those that are not UTF-8 among them."""
    if directory and name.startswith(("_metadata", "_common_metadata")):
        return False
    marked = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    return marked or name != name.encode("utf-8", "ignore").decode("utf-8")


def _entries(system, folder: str, directories: bool) -> Iterator[tuple[str, int | None]]:
    """Visible subdirectories or files of a folder, with sizes where the listing tells them; a local one is walked, not held."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                if (entry.is_dir() if directories else entry.is_file()) and not _hidden(entry.name, directories):
                    yield entry.name, None
        return
    kind = fs.FileType.Directory if directories else fs.FileType.File
    for info in system.get_file_info(fs.FileSelector(folder)):
        if info.type == kind and not _hidden(info.base_name, directories):
            yield info.base_name, info.size


def _listed_by_tasks(spark: SparkSession, root: str, exts: tuple[str, ...]) -> DataFrame:
    """``path, length`` of the files: one task names the classes, each class is walked by one task, sizes are asked for by all.

    Empty files are left out, as Spark's sources do.
    """
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    suffixes = tuple(f".{ext}" for ext in exts)

    def classes(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, bare = output_system(root)
        names = sorted(name for name, _ in _entries(system, bare, True))
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "part": pa.array([i % tasks for i in range(len(names))], pa.int32())})

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, bare = output_system(root)
        for batch in batches:
            for label in batch.column(0).to_pylist():
                found = ((f"{root}/{label}/{name}", size) for name, size in _entries(system, f"{bare.rstrip('/')}/{label}", False) if name.endswith(suffixes))
                while rows := list(islice(found, LISTED_ROWS)):
                    paths, sizes = zip(*rows)
                    yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "length": pa.array(sizes, pa.int64())})

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, bare = output_system(root)
        for batch in batches:
            paths, sizes = (column.to_pylist() for column in batch.columns)
            sizes = [os.stat(_bare_path(path, root, bare)).st_size if size is None else size for path, size in zip(paths, sizes)]
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "length": pa.array(sizes, pa.int64())})

    named = spark.range(1, numPartitions=1).mapInArrow(classes, "name string, part int").repartitionById(tasks, "part")
    found = named.mapInArrow(files, "path string, length bigint").repartition(tasks, "path")
    return found.mapInArrow(sized, "path string, length bigint").where("length > 0")


def _bare_path(path: str, root: str, bare: str) -> str:
    """A file's name in pyarrow's file system, where its root is ``bare``."""
    return bare.rstrip("/") + path[len(root):]


def _with_contents(listed: DataFrame, root: str) -> DataFrame:
    """Add ``image``: the files' bytes, read by tasks that are as many as the bytes ask for."""
    cores = listed.sparkSession.sparkContext.defaultParallelism
    total = listed.agg(F.sum("length")).first()[0] or 0
    spread = listed.repartition(max(TASKS_PER_CORE * cores, ceil(total / TASK_BYTES)), "path")
    names = [*listed.columns, "image"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, bare = output_system(root)
        for batch in batches:
            first, blobs, held = 0, [], 0
            paths = batch.column(names.index("path")).to_pylist()
            for i, path in enumerate(paths):
                with system.open_input_file(_bare_path(path, root, bare)) as file:
                    blobs.append(file.read())
                held += len(blobs[-1])
                if held >= READ_BYTES or i + 1 == len(paths):
                    piece = batch.slice(first, len(blobs))
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(blobs, pa.binary())], names)
                    first, blobs, held = i + 1, [], 0

    return spread.mapInArrow(run, T.StructType([*listed.schema.fields, T.StructField("image", T.BinaryType())]))


def list_class_folder(spark: SparkSession, root: str, exts: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """``path, label, filename, length`` of the files, contents unread."""
    own = _task_root(spark, root)
    if own is not None:
        files = _listed_by_tasks(spark, own, exts)
    else:
        files = _in_few_tasks(
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(exts) + "}")
            .load(root).select("path", "length").where(_two_levels_below(root))
        )
    return files.select("path", label_from_path("path").alias("label"), file_name("path").alias("filename"), "length")


def read_class_folder(spark: SparkSession, root: str, exts: tuple[str, ...] = IMAGE_EXTENSIONS,
                      with_content: bool = True, max_samples: int | None = None) -> DataFrame:
    """``sample_idx, path, label, filename, length[, image]``, numbered by class, then file name."""
    listed = ordered_position(list_class_folder(spark, root, exts), ["label", "filename"], "sample_idx")
    listed = take_prefix(listed, max_samples)
    if not with_content:
        return listed
    own = _task_root(spark, root)
    if own is not None:
        return _with_contents(listed, own)
    content = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(exts) + "}")
        .load(root).select("path", F.col("content").alias("image"))
    )
    content = _in_few_tasks(content, listed.agg(F.sum("length")).first()[0] or 0)
    # A listing small enough is sent to the contents, which then stay where they are read.
    return content.join(broadcast_if_small(listed), "path").select(*listed.columns, "image")


def file_sizes(spark: SparkSession, root: str, container: str, glob: str = "*") -> DataFrame:
    """``container, path, length`` of the files below ``root``, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return _in_few_tasks(files).select(F.lit(container).alias("container"), "path", "length")


def read_decoded_folder(spark: SparkSession, root: str, exts: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """Files decoded by Spark's image source: ``path, label, height, width, channels, image``.

    Undecodable files stay, with ``height = -1``.
    """
    decoded = (
        spark.read.format("image").option("dropInvalid", False)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(exts) + "}").load(root)
    )
    return spark_image_blobs(_in_few_tasks(decoded, _folder_bytes(spark, root))).where(_two_levels_below(root))
