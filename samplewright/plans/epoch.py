"""One epoch of a data loader as a chain of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions.fixed import DEFAULT_CHUNK, DEFAULT_SEED
from samplewright.operators import collate as gather
from samplewright.operators import sampler
from samplewright.operators.images import batch_tensors
from samplewright.session import row_bytes
from samplewright.sinks.tables import write_batches

# Bytes of the samples of one partition, about.
PART_BYTES = 128 << 20


@dataclass(frozen=True)
class EpochPlan:
    """Settings of a loader; each method adds one step to the plan of ``samples``.

    Shuffled samples are laid out in partitions of about ``part_bytes`` of payload, at
    least one for each core, that hold whole batches; these are also the files of an
    epoch written in order. ``partitions`` sets their number instead.
    """

    key: str
    batch_size: int
    seed: int = DEFAULT_SEED
    shuffle: bool = True
    drop_last: bool = True
    n_workers: int = 1
    chunk: int = DEFAULT_CHUNK
    interleave: bool = False
    bucket_hex: int | None = None
    partitions: int | None = None
    part_bytes: int = PART_BYTES

    def __post_init__(self) -> None:
        for name in ("batch_size", "n_workers", "chunk", "part_bytes"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be > 0")

    def next_epoch(self, seed: int | None = None) -> EpochPlan:
        """The plan of the following epoch: the given seed, else this one plus 1."""
        return replace(self, seed=sampler.next_seed(self.seed, seed))

    def positions(self, samples: DataFrame) -> DataFrame:
        """``pos`` and ``n_total`` of every sample."""
        return sampler.shuffle(samples, self.key, self.seed, self.shuffle, self.bucket_hex, self.partitions, self.batch_size)

    def batches(self, samples: DataFrame) -> DataFrame:
        """One row per sample with ``pos, worker_id, batch_id, slot``."""
        return self._batched(self.positions(samples))

    def _batched(self, placed: DataFrame) -> DataFrame:
        placed = sampler.assign_workers(placed, self.n_workers)
        return sampler.assign_batches(
            placed, self.batch_size, drop_last=self.drop_last,
            order="interleaved" if self.interleave else "global",
            n_workers=self.n_workers, chunk=self.chunk,
        )

    def _laid_out(self, samples: DataFrame, keep_part: bool = False) -> DataFrame:
        return sampler.shuffle(samples, self.key, self.seed, True, self.bucket_hex, self.partitions, self.batch_size,
                               keep_part=keep_part, part_bytes=self.part_bytes)

    def _grouped(self, samples: DataFrame) -> tuple[DataFrame, list[str]]:
        """Batched samples and, where whole batches share a partition, its column."""
        if not self.shuffle or self.interleave:
            return self.batches(samples), []
        return self._batched(self._laid_out(samples, keep_part=True)), ["_part"]

    def collated(self, samples: DataFrame, tensor: str | None, label: str, scale: bool = True,
                 parse_labels: bool = True, dtype: str = "double") -> DataFrame:
        """One row per batch. The samples are shuffled once: the partitions of the
        shuffle begin and end at batch borders."""
        narrow = samples.select(*dict.fromkeys([self.key, *([tensor] if tensor else []), label]))
        placed, within = self._grouped(narrow)
        return gather.collate(placed, tensor, label, scale, within=within, parse_labels=parse_labels, dtype=dtype)

    def collated_images(self, samples: DataFrame, label: str = "label", decoder: Callable | None = None,
                        decoder_columns: Sequence[str] = ("image",), parse_labels: bool = True,
                        **options) -> DataFrame:
        """Decoded batches: ``batch_id, size, labels, images`` (an array of binary tensors).

        Encoded images are shuffled, once, and decoded batch by batch where they land.
        """
        fields = list(dict.fromkeys([*decoder_columns, label]))
        placed, within = self._grouped(samples.select(*dict.fromkeys([self.key, *fields])))
        if parse_labels:
            placed = gather.with_numeric_label(placed, label)
        batches = gather.gather(placed, fields, within=within).withColumnRenamed(label, "labels")
        return batch_tensors(batches, decoder=decoder, decoder_columns=decoder_columns, **options)

    def collated_with(self, samples: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """Batches made by a user function of their slot-ordered samples."""
        placed, within = self._grouped(samples)
        return gather.collate_with(placed, fn, schema, within=within)

    def write(self, samples: DataFrame, path: str, mode: str = "error") -> None:
        """The epoch as files to be read one after another, batch by batch."""
        if self.shuffle and not self.interleave:
            write_batches(self._batched(self._laid_out(samples)), path, mode=mode)
        else:
            size = samples.agg(F.coalesce(F.sum(row_bytes(samples)), F.lit(0))).first()[0]
            least = samples.sparkSession.sparkContext.defaultParallelism
            write_batches(self.batches(samples), path, self.partitions or max(least, -(-size // self.part_bytes)), mode)
