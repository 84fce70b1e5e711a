"""Shuffle, worker and replica partitions, chunks and batches as columns.

Every assignment is arithmetic on ``pos`` (the shuffled position) and the row
count ``n``; only the position itself needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.functions.columns import int_div
from samplewright.functions.fixed import DEFAULT_CHUNK, DEFAULT_SEED
from samplewright.operators.rank import hashed_position, ordered_position

TOTAL = "n_total"


def _count(n: int | str | Column) -> Column:
    if isinstance(n, int):
        return F.lit(n).cast("bigint")
    return F.col(n) if isinstance(n, str) else n


def shuffle(df: DataFrame, key: str | Sequence[str], seed: int = DEFAULT_SEED, enabled: bool = True,
            bucket_hex: int | None = None, partitions: int | None = None, align: int = 1,
            keep_part: bool = False, part_bytes: int | None = None) -> DataFrame:
    """Add ``pos`` (a seeded permutation of 0..N-1) and ``n_total``.

    ``enabled=False`` keeps the natural order of ``key`` instead. The other options
    are those of ``rank.hashed_position``.
    """
    if enabled:
        return hashed_position(df, key, seed, total=TOTAL, bucket_hex=bucket_hex, partitions=partitions,
                               align=align, keep_part=keep_part, part_bytes=part_bytes)
    keys = [key] if isinstance(key, str) else list(key)
    placed = ordered_position(df.select(*keys), keys, total=TOTAL)
    joined = df.join(placed, keys) if len(df.columns) > len(keys) else placed
    return joined.select(*df.columns, "pos", TOTAL)


def next_seed(previous: int, seed: int | None = None) -> int:
    """Seed of the next epoch: the given one, else the previous plus one."""
    return previous + 1 if seed is None else seed


def shuffle_epochs(df: DataFrame, key: str | Sequence[str], seeds: Sequence[int],
                   bucket_hex: int | None = None) -> DataFrame:
    """One permutation per epoch; adds ``epoch``, ``pos`` and ``n_total``."""
    epochs = F.array(*[F.struct(F.lit(e).alias("epoch"), F.lit(s).alias("seed")) for e, s in enumerate(seeds)])
    spread = df.withColumn("_epoch", F.explode(epochs))
    spread = spread.withColumns({"epoch": F.col("_epoch.epoch"), "_seed": F.col("_epoch.seed")}).drop("_epoch")
    placed = hashed_position(spread, key, F.col("_seed"), total=TOTAL, by=["epoch"],
                             bucket_hex=bucket_hex, by_values=len(seeds))
    return placed.drop("_seed")


def worker_of(pos: Column, n: Column, n_workers: int) -> Column:
    """Contiguous slices of ``n div W``; the last worker takes the remainder."""
    size = int_div(n, n_workers)
    return (
        F.when(size == 0, F.lit(n_workers - 1))
        .otherwise(F.least(int_div(pos, size), F.lit(n_workers - 1).cast("bigint")))
        .cast("int")
    )


def assign_workers(df: DataFrame, n_workers: int, n: int | str | Column = TOTAL, mode: str = "contiguous",
                   out: str = "worker_id") -> DataFrame:
    """Add the worker of each position: ``contiguous`` slices or ``strided`` (``pos mod W``)."""
    if n_workers <= 0:
        raise ValueError("n_workers must be > 0")
    if mode == "contiguous":
        return df.withColumn(out, worker_of(F.col("pos"), _count(n), n_workers))
    if mode == "strided":
        return df.withColumn(out, (F.col("pos") % n_workers).cast("int"))
    raise ValueError(f"unknown mode {mode!r}")


def assign_chunks(df: DataFrame, size: int = DEFAULT_CHUNK, n: int | str | Column = TOTAL,
                  n_workers: int | None = None, out: str = "chunk_id") -> DataFrame:
    """Add fixed-size chunk ids, over all positions or inside each worker's slice."""
    if size <= 0:
        raise ValueError("chunk size must be > 0")
    pos = F.col("pos")
    if n_workers is not None:
        total = _count(n)
        pos = pos - worker_of(pos, total, n_workers) * int_div(total, n_workers)
    return df.withColumn(out, int_div(pos, size))


def interleaved(pos: Column, n: Column, n_workers: int, chunk: int) -> Column:
    """Place of a sample when the workers' chunks arrive in turn, one chunk each."""
    size = int_div(n, n_workers)
    last = n - size * (n_workers - 1)
    worker = worker_of(pos, n, n_workers).cast("bigint")
    inside = pos - worker * size
    turn = int_div(inside, chunk)
    done = turn * chunk
    earlier_turns = F.least(done, size) * (n_workers - 1) + F.least(done, last)
    same_turn = worker * F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(chunk).cast("bigint"), size - done))
    return earlier_turns + same_turn + inside % chunk


def assign_batches(df: DataFrame, batch_size: int, n: int | str | Column = TOTAL, drop_last: bool = True,
                   order: str = "global", n_workers: int = 1, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Add ``batch_id`` and ``slot``; ``drop_last`` leaves out the incomplete final batch.

    ``order='interleaved'`` batches the round-robin arrival of the workers' chunks.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    total = _count(n)
    if order == "global":
        arrival = F.col("pos")
    elif order == "interleaved":
        arrival = interleaved(F.col("pos"), total, n_workers, chunk)
    else:
        raise ValueError(f"unknown order {order!r}")
    out = df.withColumn("_arrival", arrival)
    out = out.withColumn("batch_id", int_div("_arrival", batch_size)).withColumn("slot", (F.col("_arrival") % batch_size).cast("int"))
    if drop_last:
        out = out.where(F.col("batch_id") < int_div(total, batch_size))
    return out.drop("_arrival")


def replica_shards(df: DataFrame, key: str | Sequence[str], replicas: int, seed: int = 0, epoch: int = 0,
                   shuffled: bool = True, bucket_hex: int | None = None) -> DataFrame:
    """Equal shares for ``replicas`` readers: adds ``rank`` and ``local_idx``.

    The order is padded from its head to a multiple of ``replicas`` (so some rows
    appear more than once) and dealt out in turn. Padding repeats a row in place;
    nothing is joined.
    """
    if replicas <= 0:
        raise ValueError("replicas must be > 0")
    placed = shuffle(df, key, seed + epoch, enabled=shuffled, bucket_hex=bucket_hex)
    n = F.col(TOTAL)
    padded = int_div(n + (replicas - 1), replicas) * replicas
    slots = placed.withColumn("_slot", F.explode(F.sequence(F.col("pos"), padded - 1, n)))
    return (
        slots.withColumn("rank", (F.col("_slot") % replicas).cast("int"))
        .withColumn("local_idx", int_div("_slot", replicas))
        .drop("_slot")
    )
