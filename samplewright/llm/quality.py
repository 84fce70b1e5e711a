"""Quality classifier: gradient-boosted trees over statistics of a document's text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm import trees
from samplewright.llm.common import bounded_batches, slabs, text_of, utf8, written
from samplewright.llm.words import U, lowered, mix, word_bounds, word_hashes

# The model is fitted on at most this many labelled rows, those with the smallest hash of their id.
SAMPLE_ROWS = 40_000

_KINDS = 11


def _kind_table() -> np.ndarray:
    """Class of a byte: other, lower, upper, digit, space, line feed, end mark, other punctuation, symbol, bar, beyond ASCII."""
    kind = np.zeros(256, dtype=np.int64)
    for byte in range(256):
        letter = chr(byte)
        if byte >= 128:
            kind[byte] = 10
        elif letter.islower():
            kind[byte] = 1
        elif letter.isupper():
            kind[byte] = 2
        elif letter.isdigit():
            kind[byte] = 3
        elif letter in " \t":
            kind[byte] = 4
        elif letter == "\n":
            kind[byte] = 5
        elif letter in ".?":
            kind[byte] = 6
        elif letter in ",;:'\"()-!":
            kind[byte] = 7
        elif letter in "|<>{}[]":
            kind[byte] = 9
        elif 32 < byte < 127:
            kind[byte] = 8
    return kind


_KIND = _kind_table()


def _repeats(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values and of the most frequent value in each text (1 and 0 without values)."""
    distinct, top = np.ones(len(first) - 1), np.zeros(len(first) - 1)
    for i in range(len(first) - 1):
        n = first[i + 1] - first[i]
        if n > 0:
            part = np.sort(values[first[i]:first[i + 1]])
            runs = np.diff(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])))
            distinct[i], top[i] = len(runs) / n, runs.max() / n
    return distinct, top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text of a slab; a text without words has zero shares."""
    n, size = len(offsets) - 1, np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    share = kinds / np.maximum(size, 1)[:, None]
    low = lowered(data)
    starts, ends, first = word_bounds(low, offsets)
    words, length = word_hashes(low, starts, ends), ends - starts
    count = np.diff(first)
    many = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)

    def per_text(values):
        return np.bincount(owner, values, n) / many

    mean = per_text(length)
    spread = np.sqrt(np.maximum(per_text(length.astype(float) ** 2) - mean ** 2, 0))
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    distinct, top = _repeats(words, first)
    pairs = np.where(np.concatenate([owner[1:] == owner[:-1], [False]])[:len(words)], mix(words + np.roll(words, -1) * U(3), 7), words)
    pair_distinct, pair_top = _repeats(pairs, first)
    line_starts, line_ends, line_first = word_bounds(low, offsets, low != 10)
    lines = np.diff(line_first)
    line_distinct, line_top = _repeats(word_hashes(low, line_starts, line_ends), line_first)
    # letters in the last byte of a word tell decorated words (word!!, word***) from plain ones
    closing = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    return np.column_stack([
        np.log1p(size), share, np.log1p(count), mean, spread, per_text(length <= 3), per_text(length >= 12), per_text(again),
        per_text(closing == 7), per_text(closing == 8), per_text((closing == 1) | (closing == 10)), per_text(length == 1),
        distinct, distinct * np.sqrt(count), top, pair_distinct, pair_top, np.log1p(lines), line_distinct, line_top,
        count / np.maximum(lines, 1), kinds[:, 2] / np.maximum(kinds[:, 1] + kinds[:, 2], 1),
    ])


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of every row; a null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch):
                rows = statistics(*utf8(slab.column("text"))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([
                    slab.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel())),
                ], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(
        run, "doc_id long, stats array<float>")


def fold(column: str = "doc_id", folds: int = 3):
    """Remainder of the crc32 of an id as text (-1 for a null id)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(-1))


def labelled(labels: DataFrame, column: str, keep, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows ``doc_id, label`` that satisfy ``keep``: those with the smallest hash of the id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)


def fit(stats: DataFrame, labels: DataFrame, keep, sample_rows: int = SAMPLE_ROWS) -> trees.Trees:
    """Trees fitted on a bounded sample of the labelled rows that satisfy ``keep`` (a condition on ``doc_id``)."""
    chosen = labelled(labels, "quality", keep, sample_rows)
    # the sample's size is bounded by its limit, so it may be sent to all tasks
    sample = stats.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "stats").limit(sample_rows).toPandas()
    if sample.empty:
        return trees.fit(np.zeros((0, 1)), np.zeros(0))
    rows = np.array(sample["stats"].to_list(), dtype=np.float64)
    return trees.fit(rows, sample["label"].to_numpy(dtype=np.float64))


def scored(stats: DataFrame, model: trees.Trees) -> DataFrame:
    """``doc_id, score`` of every row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("stats").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(rows), type=pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Labels of the held-out fold (crc32 of the id as text, modulo ``folds``) are never learned from; the score depends on
    the text alone. Null and empty texts are scored by their (zero) statistics, a null id is never held out, repeated
    rows are scored each. Rows of ``labels`` with a null id or a label other than 0 and 1 are left out. Without usable
    labels, or with one class only, all scores are equal.
    """
    stats = written(features(docs), "stats")
    model = fit(stats, labels, fold(folds=folds) != held_out)
    return scored(stats, model).select(
        "doc_id", (fold(folds=folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
