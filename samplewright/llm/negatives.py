"""Hard negatives by slot-decomposed selection.

An anchor's positives ask for the best negatives in one score window each, and the windows overlap. Their upper limits, from
the highest down, cut the scores into disjoint slots. Tasks keep the ``k`` best negatives of each slot and these are
combined once; the best below a limit are those of its slot, then those of the slots below it, cut at ``k``. One sweep from
the lowest slot up so answers all windows, and the lower limits cut the ends off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplewright.llm.common import written
from samplewright.llm.strips import EXACT, Best, Strip, leading, strips, usable
from samplewright.session import scratch_path

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def same_label(strip: Strip, batches: Iterator[pa.RecordBatch], k: int) -> Best:
    """The ``k`` best rows of a task that have an anchor's label, for each anchor."""
    best = Best(len(strip), k)
    for rows, ids, anchors, (score,), bound in strip.tiles(batches):
        score = np.where(rows.column("label").to_numpy()[:, None] == strip.columns["label"][anchors], score, -bound - 1)
        row, column = leading(score, k, np.maximum(best.least[anchors], -bound))
        best.add(column + anchors.start, score[row, column], ids[row])
    return best


def by_slot(strip: Strip, batches: Iterator[pa.RecordBatch], upper: np.ndarray, lower: np.ndarray, k: int) -> Best:
    """The ``k`` best rows of a task with another label, for each anchor and slot (list ``anchor * slots + slot``).

    ``upper`` has an anchor's limits in descending order; slot ``i`` holds the scores up to limit ``i`` and above limit
    ``i + 1``. Scores below ``lower``, an anchor's smallest lower limit, are in no window.
    """
    slots = upper.shape[1]
    best = Best(len(strip) * slots, k)
    for rows, ids, anchors, (score,), bound in strip.tiles(batches):
        score = np.where(rows.column("label").to_numpy()[:, None] != strip.columns["label"][anchors], score, -bound - 1)
        for slot in range(slots):
            owner = np.arange(anchors.start, anchors.stop) * slots + slot
            least = np.maximum(np.maximum(best.least[owner], lower[anchors]), -bound)
            if slot + 1 < slots:
                least = np.maximum(least, upper[anchors, slot + 1] + 1)
            row, column = leading(np.where(score <= upper[anchors, slot], score, -bound - 1), k, least)
            best.add(owner[column], score[row, column], ids[row])
    return best


def limits(positives: pa.Table, anchors: int, most: int, window: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Upper limits in descending order and the smallest lower limit of each anchor, as whole numbers.

    Missing positives repeat the lowest limit, whose slots stay empty; an anchor without any has a limit below all scores.
    """
    query, place, score = (positives[name].to_numpy().astype(np.int64) for name in ("query", "place", "positive_score"))
    upper = np.full((anchors, most), -EXACT, dtype=np.int64)
    upper[query, place] = window[1] * score // 100
    for slot in range(1, most):
        missing = upper[:, slot] == -EXACT
        upper[missing, slot] = upper[missing, slot - 1]
    lower = np.full(anchors, EXACT, dtype=np.int64)
    np.minimum.at(lower, query, -(-window[0] * score // 100))
    return upper, lower


def mine(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", k: int = 10, positives: int = 5,
         window: tuple[int, int] = (30, 90), scale: float = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of anchors and positives.

    Scores are integer inner products of ``floor(scale * x)``, higher ones first, ties by the smaller id. An anchor's
    positives are the first ``positives`` other rows of its label; each gets the first ``k`` rows of other labels whose
    score is from ``window[0]`` to ``window[1]`` per cent of its own (none if that is negative), fewer if there are not
    more. Rows without an id, label or vector, or with null or non-finite components, take no part; a shorter vector
    counts as if zeros followed. A row with an anchor's id is neither its positive nor its negative; rows that repeat
    another id count each; a repeated anchor is asked once, anchors with one id and different vectors or labels each.
    Components too large for exact scores raise. Extra columns do not matter; without anchors there are no rows.
    """
    spark = vectors.sparkSession
    label = (F.col(label) if isinstance(label, str) else label).cast("long")
    rows = usable(vectors, {"label": label}).where("label is not null")
    anchors = usable(vectors.where(is_anchor), {"label": label}).where("label is not null").dropDuplicates(["vec_id", "embedding", "label"])
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/strip=-1")
    for number, strip, shared in strips(anchors, scale):

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = same_label(shared.value, batches, positives)
            yield pa.RecordBatch.from_arrays([pa.array(best.owner.astype(np.int32)), pa.array(best.id), pa.array(best.score)],
                                             names=["query", "positive_id", "positive_score"])

        first = Window.partitionBy("query").orderBy(F.desc("positive_score"), "positive_id")
        known = written(rows.mapInArrow(near, "query int, positive_id long, positive_score long").withColumn(
            "place", F.row_number().over(first) - 1).where(F.col("place") < positives), f"positives-{number}")
        # at most ``positives`` rows an anchor of the strip
        cuts = spark.sparkContext.broadcast(limits(known.toArrow(), len(strip), positives, window))

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = by_slot(shared.value, batches, *cuts.value, k)
            yield pa.RecordBatch.from_arrays([pa.array((best.owner // positives).astype(np.int32)), pa.array((best.owner % positives).astype(np.int32)),
                                              pa.array(best.id), pa.array(best.score)], names=["query", "slot", "negative_id", "negative_score"])

        of_slot = Window.partitionBy("query", "slot").orderBy(F.desc("negative_score"), "negative_id")
        kept = rows.mapInArrow(combine, "query int, slot int, negative_id long, negative_score long").withColumn(
            "place", F.row_number().over(of_slot)).where(F.col("place") <= k)
        ids = spark.createDataFrame(pa.table({"query": np.arange(len(strip), dtype=np.int32), "anchor_id": strip.ids}))
        answers = _windows(known, kept, k, positives, window).join(ids, "query")
        answers.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.parquet(f"{path}/strip={number}")
        cuts.destroy()
    return spark.read.schema(SCHEMA).parquet(path).drop("strip")


def _windows(known: DataFrame, kept: DataFrame, k: int, positives: int, window: tuple[int, int]) -> DataFrame:
    """Suffix merges: the ``k`` best negatives of each slot and the slots below, cut at each positive's lower limit.

    An anchor has at most ``positives * k`` kept rows.
    """
    negative = F.struct(F.col("negative_score"), F.col("negative_id"))
    held = kept.groupBy("query").agg(F.collect_list(F.struct("slot", (-F.col("negative_score")).alias("down"), "negative_id", negative.alias("negative"))).alias("held"))
    slots = F.transform(F.sequence(F.lit(positives - 1), F.lit(0), F.lit(-1)), lambda slot: F.transform(
        F.filter("ordered", lambda e: e["slot"] == slot), lambda e: e["negative"]))
    none = F.filter(F.transform("ordered", lambda e: e["negative"]), lambda e: F.lit(False))
    # scores of a slot are above those of the slots below it, so a merge is a list after the other
    merged = F.aggregate(slots, F.array(none), lambda done, slot: F.concat(F.array(F.slice(F.concat(slot, done[0]), 1, k)), done))
    suffixes = held.withColumn("ordered", F.array_sort("held")).select("query", merged.alias("suffixes"))
    each = known.join(suffixes, "query").select("query", "positive_id", "positive_score", F.posexplode(F.col("suffixes")[F.col("place")]).alias("place", "negative"))
    inside = F.lit(window[0]) * F.col("positive_score") <= 100 * F.col("negative.negative_score")
    return each.where(inside).select("query", "positive_id", (F.col("place") + 1).alias("rank"), F.col("negative.negative_id").alias("negative_id"),
                                     "positive_score", F.col("negative.negative_score").alias("negative_score"))
