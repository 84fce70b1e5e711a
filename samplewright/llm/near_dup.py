"""Near-duplicate detection with HyperMinHash sketches.

Every text's set of word shingles is hashed ``REPEATS`` times; each time the hash picks one of ``BUCKETS`` buckets and
a bucket keeps its smallest hash as a 16-bit register: the count of leading zeros and the next ten bits. Bands of
``BAND`` registers are the candidate keys, the corrected share of equal registers thins the pairs, and an exact
comparison of the full sets confirms each link.

No bucket is expanded into all its pairs. Members of a bucket are compared with its smallest and its largest document;
what is linked then counts as one component. Only in buckets that still hold several components the other members are
compared too: up to ``PAIRED`` of them by a join, more of them block by block inside tasks, which return links only. So a
large group of copies costs a few rows per document, and no link between different texts is given up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samplewright.llm.common import bounded_batches, discard, perhaps_among, release_memory, release_shuffles, slabs, text_of, utf8, written
from samplewright.llm.components import components
from samplewright.llm.words import distinct_sets, lowered, mix, shingle_hashes, word_bounds, word_hashes
from samplewright.session import broadcast_if_small, scratch_path

WIDTH = 5
PERCENT = 75
REPEATS = 35
BUCKETS = 8
BAND = 5
BANDS = REPEATS * BUCKETS // BAND
MANTISSA = 10
EMPTY = 0xFFFF
# Registers used for the estimate, and how many standard deviations below the threshold a pair is still verified.
ESTIMATE = 128
SLACK = 6.0
# Inner members of a bucket up to which its pairs are joined; beyond it, blocks of about BLOCK members are compared in tasks,
# STRIP rows at a time.
PAIRED = 24
BLOCK = 512
STRIP = 64
# Rows of one key that stay together in a join; a key with more is dealt to several tasks.
HOT = 256
# Shingles sketched in one step.
STEP = 1 << 17


def shingle_sets(batch: pa.RecordBatch, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a slab, and offsets."""
    data, offsets = utf8(batch.column("text"))
    data = lowered(data)
    starts, ends, first = word_bounds(data, offsets)
    return distinct_sets(*shingle_hashes(word_hashes(data, starts, ends), first, width))


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, one row a set: bucket after bucket, the repeats of a bucket side by side."""
    n = len(offsets) - 1
    out = np.empty((n, BUCKETS, REPEATS), dtype=np.uint16)
    most = np.iinfo(np.uint64).max
    first = 0
    while first < n:
        last = min(max(int(np.searchsorted(offsets, offsets[first] + STEP, side="left")), first + 1), n)
        part = hashes[offsets[first]:offsets[last]]
        row = np.repeat(np.arange(last - first) * BUCKETS, np.diff(offsets[first:last + 1]))
        for k in range(REPEATS):
            h = mix(part, 0x5851F42D4C957F2D * (k + 1))
            least = np.full((last - first) * BUCKETS, most, dtype=np.uint64)
            np.minimum.at(least, row + (h >> np.uint64(61)).astype(np.int64), h << np.uint64(3))
            out[first:last, :, k] = _register(least).reshape(-1, BUCKETS)
        first = last
    return out.reshape(n, BUCKETS * REPEATS)


def _register(least: np.ndarray) -> np.ndarray:
    """Leading zeros (six bits) and the ``MANTISSA`` bits after the leading one."""
    exact = (least >> np.uint64(11)).astype(np.float64)  # at most 53 bits, so the conversion rounds nothing
    fraction, exponent = np.frexp(exact)
    zeros = np.clip(53 - exponent, 0, 62).astype(np.uint16)
    bits = np.where(exact > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    return np.where(least == np.iinfo(np.uint64).max, np.uint16(EMPTY), (zeros << np.uint16(MANTISSA)) | bits)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of two disjoint sets are equal by chance: same zeros, same mantissa."""
    level = np.arange(53)
    near, far = 0.5 ** (level + 1), 0.5 ** level

    def zeros(size):
        size = np.maximum(size, 1.0)[:, None] / BUCKETS
        return (1 - near) ** size - (1 - far) ** size

    return (zeros(n) * zeros(m)).sum(axis=1) / (1 << MANTISSA)


def estimate(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity corrected for chance equality, and the number of registers it rests on."""
    used = ((left != EMPTY) | (right != EMPTY)).sum(axis=1)
    equal = ((left == right) & (left != EMPTY)).sum(axis=1)
    by_chance = chance(n.astype(float), m.astype(float))
    share = equal / np.maximum(used, 1)
    return (share - by_chance) / (1 - by_chance), used


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n, h1, h2, registers`` of every row: set size, a 128-bit hash of the set, its registers."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch):
                hashes, offsets = shingle_sets(slab)
                n = np.diff(offsets)
                # zero rows would make reduceat repeat a neighbour; the sum of an empty set is set below
                sums = []
                for seed in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes, seed), dtype=np.uint64)])
                    sums.append(mix(total[offsets[1:]] - total[offsets[:-1]], seed).view(np.int64))
                regs = registers(hashes, offsets)
                yield pa.RecordBatch.from_arrays([
                    slab.column("doc_id"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]),
                    pa.array([r.tobytes() for r in regs], type=pa.binary()),
                ], names=["doc_id", "n", "h1", "h2", "registers"])
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, registers binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """``id, shingles`` of documents with an id."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch):
                hashes, offsets = shingle_sets(slab)
                yield pa.RecordBatch.from_arrays([
                    slab.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64))),
                ], names=["id", "shingles"])
        release_memory()

    return docs.mapInArrow(run, "id long, shingles array<long>")


def band_keys(distinct: DataFrame) -> DataFrame:
    """``key, id``: one row per document and band that holds anything."""
    size = 2 * BAND
    banded = distinct.select("id", "registers", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    piece = F.expr(f"substring(registers, band * {size} + 1, {size})")
    return banded.select("id", "band", piece.alias("piece")).where(F.col("piece") != F.lit(b"\xff" * size)).select(
        F.xxhash64("band", "piece").alias("key"), "id")


def with_facts(rows: DataFrame, facts: DataFrame, size: str) -> DataFrame:
    """Rows (``key, id``) joined with what is known of their keys, ``size`` being the number of a key's rows.

    The rows of a key with many of them are dealt to as many tasks as they take, and its facts to each of these.
    """
    facts = written(facts, "facts")
    hot = written(facts.where(F.col(size) > HOT).select("key", F.ceil(F.col(size) / HOT).cast("int").alias("salts")), "hot")
    if hot.isEmpty():
        return rows.join(facts, "key")
    hot = broadcast_if_small(hot)
    cold = rows.join(hot, "key", "left_anti").join(facts, "key")
    salted = rows.join(hot, "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    copied = facts.join(hot, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return cold.union(salted.join(copied, ["key", "salt"]).select(*cold.columns))


def likely(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``a, b, score`` of the pairs whose estimate does not rule a link out."""
    head = F.expr(f"substring(registers, 1, {2 * ESTIMATE})")
    side = distinct.select("id", "n", head.alias("regs"))
    joined = (
        pairs.join(side.toDF("a", "n_a", "regs_a"), "a").join(side.toDF("b", "n_b", "regs_b"), "b")
        # sizes alone rule a pair out when the smaller set is below the threshold's share of the larger
        .where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
        .select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1)
                           for c in ("regs_a", "regs_b"))
            sizes = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            score, used = estimate(left, right, *sizes)
            level = PERCENT / 100
            keep = score >= level - SLACK * np.sqrt(level * (1 - level) / np.maximum(used, 1))
            yield pa.RecordBatch.from_arrays([
                batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep)), pa.array(score[keep]),
            ], names=["a", "b", "score"])
        release_memory()

    return joined.mapInArrow(run, "a long, b long, score double")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets meet the threshold."""
    joined = pairs.select("a", "b").join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    shared = joined.select("a", "b", F.size("left").alias("n"), F.size("right").alias("m"),
                           F.size(F.array_intersect("left", "right")).cast("long").alias("both"))
    return shared.where(100 * F.col("both") >= PERCENT * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    return (
        pairs.join(labels.toDF("a", "c_a"), "a", "left").join(labels.toDF("b", "c_b"), "b", "left")
        .where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")
    )


def _across_blocks(inner: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: for each document of a large bucket and each other component of the bucket, the likeliest link between them.

    A bucket is cut into blocks of about ``BLOCK`` documents and each pair of blocks is one group. Overlaps are counted on
    the whole shingle hashes, as ``confirmed`` counts them, so a link that is found here is one there.
    """
    blocks = F.ceil(F.col("inside") / BLOCK).cast("int")
    dealt = inner.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "c", "shingles")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(h) for h in group["shingles"]])
        flat = np.concatenate(group["shingles"].to_list()).astype(np.int64)
        row = np.repeat(np.arange(len(group)), sizes)
        ids, block = group["id"].to_numpy(), group["block"].to_numpy()
        names, c = np.unique(group["c"].to_numpy(), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        found: list[tuple[int, int]] = []
        # pairs inside the most frequent component need no look, so its documents only stand on one side
        few = np.flatnonzero(c != np.bincount(c).argmax())
        same = group["p"].iloc[0] == group["q"].iloc[0]
        for i in range(0, len(few), STRIP):
            strip = few[i:i + STRIP]
            vocabulary, at = np.unique(np.concatenate([flat[starts[k]:starts[k + 1]] for k in strip]), return_inverse=True)
            ours = np.zeros((len(strip), len(vocabulary)), dtype=np.float32)
            ours[np.repeat(np.arange(len(strip)), sizes[strip]), at] = 1
            place = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
            hit = vocabulary[place] == flat
            for first in range(0, len(group), 256):
                last = min(first + 256, len(group))
                span = slice(starts[first], starts[last])
                theirs = np.zeros((last - first, len(vocabulary)), dtype=np.float32)
                theirs[row[span][hit[span]] - first, place[span][hit[span]]] = 1
                both = (ours @ theirs.T).astype(np.int64)
                total = sizes[strip][:, None] + sizes[first:last][None, :]
                good = (100 * both >= PERCENT * (total - both)) & (c[strip][:, None] != c[first:last][None, :])
                if not same:
                    good &= block[strip][:, None] != block[first:last][None, :]
                for x, y in zip(*np.nonzero(good)):
                    found.append((strip[x], first + y, both[x, y] / (total[x, y] - both[x, y])))
        if not found:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        pairs = pd.DataFrame(found, columns=["x", "y", "score"])
        pairs["c"] = c[pairs["y"]]
        pairs = pairs.loc[pairs.groupby(["x", "c"])["score"].idxmax()]
        x, y = ids[pairs["x"]], ids[pairs["y"]]
        return pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return dealt.groupBy("key", "p", "q").applyInPandas(run, "a long, b long")


def _ordered(left, right) -> list:
    return [F.greatest(left, right).alias("a"), F.least(left, right).alias("b")]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``; other columns are ignored).

    A set holds the distinct runs of five words, in lower case for A-Z; a text of fewer words has one run. Texts that are
    null, empty or blank have empty sets and are linked with nothing. Documents are linked when 100 times the
    intersection is at least 75 times the union; the component is the smallest id reachable. Rows that repeat an id are
    one document with several texts: each row is returned, all with the component of the id. A row with a null id is
    linked with nothing, has a null component and is kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    wide = scratch_path(spark, "sketches")
    sketches(docs).write.parquet(wide)
    drawn = spark.read.parquet(wide)
    distinct = written(drawn.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(
        F.min("doc_id").alias("id"), F.first("registers").alias("registers")).select("id", "n", "h1", "h2", "registers"), "distinct")
    drawn = written(drawn.drop("registers"), "drawn")
    # registers are kept once for each different text
    discard(spark, wide)
    release_shuffles(spark)
    marks = drawn.where("n > 0 and doc_id is not null")

    keys = band_keys(distinct)
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    members = written(with_facts(keys, shared, "members"), "members")
    release_shuffles(spark)
    pairs = members.where("id <> lo").select(*_ordered("id", "lo")).union(
        members.where("id <> hi and id <> lo").select(*_ordered("id", "hi"))).distinct()
    pairs = written(likely(pairs, distinct), "pairs")
    release_shuffles(spark)
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    # most texts share no band with another one: they are left out before the join that needs a shuffle
    wanted = written(wanted, "wanted")
    texts = texts.where(perhaps_among("doc_id", wanted))
    full = scratch_path(spark, "sets")
    full_sets(texts.join(wanted, "doc_id", "left_semi")).where(F.size("shingles") > 0).distinct().write.parquet(full)
    sets = spark.read.parquet(full)
    release_shuffles(spark)

    # One document under several texts joins the components of all of them.
    several = marks.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y")
    owners = distinct.select("id", "h1", "h2")
    same = marks.join(several.select("doc_id"), "doc_id").join(owners, ["h1", "h2"]).where("doc_id <> id").select(*_ordered("doc_id", "id"))

    # The likeliest partner of each document first, then the other pairs that are still apart.
    best = pairs.groupBy("a").agg(F.max_by("b", "score").alias("b"))
    links = written(confirmed(best, sets).union(same), "links")
    release_shuffles(spark)
    labels = written(components(links), "labels")
    rest = written(_apart(pairs.join(best, ["a", "b"], "left_anti"), labels), "rest")
    release_shuffles(spark)
    labels = written(components(confirmed(rest, sets), labels), "labels")
    release_shuffles(spark)

    # Buckets of four and more whose inner members (all but lo and hi, which were compared with all) are in several components.
    inner = members.where("members > 3 and id <> lo and id <> hi").select("key", "id").join(
        labels.toDF("id", "c"), "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"))
    mixed = inner.groupBy("key").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi"), F.count("*").alias("inside")).where("c_lo < c_hi")
    inner = written(with_facts(inner, mixed.select("key", "inside"), "inside"), "inner")
    release_shuffles(spark)
    few = inner.where(F.col("inside") <= PAIRED)
    left, right = few.toDF("key", "x", "c_x", "inside"), few.toDF("key", "y", "c_y", "inside")
    across = left.join(right, "key").where("x > y and c_x <> c_y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    across = likely(across.join(pairs, ["a", "b"], "left_anti"), distinct).select("a", "b")
    across = written(across.union(_across_blocks(inner.where(F.col("inside") > PAIRED), sets)).distinct(), "across")
    release_shuffles(spark)
    labels = written(components(confirmed(across, sets), labels), "labels")
    discard(spark, full)
    release_shuffles(spark)

    named = drawn.select("doc_id", "n", "h1", "h2").join(owners, ["h1", "h2"], "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("id", "doc_id")).otherwise(F.col("doc_id")).alias("id"))
    return named.join(labels.toDF("id", "c"), "id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("c", "id")).otherwise(F.col("id"))).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group is kept, with all columns.

    Of rows that repeat an id one stays (the first text in order); rows with a null id stay.
    """
    found = written(near_duplicates(docs), "groups")
    release_shuffles(docs.sparkSession)
    # rows of one id stay or go together; only rows that may have to go are shuffled to the join that decides
    gone = written(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    known, perhaps = docs.where("doc_id is not null"), perhaps_among("doc_id", gone)
    kept = known.where(~perhaps).union(known.where(perhaps).join(gone, "doc_id", "left_anti").select(*docs.columns))
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    rest = docs.where("doc_id is null")
    if repeated.isEmpty():
        return kept.union(rest)
    once = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    first = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns))
    several = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    return once.union(several.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place")).union(rest)
