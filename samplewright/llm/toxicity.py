"""Toxicity: a convolutional text classifier fitted on all labelled texts, its thresholds calibrated by language.

Words are embedded as the sum of hashed vectors for the word and its beginnings. Filters of several widths run over the
word sequence, each filter's maximum over the text feeds a logistic layer. Only the places of the maxima have gradients.
The language is guessed from the text's function words; each language has a threshold of its own, which is moved to 0.5.

One task fits a first network on some texts. From there on all labelled texts count: those to fit on are dealt to shards,
each shard goes on from the common network in a task of its own, and Spark adds up what the shards changed; the thresholds
are those with the fewest errors on all labelled texts kept back from fitting.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import bounded_batches, discard, release_memory, release_shuffles, slabs, text_of, utf8, written
from samplewright.llm.quality import fold
from samplewright.llm.words import lowered, word_bounds, word_hashes
from samplewright.operators.rank import running
from samplewright.session import broadcast_if_small, scratch_path

# The first network is fitted on at most so many toxic and other labelled texts (smallest hash first), none of them longer
# than SAMPLE_CHARS. The passes after it, the thresholds and the scores read all texts, whole and of any length.
TOXIC_ROWS = 4_000
OTHER_ROWS = 8_000
SAMPLE_CHARS = 20_000

BITS = 16
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
BEGINNINGS = (4, 5, 6)
UPDATES = 2_400
BATCH = 64
RATE = 0.1
HIDDEN = 0.6

# Passes over all texts to fit on, rows and bytes of text of a shard, and the share of the texts kept back for the thresholds.
PASSES = 2
SHARD_ROWS = 8_192
SHARD_BYTES = 32 << 20
KEPT_BACK = 5
# Changes are added up as integers, so that their order does not matter.
UNIT = 2.0 ** 32
# A language with fewer texts of either kind takes the common threshold.
LEAST = 20

# Frequent function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with as be at by this from or are",
    "de": "der die und das den von ist mit ein nicht im des auf eine als auch sich zu dem für",
    "fr": "le les et des un une que dans pour qui sur au par ne pas plus du ce il elle",
    "es": "el los y en del las por con para una su al lo como más pero sus se la que",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes (A-Z and the accented capitals of Latin-1) and which of them belong to words."""
    low = lowered(data)
    if len(low):
        accented = (np.concatenate([[0], data[:-1]]) == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        low = low + accented.astype(np.uint8) * np.uint8(32)
    return low, ((low >= 97) & (low <= 122)) | (low >= 128)


def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    words = [(w, k) for k, text in enumerate(FUNCTION_WORDS.values()) for w in text.split()]
    raw = [w.encode() for w, _ in words]
    ends = np.cumsum([len(r) for r in raw])
    hashes = word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], np.array([k for _, k in words])[order]


@dataclass
class Tokens:
    """Word features of some texts: rows of the embedding table per word, words per text, guessed language."""

    rows: np.ndarray   # words x (1 + beginnings); the last table row is zero and pads
    first: np.ndarray  # offsets of the texts
    language: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    low, inside = _letters(data)
    starts, ends, first = word_bounds(low, offsets, inside)
    hashes = word_hashes(low, starts, ends)
    rows = np.empty((len(starts), 1 + len(BEGINNINGS)), dtype=np.int32)
    rows[:, 0] = hashes & np.uint64((1 << BITS) - 1)
    for k, size in enumerate(BEGINNINGS):
        part = word_hashes(low, starts, np.minimum(ends, starts + size)) >> np.uint64(7 * k + 8)
        rows[:, k + 1] = np.where(ends - starts > size, part & np.uint64((1 << BITS) - 1), 1 << BITS)
    names, kind = _function_hashes()
    at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
    hit = np.flatnonzero(names[at] == hashes)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    votes = np.bincount(owner[hit] * len(FUNCTION_WORDS) + kind[at[hit]], minlength=n * len(FUNCTION_WORDS)).reshape(n, len(FUNCTION_WORDS))
    language = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(FUNCTION_WORDS)) if n else np.zeros(0, np.int64)
    return Tokens(rows, first, language)


@dataclass
class Network:
    table: np.ndarray                # (2^BITS + 1) x SIZE
    filters: dict[int, np.ndarray]   # width -> width x SIZE x FILTERS
    bias: np.ndarray
    out: np.ndarray
    offset: float
    threshold: np.ndarray            # by language, on the raw output

    @staticmethod
    def new(seed: int = 7) -> Network:
        random = np.random.default_rng(seed)
        table = (random.standard_normal(((1 << BITS) + 1, SIZE)) * 0.1).astype(np.float32)
        table[-1] = 0
        filters = {w: (random.standard_normal((w, SIZE, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}
        count = len(WIDTHS) * FILTERS
        return Network(table, filters, np.zeros(count, np.float32), (random.standard_normal(count) * 0.3).astype(np.float32), -2.0,
                       np.zeros(len(LANGUAGES)))

    def pooled(self, rows: np.ndarray, first: np.ndarray, places: bool = False):
        """Maximum of every filter over each text, and on request the word where it is reached.

        Filters see empty words beyond a text's end, so a text shorter than a filter still has a value; a text without
        words has zeros.
        """
        n, count = len(first) - 1, np.diff(first)
        out = np.zeros((n, len(WIDTHS) * FILTERS), dtype=np.float32)
        where = np.full(out.shape, -1, dtype=np.int64)
        full = np.flatnonzero(count > 0)
        if not len(full):
            return (out, where) if places else out
        vectors = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            vectors += self.table[rows[:, k]]
        # words of the same text that follow each word
        left = np.repeat(first[1:], count) - np.arange(len(rows)) - 1
        for i, width in enumerate(WIDTHS):
            value = vectors @ self.filters[width][0]
            for k in range(1, width):
                later = vectors[k:] @ self.filters[width][k]
                value[:-k] += np.where((left[:-k] >= k)[:, None], later, 0)
            columns = slice(i * FILTERS, (i + 1) * FILTERS)
            top = np.maximum.reduceat(value, first[:-1][full], axis=0)
            out[full, columns] = top
            if places:
                same = value == np.repeat(top, count[full], axis=0)
                index = np.where(same, np.arange(len(rows))[:, None], len(rows))
                where[full, columns] = np.minimum.reduceat(index, first[:-1][full], axis=0)
        return (out, where) if places else out

    def raw(self, tokens: Tokens) -> np.ndarray:
        return np.maximum(self.pooled(tokens.rows, tokens.first) + self.bias, 0) @ self.out + self.offset

    def score(self, tokens: Tokens) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(tokens) - self.threshold[tokens.language]).astype(np.float64), -30, 30)))


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and which of them each row is."""
    code = np.zeros(len(rows), dtype=np.int64)
    for column in rows.T:
        _, code = np.unique(code * (int(column.max(initial=0)) + 1) + column, return_inverse=True)
    _, place, code = np.unique(code, return_index=True, return_inverse=True)
    return rows[place], code.astype(np.int32)


@dataclass
class Sample:
    """Texts to fit on: each distinct word's features once, and for every word of every text which of them it has."""

    rows: np.ndarray   # distinct words x (1 + beginnings)
    words: np.ndarray  # rows of the words of all texts
    first: np.ndarray  # offsets of the texts
    language: np.ndarray

    @staticmethod
    def of(pieces: Iterable[Tokens]) -> Sample:
        rows, words = [np.zeros((0, 1 + len(BEGINNINGS)), np.int32)], [np.zeros(0, np.int32)]
        counts, language, known = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], 0
        for piece in pieces:
            own, index = _distinct_rows(piece.rows)
            rows.append(own)
            words.append(index + np.int32(known))
            counts.append(np.diff(piece.first))
            language.append(piece.language)
            known += len(own)
        distinct, renamed = _distinct_rows(np.concatenate(rows))
        return Sample(distinct, renamed[np.concatenate(words)], np.cumsum(np.concatenate(counts)), np.concatenate(language))

    def texts(self, chosen: np.ndarray) -> Tokens:
        count = np.diff(self.first)[chosen]
        first = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(self.first[:-1][chosen] - first[:-1], count) + np.arange(first[-1])
        return Tokens(self.rows[self.words[place]], first, self.language[chosen])


@dataclass
class Learner:
    """A network being fitted with Adagrad and the sums of its squared gradients."""

    net: Network
    past: dict

    @staticmethod
    def of(net: Network) -> Learner:
        return Learner(net, {"table": np.full(len(net.table), 1e-2, np.float32), "bias": np.full_like(net.bias, 1e-2), "out": np.full_like(net.out, 1e-2),
                             "offset": 1e-2, **{w: np.full_like(f, 1e-2) for w, f in net.filters.items()}})

    def update(self, part: Tokens, label: np.ndarray, weight: np.ndarray) -> None:
        """One step along the gradient of some texts, the weights of their errors given."""
        net, past, rate = self.net, self.past, RATE
        top, where = net.pooled(part.rows, part.first, places=True)
        hidden = np.maximum(top + net.bias, 0)
        raw = hidden @ net.out + net.offset
        error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label) * weight).astype(np.float32)
        back = (error[:, None] * net.out) * (hidden > 0)
        for name, grad in (("out", hidden.T @ error + 1e-4 * net.out), ("bias", back.sum(axis=0))):
            past[name] += grad ** 2
            setattr(net, name, getattr(net, name) - rate * grad / np.sqrt(past[name]))
        past["offset"] += float(error.sum()) ** 2
        net.offset -= rate * float(error.sum()) / past["offset"] ** 0.5
        grads: list[tuple[np.ndarray, np.ndarray]] = []
        for i, width in enumerate(WIDTHS):
            columns = slice(i * FILTERS, (i + 1) * FILTERS)
            text, column = np.nonzero((where[:, columns] >= 0) & (back[:, columns] != 0))
            at, slope = where[:, columns][text, column], back[:, columns][text, column]
            grad = np.zeros_like(net.filters[width])
            for k in range(width):
                ok = at + k < part.first[1:][text]
                rows, f, s = part.rows[at[ok] + k], column[ok], slope[ok]
                vectors = net.table[rows].sum(axis=1)
                by_filter = np.zeros((FILTERS, SIZE), dtype=np.float32)
                np.add.at(by_filter, f, s[:, None] * vectors)
                grad[k] = by_filter.T
                to_words = s[:, None] * net.filters[width][k][:, f].T
                grads.append((rows.ravel(), np.repeat(to_words, rows.shape[1], axis=0)))
            past[width] += grad ** 2
            net.filters[width] = net.filters[width] - rate * grad / np.sqrt(past[width])
        rows, slopes = (np.concatenate(x) for x in zip(*grads))
        slopes, rows = slopes[rows < 1 << BITS], rows[rows < 1 << BITS]
        names, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(names), SIZE), dtype=np.float32)
        np.add.at(total, inverse, slopes)
        past["table"][names] += (total ** 2).mean(axis=1)
        net.table[names] -= rate * total / np.sqrt(past["table"][names])[:, None]

    def pieces(self) -> np.ndarray:
        """All numbers as rows of ``SIZE + 1``: the embedding table's first, then what is dense."""
        net, past = self.net, self.past
        dense = [net.bias, net.out, [net.offset], *[net.filters[w].ravel() for w in WIDTHS],
                 past["bias"], past["out"], [past["offset"]], *[past[w].ravel() for w in WIDTHS]]
        flat = np.concatenate([np.asarray(x, dtype=np.float64) for x in dense])
        flat = np.concatenate([flat, np.zeros(-len(flat) % (SIZE + 1))])
        return np.concatenate([np.column_stack([net.table, past["table"]]).astype(np.float64), flat.reshape(-1, SIZE + 1)])

    def with_pieces(self, pieces: np.ndarray) -> Learner:
        """A learner with the numbers of ``pieces``."""
        rows, flat = pieces[:len(self.net.table)], pieces[len(self.net.table):].ravel()
        net, past, at = Network(**vars(self.net)), dict(self.past), 0

        def taken(like: np.ndarray) -> np.ndarray:
            nonlocal at
            at += like.size
            return flat[at - like.size:at].reshape(like.shape).astype(np.float32)

        net.table, past["table"] = rows[:, :SIZE].astype(np.float32), rows[:, SIZE].astype(np.float32)
        net.bias, net.out, net.offset = taken(net.bias), taken(net.out), float(taken(np.zeros(1))[0])
        net.filters = {w: taken(net.filters[w]) for w in WIDTHS}
        past["bias"], past["out"], past["offset"] = taken(past["bias"]), taken(past["out"]), float(taken(np.zeros(1))[0])
        return Learner(net, past | {w: taken(past[w]) for w in WIDTHS})


def _hidden(part: Tokens, random: np.random.Generator) -> Tokens:
    """Words are left out at random, or a few frequent toxic words would explain all texts and others stay unlearned."""
    seen = random.random(len(part.rows)) >= HIDDEN
    return Tokens(part.rows[seen], np.concatenate([[0], np.cumsum(seen)])[part.first], part.language)


def begun(sample: Sample, label: np.ndarray, updates: int = UPDATES, seed: int = 7) -> Learner:
    """A network fitted on some texts in one task."""
    net = Network.new(seed)
    learner = Learner.of(net)
    n = len(label)
    if n == 0 or label.min() == label.max():
        net.out[:] = 0
        net.offset = 0.0 if n == 0 else (4.0 if label[0] else -4.0)
        return learner
    random = np.random.default_rng(seed)
    fitted = np.arange(n)
    epochs = int(np.clip(np.ceil(updates * BATCH / n), 8, 60))
    weight = np.where(label == 1, n / (2 * label.sum()), n / (2 * (n - label.sum())))
    for epoch in range(epochs):
        fitted = random.permutation(fitted)
        for first in range(0, n, BATCH):
            chosen = fitted[first:first + BATCH]
            part = sample.texts(chosen)
            learner.update(_hidden(part, random) if epoch < epochs - 1 else part, label[chosen], weight[chosen] / len(chosen))
    return learner


def train(sample: Sample, label: np.ndarray, updates: int = UPDATES, seed: int = 7) -> Network:
    """A network fitted on some texts, its thresholds not moved."""
    return begun(sample, label, updates, seed).net


def _first(rows: DataFrame, toxic_rows: int, other_rows: int) -> Learner:
    """The learner that the passes start from; one task fits it, and only its numbers come to the driver."""
    short = rows.where(F.length("text") <= SAMPLE_CHARS)
    chosen = F.lit(False)
    for label, most in ((1, toxic_rows), (0, other_rows)):
        last = short.where(F.col("label") == label).select("place").orderBy("place").limit(most).agg(F.max("place")).first()[0]
        if last is not None:
            chosen = chosen | ((F.col("label") == label) & (F.col("place") <= last))
    # the rows and their lengths are bounded, so one task may hold them
    drawn = short.where(chosen).orderBy("place", "label").limit(toxic_rows + other_rows).select("text", "label").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[np.ndarray] = []

        def pieces() -> Iterator[Tokens]:
            for batch in batches:
                labels.append(batch.column("label").to_numpy().astype(np.float32))
                for slab in slabs(batch.select(["text"]), size=1 << 20):
                    yield tokens(*utf8(slab.column("text")))

        sample = Sample.of(pieces())
        label = np.concatenate([np.zeros(0, np.float32), *labels])
        # without texts of both kinds there is nothing to begin with
        learner = begun(sample, label) if len(set(label)) > 1 else Learner.of(Network.new())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((vars(learner.net), learner.past))], type=pa.binary())], names=["net"])
        release_memory()

    fitted = drawn.mapInArrow(run, "net binary").collect()
    if not fitted:
        return Learner.of(Network.new())
    net, past = pickle.loads(fitted[0].net)
    return Learner(Network(**net), past)


def _passed(rows: DataFrame, learner: Learner, shards: int, weight: dict[int, float], number: int) -> Learner:
    """The learner after a pass over all rows: every shard goes on from it, and a number changes by the mean of the changes
    of the shards that moved it. Words are left out at random in all passes but the last.
    """
    shared = rows.sparkSession.sparkContext.broadcast(learner)
    columns = [f"v{i}" for i in range(SIZE + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, random = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if own is None:
                own = copy.deepcopy(shared.value)
                random = np.random.default_rng([number, batch.column("shard")[0].as_py()])
            for slab in slabs(batch, size=1 << 19):
                part, label = tokens(*utf8(slab.column("text"))), slab.column("label").to_numpy().astype(np.float32)
                factor = np.where(label == 1, weight[1], weight[0]) / BATCH
                for first in range(0, len(label), BATCH):
                    last = min(first + BATCH, len(label))
                    span = slice(part.first[first], part.first[last])
                    some = Tokens(part.rows[span], part.first[first:last + 1] - part.first[first], part.language[first:last])
                    own.update(_hidden(some, random) if number < PASSES - 1 else some, label[first:last], factor[first:last])
        if own is not None:
            change = own.pieces()
            change -= shared.value.pieces()
            moved = np.flatnonzero(change.any(axis=1))
            change = np.rint(change[moved] * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(moved), *[pa.array(change[:, i]) for i in range(len(columns))]], names=["piece", *columns])
        release_memory()

    dealt = rows.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "label")
    changes = dealt.select("shard", "text", "label").mapInArrow(run, ", ".join(f"{c} long" for c in ["piece", *columns]))
    # one row for each row of the embedding table at most, and a hundred more
    total = changes.groupBy("piece").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns]).toArrow()
    pieces, n = learner.pieces(), total.column("n").to_numpy()
    pieces[total.column("piece").to_numpy()] += np.column_stack([total.column(c).to_numpy() for c in columns]) / n[:, None] / UNIT
    shared.unpersist()
    return learner.with_pieces(pieces)


def calibrated(values: DataFrame) -> np.ndarray:
    """Thresholds by language from ``language, raw, label`` of all texts kept back: those with the fewest errors, of equal
    ones the one in the widest gap. A language with few texts of either kind takes the common one.
    """
    common = F.lit(len(LANGUAGES))
    counted = values.union(values.select(common, "raw", "label")).groupBy("language", "raw").agg(
        F.sum("label").cast("long").alias("toxic"), F.sum(1 - F.col("label")).cast("long").alias("other"))
    counted = written(counted, "values")
    totals = {r.language: r for r in counted.groupBy("language").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.max("raw").alias("most")).collect()}
    # errors of a threshold just below each value: toxic texts under it, others from it on
    sums = running(counted, ["language"], "raw", {"missed": ("toxic", "sum"), "passed": ("other", "sum"), "below": ("raw", "max")}, inclusive=False)
    least = sums.groupBy("language").agg(F.min(F.struct(
        (F.coalesce("missed", F.lit(0)) - F.coalesce("passed", F.lit(0))).alias("wrong"),
        (F.coalesce("below", "raw") - F.col("raw")).alias("gap"), "raw", F.coalesce("below", "raw").alias("below"))).alias("best"))
    found = {}
    for r in least.collect():
        own = totals[r.language]
        # above all values every toxic text is missed, and no other one is taken for toxic
        found[r.language] = own.most + 1.0 if own.toxic < r.best.wrong + own.other else (r.best.raw + r.best.below) / 2
    out = np.zeros(len(LANGUAGES))
    for k in range(len(LANGUAGES)):
        enough = [x for x, few in ((k, LEAST), (len(LANGUAGES), 1)) if x in totals and min(totals[x].toxic, totals[x].other) >= few]
        out[k] = found[enough[0]] if enough else 0.0
    return out


def _values(rows: DataFrame, net: Network) -> DataFrame:
    """``language, raw, label`` of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch, size=1 << 20):
                part = tokens(*utf8(slab.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(part.language.astype(np.int32)), pa.array(shared.value.raw(part).astype(np.float64)), slab.column("label")],
                                                 names=["language", "raw", "label"])
        release_memory()

    return rows.select("text", "label").mapInArrow(run, "language int, raw double, label int")


def fit(docs: DataFrame, labels: DataFrame, keep, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> Network:
    """A network fitted on all labelled texts that satisfy ``keep`` (a condition on ``doc_id``).

    One in ``KEPT_BACK`` of the documents is not fitted on but sets the thresholds. Only numbers of the network come to the
    driver. ``toxic_rows`` and ``other_rows`` bound the texts of the first network that the passes go on from.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kinds = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    path = scratch_path(spark, "labelled")
    texts.join(broadcast_if_small(kinds), "doc_id").select(
        "text", "label", F.xxhash64("doc_id", "text").alias("place"),
        (F.pmod(F.xxhash64("doc_id", F.lit("kept back")), F.lit(KEPT_BACK)) == 0).alias("back")).write.parquet(path)
    release_shuffles(spark)
    rows = spark.read.parquet(path)

    def counts(some: DataFrame) -> tuple[int, int, int]:
        return tuple(x or 0 for x in some.agg(F.count("*"), F.sum("label"), F.sum(F.octet_length("text"))).first())

    fitted = rows.where(~F.col("back"))
    n, toxic, size = counts(fitted)
    if not 0 < toxic < n:
        # too few texts to keep any back
        fitted, rows = rows, rows.limit(0)
        n, toxic, size = counts(fitted)
    if not 0 < toxic < n:
        return train(Sample.of([]), np.full(min(n, 1), toxic > 0, np.float32))
    learner = _first(fitted, toxic_rows, other_rows)
    shards = max(-(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    for number in range(PASSES):
        learner = _passed(fitted, learner, shards, {1: n / (2 * toxic), 0: n / (2 * (n - toxic))}, number)
        release_shuffles(spark)
    net = learner.net
    net.threshold = calibrated(_values(rows.where("back"), net))
    discard(spark, path)
    return net


def scored(docs: DataFrame, net: Network, keep_rows: bool = False) -> DataFrame:
    """``doc_id, score`` of every row, or with ``keep_rows`` the rows of ``docs`` whose score is below 0.5."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch, size=1 << 20):
                score = shared.value.score(tokens(*utf8(slab.column("text"))))
                yield pa.RecordBatch.from_arrays([slab.column("doc_id"), pa.array(score, type=pa.float64())], names=["doc_id", "score"])
        release_memory()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).fill_null("")
            only = pa.RecordBatch.from_arrays([text], names=["text"])
            scores = [shared.value.score(tokens(*utf8(slab.column("text")))) for slab in slabs(only, size=1 << 20)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < 0.5))
        release_memory()

    if keep_rows:
        return docs.mapInArrow(clean, docs.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Labels of the held-out fold (crc32 of the id as text, modulo ``folds``) are never learned from; the score depends on
    the text alone. Null and empty texts get the score of a text without words, a null id is never held out, repeated rows
    are scored each. Rows of ``labels`` with a null id or a label other than 0 and 1 are left out. Without usable labels
    every score is 0.5 shifted by nothing, with one class only it is that class.
    """
    net = fit(docs, labels, fold(folds=folds) != held_out)
    return scored(docs, net).select(
        "doc_id", (fold(folds=folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
