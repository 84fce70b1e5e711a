"""Spelling variants: words one edit apart, grouped below the frequent form.

Two words within one edit share the first or the last half of the shorter one's letters: an edit leaves one of them whole.
Words meet in cells by that half and length. A cell's words have a bit-sliced index, one bitset over the words for each
position and letter. For a query the recurrences take its letters one by one and update, for all words of the cell at once
and 64 in a machine word, the set that agrees so far and the three sets with one error so far: a letter replaced, one of
the query's left out (the word's positions lag by one), one of the word's left out (they are ahead by one).
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import text_of, written
from samplewright.session import broadcast_if_small

LETTERS = r"[A-Za-zÀ-ÿ]+"
# Words of a cell, about, and their letters; keys with more words are dealt to several cells.
CELL_WORDS = 2048
CELL_LETTERS = 1 << 17
QUERIES = 64
POSITION = 21  # code points have 21 bits


class Index:
    """Bitsets over words: one for each (position, letter) that occurs, and one for each length."""

    def __init__(self, words: list[str]):
        self.width = -(-max(len(words), 1) // 64)
        letters, self.length, begin = letters_of(words)
        owner = np.repeat(np.arange(len(words)), self.length)
        key = (np.arange(len(letters)) - begin[owner]) << POSITION | letters
        self.keys, row = np.unique(key, return_inverse=True)
        # one row more, empty, for what does not occur
        self.bits = np.zeros((len(self.keys) + 1, self.width), dtype=np.uint64)
        place = row * self.width + (owner >> 6)
        order = np.argsort(place, kind="stable")
        if len(order):
            first = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) > 0]))
            bit = np.uint64(1) << (owner[order] & 63).astype(np.uint64)
            self.bits.reshape(-1)[place[order][first]] = np.bitwise_or.reduceat(bit, first)

    def having(self, length: int) -> np.ndarray:
        """The words of a length."""
        bits = np.zeros(self.width * 64, dtype=np.uint8)
        bits[:len(self.length)] = self.length == length
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each letter the words that have it at the position."""
        if position < 0:
            return self.bits[np.full(len(letters), len(self.keys))]
        key = position << POSITION | letters
        row = np.searchsorted(self.keys, key)
        known = row < len(self.keys)
        known[known] = self.keys[row[known]] == key[known]
        return self.bits[np.where(known, row, len(self.keys))]

    def one_edit(self, queries: np.ndarray) -> np.ndarray:
        """Bitsets of the words exactly one edit from each query; queries are equally long, one row of letters each."""
        number, length = queries.shape
        agree = np.full((number, self.width), ~np.uint64(0))
        replaced, lagging, ahead = (np.zeros_like(agree) for _ in range(3))
        for i in range(length):
            here, before, after = (self.at(i + shift, queries[:, i]) for shift in (0, -1, 1))
            ahead = (ahead | agree) & after
            lagging = lagging & before | agree
            replaced = replaced & here | agree & ~here
            agree = agree & here
        return replaced & self.having(length) | lagging & self.having(length - 1) | (ahead | agree) & self.having(length + 1)


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words side by side, and length and begin of each word."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return letters, length, np.cumsum(length) - length


def near(queries: list[str], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the queries and of the words that are exactly one edit apart."""
    index = Index(words)
    letters, length, begin = letters_of(queries)
    found = []
    for size in np.unique(length):
        mine = np.flatnonzero(length == size)
        for first in range(0, len(mine), QUERIES):
            chunk = mine[first:first + QUERIES]
            sets = index.one_edit(letters[begin[chunk][:, None] + np.arange(size)])
            query, column = np.nonzero(sets)
            bits = np.unpackbits(sets[query, column].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(bits)
            found.append((chunk[query[at]], column[at] * 64 + bit))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found])


def planted(run: Column, doc_id: Column, every: int = 199) -> Column:
    """The run, in one of ``every`` cases without one letter: those whose crc32 with the document's id is divisible by it."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, change=None, least_letters: int = 6, least_count: int = 5) -> DataFrame:
    """``word, n``: the words of all texts with at least so many letters and occurrences.

    A word is a maximal run of Latin letters, only A-Z lower-cased; ``change(run, doc_id)`` may rewrite it.
    """
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(
        F.translate(text_of(docs), ascii_uppercase, ascii_lowercase), F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.select((change(F.col("run"), F.col("doc_id")) if change else F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b`` for all pairs of different words (``word, n``) one edit apart, each pair once."""
    size = F.length("word")
    keyed = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("s")).withColumn("h", F.floor(F.col("s") / 2).cast("int"))
    keyed = keyed.select("word", "n", "s", "h", F.posexplode(F.array(
        F.substring("word", F.lit(1), F.col("h")), F.substring("word", F.length("word") - F.col("h") + 1, F.col("h")))).alias("side", "half"))
    keyed = written(keyed.withColumn("asks", F.length("word") == F.col("s")), "halves")
    # queries are the words of the shorter length; the index has these and those one letter longer
    room = F.greatest(F.lit(64), F.least(F.lit(CELL_WORDS), F.lit(CELL_LETTERS) / F.greatest(F.col("s"), F.lit(1)))).cast("int")
    cells = keyed.groupBy("s").agg(F.ceil(F.count("*") / 2 / room).alias("cells"))
    crowded = keyed.groupBy("s", "side", "half").agg(F.count("*").alias("indexed"), F.count_if("asks").alias("asked")).where(F.col("indexed") > room).select(
        "s", "side", "half", F.ceil(F.col("indexed") / room).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("asked") / room)).alias("parts"))
    placed = keyed.join(broadcast_if_small(cells), "s").join(broadcast_if_small(written(crowded, "crowded")), ["s", "side", "half"], "left")
    own, mix = F.xxhash64("half"), F.xxhash64("word")
    placed = placed.select("word", "n", "s", "side", "h", "asks", F.when(F.col("blocks").isNull(), F.pmod(own, F.col("cells"))).otherwise(own).alias("cell"),
                           F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("parts", F.lit(1)).alias("parts"))
    key = ["s", "side", "cell", "part", "block"]
    indexed = placed.withColumn("block", F.pmod(mix, F.col("blocks"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = placed.where("asks").withColumn("part", F.pmod(mix, F.col("parts"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = [*key, "word", "n", "h"]
    renamed = [F.col(c).alias(c) for c in columns]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.reset_index(drop=True), right.reset_index(drop=True)
        query, word = near(left["word"].to_list(), right["word"].to_list()) if len(left) and len(right) else ([], [])
        a, b = left.iloc[query], right.iloc[word]
        out = pd.DataFrame({"a": a["word"].to_numpy(), "n_a": a["n"].to_numpy(), "b": b["word"].to_numpy(), "n_b": b["n"].to_numpy()})
        if out.empty:
            return out.astype({"a": str, "n_a": "int64", "b": str, "n_b": "int64"})
        h, side = left["h"].iloc[0], left["side"].iloc[0]
        first = out["a"].str[:h] == out["b"].str[:h]
        last = out["a"].str[len(out["a"].iloc[0]) - h:] == pd.Series([w[len(w) - h:] for w in out["b"]])
        # a pair belongs to its common first half, or else to its common last half; of equally long words the smaller one asks
        mine = first if side == 0 else last & ~first
        return out[mine & ((out["a"].str.len() < out["b"].str.len()) | (out["a"] < out["b"]))]

    return asked.select(*columns).groupBy(*key).cogroup(indexed.select(*renamed).groupBy(*key)).applyInPandas(meet, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the end of each chain of forms, found by doubling the steps.

    Each round halves the chains; forms are more frequent than their words, so there are no circles.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if stepped.where("moved").isEmpty():
            return stepped.select("word", "root")
        now = stepped.select("word", "root")


def group(words: DataFrame, factor: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of a vocabulary (``word, n``, words distinct).

    Words are near if exactly one code point is inserted, deleted or replaced between them. A word's form is its near word
    with the largest ``n`` (ties: the first in code-point order) if that is at least ``factor`` times its own, else null;
    its root is the end of the chain of forms, the word itself without one. An empty vocabulary gives no rows.
    """
    words = written(words.select("word", "n"), "vocabulary")
    ways = F.array(F.struct(F.col("a").alias("word"), (-F.col("n_b")).alias("less"), F.col("b").alias("near")),
                   F.struct(F.col("b").alias("word"), (-F.col("n_a")).alias("less"), F.col("a").alias("near")))
    best = pairs(words).select(F.inline(ways)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    joined = words.join(best, "word", "left")
    taken = -F.col("best.less") >= factor * F.col("n")
    known = written(joined.select("word", F.when(taken, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                  F.when(taken, -F.col("best.less")).alias("form_n")), "forms")
    return known.join(roots(known.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, change=None, least_letters: int = 6, least_count: int = 5, factor: int = 5) -> DataFrame:
    """Spelling variants of the words of all documents (``doc_id, text``), see ``vocabulary`` and ``group``.

    A null or empty text has no words; repeated rows and ids count each; a null id is an empty text for ``change``. Words
    of any length take part. Other columns do not matter; without documents there are no rows.
    """
    return group(vocabulary(docs, change, least_letters, least_count), factor)
