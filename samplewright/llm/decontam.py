"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are brought to one form (lower case, every run of other than letters and digits one space).
An item of ``m`` characters may be quoted with ``k`` edits. A quotation keeps at least ``m - q + 1 - kq`` of the item's
q-grams, all on diagonals (text position minus item position) that lie within ``k`` of each other. So shared q-grams are
counted in diagonal bands of width ``2k + 1`` that overlap by half; bands that reach the bound are verified by an
alignment restricted to the band.

The benchmark is worked through in blocks of bounded size, each a pass over all documents; a block is all that is sent
to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import bounded_batches, release_memory, text_of
from samplewright.llm.words import mix

Q = 12
EDIT_RATE = 0.05
# Characters of benchmark items that one pass holds in a task.
BLOCK_CHARS = 4 << 20
# Characters of text filtered in one step; longer texts are cut with an overlap that no quotation exceeds.
STEP_CHARS = 2 << 20
# Grams hashed at once, and shared grams and cells of alignments that one step holds.
STEP_GRAMS = 1 << 17
STEP_HITS = 1 << 20
STEP_CELLS = 1 << 22
TABLE_BITS = 22
BORDER = 1
BASE = 0x9E3779B97F4A7C15

_FORM: list[np.ndarray] = []
_HELD: dict[str, Items] = {}


def _forms() -> np.ndarray:
    """For every code point the lower-case letter or digit it counts as, or a space."""
    if not _FORM:
        form = np.full(0x110000, 32, dtype=np.uint32)
        for code in range(0x110000):
            letter = chr(code)
            if letter.isalnum():
                low = letter.lower()
                form[code] = ord(low) if len(low) == 1 else code
        _FORM.append(form)
    return _FORM[0]


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the compared form and the position of each in the text."""
    codes = _forms()[np.frombuffer(text.encode("utf-32-le", errors="replace"), dtype=np.uint32)]
    space = codes == 32
    drop = space.copy()
    drop[1:] &= space[:-1]  # the first space of a run stays
    drop[:1] = space[:1]
    at = np.flatnonzero(~drop)
    if len(at) and space[at[-1]]:
        at = at[:-1]
    return codes[at], at


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the ``q`` codes at each position, built by doubling."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    part, width, done = codes.astype(np.uint64), 1, 0
    power, scale, total = BASE, 1, np.zeros(n, dtype=np.uint64)
    while True:
        if q & width:
            total += part[done:done + n] * np.uint64(scale)
            done, scale = done + width, scale * power % (1 << 64)
        if done == q:
            return total
        part = part[:-width] + part[width:] * np.uint64(power)
        width, power = width * 2, power * power % (1 << 64)


def _least_so_far(values: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Running minimum along each row that begins anew where the number of the stretch changes; by doubling."""
    out, shift = values.copy(), 1
    while shift < out.shape[1]:
        same = stretch[:, shift:] == stretch[:, :-shift]
        out[:, shift:] = np.where(same, np.minimum(out[:, shift:], out[:, :-shift]), out[:, shift:])
        shift *= 2
    return out


class Items:
    """One block of benchmark items: their codes, edit budgets and the index of their q-grams."""

    def __init__(self, rows: list[tuple[int, str]], rate: float = EDIT_RATE, q: int = Q):
        kept = [(number, codes) for number, text in rows if len(codes := normalised(text or "")[0])]
        self.ids = np.array([number for number, _ in kept], dtype=np.int64)
        self.codes = [codes for _, codes in kept]
        self.size = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.q = np.minimum(self.size, q)
        # the largest budget within the rate for which the lemma still asks for one shared gram
        self.budget = np.maximum(np.minimum((rate * self.size).astype(np.int64), (self.size - self.q) // self.q), 0)
        self.need = self.size - self.q + 1 - self.budget * self.q
        self.reach = int((self.size + self.budget).max(initial=0)) + 1
        self.index = {int(width): self._index(int(width)) for width in np.unique(self.q)}

    def _index(self, width: int):
        own = np.flatnonzero(self.q == width)
        grams = [gram_hashes(self.codes[i], width) for i in own]
        hashes = mix(np.concatenate(grams))
        item = np.repeat(own, [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(hashes, kind="stable")
        hashes, item, place = hashes[order], item[order], place[order]
        table = np.zeros(1 << TABLE_BITS, dtype=bool)
        table[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        names, first = np.unique(hashes, return_index=True)
        return table, names, np.concatenate([first, [len(hashes)]]), item, place

    def hits(self, codes: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Text position, item and item position of all shared grams, and the position that the next hits begin at.

        In text order and at most ``STEP_HITS`` at a time, for a gram may recur in an item as often as in the text.
        """
        table, names, first, item, place = self.index[width]
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for begin in range(0, len(codes) - width + 1, STEP_GRAMS):
            hashes = mix(gram_hashes(codes[begin:begin + STEP_GRAMS + width - 1], width))
            some = np.flatnonzero(table[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            name = np.minimum(np.searchsorted(names, hashes[some]), len(names) - 1)
            same = names[name] == hashes[some]
            parts.append((some[same] + begin, name[same]))
        at, found = (np.concatenate(x) for x in zip(*parts))
        ends = np.cumsum(first[found + 1] - first[found])
        total = int(ends[-1]) if len(ends) else 0
        for begin in range(0, total, STEP_HITS):
            hit = np.arange(begin, min(begin + STEP_HITS, total))
            owner = np.searchsorted(ends, hit, side="right")
            run = first[found[owner] + 1] - ends[owner] + hit
            following = int(at[np.searchsorted(ends, hit[-1] + 1, side="right")]) if hit[-1] + 1 < total else len(codes)
            yield at[owner], item[run], place[run], following

    def regions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and first diagonals of the bands that reach the lemma's bound.

        Bands are counted while the text is gone through; one that no further position can add to is judged and
        forgotten, so that no more are held than an item's length of text has.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        span = 2 * len(codes) + 3
        for width in self.index:
            key, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at, item, own, following in self.hits(codes, width):
                stride = self.budget[item] + 1
                diagonal = at - own + len(codes)  # kept positive
                band = diagonal // stride
                # a band of width 2k + 1 starts at each multiple of k + 1; a diagonal lies in one or two of them
                second = diagonal - band * stride < self.budget[item]
                key = np.concatenate([key, item * span + band, (item * span + band - 1)[second]])
                place = np.concatenate([place, own, own[second]])
                # a gram of the item counts once in a band
                order = np.lexsort((place, key))
                key, place = key[order], place[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
                key, place = key[new], place[new]
                item = key // span
                last = (key - item * span) * (self.budget[item] + 1) - len(codes) + 2 * self.budget[item] + self.size[item]
                done = last < following if following < len(codes) else np.ones(len(key), bool)
                names, count = np.unique(key[done], return_counts=True)
                good = names[count >= self.need[names // span]]
                item = good // span
                found.append((item, (good - item * span) * (self.budget[item] + 1) - len(codes)))
                key, place = key[~done], place[~done]
        return tuple(np.concatenate(x) for x in zip(*found))

    def align(self, codes: np.ndarray, item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edits (or -1 beyond the budget), start and end of the best alignment of each item within its band.

        All regions advance together, one item character a step; cells hold cost and start in one integer.
        An alignment lies within one text: none leads over a border.
        """
        n = len(item)
        edits, left, right = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.argsort(self.size[item], kind="stable")
        while len(order):
            # the longest item sets the width of a part's tables
            rows = int(np.searchsorted(np.arange(1, len(order) + 1) * (self.size + 16 * self.budget)[item[order]], STEP_CELLS, side="right"))
            part, order = order[:max(rows, 1)], order[max(rows, 1):]
            edits[part], left[part], right[part] = self._align(codes, item[part], start[part])
        return edits, left, right

    def _align(self, codes, item, start):
        budget, size = self.budget[item], self.size[item]
        lane = np.arange(2 * int(budget.max()) + 1)
        unit = np.int64(1) << 32
        far, climb = unit << 20, lane * unit
        pattern = np.zeros((len(item), int(size.max())), dtype=np.int64)
        for i, k in enumerate(item):
            pattern[i, :size[i]] = self.codes[k]
        padded = np.concatenate([codes.astype(np.int64), [-1]])
        best = np.full((len(item), 2), far)
        live, column = np.arange(len(item)), start[:, None] + lane
        own = lane <= 2 * budget[:, None]
        cell = np.where(own & (column >= 0) & (column <= len(codes)), column + len(codes), far)
        for row in range(int(size.max()) + 1):
            ended = size[live] == row
            if ended.any():
                best[live[ended], 0] = cell[ended].min(axis=1)
                best[live[ended], 1] = column[ended, cell[ended].argmin(axis=1)]
            # a region none of whose cells is within the budget is given up
            keep = ~ended & (cell.min(axis=1) // unit <= budget[live])
            if not keep.all():
                live, cell, column, own = live[keep], cell[keep], column[keep], own[keep]
            if not len(live):
                break
            letter = padded[np.where((column >= 0) & (column < len(codes)), column, len(codes))]
            step = cell + np.where(letter == pattern[live, row][:, None], 0, unit)
            # no step leads over the border of two texts
            wall = letter == BORDER
            step[(letter < 0) | wall] = far
            # the item's character has no partner: from the next lane of the row before
            step[:, :-1] = np.minimum(step[:, :-1], cell[:, 1:] + unit)
            # a text character has no partner: along the row, one edit a lane
            cell = np.minimum.accumulate(step - climb, axis=1) + climb
            walled = np.flatnonzero(wall.any(axis=1))
            if len(walled):
                cell[walled] = _least_so_far(step[walled] - climb, np.cumsum(wall[walled], axis=1)) + climb
            column = column + 1
            cell[~(own & (column >= 0) & (column <= len(codes)))] = far
        cost = best[:, 0] // unit
        good = cost <= budget
        return np.where(good, cost, -1), np.where(good, best[:, 0] % unit - len(codes), 0), np.where(good, best[:, 1], 0)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """``text, item, edits, start, end`` of the best quotation of each item in each text; offsets in code points."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not len(self.ids):
            return []
        parts: list[tuple[int, int, np.ndarray]] = []  # text, offset in its compared form, codes
        places: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> None:
            border = np.full(1, BORDER, dtype=np.uint32)
            codes = np.concatenate([x for _, _, piece in parts for x in (piece, border)])
            begin = np.concatenate([[0], np.cumsum([len(piece) + 1 for _, _, piece in parts])])
            item, start = self.regions(codes)
            order = np.lexsort((start, item))
            item, start = item[order], start[order]
            # texts that a region's first and last character lie in
            ends = [np.searchsorted(begin, np.clip(x, 0, len(codes) - 1), side="right") - 1 for x in (start, start + 2 * self.budget[item] + self.size[item])]
            inside = np.where(ends[0] == ends[1], ends[0], -1)
            left_over, most = np.arange(len(item)), 4
            while len(left_over):
                # first regions first: behind a quotation without edits none of its text is better
                turn = np.arange(len(left_over)) - np.searchsorted(item[left_over], item[left_over])
                now, left_over = left_over[turn < most], left_over[turn >= most]
                edits, left, right = self.align(codes, item[now], start[now])
                exact = set()
                for i in np.flatnonzero(edits >= 0):
                    k = int(np.searchsorted(begin, left[i], side="right")) - 1
                    text, offset, piece = parts[k]
                    low, high = left[i] - begin[k], min(right[i] - begin[k], len(piece))
                    at = places[text]
                    entry = (int(edits[i]), int(at[offset + low]) if offset + low < len(at) else 0, int(at[offset + max(high - 1, low)]) + 1)
                    key = (text, int(item[now[i]]))
                    if key not in found or entry < found[key]:
                        found[key] = entry
                    if not edits[i]:
                        exact.add((int(item[now[i]]), k))
                if exact and len(left_over):
                    left_over = left_over[[pair not in exact for pair in zip(item[left_over].tolist(), inside[left_over].tolist())]]
                most *= 8

        for number, text in enumerate(texts):
            if not text:
                continue
            codes, places[number] = normalised(text)
            step = max(STEP_CHARS, 4 * self.reach)
            for offset in range(0, max(len(codes) - self.reach, 1), step):
                piece = codes[offset:offset + step + self.reach]
                parts.append((number, offset, piece))
                size += len(piece)
                if size >= step:
                    flush()
                    parts, size, places = [], 0, {number: places[number]}
        if parts:
            flush()
        return [(text, int(self.ids[item]), *entry) for (text, item), entry in sorted(found.items())]


def _held(block: tuple[str, list[tuple[int, str]]], rate: float) -> Items:
    """The index of a block's items; a Python worker makes it once for all its tasks and holds one at a time."""
    name = f"{block[0]} {rate}"
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Items(block[1], rate)
    return _HELD[name]


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The distinct items with a text, block by block; an item longer than a block is a block of its own, roughly."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, ceil(total / block_chars))
    for block in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield [(r.item_id, r.text) for r in sorted(part.collect())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """``doc_id, item_id, edits, start, end``: each benchmark item that a document quotes within the edit budget.

    The budget is ``rate`` times the item's length, at most what the q-gram lemma can filter; an item shorter than a
    q-gram must be quoted exactly. Offsets are code points of the document and span its best quotation (fewest edits,
    then the first). Items without a letter or digit, null items and null or empty texts match nothing. Rows that repeat
    an id are searched each, and their results appear each. Without benchmark rows the result is empty.
    """
    bounded_batches(docs.sparkSession, rows=500, size=2 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    schema = "doc_id long, item_id long, edits int, start long, end long"

    def pass_over(block: list[tuple[int, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast((uuid4().hex, block))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _held(shared.value, rate)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = items.search(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_pylist([
                    {"doc_id": ids[t], "item_id": i, "edits": e, "start": s, "end": x} for t, i, e, s, x in found
                ], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()),
                                     ("start", pa.int64()), ("end", pa.int64())]))
            release_memory()

        return rows.mapInArrow(run, schema)

    out = None
    for block in benchmark_blocks(benchmark):
        found = pass_over(block)
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs`` that quote no benchmark item; all columns stay as they are.

    Each block of the benchmark is a filter inside the same stage, so documents are not shuffled. Null and empty texts stay.
    """
    bounded_batches(docs.sparkSession, rows=500, size=2 << 20)
    for block in benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast((uuid4().hex, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _held(shared.value, rate)
            for batch in batches:
                texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[t for t, *_ in items.search(texts)]] = False
                yield batch.filter(pa.array(keep))
            release_memory()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
