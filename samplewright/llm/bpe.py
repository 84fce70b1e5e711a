"""Byte-level BPE: encoding by batched merge rounds in numpy, decoding by gathering bytes.

A text is cut at single spaces (or, where spaces are less plain, into its words); each task keeps the ids of the parts it
has met, up to a byte bound, and encodes the words of new parts together. The symbols of all of them lie in one flat array. A round looks every neighbouring pair up in the
sorted pair keys of the vocabulary, finds each word's lowest rank, and merges its occurrences from the left; words
without a known pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import bounded_batches, release_memory, slabs, text_of

# Letters and numbers of later Unicode versions than the vocabulary's pre-tokenizer knows. To it they are
# neither, whatever version the regular expressions of an executor have.
NEWER_LETTERS = (
    "\u0558 \u058B-\u058C \u088F \u0C5C \u0CDC \u208F \u209D-\u209F \uA7CE-\uA7CF \uA7D2 \uA7D4 \uA7DD \uA7E2 \uA7F1 \uAB6C-\uAB6D "
    "\U000107BB-\U000107BF \U00010940-\U00010959 \U00010EC5-\U00010EC7 \U00010ED9-\U00010EEE \U00011B0A \U00011DB0-\U00011DDB "
    "\U00011DF1 \U00016EA0-\U00016EB8 \U00016EBB-\U00016ED3 \U00016FF2-\U00016FF3 \U000187F8-\U000187FF \U00018CD6-\U00018CDA "
    "\U00018D09-\U00018D20 \U00018D80-\U00018DF2 \U00018E00-\U00019191 \U000191A0-\U000191D2 \U0001B123-\U0001B128 \U0001B168 "
    "\U0001D6A6 \U0001DF1F-\U0001DF24 \U0001DF2B-\U0001DF81 \U0001DF90-\U0001DF96 \U0001DFCD-\U0001DFFF \U0001E6C0-\U0001E6DE "
    "\U0001E6E0-\U0001E6E2 \U0001E6E4-\U0001E6E5 \U0001E6E7-\U0001E6ED \U0001E6F0-\U0001E6F4 \U0001E6FE-\U0001E6FF \U0002B73A-\U0002B73F "
    "\U0002B81E \U0002CEA2-\U0002CEAD \U000323B0-\U00033479 \U0003D000-\U0003FC3F"
)
NEWER_NUMBERS = "\U00011DE0-\U00011DE9 \U0001246F \U00012475-\U0001247F \U00012550-\U00012686 \U00016FF4-\U00016FF6"
LETTER, NUMBER = (r"[\p{%s}--[%s]]" % (name, newer.replace(" ", "")) for name, newer in (("L", NEWER_LETTERS), ("N", NEWER_NUMBERS)))
# The pattern that cuts a text into words (fixed value of the vocabulary's pre-tokenizer).
PATTERN = rf"""(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"""

# A word of Latin letters after a space, perhaps with a full stop or comma: cut as the pattern would, without it.
PLAIN = re.compile("([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([.,]?)").fullmatch
# White space that is neither a space nor a line feed.
OTHER_SPACE = re.compile(r"[^\S \n]")
# Bytes of words and their ids that a task keeps: those met since the newer half of the memory was begun, and those of the half
# before. Results do not depend on it.
CACHE_BYTES = 32 << 20
# A kept word takes this besides its letters and ids: a string, a number and their place in a table that may just have doubled.
WORD_BYTES = 260
# Ids that are turned into bytes at a time.
DECODED_IDS = 1 << 16
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary: itself, or the next free one from U+0100."""
    letters, free = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            letters[chr(byte)] = byte
        else:
            letters[chr(free)] = byte
            free += 1
    return letters


def enlarged(array: np.ndarray, length: int) -> np.ndarray:
    """The array with room for ``length`` values, its own first."""
    if length <= len(array):
        return array
    out = np.zeros(max(length, 2 * len(array)), dtype=array.dtype)
    out[:len(array)] = array
    return out


def gathered(store: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``begin, size`` of the store with the given numbers side by side, and their sizes."""
    size = size[number]
    ends = np.cumsum(size)
    place = np.repeat(begin[number] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return store[place], size


class Memory:
    """Words with a number each, and where a word's ids lie in one flat array."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.store, self.used = np.zeros(1 << 14, dtype=np.uint32), 0
        self.begin, self.size = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)

    def remember(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.known), len(self.known) + len(words)
        self.store = enlarged(self.store, self.used + len(ids))
        self.begin, self.size = enlarged(self.begin, last), enlarged(self.size, last)
        self.store[self.used:self.used + len(ids)] = ids
        self.begin[first:last] = self.used + np.cumsum(sizes) - sizes
        self.size[first:last] = sizes
        self.known.update(zip(words, range(first, last)))
        self.used += len(ids)
        # letters beyond Latin-1 take up to four bytes each; the arrays may just have doubled
        self.bytes += sum(len(w) if w.isascii() else 4 * len(w) for w in words) + 8 * len(ids) + WORD_BYTES * len(words)

    def recall(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words side by side, and how many each has."""
        number = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        return gathered(self.store, self.begin, self.size, number)


class Vocabulary:
    """Arrays made from a tokenizer file: byte ids, sorted pair keys with rank and merged id, bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], byte_letters()
        ids: dict[str, int] = model["vocab"]
        self.byte_id = np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.byte_id[byte] = ids[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        added = {token["content"]: token["id"] for token in content["added_tokens"]}
        self.added = added
        top = max([*ids.values(), *added.values()]) + 1
        pieces = [b""] * top
        for token, number in ids.items():
            pieces[number] = bytes(letters[c] for c in token)
        for token, number in added.items():
            pieces[number] = token.encode()
        self.length = np.array([len(p) for p in pieces], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.old, self.young = Memory(), Memory()

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NO_RANK`` where unknown) and index of each pair, by binary search."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NO_RANK), at

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), size)
        rank, at = np.full(len(symbols), NO_RANK, dtype=np.int32), np.zeros(len(symbols), dtype=np.int64)
        changed = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            n = len(symbols)
            # only pairs next to a merge have to be looked up again
            inner = changed[(changed >= 0) & (changed < n - 1)]
            rank[changed[changed >= 0]] = NO_RANK
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[inner], at[inner] = self.look_up(symbols[inner], symbols[inner + 1])
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.concatenate([first, [n]]))
            over = np.repeat(lowest == NO_RANK, sizes)
            if over.any():
                done.append((owner[over], symbols[over]))
            # in a run of overlapping occurrences (aaa) every second one counts, from the left
            places = np.flatnonzero((rank == np.repeat(lowest, sizes)) & ~over)
            new_run = np.concatenate([[True], np.diff(places) > 1]) if len(places) else np.zeros(0, bool)
            places = places[(np.arange(len(places)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]) % 2 == 0]
            symbols[places] = self.made[at[places]]
            keep = ~over
            keep[places + 1] = False
            moved = (np.cumsum(keep) - 1)[places]
            changed = np.concatenate([moved, moved - 1])
            symbols, owner, rank, at = symbols[keep], owner[keep], rank[keep], at[keep]
        if not done:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(words), dtype=np.int64)
        owner, ids = np.concatenate([o for o, _ in done]), np.concatenate([s for _, s in done])
        return ids[np.argsort(owner, kind="stable")].astype(np.uint32), np.bincount(owner, minlength=len(words))

    def pieces(self, text: str) -> list[str]:
        """Added tokens and words of a text, in order."""
        if self.split is None or not any(token in text for token in self.added):
            return self.words.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.split.split(text)):
            out += [part] if i % 2 else self.words.findall(part)
        return out

    def units(self, text: str) -> list[str]:
        """Keys of the parts of a text that are encoded on their own.

        No word reaches over a single space between other characters, so a text with no other spaces is cut there: the
        part after a space has itself as key. Other texts are cut into their words. The key of a part that stands as it
        is begins with a space.
        """
        if not text:
            return []
        plain = not (text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text
                     or OTHER_SPACE.search(text) or any(token in text for token in self.added))
        if not plain:
            return [" " + piece for piece in self.pieces(text)]
        parts = text.split(" ")
        parts[0] = " " + parts[0]
        return parts

    def learn(self, keys: list[str]) -> None:
        """Encode new parts: the distinct words in them together, then their ids joined."""
        cut = []
        for key in keys:
            plain = PLAIN(key)
            if plain:
                cut.append([" " + plain[1], plain[2]] if plain[2] else [" " + key])
            elif key[1:] in self.added:
                cut.append([key[1:]])
            else:
                cut.append(self.words.findall(key[1:] if key[0] == " " else " " + key))
        number: dict[str, int] = {}
        order = np.array([number.setdefault(w, len(number)) for words in cut for w in words], dtype=np.int64)
        ids, size = self.encode_words([w for w in number if w not in self.added])
        if any(w in self.added for w in number):
            own = iter(np.split(ids, np.cumsum(size)[:-1]))
            parts = [np.array([self.added[w]], dtype=np.uint32) if w in self.added else next(own) for w in number]
            ids, size = np.concatenate(parts), np.array([len(p) for p in parts])
        ids, sizes = gathered(ids, np.cumsum(size) - size, size, order)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(words) for words in cut])]
        self.young.remember(keys, ids, np.diff(ends, prepend=0))

    @property
    def known_bytes(self) -> int:
        return self.young.bytes + self.old.bytes

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as unsigned 32-bit integers side by side, and the ``n + 1`` offsets of the texts in them."""
        if 2 * self.young.bytes > CACHE_BYTES:
            self.old, self.young = self.young, Memory()
        cut = [self.units(t) for t in texts]
        keys = list(chain.from_iterable(cut))
        missing = set(keys).difference(self.young.known)
        again = [key for key in missing if key in self.old.known]
        if again:
            self.young.remember(again, *self.old.recall(again))
        new = list(missing.difference(again))
        if new:
            self.learn(new)
        ids, size = self.young.recall(keys)
        last = np.cumsum([len(c) for c in cut], dtype=np.int64)
        return ids, np.concatenate([[0], np.concatenate([[0], np.cumsum(size)])[last]]).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        ids, offsets = self.encode_flat(texts)
        return np.split(ids, offsets[1:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        parts = (ids[first:first + DECODED_IDS].astype(np.int64) for first in range(0, len(ids), DECODED_IDS))
        return b"".join(gathered(self.bytes, self.start, self.length, part)[0].tobytes() for part in parts).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a Python worker and file."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and the ``ids`` themselves on request.

    ``path`` names a byte-level tokenizer file that every executor has. The ids are those of the whole text without
    truncation; the second digest is that of the text decoded from the ids. A null or empty text has no ids. Rows are
    independent, so null, repeated or clashing ids and other columns do not matter.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path)
        for batch in batches:
            for slab in slabs(batch):
                flat, offsets = tokens.encode_flat(slab.column("text").to_pylist())
                flat = flat.astype("<u4", copy=False)
                ids = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                columns = [
                    slab.column("doc_id"), pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], type=pa.string()),
                    pa.array([hashlib.sha256(tokens.decode(i).encode()).hexdigest() for i in ids], type=pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release_memory()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path)
        for batch in batches:
            texts = [tokens.decode(np.asarray(ids or [], dtype=np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
