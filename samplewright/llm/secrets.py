"""Secret scans: fixed patterns, and encoded secrets that are reported only when their decoded structure holds.

Runs of base64 or hexadecimal letters are candidates. A candidate counts when its decoded bytes parse to the end: nested
lengths of a DER private or public key, the length-prefixed fields of an OpenSSH key, or the header of a signed token.
Key blocks between BEGIN and END marks count when their body passes the same tests.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import bounded_batches, release_memory, slabs, text_of

# Base patterns (fixed values); letters of the names count in either case, ASCII only.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

# What a text must hold for any pattern with a name, and for any with a run of letters, to match at all.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20}")

# Candidates for a structural look: a token of three parts, a marked key block, runs of encoded bytes.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])")
BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}?KEY)-----((?:(?!-----)[\s\S])*?)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
URL_SAFE = re.compile(r"[A-Za-z0-9_-]{40,}={0,2}")
DIGITS = re.compile(r"(?:[0-9A-Fa-f]{2}){20,}")

# Kinds in the order of spans that begin together.
KINDS = ("assign", "access", "hex", "token", "key")
_RANK = {kind: k for k, kind in enumerate(KINDS)}


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``start, kind, end`` of the base patterns, leftmost and without overlaps within a kind."""
    low = text.lower()
    found = []
    if any(name in low for name in NAMES):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if RUN.search(text):
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def unbase64(text: str) -> bytes | None:
    """Bytes of base64 or base64url letters without white space; padding may lack."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """Value of a DER length and where the content begins."""
    if at >= len(data):
        return None
    if data[at] < 0x80:
        return data[at], at + 1
    count = data[at] & 0x7F
    if not 1 <= count <= 4 or at + 1 + count > len(data) or data[at + 1] == 0:
        return None
    value = int.from_bytes(data[at + 1:at + 1 + count], "big")
    return (value, at + 1 + count) if value >= 0x80 else None


def _elements(data: bytes, first: int, last: int) -> list[tuple[int, int, int]] | None:
    """``tag, start, end`` of the elements that fill ``[first, last)``, constructed ones checked throughout."""
    top: list[tuple[int, int, int]] = []
    todo = [(first, last, top)]
    while todo:
        at, end, out = todo.pop()
        while at < end:
            size = _length(data, at + 1)
            if size is None or size[1] + size[0] > end:
                return None
            tag, start, stop = data[at], size[1], size[1] + size[0]
            if tag == 0:
                return None
            if out is not None:
                out.append((tag, start, stop))
            if tag & 0x20:
                todo.append((start, stop, None))
            at = stop
    return top


def der_key(data: bytes) -> bool:
    """Whether the bytes are one DER sequence, nested lengths and all, with the shape of a key."""
    whole = _elements(data, 0, len(data)) if data[:1] == b"\x30" and len(data) >= 24 else None
    if not whole or len(whole) != 1:
        return False
    parts = _elements(data, whole[0][1], whole[0][2])
    tags = [tag for tag, _, _ in parts or []]
    if tags[:3] == [0x02, 0x30, 0x04]:  # private key with algorithm
        return True
    if tags[:2] == [0x02, 0x04] and parts[0][2] - parts[0][1] == 1:  # elliptic-curve private key
        return True
    if len(tags) >= 6 and set(tags) == {0x02}:  # private key as a row of integers
        return True
    if tags == [0x30, 0x04]:  # encrypted private key
        return True
    if tags == [0x30, 0x03]:  # public key with algorithm: the identifier must be there
        algorithm = _elements(data, parts[0][1], parts[0][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def ssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key or a public key blob: names and length-prefixed fields to the end."""

    def field(at: int) -> tuple[bytes, int] | None:
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at:at + 4], "big")
        return (data[at + 4:at + 4 + size], at + 4 + size) if at + 4 + size <= len(data) else None

    mark = b"openssh-key-v1\x00"
    if data.startswith(mark):
        at = len(mark)
        for _ in range(3):  # cipher, derivation, options
            part = field(at)
            if part is None:
                return False
            at = part[1]
        if at + 4 > len(data):
            return False
        count, at = int.from_bytes(data[at:at + 4], "big"), at + 4
        for _ in range(min(count, 64) + 1):
            part = field(at)
            if part is None:
                return False
            at = part[1]
        return 1 <= count <= 64 and at == len(data)
    part = field(0)
    if part is None or not re.fullmatch(rb"(ssh|ecdsa|sk-ssh)-[a-z0-9@.-]{3,40}", part[0]):
        return False
    at, fields = part[1], 0
    while part is not None and at < len(data):
        part = field(at)
        if part is not None:
            at, fields = part[1], fields + 1
    return part is not None and fields >= 1


def is_key(data: bytes | None) -> bool:
    return data is not None and (der_key(data) or ssh_key(data))


def signed_token(header: str, payload: str) -> bool:
    """Whether the parts of a token are JSON objects and the header names an algorithm."""
    try:
        head, body = (json.loads(unbase64(part) or b"") for part in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """``start, kind, end`` of the candidates whose structure holds."""
    found = [(m.start(), "token", m.end()) for m in TOKEN.finditer(text) if signed_token(m[1], m[2])] if "eyJ" in text else []
    covered: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        for m in BLOCK.finditer(text):
            body = "".join(line for line in m[2].split() if ":" not in line and "," not in line)
            if is_key(unbase64(body)) or ("ENCRYPTED" in m[2] and len(unbase64(body) or b"") >= 64):
                found.append((m.start(), "key", m.end()))
                covered.append(m.span())
    for pattern, decode in ((BASE64, unbase64), (URL_SAFE, unbase64), (DIGITS, bytes.fromhex)) if RUN.search(text) else ():
        for m in pattern.finditer(text):
            if any(a <= m.start() and m.end() <= b for a, b in covered):
                continue
            data = decode(m[0])
            if data is not None and data[:1] in (b"\x30", b"\x00", b"o") and is_key(data):
                found.append((m.start(), "key", m.end()))
    return list(dict.fromkeys(found))


def all_spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The base spans and all spans, each by start and then kind."""

    def order(span):
        return span[0], _RANK[span[1]], span[2]

    base = base_spans(text)
    return sorted(base, key=order), sorted(base + confirmed_spans(text), key=order)


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every stretch that a span covers replaced by ``[SECRET]``."""
    out, at = [], 0
    first, last = -1, -1
    for start, _, end in [*spans, (len(text) + 1, "", 0)]:
        if start <= last:
            last = max(last, end)
            continue
        if last >= 0:
            out += [text[at:first], "[SECRET]"]
            at = last
        first, last = start, end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed`` of every row.

    Spans are ``kind:start:end`` in code points, end exclusive. A null or empty text has no spans; rows are independent, so
    null and repeated ids and further columns do not matter.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch):
                rows = []
                for text in slab.column("text").to_pylist():
                    base, spans = all_spans(text)
                    kinds = [kind for _, kind, _ in base]
                    rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
                                 hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [slab.column("doc_id"), *(pa.array(columns[i], type=kind) for i, kind in enumerate(
                        [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]))],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def without_secrets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with secrets replaced in ``text`` and ``n_chars``, where there is one, counted anew.

    No row goes; a null text stays null, and rows without a secret stay as they are.
    """
    bounded_batches(docs.sparkSession, rows=500, size=2 << 20)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch):
                texts = slab.column(names.index("text")).to_pylist()
                spans = [all_spans(t)[1] if t else [] for t in texts]
                columns = {name: slab.column(i) for i, name in enumerate(names)}
                clean = [redacted(t, s) if s else t for t, s in zip(texts, spans)]
                columns["text"] = pa.array(clean, type=slab.column(names.index("text")).type)
                if "n_chars" in columns:
                    kind = columns["n_chars"].type
                    columns["n_chars"] = pa.array([len(c) if s else n for c, s, n in zip(clean, spans, columns["n_chars"].to_pylist())], type=kind)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)
        release_memory()

    return docs.mapInArrow(run, docs.schema)
