"""Operators on texts against plain versions of what they compute."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import string
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from samplewright.llm import bpe, common, decontam, near_dup, pii, quality, secrets, toxicity, words
from samplewright.llm.common import QUERIES
from samplewright.llm.queries import tokenizer_path

SF_DIR = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t", "a", "word " * 3, "x" * 20_000, "é" * 5_000 + " ü", "<|endoftext|> it's  12 3", "same text of five words here"] + [
    "same text of five words here"]


def odd_docs(spark):
    """Nulls in all columns, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    rows = [(i, t, None, None, i, i) for i, t in enumerate(ODD)] + [(None, "no id", "en", "s", 1, 2), (9, ODD[9], "en", "s", None, None), (9, "another text under one id", "en", "s", 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, id long")


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


# ---- op1


def plain_form(text):
    return re.sub(r"[\W_]+", " ", "".join(c.lower() if len(c.lower()) == 1 else c for c in text)).strip()


def least_edits(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_leaks_match_plain_alignment():
    rng = random.Random(5)
    for _ in range(60):
        item = "".join(rng.choices("abcd ef", k=rng.randint(3, 130)))
        quoted = list(item)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(quoted)) if quoted else 0
            kind = rng.random()
            if kind < 0.4 and quoted:
                quoted[at] = rng.choice("abcdef")
            elif kind < 0.7 and quoted:
                del quoted[at]
            else:
                quoted.insert(at, rng.choice("abcdef"))
        text = "".join(rng.choices("abcdef ", k=rng.randint(0, 70))) + "".join(quoted) + "".join(rng.choices("abcdef ", k=rng.randint(0, 70)))
        items = decontam.Items([(7, item)])
        if not len(items.ids):
            continue
        edits = least_edits(plain_form(item), plain_form(text))
        found = items.search([text])
        assert [f[2] for f in found] == ([edits] if edits <= items.budget[0] else [])


def test_leaks_in_long_texts_and_spans(monkeypatch):
    monkeypatch.setattr(decontam, "STEP_CHARS", 500)
    item = "The answer, of course, is forty-two apples and nine pears."
    text = "filler words go here. " * 200 + "the ANSWER of course is forty two apples and nine pears" + " more filler" * 300
    (found,) = decontam.Items([(1, item)]).search([text])
    assert text[found[3]:found[4]] == "the ANSWER of course is forty two apples and nine pears" and found[2] == 0


def test_leaks_stay_within_one_text():
    rng = random.Random(11)
    item = "".join(rng.choices(string.ascii_lowercase, k=100))
    items = decontam.Items([(7, item)])
    budget = int(items.budget[0])
    clean = "a clean text without any of it zzzz"
    for missing in range(1, budget + 1):
        assert items.search([clean, item[missing:] + " tail"]) == [(1, 7, missing, 0, 100 - missing)]
        assert items.search([clean, item[missing:] + " tail"]) == [(t + 1, *x) for t, *x in items.search([item[missing:] + " tail"])]
        assert items.search([item[:-missing], "qqqq" + clean]) == [(0, 7, missing, 0, 100 - missing)]
        # short texts between, so that several borders lie within the band
        assert items.search([clean, "z", "", "z", item[missing:], "z"]) == [(4, 7, missing, 0, 100 - missing)]
    # an item in two texts, half in each, is quoted in neither
    assert items.search([clean + item[:50], item[50:] + clean]) == []
    for _ in range(200):
        short = "".join(rng.choices("ab", k=40))
        one = decontam.Items([(1, short)])
        texts = ["".join(rng.choices("ab", k=rng.randint(0, 3))) + short[rng.randint(0, 2):40 - rng.randint(0, 2)] if rng.random() < 0.4
                 else "".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(6)]
        assert one.search(texts) == [(t, *x) for t, text in enumerate(texts) for _, *x in one.search([text])]


def test_bands_are_counted_alike_in_steps(monkeypatch):
    """Small steps cut positions, bands and texts; the regions and what is found stay the same."""
    rng = random.Random(2)
    for _ in range(12):
        rows = [(i, "".join(rng.choices("ab ", k=rng.randint(1, 90)))) for i in range(6)] + [(9, "ha " * rng.randint(5, 40))]
        texts = ["".join(rng.choices("ab ", k=rng.randint(0, 200))) + rows[rng.randrange(7)][1] + "ha " * rng.randint(0, 60) for _ in range(4)]
        codes = decontam.normalised(" ".join(texts))[0]
        whole = decontam.Items(rows)
        wanted, found = sorted(zip(*map(list, whole.regions(codes)))), whole.search(texts)
        plain = set()
        for i, m in enumerate(whole.size):
            k, q = int(whole.budget[i]), int(whole.q[i])
            grams = [whole.codes[i][p:p + q].tobytes() for p in range(m - q + 1)]
            places = {}
            for at in range(len(codes) - q + 1):
                places.setdefault(codes[at:at + q].tobytes(), []).append(at)
            for first in range(-(len(codes) // (k + 1) + 2) * (k + 1), len(codes) + k + 1):
                if (first + len(codes)) % (k + 1) == 0 and sum(any(first <= at - p <= first + 2 * k for at in places.get(g, [])) for p, g in enumerate(grams)) >= whole.need[i]:
                    plain.add((i, first))
        assert set(wanted) == plain
        monkeypatch.setattr(decontam, "STEP_HITS", rng.choice([1, 7, 50]))
        monkeypatch.setattr(decontam, "STEP_CELLS", 1000)
        assert sorted(zip(*map(list, whole.regions(codes)))) == wanted and whole.search(texts) == found
        monkeypatch.undo()


def test_a_repeated_phrase_stays_in_memory():
    items = decontam.Items([(7, "ha " * 100)])
    text = "well " + "ha " * 160_000
    tracemalloc.start()
    begin = time.perf_counter()
    assert items.search([text]) == [(0, 7, 0, 5, 5 + 299)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20 and time.perf_counter() - begin < 60


def test_leaks_on_tables(spark):
    docs, items = documents(spark), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()}
    texts = [(r.doc_id, plain_form(r.text)) for r in docs.collect()]
    wanted = {(d, i.item_id) for i in items.collect() for d, t in texts if plain_form(i.text) in t}
    assert wanted and wanted <= found
    kept = {r.doc_id for r in decontam.decontaminated(docs, items).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _ in found}
    blocks = list(decontam.benchmark_blocks(items, block_chars=2000))
    assert len(blocks) > 1 and sum(map(len, blocks)) == items.count()


def test_leaks_on_odd_rows(spark):
    items = spark.createDataFrame([(1, "same text of five words here", "x"), (2, None, "x"), (None, "no id", "x"), (3, "...", "x")], "item_id long, text string, doc_id string")
    docs = odd_docs(spark)
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()) == [(9, 1), (9, 1), (10, 1)]
    kept = decontam.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert decontam.find_leaks(docs.limit(0), items).count() == 0 and decontam.find_leaks(docs, items.limit(0)).count() == 0


def test_leaks_are_searched_in_little_memory(monkeypatch):
    """grams are hashed piece by piece; those of a whole step took 25 MB for a million characters."""
    rng = random.Random(21)
    item = " ".join("".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(12))
    filler = "".join(rng.choices(string.ascii_lowercase + " ", k=1 << 20))
    items, codes = decontam.Items([(3, item)]), decontam.normalised(f"{filler[:400_000]} {item} {filler[400_000:]}")[0]
    tracemalloc.start()
    found = [np.concatenate(x) for x in zip(*((at, place) for at, _, place, _ in items.hits(codes, decontam.Q)))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20
    monkeypatch.setattr(decontam, "STEP_GRAMS", 1 << 30)
    whole = [np.concatenate(x) for x in zip(*((at, place) for at, _, place, _ in items.hits(codes, decontam.Q)))]
    assert len(whole[0]) >= len(item) - decontam.Q + 1 and all(np.array_equal(x, y) for x, y in zip(found, whole))
    # grams that lie across the pieces
    monkeypatch.setattr(decontam, "STEP_GRAMS", 7)
    short = decontam.normalised(f"before {item} after")[0]
    pieces = [at for at, *_ in items.hits(short, decontam.Q)][0]
    assert list(pieces) == list(range(7, 7 + len(item) - decontam.Q + 1))
    assert decontam.Items([(3, item)]).search(["tiny", item]) == [(1, 3, 0, 0, len(item))]



# ---- op2


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    assert path == public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = list(" \n\t'sSdlvr aAéñ中1２½.,!\u0085\x1c_ ") + ["<|endoftext|>", "<|endof", "'ll", "'re", "    "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, "=-" * 2000, "x" * 9000 + "yz" * 500]
    texts += [t for t in ODD if t is not None] + [r.text for r in documents(spark).collect()]
    mine = bpe.Vocabulary(path)
    for text, ids in zip(texts, mine.encode(texts)):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted
        assert mine.decode(ids) == library.decode(wanted, skip_special_tokens=False)
    assert mine.decode(np.array([mine.byte_id[0xC3]])) == "�"


def test_bpe_letters_of_every_code_point():
    from tokenizers import Tokenizer

    tokens, library = bpe.Vocabulary(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for first in range(0, len(points), 20_000):
        text = " ".join(f"{chr(c)}'s{chr(c)}1" for c in points[first:first + 20_000])
        assert tokens.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_memory_is_counted():
    tokens = bpe.Vocabulary(tokenizer_path())
    words = [f"w{i:07d}{i * 7919 % 1000003}" for i in range(60_000)]
    tracemalloc.start()
    for first in range(0, len(words), 5000):
        tokens.learn([" " + w for w in words[first:first + 5000]])
    del words
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert 0.5 * held < tokens.known_bytes and held < 1.1 * tokens.known_bytes


def test_bpe_rows(spark):
    rows = bpe.encode(odd_docs(spark), tokenizer_path(), with_ids=True).collect()
    assert len(rows) == len(ODD) + 3
    for row in rows:
        assert row.n_tokens == len(row.ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(row.ids, dtype="<u4").tobytes()).hexdigest()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].n_tokens == 0 and by_id[6].decoded_sha256 == hashlib.sha256(ODD[6].encode()).hexdigest()
    back = bpe.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in rows[:9]] + [(77, None)], "doc_id long, ids array<int>"), tokenizer_path())
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD[:9])} | {77: ""}
    assert bpe.encode(odd_docs(spark).limit(0), tokenizer_path()).count() == 0


def test_bpe_cache_limit(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 100)
    tokens = bpe.Vocabulary(tokenizer_path())
    texts = ["alpha beta", "gamma delta", "alpha beta"]
    assert [tokens.encode([t])[0].tolist() for t in texts] == [i.tolist() for i in bpe.Vocabulary(tokenizer_path()).encode(texts)]


def test_filter_of_ids_loses_none_and_spares_most_rows(spark):
    """Rows that can have no partner are told apart before any shuffle."""
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    rows = spark.range(30_000).withColumnRenamed("id", "doc_id")
    left = {r.doc_id for r in rows.where(common.perhaps_among("doc_id", ids)).collect()}
    assert set(range(0, 3000, 3)) <= left and len(left) < 2000
    assert rows.where(common.perhaps_among("doc_id", ids.limit(0))).count() == 0


# ---- op3, op8


def held_out_rows(spark, name, label, folds, rest):
    labels = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = QUERIES[name](spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == rest) and r.predicted == int(r.score >= 0.5) for r in rows)
    return [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


@pytest.mark.parametrize(("name", "label", "folds", "rest"), [("op3_quality", "quality", 3, 1), ("op8_toxicity", "toxic", 5, 0)])
def test_classifiers_on_the_held_out_fold(spark, name, label, folds, rest):
    rows = held_out_rows(spark, name, label, folds, rest)
    right = sum((s >= 0.5) == bool(y) for s, y in rows) / len(rows)
    assert len(rows) > 300 and right > 0.97
    ones, zeros = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert sum(a > b for a in ones for b in zeros) / (len(ones) * len(zeros)) > 0.96


@pytest.mark.parametrize(("operator", "label"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, operator, label):
    docs = odd_docs(spark).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(11)] + [(None, 1, 1, "x"), (3, None, None, "x"), (4, 7, 7, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    for used in (labels, labels.limit(0), labels.where(f"{label} = 1")):
        rows = operator(docs, used).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out in (True, False) for r in rows)
    assert operator(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.fold() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = ({r.doc_id: r.score for r in quality.quality(docs, x).collect()} for x in (labels, turned))
    assert first == second


# ---- op4


def plain_base(text):
    out = []
    name = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, m.end(), "assign") for m in name.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x81, len(body)]) if len(body) < 256 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def integer(n):
    return der(0x02, b"\x01" + bytes(range(1, n)))


def encoded_secrets():
    rsa = der(0x30, der(0x02, b"\x00"), *[integer(40) for _ in range(8)])
    wrapped = der(0x30, der(0x02, b"\x00"), der(0x30, der(0x06, b"\x2a\x86\x48"), der(0x05)), der(0x04, rsa))

    def field(x):
        return len(x).to_bytes(4, "big") + x

    ssh = b"openssh-key-v1\x00" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"public" * 4) + field(b"private" * 9)
    blob = field(b"ssh-ed25519") + field(bytes(range(32)))
    url = [base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})]
    b64 = [base64.b64encode(x).decode() for x in (rsa, wrapped, ssh, blob)]
    block = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(b64[0][i:i + 64] for i in range(0, len(b64[0]), 64)) + "\n-----END RSA PRIVATE KEY-----"
    return b64, rsa.hex().upper(), block, f"{url[0]}.{url[1]}.c2lnbmF0dXJl"


def test_secrets_confirmed_by_structure():
    b64, hexed, block, token = encoded_secrets()
    for text in (*b64, hexed):
        assert secrets.confirmed_spans(f"é {text} end") == [(2, "key", 2 + len(text))]
    assert secrets.confirmed_spans(f"x {block} y") == [(2, "key", 2 + len(block))]
    assert secrets.confirmed_spans(f"x {token} y") == [(2, "token", 2 + len(token))]
    cut = base64.b64encode(base64.b64decode(b64[0])[:-3]).decode()
    head = base64.urlsafe_b64encode(b'{"typ":"JWT"}').decode().rstrip("=")
    for text in (cut, "A" * 64, "abcd" * 20, f"{head}.{head}.c2lnbmF0dXJl", "-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----"):
        assert secrets.confirmed_spans(f"x {text} y") == []


def test_secrets_in_url_safe_letters():
    rng = random.Random(12)
    for n in range(60):
        private = der(0x30, integer(0), der(0x30, der(0x06, bytes([0x2A, 0x86, 0x48]))), der(0x04, rng.randbytes(1200)))
        public = der(0x30, der(0x30, der(0x06, bytes([0x2A, 0x86, 0x48]))), der(0x03, b"\0" + rng.randbytes(65)))
        field = b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b""))
        openssh = b"openssh-key-v1\0" + field + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (rng.randbytes(51), rng.randbytes(300)))
        for data in (private, public, openssh):
            for key in (base64.urlsafe_b64encode(data).decode(), base64.urlsafe_b64encode(data).decode().rstrip("="), base64.b64encode(data).decode()):
                text = f"see {key}, it is set"
                assert secrets.confirmed_spans(text) == [(4, "key", 4 + len(key))]
                assert secrets.redacted(text, secrets.all_spans(text)[1]) == "see [SECRET], it is set"


def test_secrets_are_replaced_in_little_memory(spark, monkeypatch):
    """a large batch is worked on in slabs, and the worker gives back what Arrow keeps after them."""
    docs = spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, n_chars int")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    plain, hidden = "words of a text " * 16_384, "words, password = abcdefgh12 " + "and more " * 16_384
    texts = [hidden if k % 3 == 0 else None if k % 7 == 0 else plain for k in range(32)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(32)), "text": texts, "n_chars": [-1] * 32},
                                       schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int32())]))
    given_back, pool = [], pa.default_memory_pool()

    class Pool:
        def release_unused(self):
            given_back.append(True)
            pool.release_unused()

    run = secrets.without_secrets(docs)
    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    out = list(run(iter([batch, batch.slice(0, 0)])))
    monkeypatch.undo()
    longest = max(len(hidden), len(plain))
    assert max(sum(len(t or "") for t in part.column("text").to_pylist()) for part in out) <= common.SLAB_BYTES + longest and given_back
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["doc_id"] for r in rows] == list(range(32))
    clean = hidden.replace("password = abcdefgh12", "[SECRET]")
    assert [(r["text"], r["n_chars"]) for r in rows] == [(clean, len(clean)) if t == hidden else (t, -1) for t in texts]


def test_secret_base_spans_match_plain_search(spark):
    rng = random.Random(2)
    parts = ["password", "Token", "api_key", "APIKEY", "ſecret", "secret", "passwd", ":", "=", " ", '"', "'", "abc", "abcdef12", "AKIA", "ABCDEFGH12345678", "é", "0123456789abcdef", "\n", "Kelvin"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(4000)] + [r.text for r in documents(spark).collect()] + ["secret=token: abcdef", *filter(None, ODD)]
    for text in texts:
        base, spans = secrets.all_spans(text)
        assert secrets.joined(base) == plain_base(text)
        assert set(base) <= set(spans)


def test_secret_rows(spark):
    rows = secrets.scan(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) + 3 and {r.spans for r in rows} == {""}
    b64, _, block, token = encoded_secrets()
    docs = spark.createDataFrame([(1, f"é password: hunter22 {token} and {b64[0]}", 5, "k"), (2, None, 0, None), (None, "token=abcdef", None, "k"), (4, "clean", 99, "k")],
                                 "doc_id long, text string, n_chars long, spans string")
    out = {r.doc_id: r for r in secrets.without_secrets(docs).collect()}
    assert secrets.without_secrets(docs).columns == docs.columns
    assert out[1].text == "é [SECRET] [SECRET] and [SECRET]" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[None].text == "[SECRET]" and out[4].n_chars == 99
    (row,) = [r for r in secrets.scan(docs).collect() if r.doc_id == 1]
    assert (row.n_assign, row.n_access, row.n_hex, row.n_confirmed) == (1, 0, 0, 2)
    assert row.base_sha256 == hashlib.sha256(b"assign:2:20").hexdigest()


# ---- op5


def luhn(number):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in number])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pseudonyms(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in pii.pseudonymised(docs, key).orderBy("doc_id").collect()]


def test_pii_formats_and_links(spark):
    texts = ["+1 (873) 555-4781", "(873) 555-4781", "873-555-4781", "4111 1111 1111 1111", "4111-1111-1111-1111", "2020-02-29", "29.02.2020", "02/29/2020", "123-45-6789",
             "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "27.134.213.116", "a.b@x.example.com", "A.B@x.example.com",
             "4111111111111112", "2021-02-29", "999.1.1.1", "000-12-3456", "DE88370400440532013000", "1.2.3", "v1.2.3.4.5", "no data", "", None]
    out = pseudonyms(spark, [t if t is None else f"é {t}, end" for t in texts])
    new = [r.text and r.text[2:-5] for r in out]
    for old, value in list(zip(texts, new))[:13]:
        assert value != old and len(value) == (8 + len("@x.example.com") if "@" in old else len(value))
        if "@" not in old and old != "27.134.213.116":
            assert re.sub("[0-9]", "0", value) == re.sub("[0-9]", "0", old)
    assert new[14:21] == texts[14:21] and [r.pii for r in out[14:]] == [[]] * 10

    def bare(x):
        return re.sub("[^0-9]", "", x)

    assert bare(new[1]) == bare(new[2]) == bare(new[0])[1:] and bare(new[3]) == bare(new[4]) and new[9].replace(" ", "") == new[10]
    assert luhn(bare(new[3])) and new[5].split("-") == new[6].split(".")[::-1] and new[7].split("/") == [new[5].split("-")[i] for i in (1, 2, 0)]
    assert int("".join(str(int(c, 36)) for c in new[10][4:] + new[10][:4])) % 97 == 1
    assert new[12].split("@")[0] == new[13].split("@")[0] and out[22].text == "é , end" and out[23].text is None
    assert pseudonyms(spark, ["4111111111111111"], "other")[0].text != pseudonyms(spark, ["4111111111111111"])[0].text


def plain_feistel(left, right, a, b, key, kind):
    for k in range(pii.ROUNDS):
        other = right if k % 2 == 0 else left
        add = int(hashlib.sha256(f"{key}:{kind}:{k}:{other}".encode()).hexdigest()[:15], 16)
        left, right = ((left + add) % a, right) if k % 2 == 0 else (left, (right + add) % b)
    return left, right


def test_pii_is_a_permutation(spark):
    days = spark.range(pii.DAYS[0] * pii.DAYS[1]).select(
        pii.feistel(F.floor(F.col("id") / pii.DAYS[1]), F.col("id") % pii.DAYS[1], F.lit(pii.DAYS[0]), F.lit(pii.DAYS[1]), "k", "date").alias("p"))
    assert days.distinct().count() == pii.DAYS[0] * pii.DAYS[1]
    digits = spark.range(1000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "phone").alias("d"))
    values = [r.d for r in digits.collect()]
    assert len(set(values)) == 1000 and all(re.fullmatch("[0-9]{3}", v) for v in values)
    left, right = plain_feistel(12, 3, 100, 10, "k", "phone")
    assert values[123] == f"{left:02d}{right}"
    assert {len(r.d) for r in spark.range(10).select(pii.permuted_digits(F.col("id").cast("string"), "k", "x").alias("d")).collect()} == {1}


def test_pii_rows(spark):
    docs = odd_docs(spark)
    out = pii.pseudonymised(docs, "k")
    assert out.columns == [*docs.columns, "pii"] and out.count() == docs.count()
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    before, after = ({(r.doc_id, r.text) for r in x.collect()} for x in (docs, out))
    assert before == after  # nothing personal in these texts
    with pytest.raises(ValueError):
        pii.pseudonymised(docs, "")
    whole = pii.pseudonymised(documents(spark).select("doc_id", "text"), "k").collect()
    number = re.compile(r"(?<!\d)\d{16}(?!\d)")
    old = {x for r in documents(spark).collect() for x in number.findall(r.text) if luhn(x)}
    new = {x for r in whole for x in number.findall(r.text)}
    assert old and not old & new


# ---- op9


def plain_sets(rows):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        out[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_components(sets):
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                a, b = top(x), top(y)
                parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def check_components(docs, rows):
    sets = plain_sets(rows)
    wanted = plain_components(sets)
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in wanted.items()}


def near_copies(rng, count, edits):
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(40)) for _ in range(120)]
    for _ in range(count):
        text = base[:]
        for _ in range(rng.choice(edits)):
            text[rng.randrange(len(text))] = f"new{rng.randrange(10 ** 6)}"
        yield " ".join(text)


def test_near_duplicates_of_near_copies(spark, monkeypatch):
    """Groups around the threshold, in which many members fail against any one leader."""
    monkeypatch.setattr(near_dup, "PAIRED", 3)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(3)
    texts = [t for _ in range(2) for t in near_copies(rng, 90, (1, 2, 3, 4, 5, 6))] + ["one two three", "One two THREE", "one two", "a b c d e f", "a b c d e f"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    check_components(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_links_across_blocks_are_counted_on_whole_hashes(spark):
    high = 1 << 32
    # two shingles of one set with equal upper halves, and a set that has only upper halves in common with another
    sets = [(1, [high + 1, high + 2, 3 * high]), (2, [high + 1, high + 2, 3 * high, 4 * high]), (3, [high + 7, 3 * high + 7, 5 * high])]
    inner = spark.createDataFrame([(9, i, i if i != 3 else 2, 3) for i in (1, 2, 3)], "key long, id long, c long, inside long")
    found = near_dup._across_blocks(inner, spark.createDataFrame(sets, "id long, shingles array<long>"))
    assert {(r.a, r.b) for r in found.collect()} == {(2, 1)}


def test_near_duplicates_of_small_sets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for i in range(300)]
    check_components(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert all((r.n_shingles, r.component_id, r.kept) == (0, r.doc_id, True) for i in (0, 1, 2, 3) for r in by_id[i])
    assert by_id[None][0].component_id is None and by_id[None][0].kept
    assert {r.component_id for r in by_id[9] + by_id[10]} == {9}
    kept = near_dup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None], key=str)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.75, 0.95):
        n = 4000
        both = int(2 * n * share / (1 + share))
        pool = rng.integers(0, 2 ** 63, 2 * n, dtype=np.uint64)
        left, right = pool[:n], np.concatenate([pool[:both], pool[n:2 * n - both]])
        flat, offsets = np.concatenate([np.sort(left), np.sort(right)]), np.array([0, n, 2 * n])
        regs = near_dup.registers(flat, offsets)
        score, used = near_dup.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))
        assert used[0] == near_dup.BUCKETS * near_dup.REPEATS and abs(score[0] - share) < 0.12


def test_word_hashes_depend_on_words_only():
    texts = [b"alpha beta alpha", b"beta", b"", b"x" * 3000 + b" alpha"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, first = words.word_bounds(data, offsets)
    found = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert found == [b"alpha", b"beta", b"alpha", b"beta", b"x" * 3000, b"alpha"] and first.tolist() == [0, 3, 4, 4, 6]
    hashes = words.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == 3 and hashes[0] == hashes[2] == hashes[5]


def test_hot_keys_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 10)
    rows = spark.range(400).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).cast("long").alias("key"), "id")
    facts = rows.groupBy("key").agg(F.min("id").alias("lo"), F.count("*").alias("members")).where("members > 1 or key % 2 = 0")
    joined = near_dup.with_facts(rows, facts, "members")
    assert sorted(map(tuple, joined.collect())) == sorted((7, i, 0, 300) if i < 300 else (i, i, i, 1) for i in range(400) if i < 300 or i % 2 == 0)
    assert near_dup.with_facts(rows, facts.where("key > 300"), "members").count() == 50 - 1
