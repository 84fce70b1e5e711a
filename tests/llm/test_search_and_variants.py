"""Exact search, hard negatives and spelling variants against plain versions of what they compute."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from samplewright.llm import negatives, queries, strips, topk, variants  # noqa: F401
from samplewright.llm.common import QUERIES

SF_DIR = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, l, "x", 1, 2, 3) for i, v, l in rows],
                                 "vec_id long, embedding array<float>, label int, query string, score int, slot int, place int")


def odd_vectors():
    """Ties, copies, repeated ids, lengths that differ, and rows that take no part."""
    rng = random.Random(3)
    rows = [(i, [rng.randint(-6, 6) / 4 for _ in range(5)], rng.randint(0, 2)) for i in range(240)]
    rows += [(i, [0.5, 0.25, -1.0, 0.0, 1.0], i % 3) for i in range(300, 360)]
    rows += [(40, [1.0, 1.0, 0.0, 0.0, 0.25], 1), (40, rows[40][1], rows[40][2]), (17, rows[17][1], rows[17][2]), (17, [2.0, 0.0, 0.0, 0.0, 0.0], 0)]
    rows += [(400, [1.0, -1.0], 0), (401, [1.0] * 9, 1), (402, [], 2), (403, [0.0] * 5, 0), (404, [1.0] * 5, None)]
    rows += [(500, None, 1), (None, [1.0] * 5, 1), (520, [1.0, None, 1.0, 1.0, 1.0], 1), (540, [NAN, 1.0, 1.0, 1.0, 1.0], 0), (560, [INF] * 5, 0)]
    return rows


def parts(rows, scale, with_label=False):
    """Rows that take part, vectors as whole numbers filled up with zeros."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and not any(x is None or not np.isfinite(x) for x in r[1])]
    rows = [r for r in rows if not with_label or r[2] is not None]
    return [(i, tuple(int(np.floor(scale * x)) for x in v) + (0,) * (9 - len(v)), l) for i, v, l in rows]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain_search(rows, every, k, scale=64):
    rows, out = parts(rows, scale), []
    for i, v in {(i, v) for i, v, _ in rows if i % every == 0}:
        best = sorted((-dot(v, w), j) for j, w, _ in rows if j != i)[:k]
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k, slices", [(20, 2), (3, 1), (1, 3), (1000, 2)])
def test_search_is_brute_force(spark, k, slices):
    rows = odd_vectors()
    found = topk.search(vectors(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, k=k, slices=slices).collect()
    assert sorted(map(tuple, found)) == plain_search(rows, 20, k)


def test_search_over_tiles_and_strips(spark, monkeypatch):
    rows = odd_vectors()
    monkeypatch.setattr(strips, "STRIP_BYTES", 400)
    monkeypatch.setattr(strips, "TILE_QUERIES", 3)
    found = topk.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=7).collect()
    assert sorted(map(tuple, found)) == plain_search(rows, 20, 7)


def test_search_keeps_copies_bounded(spark):
    """Half of the rows are one vector: a task returns no more than the k first of them for a query."""
    rows = spark.range(6000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(1.0))).otherwise(
        F.array(F.rand(1), F.rand(2))).alias("embedding"))
    strip = strips.Strip(rows.where("vec_id % 500 = 0").toArrow(), 64)
    best = topk.sufficient(strip, iter(rows.toArrow().to_batches()), np.full(len(strip), 8192.0), 20)
    assert np.bincount(best.owner).tolist() == [20] * len(strip)
    assert sorted(best.id[best.owner == 0]) == list(range(2, 42, 2))


def test_cutoff_is_safe_and_sharp():
    rng = np.random.default_rng(5)
    import pyarrow as pa

    data = np.round(rng.standard_normal((6000, 16)) * 40) / 64
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6000)), pa.array(data.tolist())], names=["vec_id", "embedding"])
    strip = strips.Strip(pa.Table.from_batches([batch.slice(0, 50)]), 64)
    owner, score = topk.local_lists(strip, iter([batch]), 10)
    whole = (np.floor(data * 64) @ np.floor(data[:50] * 64).T)
    whole[np.arange(50), np.arange(50)] = -np.inf
    for q in range(50):
        kth = np.sort(whole[:, q])[-10]
        cutoff = score[owner == q].min()
        assert (owner == q).sum() == 10 and cutoff <= kth and (whole[:, q] >= cutoff).sum() < 600


def test_search_without_rows(spark):
    none = vectors(spark, odd_vectors()).limit(0)
    assert topk.search(none, F.col("vec_id") % 20 == 0).count() == 0
    alone = topk.search(vectors(spark, [(20, [1.0, 2.0], 0)]), F.col("vec_id") % 20 == 0)
    assert alone.count() == 0 and alone.columns == ["query_id", "rank", "vec_id", "score"]


def test_too_large_components_raise(spark):
    with pytest.raises(PySparkException):
        topk.search(vectors(spark, [(20, [1e9, 1.0], 0), (21, [1e9, 1.0], 0)]), F.col("vec_id") % 20 == 0).collect()


def test_large_components_are_exact(spark):
    rows = [(i, [float(i * 4099 + 1), float(2 ** 18 - i)], 0) for i in range(60)]
    found = topk.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=5).collect()
    assert sorted(map(tuple, found)) == plain_search(rows, 20, 5)


def plain_negatives(rows, every, k=10, positives=5, window=(30, 90), scale=256):
    rows, out = parts(rows, scale, True), []
    for i, v, label in {(i, v, l) for i, v, l in rows if i % every == 0}:
        scores = sorted((-dot(v, w), j, l == label) for j, w, l in rows if j != i)
        for s, j, same in [x for x in scores if x[2]][:positives]:
            inside = [(n, m) for n, m, other in scores if not other and window[0] * -s <= -100 * n <= window[1] * -s][:k]
            out += [(i, j, rank + 1, m, -s, -n) for rank, (n, m) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("k, positives, window", [(10, 5, (30, 90)), (2, 3, (0, 100)), (50, 1, (60, 61)), (4, 8, (30, 90))])
def test_negatives_are_brute_force(spark, k, positives, window):
    rows = odd_vectors()
    found = negatives.mine(vectors(spark, rows).repartition(4), F.col("vec_id") % 20 == 0, k=k, positives=positives, window=window).collect()
    wanted = plain_negatives(rows, 20, k, positives, window)
    assert sorted(map(tuple, found)) == wanted and wanted


def test_negatives_over_tiles_and_strips(spark, monkeypatch):
    rows = odd_vectors()
    monkeypatch.setattr(strips, "STRIP_BYTES", 300)
    monkeypatch.setattr(strips, "TILE_ROWS", 50)
    found = negatives.mine(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, found)) == plain_negatives(rows, 20)


def test_negatives_without_rows(spark):
    none = vectors(spark, odd_vectors()).limit(0)
    assert negatives.mine(none, F.col("vec_id") % 20 == 0).count() == 0
    same = negatives.mine(vectors(spark, [(i, [1.0, 2.0], 4) for i in range(30)]), F.col("vec_id") % 20 == 0)
    assert same.count() == 0
    assert negatives.mine(vectors(spark, [(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") == 0).count() == 0  # positive below zero


def plain_variants(rows, change=True, least=6, count=5, factor=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if change and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}
    near = {w: {v for v in n if v != w and one_edit(w, v)} for w in n}
    best = {w: min(((-n[v], v) for v in near[w]), default=(0, None)) for w in n}
    form = {w: v if v is not None and -c >= factor * n[w] else None for w, (c, v) in best.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_near_is_brute_force():
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(0, 7))) for _ in range(400)} | {"", "a" * 200, "a" * 201, "a" * 199 + "b", "ÿ" * 3})
    query, word = variants.near(words, words)
    found = {(words[q], words[w]) for q, w in zip(query, word)}
    assert len(found) == len(query) and found == {(a, b) for a in words for b in words if one_edit(a, b)}


@pytest.mark.parametrize("room", [variants.CELL_WORDS, 3])
def test_pairs_are_whole_and_come_once(spark, room, monkeypatch):
    """Also where one key holds most words and is dealt to many cells."""
    monkeypatch.setattr(variants, "CELL_WORDS", room)
    monkeypatch.setattr(variants, "CELL_LETTERS", 400 if room == 3 else variants.CELL_LETTERS)
    rng = random.Random(4)
    words = sorted({"same" + "".join(rng.choices("ab", k=rng.randint(2, 6))) for _ in range(120)} | {"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(80)} | {"x" * 3000, "x" * 2999 + "y"})
    found = variants.pairs(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")).collect()
    number = {w: i for i, w in enumerate(words)}
    assert all(number[r.a] == r.n_a and number[r.b] == r.n_b for r in found)
    assert sorted(tuple(sorted((r.a, r.b))) for r in found) == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_chains_and_ties(spark):
    counts = {"abcdef": 5, "abcdeg": 25, "abcdgg": 125, "abcdxg": 125, "abcggg": 625, "bcdefg": 3125, "abcdefgh": 5, "lonely": 7, "abcdeff": 24}
    rows = {r.word: r for r in variants.group(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert rows["abcdef"].form == "abcdeg" and rows["abcdef"].root == "abcggg" and rows["abcdef"].n_near == 2 and rows["abcdef"].form_n == 25
    assert rows["abcdeg"].form == "abcdgg" and rows["abcdxg"].form is None and rows["abcggg"].root == "abcggg"
    assert rows["lonely"].n_near == 0 and rows["lonely"].root == "lonely" and len(rows) == len(counts)


def test_variants_of_odd_documents(spark):
    texts = ["Straße straße STRASSE strasse " * 5, None, "", "12 ½ ×÷", "ÀÉÎÕÜ àéîõü " * 6, "x" * 30_000 + " " + ("longer " * 7), "colour " * 40 + "color " * 6 + "colours " * 5,
             "word-with_marks wordwith " * 9] + ["some repeated row of letters receive recieve receive"] * 12
    rows = [(i % 9, t, 1, "w", "f") for i, t in enumerate(texts)] + [(None, "nothing nothing nothing nothing nothing nothinge " * 5, 1, "w", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, word string, form string")
    found = sorted(map(tuple, variants.spelling_variants(docs, variants.planted).collect()))
    assert found == plain_variants([(r[0], r[1]) for r in rows]) and len(found) > 10
    assert sorted(map(tuple, variants.spelling_variants(docs).collect())) == plain_variants([(r[0], r[1]) for r in rows], change=False)
    assert variants.spelling_variants(docs.limit(0), variants.planted).count() == 0
    assert variants.spelling_variants(docs.where("text is null")).count() == 0


def test_variants_query_is_plain(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(map(tuple, QUERIES["op12_spelling_variants"](spark, SF_DIR).collect()))
    assert found == plain_variants([tuple(r) for r in docs]) and any(r[1] for r in found)
