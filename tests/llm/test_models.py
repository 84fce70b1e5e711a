"""The classifiers' arithmetic against plain loops: tree walks, convolutions, and how an update changes the loss."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from samplewright.llm import toxicity, trees


def test_trees_are_walked_row_by_row():
    random = np.random.default_rng(1)
    rows = np.round(random.standard_normal((600, 5)), 1)  # rounded, so that values meet cuts exactly
    label = (rows[:, 0] + rows[:, 1] * rows[:, 2] > 0.3).astype(float)
    model = trees.fit(rows[:400], label[:400], trees=20, depth=3)
    inner = model.feature.shape[1]

    def walk(row):
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
            at = 0
            while at < inner:
                at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
            total += leaf[at - inner]
        return total

    assert np.allclose(model.raw(rows), [walk(row) for row in rows], rtol=0, atol=1e-12)
    assert ((model.score(rows[400:]) >= 0.5) == label[400:]).mean() > 0.8


def test_a_leaf_is_the_newton_step():
    """One tree of one level: the cut and both leaves are those a search over all cuts finds."""
    random = np.random.default_rng(2)
    rows = random.integers(0, 9, (300, 2)).astype(float)
    label = (rows[:, 1] > 4).astype(float) * (random.random(300) < 0.9)
    model = trees.fit(rows, label, trees=1, depth=1, rate=1.0)
    share = (label.sum() + 1) / (len(label) + 2)
    slope, bend = label - share, share * (1 - share)

    def value(inside):
        return slope[inside].sum() ** 2 / (bend * inside.sum() + 1)

    best = max(((value(rows[:, f] <= c) + value(rows[:, f] > c)), f, c) for f in range(2) for c in range(8))
    feature, cut = model.feature[0, 0], model.cut[0, 0]
    left = rows[:, feature] <= cut
    assert feature == best[1] and (left == (rows[:, best[1]] <= best[2])).all()
    assert np.allclose(model.leaf[0], [slope[m].sum() / (bend * m.sum() + 1) for m in (left, ~left)])


def texts_of(*texts):
    raw = [t.encode() for t in texts]
    return toxicity.tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_filters_are_a_looped_convolution():
    net = toxicity.Network.new(3)
    part = texts_of("some words that follow each other, and some words again", "one", "", "two words", "the of and to in is that it was for on with")
    pooled, where = net.pooled(part.rows, part.first, places=True)
    for t in range(len(part.first) - 1):
        words = [sum(net.table[i] for i in row) for row in part.rows[part.first[t]:part.first[t + 1]]]
        for i, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                values = [sum(float(words[at + k] @ net.filters[width][k][:, f]) for k in range(width) if at + k < len(words)) for at in range(len(words))]
                column = i * toxicity.FILTERS + f
                if not words:
                    assert pooled[t, column] == 0 and where[t, column] == -1
                    continue
                assert abs(pooled[t, column] - max(values)) < 1e-4
                assert abs(values[where[t, column] - part.first[t]] - max(values)) < 1e-4
    hidden = np.maximum(pooled + net.bias, 0)
    assert np.allclose(net.raw(part), hidden @ net.out + net.offset)


def test_scores_follow_the_language_threshold():
    net = toxicity.Network.new(3)
    net.threshold = np.arange(5.0)
    part = texts_of("the cat and the dog", "der Hund und die Katze", "xyzzy")
    assert part.language.tolist() == [0, 1, 4]
    assert np.allclose(net.score(part), 1 / (1 + np.exp(-(net.raw(part).astype(float) - [0, 1, 4]))))


def test_training_lowers_the_loss_and_takes_one_class():
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("amo", "elu", "iro")]
    random = np.random.default_rng(5)
    label = np.arange(240) % 2
    texts = [" ".join([*random.choice(words, 12), *(["vilebad"] if y else [])]) for y in label]
    sample = toxicity.Sample.of([texts_of(*texts)])
    net = toxicity.train(sample, label.astype(np.float32), updates=200)
    assert ((net.score(sample.texts(np.arange(240))) >= 0.5) == label).mean() > 0.95
    for only in (0.0, 1.0):
        same = toxicity.train(sample, np.full(240, only, np.float32))
        assert ((same.score(sample.texts(np.arange(240))) >= 0.5) == only).all()
    none = toxicity.train(toxicity.Sample.of([]), np.zeros(0, np.float32))
    assert np.allclose(none.score(texts_of("a text", "")), 0.5)


def test_all_labelled_texts_are_learned_from(spark):
    """Also those too long for the first network; the result doesn't depend on how the rows lie."""
    random = np.random.default_rng(6)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("amo", "elu", "iro")]
    texts = [(i, " ".join([*random.choice(words, 4200 if i % 10 == 0 else 12), *(["vilebad"] if i % 2 else [])])) for i in range(120)]
    assert max(len(t) for _, t in texts) > toxicity.SAMPLE_CHARS
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = [spark.createDataFrame([(i, int(turned if i % 10 == 0 else i % 2)) for i in range(120)], "doc_id long, toxic int") for turned in (0, 1)]
    nets = [toxicity.fit(d, x, F.lit(True)) for d, x in ((docs, labels[0]), (docs.repartition(7), labels[0]), (docs, labels[1]))]
    assert (nets[0].table == nets[1].table).all() and (nets[0].out == nets[1].out).all() and (nets[0].threshold == nets[1].threshold).all()
    assert (nets[0].table != nets[2].table).any()


def test_thresholds_have_the_fewest_errors_on_all_texts(spark):
    random = np.random.default_rng(8)
    rows = [(int(k), float(np.round(random.normal(y + k, 0.8), 1)), int(y)) for k in (0, 1, 4) for y in random.integers(0, 2, 150)] + [(2, 0.5, 1), (2, 0.1, 0)]
    found = toxicity.calibrated(spark.createDataFrame(rows, "language int, raw double, label int"))

    def errors(chosen, cut):
        return sum((raw >= cut) != bool(y) for _, raw, y in chosen)

    for k in range(len(toxicity.LANGUAGES)):
        chosen = [r for r in rows if r[0] == k] if k in (0, 1, 4) else rows
        assert errors(chosen, found[k]) == min(errors(chosen, cut) for cut in [r[1] - 0.05 for r in chosen] + [99.0])
