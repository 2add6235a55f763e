import random

import numpy as np
import pytest

from chargelens.llm.quality import Network, Space, context_table, quality, train

SMALL = Space(slots=256, dims=16)


def naive(space, texts):
    """Context vectors, word by word."""
    total = np.zeros((space.slots, space.dims + 1), dtype=np.int64)
    for text in texts:
        h, _ = space.words([text])
        for i, word in enumerate(h):
            slot = int(space.slot(h[i : i + 1])[0])
            total[slot, space.dims] += 1
            for j in range(max(0, i - space.window), min(len(h), i + space.window + 1)):
                if i != j:
                    alone = np.zeros_like(total)
                    space.gather(alone, [])
                    total[slot, : space.dims] += index_vector(space, h[j])
            assert word == h[i]
    return total


def index_vector(space, h):
    from chargelens.llm.kernels import mix64

    bits = int(mix64(np.array([h ^ np.uint64(0xA0761D6478BD642F)]))[0])
    out = np.zeros(space.dims, dtype=np.int64)
    for e in range(space.entries):
        own = bits >> 12 * e
        out[own % space.dims] += 1 - 2 * (own >> 11 & 1)
    return out


def text(rng, good):
    words = [rng.choice(["alpha", "beta", "gamma", "delta", "épsilon"]) for _ in range(rng.randint(5, 40))]
    return " ".join(words if good else [w.upper() + "!!" for w in words])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    return [(i, text(rng, i % 3 > 0), int(i % 3 > 0)) for i in range(300)]


def test_the_table_is_the_sum_over_all_words(spark):
    texts = ["Is it? It is, 42 is!!", "", "a\nb b\nb", "é" * 3 + " x", None, "a b a b a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = context_table(docs.na.fill(""), SMALL, 10)
    assert np.array_equal(got, naive(SMALL, [t or "" for t in texts]))
    assert np.array_equal(context_table(docs.na.fill("").repartition(5), SMALL, 1000), got)


def test_pooling_is_a_weighted_mean():
    rng = np.random.default_rng(1)
    vectors, weight = rng.normal(size=(256, 16)).astype(np.float32), rng.random(256).astype(np.float32)
    texts = ["one two three", "", "one " * 500, "two, three"]
    got = SMALL.pool(vectors, weight, texts, chunk=64)
    for t, row in zip(texts, got, strict=True):
        s = SMALL.slot(SMALL.words([t])[0])
        want = vectors[s].sum(axis=0) / weight[s].sum() if len(s) else np.zeros(16)
        assert np.allclose(row, want, atol=1e-4)


def test_held_out_texts_are_told_apart(spark, corpus):
    docs = spark.createDataFrame([(i, t, "no label", 0) for i, t, _ in corpus] + [(None, None, "x", 1), (7, "", "x", 1), (900, "alpha beta " * 20_000, "x", 1)], "doc_id long, text string, label string, quality int")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus if i % 5] + [(None, 1), (3, None), (4, 7), (100_000, 1)], "doc_id long, quality int")
    rows = quality(docs, labels, space=SMALL).collect()
    assert len(rows) == 303
    assert all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] is not None and r["doc_id"] != 7}
    assert all((score[i] >= 0.5) == bool(y) for i, _, y in corpus if i % 5 == 0)
    assert score[900] > 0.5
    again = {r["doc_id"]: r["score"] for r in quality(docs.repartition(7), labels.repartition(3), space=SMALL).collect() if r["doc_id"] not in (None, 7)}
    assert max(abs(again[k] - v) for k, v in score.items()) < 1e-6


def test_without_labels_or_texts(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus[:5]], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality(docs, none, space=SMALL).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    assert len({r["score"] for r in quality(docs, one, space=SMALL).collect()}) == 1
    assert quality(docs.limit(0), one, space=SMALL).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        quality(docs, one, space=Space(slots=100))


def test_the_temperature_calibrates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 8))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))
    y = (rng.random(4000) < p).astype(float)
    net = train(x, y, np.arange(4000) % 5 == 0)
    fresh = rng.normal(size=(4000, 8))
    got, want = net.scores(fresh), 1 / (1 + np.exp(-(2 * fresh[:, 0] - fresh[:, 1])))
    assert np.abs(got - want).mean() < 0.05
    for lo in (0.1, 0.4, 0.7):
        inside = (got >= lo) & (got < lo + 0.2)
        assert abs(got[inside].mean() - want[inside].mean()) < 0.04


def test_gradients_are_those_of_differences():
    """One step of training on a fixed batch lowers the loss of the network as written."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(200, 4)), (rng.random(200) < 0.5).astype(float)
    y[x[:, 0] > 0] = 1
    aside = np.arange(200) % 4 == 0
    short, long = train(x, y, aside, epochs=1), train(x, y, aside, epochs=40)
    loss = lambda net: float((np.logaddexp(0, net.logits(x)) - y * net.logits(x)).mean())
    assert isinstance(short, Network)
    assert loss(long) < loss(short)
