"""The toxicity model against a plain version of its definition, and what it learns: rare expressions at any size, each word apart, every labelled row."""

import math
import re

import numpy as np
import pytest

from chargelens.llm.kernels import words
from chargelens.llm.toxicity import WHOLE, fit, toxicity, with_labels

ONE = {"a": (0.75,), "b": (0.5,), "window": (1,)}


def labelled(spark, texts, toxic, ids=None):
    rows = [(k if ids is None else ids[k], t, c) for k, (t, c) in enumerate(zip(texts, toxic, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def filler(rng, n):
    return [" ".join(f"w{k}" for k in rng.integers(0, 2000, 12)) for _ in range(n)]


def plain_model(texts, toxic, a, b):
    """log P(word | 1) - log P(word | 0) by the definition, as a function of a word."""
    before = [{}, {}]
    for t, c in zip(texts, toxic, strict=True):
        last = None
        for w in re.findall(r"[0-9a-z]+", t.lower()):
            before[c].setdefault(w, set()).add(last)
            last = w
    every = set(before[0]) | set(before[1])
    both = {w: len(before[0].get(w, set()) | before[1].get(w, set())) for w in every}
    n = [{w: len(x) for w, x in side.items()} for side in before]
    total = [sum(x.values()) for x in n]

    def left(c, w):
        scale = total[c] / min(total)
        k = n[c].get(w, 0)
        return max(k - scale * (a + b * math.sqrt(k / scale)), 0.0)

    rest = [total[c] - sum(left(c, w) for w in n[c]) for c in (0, 1)]

    def p(c, w):
        return (left(c, w) + rest[c] * (both.get(w, 0) + 0.5) / (sum(both.values()) + 0.5 * len(every))) / total[c]

    return lambda w: math.log(p(1, w)) - math.log(p(0, w))


@pytest.mark.parametrize("window", [WHOLE, 1, 3])
def test_ratios_follow_the_definition(spark, window):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 25, rng.integers(1, 30))) for _ in range(90)]
    texts += [t + " foul muck" for t in texts[:20]]
    toxic = [0] * 60 + [1] * 50
    model = fit(labelled(spark, texts, toxic), grid={"a": (0.75,), "b": (0.5,), "window": (window,)})
    gap = plain_model(texts, toxic, 0.75, 0.5)
    known = set(" ".join(texts).split())
    for t in [*texts[:10], *texts[-5:], "foul", "w3 foul w4 w5", ""]:
        g = [gap(w) for w in t.split() if w in known]
        size = min(window or len(g), len(g))
        want = max((sum(g[i : i + size]) / size for i in range(len(g) - size + 1)), default=0.0) if g else 0.0
        assert model.ratios([t])[0] == pytest.approx(want, abs=1e-9)
    score = {r.doc_id: r for r in toxicity(labelled(spark, texts, toxic), labelled(spark, texts, toxic), grid={"a": (0.75,), "b": (0.5,), "window": (window,)}).collect()}
    for k in (0, 5, 100):
        assert score[k].score == pytest.approx(1 / (1 + math.exp(-(model.slope * score[k].ratio + model.offset))))


@pytest.mark.parametrize("rows", [300, 6000])
def test_a_rare_expression_counts_at_any_size(spark, rows):
    rng = np.random.default_rng(7)
    toxic = filler(rng, rows)
    for k in range(0, rows, rows // 12):
        toxic[k] += " grubvex"
    model = fit(labelled(spark, toxic + filler(rng, 2 * rows), [1] * rows + [0] * 2 * rows), grid=ONE)
    known, other = model.ratios(["grubvex", "w5"])
    assert known > 1 and known > 5 * abs(other)


def test_words_that_share_leading_hash_bits_are_apart(spark):
    rng = np.random.default_rng(8)
    foul = words(["grubvex"]).hash[0] >> np.uint64(46)
    names = [f"q{k}" for k in range(3_000_000)]
    clean = names[int(np.flatnonzero(words([" ".join(names)]).hash >> np.uint64(46) == foul)[0])]
    toxic = [f"{t} grubvex" for t in filler(rng, 200)]
    ordinary = [f"{t} {clean}" for t in filler(rng, 400)]
    known, other = fit(labelled(spark, toxic + ordinary, [1] * 200 + [0] * 400), grid=ONE).ratios(["grubvex", clean])
    assert known > 0 > other


def test_every_labelled_row_is_learned(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    aside = [r.id for r in spark.range(2000).where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(4)) == 0).limit(40).collect()]
    ids = aside + [k for k in range(2000) if k not in set(aside)]
    texts = [f"{t} grubvex" for t in filler(rng, 40)] + filler(rng, len(ids) - 40)
    model = fit(labelled(spark, texts, [1] * 600 + [0] * (len(ids) - 600), ids), grid=ONE)
    known, other = model.ratios(["grubvex", "nowhere"])
    assert known > other


def test_parameters_are_chosen_on_rows_that_were_not_counted(spark):
    rng = np.random.default_rng(10)
    toxic = [f"{t} grubvex {u}" for t, u in zip(filler(rng, 200), filler(rng, 200), strict=True)]
    docs = labelled(spark, toxic + filler(rng, 600), [1] * 200 + [0] * 600)
    model = fit(docs)
    assert model.scores(model.ratios([toxic[0]]))[0] > 0.7 > 0.3 > model.scores(model.ratios([filler(rng, 1)[0]]))[0]


def test_edges(spark):
    rng = np.random.default_rng(12)
    rows = [(k, ("grubvex " if k % 3 == 0 else "") + t, int(k % 3 == 0)) for k, t in enumerate(filler(rng, 300))]
    known = spark.createDataFrame([*rows, (300, None, 1), (301, "x", None)], "doc_id long, text string, toxic int")
    odd = [(None, "grubvex"), (1, None), (1, None), (2, ""), (3, "... !!"), (4, "word " * 200_000), (4, "word " * 200_000)]
    docs = spark.createDataFrame([(*r, "own", "own") for r in odd], "doc_id long, text string, ratio string, score string")
    got = toxicity(docs, known).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got) and all(r.ratio == 0 for r in got if r.doc_id in (1, 2, 3))
    assert toxicity(docs.limit(0), known).count() == 0 and toxicity(docs, known.limit(0)).count() == len(odd)
    assert toxicity(docs, known.where("toxic = 0")).count() == len(odd)
    some = with_labels(known.select("doc_id", "text"), known.where("doc_id % 7 = 0").select("doc_id", "toxic"))
    assert sorted(r.doc_id for r in some.collect()) == list(range(0, 302, 7))
