"""Toxicity by class-conditional Kneser-Ney models.

Two models, one a class. A word counts as often as it has different words before it in the class's labelled text
(Kneser-Ney's continuation counts, so that copies, near copies and repeated passages add nothing). A discount is taken off every
count, and the mass it frees goes to one distribution of both classes' counts, by which rare expressions are smoothed: a
word that is rare in both classes has the same ratio as any other such word. The two log-likelihoods are compared word by word, for and against, and
their difference is divided by the number of words. It is taken over every window of ``window`` words of the text, and the text has the
ratio of its most toxic window: a long text isn't excused by its length. A logistic curve maps the ratio to the score.

The discount of a count n is a + b * sqrt(n), on the scale of the smaller class, whatever the size of the table. a, b and the window are chosen, and the
curve fitted, on labelled rows that the choosing models have not counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargelens.llm.common import doc_columns, maybe_in, runs_of, saved, small_batches
from chargelens.llm.kernels import Words, mix64, words

#: A word that begins a text follows this context.
START = 0
#: The whole text as one window.
WHOLE = 0


def _pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(32 bits of the word before, word) of each word."""
    before = np.full(len(w.hash), START, dtype=np.uint32)
    before[1:] = w.hash[:-1] >> np.uint64(32)
    before[w.first[:-1][np.diff(w.first) > 0]] = START
    return before.view(np.int32), w.hash.view(np.int64)


@dataclass
class Counts:
    """Continuation counts of the words that a discount of ``least`` leaves something of; sums over all words."""

    word: np.ndarray
    n: np.ndarray  # class by word
    both: np.ndarray
    total: np.ndarray  # a class
    both_total: float
    kinds: float

    def scale(self) -> np.ndarray:
        return self.total / self.total.min()

    def gaps(self, a: float, b: float) -> tuple[np.ndarray, float]:
        """log P(word | 1) - log P(word | 0) of each word, and of every other word."""
        if not self.total.all():
            return np.zeros(len(self.word)), 0.0
        p_both = (self.both + 0.5) / (self.both_total + 0.5 * self.kinds)
        p, rest = [], []
        for n, total, scale in zip(self.n, self.total, self.scale(), strict=True):
            left = np.maximum(n - scale * (a + b * np.sqrt(n / scale)), 0)
            rest.append(max(total - left.sum(), 1e-9))
            p.append((left + rest[-1] * p_both) / total)
        other = np.log(rest[1] / self.total[1]) - np.log(rest[0] / self.total[0])
        return np.log(p[1]) - np.log(p[0]), float(other)


def window_ratios(gap: np.ndarray, w: Words, window: int) -> np.ndarray:
    """Per text the largest mean of ``gap`` over ``window`` words in a row, or over all where there are fewer; 0 without words."""
    count = np.diff(w.first)
    total = np.concatenate([[0.0], np.cumsum(gap)])
    out = np.zeros(len(count))
    full = count > 0
    if window == WHOLE:
        out[full] = (total[w.first[1:]] - total[w.first[:-1]])[full] / count[full]
        return out
    place = np.arange(len(gap)) - w.first[w.doc]
    size = np.minimum(place + 1, window)
    ends = np.flatnonzero((place + 1 >= window) | (place + 1 == count[w.doc]))
    means = (total[ends + 1] - total[ends + 1 - size[ends]]) / size[ends]
    if len(ends):
        first = np.searchsorted(w.doc[ends], np.flatnonzero(full))
        out[full] = np.maximum.reduceat(means, first)
    return out


@dataclass
class Model:
    """words: sorted keys of the words with a gap of their own; gap: theirs, in the same order; other: everybody else's."""

    words: np.ndarray
    gap: np.ndarray
    other: float = 0.0
    window: int = WHOLE
    slope: float = 1.0
    offset: float = 0.0

    def gaps(self, w: Words) -> np.ndarray:
        if not len(self.words):
            return np.full(len(w.hash), self.other)
        word = w.hash.view(np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, self.gap[at], self.other)

    def ratios(self, texts) -> np.ndarray:
        """Difference of the log-likelihoods a word, class 1 less class 0, of each text's most toxic window; 0 for a text without words."""
        w = words(texts)
        return window_ratios(self.gaps(w), w, self.window)

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * ratios + self.offset, -30, 30)))


def _counted(batch_chars: int):
    """Distinct (word, before, flags) of each batch: flag 1 << c for class c, 4 << c where the row is not set aside."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for flags, part in frame.groupby("flags"):
                texts = part["text"].tolist()
                for lo, hi in runs_of(texts, batch_chars):
                    before, word = _pairs(words(texts[lo:hi]))
                    one = np.unique(mix64(word.view(np.uint64)) + before.view(np.uint32), return_index=True)[1]
                    yield pd.DataFrame({"word": word[one], "before": before[one], "flags": flags})

    return count


def _counts(table: DataFrame, k0: str, k1: str, both: str, least: float) -> Counts:
    t = table.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (k0, k1, both)), F.count_if(F.col(both) > 0).alias("kinds")).first()
    total = np.array([t[k0], t[k1]], dtype=float)
    small = max(min(t[k0], t[k1]), 1)
    wanted = (F.col(k0) * small > least * t[k0]) | (F.col(k1) * small > least * t[k1])
    found = table.where(wanted).select("word", *(F.col(c).cast("int").alias(c) for c in (k0, k1, both))).toArrow()
    word = found["word"].to_numpy()
    order = np.argsort(word)
    n = np.stack([found[k].to_numpy()[order].astype(float) for k in (k0, k1)])
    return Counts(word[order], n, found[both].to_numpy()[order].astype(float), total, float(t[both]), float(t["kinds"]))


#: What is tried, of each, in this order.
GRID = {"a": (0.75, 1.5, 3.0), "b": (0.0, 0.5, 1.0), "window": (WHOLE, 32, 16, 8, 4, 2, 1)}


def fit(labelled: DataFrame, grid: dict | None = None, calibration_rows: int = 20_000, batch_chars: int = 2_000_000, texts: DataFrame | None = None) -> Model:
    """labelled: doc_id, text, toxic (0 or 1). texts: doc_id, text of the same rows where ``labelled`` is a join, so that the
    ids set aside, a bounded set, are sent to the texts and no text is shuffled or sorted for it. Counts are of all rows. One row in 4, at
    most ``calibration_rows`` of them, is scored by models of the other rows' counts: by the least log-loss of a curve fitted there the discount and
    the window are chosen from ``grid``.

    Words and what stands before them are counted on the executors, and the counts stay there as a table. The driver and each
    executor hold the words whose count exceeds the discount, 12 bytes each: they grow with the vocabulary of the labelled text.
    """
    grid = GRID | (grid or {})
    spark = labelled.sparkSession
    share = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(4))
    flags = F.when(F.col("toxic") == 1, 2).otherwise(1) * F.when(share != 0, 5).otherwise(1)
    pairs = labelled.select("text", flags.alias("flags")).mapInPandas(_counted(batch_chars), "word long, before int, flags int").groupBy("word", "before").agg(F.bit_or("flags").alias("flags"))
    has = lambda bits: F.count_if(F.col("flags").bitwiseAND(bits) != 0)
    table = saved(pairs.groupBy("word").agg(*(has(b).alias(c) for b, c in ((1, "k0"), (2, "k1"), (3, "both"), (4, "part0"), (8, "part1"), (12, "part")))))

    least = min(grid["a"])
    part = _counts(table, "part0", "part1", "part", least)
    tried = list(product(grid["a"], grid["b"]))
    shared = spark.sparkContext.broadcast([Model(part.word, *part.gaps(a, b)) for a, b in tried])

    @F.pandas_udf("array<double>")
    def ratios(texts: pd.Series) -> pd.Series:
        values, out = texts.tolist(), []
        for lo, hi in runs_of(values, 1_000_000):
            w = words(values[lo:hi])
            x = [window_ratios(g, w, size) for g in (m.gaps(w) for m in shared.value) for size in grid["window"]]
            out.extend(np.stack(x, axis=1))
        return pd.Series(out)

    order = F.xxhash64(F.lit(6), "doc_id")
    if texts is None:
        rest = labelled.where(share == 0).orderBy(order).limit(calibration_rows)
    else:
        few = labelled.where(share == 0).select("doc_id", "toxic").orderBy(order).limit(calibration_rows)
        rest = texts.where("text is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id")
    aside = rest.select("toxic", ratios("text").alias("x")).toPandas()
    a, b, window, slope, offset = least, min(grid["b"]), grid["window"][0], 1.0, 0.0
    y = aside["toxic"].to_numpy(dtype=float)
    if len(y) and 0 < y.sum() < len(y):
        x = np.stack(aside["x"].to_numpy())
        curves = [_curve(x[:, k], y) for k in range(x.shape[1])]
        best = int(np.argmin([c[2] for c in curves]))
        (a, b), window = tried[best // len(grid["window"])], grid["window"][best % len(grid["window"])]
        slope, offset, _ = curves[best]
    whole = _counts(table, "k0", "k1", "both", a)
    return Model(whole.word, *whole.gaps(a, b), window=window, slope=slope, offset=offset)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and mean log-loss of a ridge logistic regression by Newton steps; a slope below 0 counts as no curve at all."""
    scale = float(np.std(x)) or 1.0
    at = np.stack([x / scale, np.ones(len(x))], axis=1)
    ridge, beta = np.array([1e-2, 1e-6]), np.zeros(2)

    def loss(v: np.ndarray) -> float:
        z = at @ v
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * v * v).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ beta, -30, 30)))
        step = np.linalg.solve((at * (p * (1 - p))[:, None]).T @ at + np.diag(ridge), at.T @ (y - p) - ridge * beta)
        length = 1.0
        while length > 1e-6 and loss(beta + length * step) > loss(beta):
            length /= 2
        beta = beta + length * step
        if abs(length * step).max() < 1e-8:
            break
    z = at @ beta
    mean = float((np.logaddexp(0, z) - y * z).mean())
    return (float(beta[0] / scale), float(beta[1]), mean) if beta[0] > 0 else (1.0, 0.0, np.inf)


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, toxic) of the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) names. Both grow with the
    input: a filter of the named ids, of bounded size, keeps most other texts out of the join, and the join decides."""
    return maybe_in(docs, F.col(id_col).cast("long"), labels, F.col(id_col).cast("long")).join(labels.hint("merge"), id_col)


def toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1_000_000, **options) -> DataFrame:
    """Per row: doc_id, ratio (difference of log-likelihoods a word, see Model.ratios), score (0 to 1).

    ``labelled``: doc_id, text, toxic; rows with a null text or label teach nothing. A text without words has the ratio 0
    and that ratio's score. Without both labels every score is that of an unfitted curve, between 0 and 1. Ids may be
    null or repeat; every row of ``docs`` is scored by its whole text, and an empty table stays empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = fit(labelled.where("text is not null and toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), **options)
    shared = spark.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            x = np.concatenate([np.zeros(0), *(shared.value.ratios(texts[lo:hi]) for lo, hi in runs_of(texts, batch_chars))])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ratio": x, "score": shared.value.scores(x)})

    return doc_columns(docs, id_col, text_col).mapInPandas(score, "doc_id long, ratio double, score double")
