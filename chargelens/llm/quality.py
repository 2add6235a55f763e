"""A quality classifier on random-indexing word vectors.

Every word has an index vector, a few +1 and -1 that its hash places, and a context vector: the sum of the index vectors that stand
next to it, over all texts, so that words used alike point alike, rare ones included. Context vectors are summed exactly, as integers, in a
table of fixed size that words share by their hash. A text is the weighted mean of its words' unit context vectors, frequent words weighing less.
A network of two layers, trained in NumPy on a bounded sample of labelled rows, turns that into a
probability, whose temperature is fitted on labelled rows that the network hasn't seen.

Words are runs of letters (case kept), of digits, or of one other character; a line end is a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargelens.llm.common import doc_columns, parts, runs_of
from chargelens.llm.kernels import flatten, mix64, span_hash

#: Byte classes: 0 between words, 1 letter or part of a character beyond ASCII, 2 digit, from 3 on every other byte by itself.
_CLASS = np.arange(256, dtype=np.int16) + 3
_CLASS[list(b" \t\r\x0b\x0c")] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2


@dataclass(frozen=True)
class Space:
    """Slots of the table, dimensions, non-zero entries of an index vector, words on each side that are context, and what p(word) halves a word's weight."""

    slots: int = 1 << 14
    dims: int = 64
    entries: int = 4
    window: int = 2
    half: float = 1e-2

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, where each text begins among them and the end)."""
        raw, off = flatten(texts)
        kind = np.zeros(len(raw) + len(off), dtype=np.int16)  # nothing between texts
        shifted = off + np.arange(len(off))
        buf = np.zeros(len(kind), dtype=np.uint8)
        at = np.arange(len(raw)) + np.repeat(np.arange(len(off) - 1), np.diff(off))
        buf[at], kind[at] = raw, _CLASS[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], kind, [0]])))
        start, end = edge[:-1], edge[1:]
        real = kind[start] > 0 if len(start) else np.zeros(0, dtype=bool)
        start, end = start[real], end[real]
        return span_hash(buf, start, end), np.searchsorted(start, shifted)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.slots)).astype(np.int64)

    def gather(self, total: np.ndarray, texts: list[str]) -> None:
        """Adds the texts' context vectors to ``total``, slots by dims and one column more, of the words' counts."""
        h, first = self.words(texts)
        slot, text = self.slot(h), np.repeat(np.arange(len(first) - 1), np.diff(first))
        bits = mix64(h ^ np.uint64(0xA0761D6478BD642F))
        width, keys, signs = self.dims + 1, [], []
        for e in range(self.entries):
            own = bits >> np.uint64(12 * e)
            place, sign = (own % np.uint64(self.dims)).astype(np.int64), 1 - 2 * (own >> np.uint64(11) & np.uint64(1)).astype(np.int8)
            for d in range(1, self.window + 1):
                near = np.flatnonzero(text[d:] == text[:-d])
                keys += [slot[near] * width + place[near + d], slot[near + d] * width + place[near]]
                signs += [sign[near + d], sign[near]]
        flat = total.reshape(-1)
        flat += np.bincount(np.concatenate(keys), np.concatenate(signs), minlength=len(flat)).astype(np.int64)  # whole numbers below 2^53
        total[:, self.dims] += np.bincount(slot, minlength=self.slots)

    def vectors(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weighted unit context vectors, weights) of the slots."""
        v = total[:, : self.dims].astype(np.float64)
        size = np.sqrt((v * v).sum(axis=1))
        p = total[:, self.dims] / max(total[:, self.dims].sum(), 1)
        weight = self.half / (self.half + p)
        return (v * (weight / np.where(size > 0, size, 1))[:, None]).astype(np.float32), weight.astype(np.float32)

    def pool(self, vectors: np.ndarray, weight: np.ndarray, texts: list[str], chunk: int = 1 << 16) -> np.ndarray:
        """Per text the weighted mean of its words' vectors; zeros for a text without words."""
        h, first = self.words(texts)
        slot = self.slot(h)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        total, mass = np.zeros((len(texts), self.dims), dtype=np.float64), np.zeros(len(texts))
        for lo in range(0, len(slot), chunk):
            s, t = slot[lo : lo + chunk], text[lo : lo + chunk]
            begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            mass[t[begin]] += np.add.reduceat(weight[s], begin)
            total[t[begin]] += np.add.reduceat(vectors[s], begin, axis=0)
        return (total / np.maximum(mass, 1e-12)[:, None]).astype(np.float32)


@dataclass
class Network:
    """Two layers over standardised features; a temperature divides the logit."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - y * z).mean())


def train(x: np.ndarray, y: np.ndarray, aside: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-3, seed: int = 17) -> Network:
    """Adam on the rows that aren't set aside; of the epochs' networks the one with the least loss on those set aside stays, and the
    temperature is chosen there too. Without rows of both labels on either side the score is the share of label 1, or a half."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    rng = np.random.default_rng(seed)
    centre, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale = np.where(scale > 1e-6, scale, 1.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    net = Network(centre, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if any(len(set(y[s].tolist())) < 2 for s in (aside, ~aside)):
        return net
    xs = (x - centre) / scale
    fit, check = np.flatnonzero(~aside), np.flatnonzero(aside)
    net.w2 = rng.normal(0, hidden**-0.5, hidden)
    at = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step, best = [np.zeros_like(p) for p in at], [np.zeros_like(p) for p in at], 0, (np.inf, [p.copy() for p in at])
    for _ in range(epochs):
        order = rng.permutation(fit)
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            a = np.tanh(xs[rows] @ at[0] + at[1])
            gap = (1 / (1 + np.exp(-np.clip(a @ at[2] + at[3], -30, 30))) - y[rows]) / len(rows)
            back = gap[:, None] * at[2] * (1 - a * a)
            grads = [xs[rows].T @ back + decay * at[0], back.sum(axis=0), a.T @ gap + decay * at[2], np.array([gap.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                at[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        now = _loss(np.tanh(xs[check] @ at[0] + at[1]) @ at[2] + at[3], y[check])
        if now < best[0]:
            best = now, [p.copy() for p in at]
    net.w1, net.b1, net.w2, net.b2 = *best[1][:3], float(best[1][3][0])
    z = net.logits(x[check])
    ones, zeros = y[check].sum(), (1 - y[check]).sum()
    goal = np.where(y[check] == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))  # Platt's: rows told apart without a fault make no score certain
    tried = np.exp(np.linspace(np.log(0.2), np.log(10), 200))
    net.temperature = float(tried[int(np.argmin([_loss(z / t, goal) for t in tried]))])
    return net


#: Slots whose vectors are summed as one row.
_TOGETHER = 64


def context_table(docs: DataFrame, space: Space, batch_chars: int) -> np.ndarray:
    """The context vectors and counts of all words of all texts of ``docs`` (text). A task sums its own and hands them on in blocks
    of slots, a block is summed in one task, and the driver gets the table, whose size is that of ``space`` whatever the input's."""
    width = space.dims + 1

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((space.slots, width), dtype=np.int64)
        for frame in frames:
            texts = frame["text"].tolist()
            for lo, hi in runs_of(texts, batch_chars):
                space.gather(total, texts[lo:hi])
        if total.any():
            wide = np.abs(total).max() >= 1 << 31
            blocks = (total if wide else total.astype(np.int32)).reshape(-1, _TOGETHER * width)
            yield pd.DataFrame({"block": np.arange(len(blocks)), "wide": wide, "sums": [zlib.compress(b.tobytes(), 1) for b in blocks]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for block, wide, sums in frame.itertuples(index=False):
                more = np.frombuffer(zlib.decompress(sums), dtype=np.int64 if wide else np.int32)
                held[block] = held[block] + more if block in held else more.astype(np.int64)
        if held:
            yield pd.DataFrame({"block": list(held), "sums": [x.tobytes() for x in held.values()]})

    rows = docs.select("text").mapInPandas(gather, "block int, wide boolean, sums binary")
    out = np.zeros((space.slots // _TOGETHER, _TOGETHER * width), dtype=np.int64)
    for row in rows.repartition(parts(docs.sparkSession), "block").mapInPandas(add, "block int, sums binary").collect():
        out[row["block"]] = np.frombuffer(row["sums"], dtype=np.int64)
    return out.reshape(space.slots, width)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", training_rows: int = 20_000, space: Space | None = None, batch_chars: int = 1_000_000, **training) -> DataFrame:
    """Per row of ``docs``: doc_id, logit (before the temperature), score (0 to 1, higher: label 1 likelier).

    ``labels``: ids with a label, 0 or 1; others, and null ids, teach nothing. Word vectors come from all texts, labelled or not. The
    network is fitted on the ``training_rows`` labels that come first in the order of the ids' hashes, a fifth of them set aside to stop it and to
    fit the temperature. Every row is scored by its whole text; null counts as empty, and texts without words share one score. Without both labels
    all scores are the share of label 1. Ids may be null or repeat, and an empty table stays empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    space = space or Space()
    if space.slots % _TOGETHER:
        raise ValueError(f"slots must be a multiple of {_TOGETHER}")
    source = doc_columns(docs, id_col, text_col)
    vectors = spark.sparkContext.broadcast(space.vectors(context_table(source, space, batch_chars)))

    @F.pandas_udf("array<float>")
    def pooled(texts: pd.Series) -> pd.Series:
        values, out = texts.tolist(), []
        for lo, hi in runs_of(values, batch_chars):
            out.extend(space.pool(*vectors.value, values[lo:hi]))
        return pd.Series(out, index=texts.index)

    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    order = F.xxhash64(F.lit(8), "doc_id")
    few = named.orderBy(order, "doc_id", "label").limit(training_rows)  # a bounded set, sent to the texts
    aside = (F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(5)) == 0).alias("aside")
    known = source.join(F.broadcast(few), "doc_id").select("doc_id", "label", aside, pooled("text").alias("x")).toPandas()
    known = known.sort_values(["doc_id", "label"], kind="stable")
    x = np.stack(known["x"].to_numpy()) if len(known) else np.zeros((0, space.dims), dtype=np.float32)
    network = spark.sparkContext.broadcast(train(x, known["label"].to_numpy(dtype=float), known["aside"].to_numpy(dtype=bool), **training))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for lo, hi in runs_of(texts, batch_chars):
                at = space.pool(*vectors.value, texts[lo:hi])
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[lo:hi], "logit": network.value.logits(at), "score": network.value.scores(at)})

    return source.mapInPandas(score, "doc_id long, logit double, score double")
