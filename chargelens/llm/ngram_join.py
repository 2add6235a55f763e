"""N-gram Jaccard self-join by chosen paths.

A text is the set of its runs of n words. In each of several independent runs a set chooses, level by level, the elements
whose hash falls below 1 / (threshold * size), about 1.25 of them at 0.8; sets that chose the same elements so far share a
bucket, and similar sets choose alike. Buckets of at most ``limit`` sets are compared by brute force, larger ones are split by
the next level's choice, and what is still larger at the last level is compared in pairs of blocks. The number of runs
follows from the recall wanted at the threshold. A pair that meets in several buckets is compared in the smallest one
only, which both sets' bucket lists tell without their elements. Elements go only to buckets that have a pair to compare:
one of fitting sizes, that shares as many first-level choices as all but a thousandth of the pairs that may be missed do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargelens.llm.common import blocks_of, bounds, columns_of, components, cut, doc_columns, grouped, parts, roots, runs_of, saved, small_batches
from chargelens.llm.kernels import mix64, word_ngrams, words

_RUN_BITS = 6


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with this probability even where every level splits."""
    meets = (1 - math.exp(-1)) ** depth
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def least_common(runs: int, risk: float) -> int:
    """How many first-level choices a pair at the threshold shares in all but this share of cases."""
    p, total, c = 1 - math.exp(-1), 0.0, 0
    while total + (term := math.comb(runs, c) * p**c * (1 - p) ** (runs - c)) <= risk:
        total, c = total + term, c + 1
    return c


def _sets(texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, elements, sizes): the distinct n-gram hashes of each text, sorted."""
    doc, h = word_ngrams(words(texts), n)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    size = np.bincount(doc, minlength=len(texts))
    return np.concatenate([[0], np.cumsum(size)]), h, size


class Chooser:
    def __init__(self, n: int, threshold: float, runs: int, depth: int, seed: int):
        if runs >= 1 << _RUN_BITS:
            raise ValueError(f"more than {(1 << _RUN_BITS) - 1} runs")
        self.n, self.threshold, self.runs, self.depth = n, threshold, runs, depth
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(1, 1 << 62, (depth, runs), dtype=np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)
        self.least = math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else 1 << 62  # smaller sets are similar only if equal

    def choose(self, texts, ids, levels: bool = True) -> pd.DataFrame:
        """Per text: doc_id, size, set digest (two longs), and each level's chosen elements with the run in the top bits."""
        edge, h, size = _sets(texts, self.n)
        out = {"doc_id": ids, "size": size}
        for name, salt in (("d1", 0x243F6A8885A308D3), ("d2", 0x13198A2E03707344)):
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(h ^ np.uint64(salt)), dtype=np.uint64)])
            out[name] = (total[edge[1:]] - total[edge[:-1]]).astype(np.int64)
        if not levels:
            return pd.DataFrame(out)
        share = np.where(size >= self.least, 1 / (self.threshold * np.maximum(size, 1)), 0.0)
        below = np.repeat((np.minimum(share, 1.0) * 1.8446744073709550e19).astype(np.uint64), size)
        doc = np.repeat(np.arange(len(size)), size)
        for level in range(self.depth):
            found = [np.flatnonzero(h * odd < below) for odd in self.odd[level]]
            token = np.concatenate([(mix64(h[f]) >> np.uint64(_RUN_BITS)) | np.uint64(r << (64 - _RUN_BITS)) for r, f in enumerate(found)]).astype(np.int64)
            owner = np.concatenate([doc[f] for f in found])
            order = np.argsort(owner, kind="stable")
            if level:  # only told apart within one bucket
                token = token >> 32
            out[f"t{level + 1}"] = np.split(token[order], np.cumsum(np.bincount(owner, minlength=len(size)))[:-1]) if len(size) else []
        return pd.DataFrame(out)


def _paths(sets: DataFrame, depth: int, limit: int) -> DataFrame:
    """(bucket, id): the buckets that are compared, each of two members or more."""
    run = F.shiftrightunsigned("t", 64 - _RUN_BITS)
    alive = sets.select("id", F.explode("t1").alias("t")).select("id", run.alias("run"), F.col("t").alias("bucket"))
    done = None
    for level in range(1, depth + 1):
        counts = cut(alive.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        last = level == depth or counts.where(F.col("n") > limit).isEmpty()
        ready = alive.join(counts if last else counts.where(F.col("n") <= limit), "bucket").select("bucket", "id")
        done = ready if done is None else done.unionByName(ready)
        if last:
            break
        split = saved(alive.join(counts.where(F.col("n") > limit).select("bucket"), "bucket"))
        next_level = split.join(sets.select("id", F.col(f"t{level + 1}").alias("next")), "id")
        alive = next_level.select("id", "run", F.explode(F.filter("next", lambda t: F.shiftrightunsigned(t, 32 - _RUN_BITS) == F.col("run"))).alias("t"), "bucket").select("id", "run", F.xxhash64("bucket", "t").alias("bucket"))
    return saved(done.distinct())


class Incidence:
    """Which members hold which values, but for values that only one of them holds; ``below`` keeps smaller values only."""

    def __init__(self, lists: list, below: int | None = None):
        self.m = len(lists)
        flat, who = np.concatenate(lists), np.repeat(np.arange(self.m), [len(x) for x in lists])
        if below is not None:
            flat, who = flat[flat < below], who[flat < below]
        _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[at] > 1
        column = (np.cumsum(count > 1) - 1)[at[keep]]
        order = np.argsort(column, kind="stable")
        self.column, self.who = column[order], who[keep][order]

    def common(self, lo: int, hi: int, columns: int = 1024) -> np.ndarray:
        """How many values each of the members lo to hi has in common with every member; a block of columns at a time."""
        out = np.zeros((hi - lo, self.m), dtype=np.float32)
        for first in range(0, int(self.column[-1]) + 1 if len(self.column) else 0, columns):
            x, y = np.searchsorted(self.column, [first, first + columns])
            has = np.zeros((columns, self.m), dtype=np.float32)
            has[self.column[x:y] - first, self.who[x:y]] = 1
            out += has[:, lo:hi].T @ has
        return out


#: Members whose pairs with all others of a group are held at once.
_TILE = 256


def _own_tiles(bucket: int, lists: list, size: np.ndarray, blk: np.ndarray, bi: int, bj: int, threshold: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, pairs): which pairs of the members lo to hi with later ones are to be compared here: of fitting sizes, in these blocks, and without a smaller bucket in common."""
    m = len(lists)
    smaller = Incidence(lists, bucket)
    for lo in range(0, m, _TILE):
        hi = min(lo + _TILE, m)
        own = np.arange(lo, hi)[:, None] < np.arange(m)[None, :]
        if bi != bj:
            own &= blk[lo:hi, None] != blk[None, :]
        own &= np.minimum(size[lo:hi, None], size[None, :]) >= threshold * np.maximum(size[lo:hi, None], size[None, :]) - 1e-9
        if own.any() and len(smaller.column):
            own &= smaller.common(lo, hi) == 0
        if own.any():
            yield lo, hi, own


def _own_pair(bucket: int, lists: list, size: np.ndarray, blk: np.ndarray, bi: int, bj: int, threshold: float) -> bool:
    """_own_tiles() of two members."""
    fits = (bi == bj or blk[0] != blk[1]) and min(size) >= threshold * max(size) - 1e-9
    return fits and not any(x < bucket for x in set(lists[0].tolist()) & set(lists[1].tolist()))


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= threshold * (len(x) + len(y) - shared) - 1e-9


def _linked(ids: np.ndarray, weight: np.ndarray, blobs: list[np.ndarray], tiles, threshold: float) -> pd.DataFrame:
    """The links among the pairs of ``tiles``, one row a linked member: id, root (the smallest id it hangs together with), n (rows it links to)."""
    m = len(ids)
    size = np.array([len(x) for x in blobs])
    order = np.argsort(ids, kind="stable")
    rank = np.empty(m, dtype=np.int64)
    rank[order] = np.arange(m)
    root, n, shared = np.arange(m), np.zeros(m), None
    for lo, hi, own in tiles:
        if own.sum() <= 2 * m:
            near = own
            for i, j in zip(*np.nonzero(own), strict=True):
                near[i, j] = _near(blobs[lo + i], blobs[j], threshold)
        else:
            shared = shared or Incidence(blobs)
            common = shared.common(lo, hi).astype(np.float64)
            near = own & (common >= threshold * (size[lo:hi, None] + size[None, :] - common) - 1e-9)
        a, b = np.nonzero(near)
        if len(a):
            n += np.bincount(a + lo, weights=weight[b], minlength=m) + np.bincount(b, weights=weight[a + lo], minlength=m)
            root = roots(m, np.concatenate([rank[a + lo], np.arange(m)]), np.concatenate([rank[b], root]))
    live = n > 0
    return pd.DataFrame({"id": ids[live], "root": ids[order][root[rank]][live], "n": n[live].astype(np.int64)})


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, depth: int = 3, limit: int = 48, block: int = 2048, seed: int = 23, batch_chars: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, kept, n_shingles.

    Words are maximal runs of digits, a-z and non-ASCII characters, A-Z lower-cased; a text of fewer than n words has one
    element, of all of them. Two rows are linked if the Jaccard similarity of their sets is at least ``threshold``. Null and
    empty texts, and others without a word, have an empty set and link with nothing. Rows with equal sets are one member of
    every bucket, whatever their number: copies add no pairs. n_links counts rows, copies included; class_id is the smallest
    id reachable by links. Rows that repeat an id link with each other; a null id has no class and is kept. An empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    source = doc_columns(docs, id_col, text_col)
    chooser = Chooser(n, threshold, runs_for(recall, depth), depth, seed)
    levels = [f"t{k + 1}" for k in range(depth)]

    def chosen(levels: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                texts = frame["text"].tolist()
                for lo, hi in runs_of(texts, batch_chars):
                    yield chooser.choose(texts[lo:hi], frame["doc_id"].iloc[lo:hi].to_numpy(), levels)

        return run

    schema = "doc_id long, size long, d1 long, d2 long"
    base = saved(source.mapInPandas(chosen(False), schema))
    classes = cut(base.where("size > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.count("*").alias("weight")))
    picks = source.mapInPandas(chosen(True), schema + ", t1 array<long>" + "".join(f", {t} array<int>" for t in levels[1:]))
    picked = picks.join(classes.withColumnRenamed("id", "doc_id"), ["doc_id", "d1", "d2"])
    sets = saved(picked.select("d1", "d2", F.col("doc_id").alias("id"), "weight", "size", *levels).dropDuplicates(["id"]))
    members = _paths(sets, depth, limit)
    lists = members.groupBy("id").agg(F.collect_list("bucket").alias("own"))  # a few a run
    keys = ["bucket", "bi", "bj"]
    placed = blocks_of(members, block).join(cut(lists), "id").join(sets.select("id", "size", F.transform("t1", lambda t: F.hash(t)).alias("sig")), "id")
    least = least_common(chooser.runs, (1 - recall) / 1000)

    def needed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped(frames, keys):
            edge, own, sig, blk, size = bounds(frame, keys), frame["own"].tolist(), frame["sig"].tolist(), frame["blk"].to_numpy(), frame["size"].to_numpy()
            head = frame[keys].to_numpy()
            use = np.zeros(len(frame), dtype=bool)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                here = (int(head[lo, 0]), own[lo:hi], size[lo:hi], blk[lo:hi], int(head[lo, 1]), int(head[lo, 2]), threshold)
                if hi - lo == 2:
                    use[lo:hi] = _own_pair(*here) and len(np.intersect1d(sig[lo], sig[lo + 1])) >= least
                elif hi - lo > 2:
                    chosen = Incidence(sig[lo:hi])
                    for x, y, pairs in _own_tiles(*here):
                        pairs &= chosen.common(x, y) >= least
                        use[lo + x : lo + y] |= pairs.any(axis=1)
                        use[lo:hi] |= pairs.any(axis=0)
            yield frame.loc[use, ["id", *keys, "blk", "own"]]

    kept = "id long, bucket long, bi int, bj int, blk int, own array<long>"
    width = parts(spark)
    ordered = placed.select("id", *keys, "blk", "own", "sig", "size").repartition(width, *keys).sortWithinPartitions(*keys)
    wanted = saved(ordered.mapInPandas(needed, kept))

    def elements(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for lo, hi in runs_of(texts, batch_chars):
                edge, h, _ = _sets(texts[lo:hi], n)
                yield pd.DataFrame({"id": frame["doc_id"].iloc[lo:hi].to_numpy(), "weight": frame["weight"].iloc[lo:hi].to_numpy(), "set": [h[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]})

    slim = base.select("doc_id", "d1", "d2").join(sets.select("d1", "d2", "id", "weight"), ["d1", "d2"]).where("doc_id = id")
    used = cut(slim.join(wanted.select("id").distinct(), "id").select("id", "weight").distinct())
    texts = source.join(used, source["doc_id"] == used["id"]).select("doc_id", "weight", "text")
    filled = wanted.join(texts.mapInPandas(elements, "id long, weight long, set binary"), "id")

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped(frames, keys):
            frame = frame.drop_duplicates([*keys, "id"])  # rows that repeat an id and a text
            edge, head = bounds(frame, keys), frame[keys].to_numpy()
            own, blobs, blk, ids, weight = frame["own"].tolist(), frame["set"].tolist(), *(frame[c].to_numpy() for c in ("blk", "id", "weight"))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                sets_here = [np.frombuffer(x, dtype=np.uint64) for x in blobs[lo:hi]]
                here = (int(head[lo, 0]), own[lo:hi], np.array([len(x) for x in sets_here]), blk[lo:hi], int(head[lo, 1]), int(head[lo, 2]), threshold)
                if hi - lo == 2:
                    if _own_pair(*here) and _near(*sets_here, threshold):
                        yield pd.DataFrame({"id": ids[lo:hi], "root": ids[lo:hi].min(), "n": weight[lo:hi][::-1]})
                elif hi - lo > 2:
                    yield _linked(ids[lo:hi], weight[lo:hi], sets_here, _own_tiles(*here), threshold)

    spread = filled.select("id", *keys, "blk", "own", "weight", "set").repartition(width, *keys).sortWithinPartitions(*keys)
    found = cut(spread.mapInPandas(compared, "id long, root long, n long").groupBy("id", "root").agg(F.sum("n").alias("n")))
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    classed = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_set = cut(sets.select("d1", "d2", "id", "weight").join(linked, "id", "left").join(classed, "id", "left").select("d1", "d2", "weight", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("component")))
    out = base.select("doc_id", "d1", "d2", "size").join(of_set, ["d1", "d2"], "left")
    real = (F.col("size") > 0) & F.col("doc_id").isNotNull()
    class_id = F.when(real, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(F.when(real, F.col("n") + F.col("weight") - 1), F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"), F.col("size").alias("n_shingles"))


def keep_one_of_class(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id; all columns stay. Rows that repeat a kept id stay."""
    id_col = options.get("id_col", "doc_id")
    dropped = ngram_join(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.withColumn("__id", F.col(id_col).cast("long")).join(cut(dropped), "__id", "left_anti").select(*columns_of(docs))
