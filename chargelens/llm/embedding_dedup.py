"""Near-duplicate vectors by Euclidean p-stable hashing.

Each of L tables hashes a normalised vector by k random projections, shifted and cut into steps of a width; vectors with
one key in a table share a bucket. k, L and the width follow the rows: a bucket of unrelated vectors holds about
``occupancy``, and a pair at the threshold meets in some table with probability ``recall``. What goes to the buckets isn't the vector but a sketch of it, the
signs of further projections in ``BITS`` bits: pairs whose sketches differ too much for the threshold go no further. The
others are candidates. A bucket sends on a spanning forest of its candidates, never their pairs, so that connected
components of candidates are found. Within a component every two vectors are then compared by their cosine in double
precision, once, whatever number of tables they met in: each vector travels once a block of its component. Buckets and
components larger than ``block`` are compared in pairs of blocks; in a component larger than ``component_limit`` only those
that share a bucket are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargelens.llm.common import blocks_of, bounds, components, cut, grouped, link_summary, parts, roots, saved
from chargelens.llm.kernels import mix64

#: Bits of a sketch, two words.
BITS = 128
_WIDTHS = (1.0, 1.5, 2.0, 2.5, 3.0)


def same_step(distance: float, width: float) -> float:
    """Probability that two points at a distance fall into one step of a random projection (Datar et al., 2004)."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(rows: int, cosine: float, recall: float, occupancy: float) -> tuple[int, int, float]:
    """(k, L, width) for so many rows: the width that needs the fewest tables. Unrelated vectors are taken to be orthogonal."""
    best = None
    for width in _WIDTHS:
        near, far = same_step(math.sqrt(2 - 2 * cosine), width), same_step(math.sqrt(2), width)
        k = max(2, math.ceil(math.log(max(rows, 2) / occupancy) / -math.log(far)))
        tables = math.ceil(math.log(1 - recall) / math.log(1 - near**k))
        if best is None or tables < best[1]:
            best = k, tables, width
    return best


def most_different(cosine: float, risk: float) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most, in all but this share of cases."""
    p, total, n = math.acos(max(-1.0, min(1.0, cosine))) / math.pi, 0.0, 0
    while n < BITS and (total := total + math.comb(BITS, n) * p**n * (1 - p) ** (BITS - n)) < 1 - risk:
        n += 1
    return n


class Hasher:
    def __init__(self, dim: int, k: int, tables: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.k, self.tables, self.width = k, tables, width
        self.axes = rng.standard_normal((dim, k * tables))
        self.shift = rng.uniform(0, width, k * tables)
        self.odd = rng.integers(1, 1 << 62, k * tables, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.signs = rng.standard_normal((dim, BITS))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Rows by tables: 64-bit keys, distinct between tables and lengths of vectors."""
        steps = np.floor((x @ self.axes + self.shift) / self.width).astype(np.int64).astype(np.uint64) * self.odd
        mixed = mix64(steps).reshape(len(x), self.tables, self.k).sum(axis=2, dtype=np.uint64)
        return mix64(mixed + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)

    def sketches(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.signs > 0, axis=1).view(np.int64)


def _unit(values) -> np.ndarray:
    """Rows of length 1. They are scaled by their largest component first, so that no square leaves the range of doubles."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in values])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(ids: np.ndarray, sketch: np.ndarray, most: int, blk: np.ndarray | None = None) -> pd.DataFrame | None:
    """A spanning forest of the members whose sketches differ in at most ``most`` bits: each one and the smallest id of its tree."""
    n, edges, sketch = len(ids), [], sketch.view(np.uint64)  # bits of a signed word would be those of its absolute value
    for lo in range(0, n, 512):
        differ = np.bitwise_count(sketch[lo : lo + 512, None, :] ^ sketch[None, lo:, :]).sum(axis=2, dtype=np.int32)
        near = differ <= most
        if blk is not None:
            near &= blk[lo : lo + 512, None] != blk[None, lo:]
        a, b = np.nonzero(near)
        keep = a < b
        edges.append((a[keep] + lo, b[keep] + lo))
    a, b = (np.concatenate([e[i] for e in edges]) for i in (0, 1))
    if not len(a):
        return None
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    root = roots(n, rank[a], rank[b])
    live = np.flatnonzero(root != np.arange(n))
    return pd.DataFrame({"a": ids[order][live], "b": ids[order][root[live]], "s0": 0, "s1": 0, "large": False})


_FOUND = "a long, b long, s0 long, s1 long, large boolean"


def _candidates(hashed: DataFrame, most: int, block: int, width: int) -> DataFrame:
    """(a, b): edges of spanning forests of the candidates in each bucket. hashed: bucket, id, s0, s1."""

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n, bucket, passing = 0, None, False

        def whole() -> Iterator[pd.DataFrame]:
            part = pd.concat(held)
            if len(part) > 1 and (out := _forest(part["id"].to_numpy(), np.ascontiguousarray(part[["s0", "s1"]].to_numpy()), most)) is not None:
                yield out

        for frame in frames:
            edge = bounds(frame, ["bucket"]) if len(frame) else [0]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                part = frame.iloc[lo:hi]
                if part["bucket"].iloc[0] != bucket:
                    if held and not passing:
                        yield from whole()
                    held, n, bucket, passing = [], 0, part["bucket"].iloc[0], False
                held.append(part)
                n += len(part)
                if n > block or passing:  # too large for one task's memory: its rows go on to be compared in pairs of blocks
                    passing = True
                    yield pd.concat(held).rename(columns={"bucket": "a", "id": "b"}).assign(large=True)[["a", "b", "s0", "s1", "large"]]
                    held = []
        if held and not passing:
            yield from whole()

    found = saved(hashed.repartition(width, "bucket").sortWithinPartitions("bucket").mapInPandas(within, _FOUND))
    edges = found.where("not large").select("a", "b")
    large = found.where("large").select(F.col("a").alias("bucket"), F.col("b").alias("id"), "s0", "s1")
    if large.isEmpty():
        return edges
    keys = ["bucket", "bi", "bj"]

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped(frames, keys):
            edge, head = bounds(frame, keys), frame[keys].to_numpy()
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = frame.iloc[lo:hi]
                out = _forest(part["id"].to_numpy(), np.ascontiguousarray(part[["s0", "s1"]].to_numpy()), most, None if head[lo, 1] == head[lo, 2] else part["blk"].to_numpy())
                if out is not None:
                    yield out

    placed = blocks_of(large.select("bucket", "id"), block).join(large, ["bucket", "id"])
    dealt = placed.select("id", *keys, "blk", "s0", "s1").repartition(width, *keys).sortWithinPartitions(*keys)
    return edges.unionByName(dealt.mapInPandas(pairs, _FOUND).select("a", "b"))


def _exact(members: DataFrame, classes: DataFrame, cosine: float, block: int, width: int, hashers=None) -> DataFrame:
    """(id, root, n) of the pairs within each bucket that reach ``cosine``. members: bucket, id. With ``hashers`` a
    bucket is a table's, and a pair counts only in the first table that both share."""
    keys = ["bucket", "bi", "bj"]
    placed = blocks_of(members, block).join(classes.select("id", "weight", "v"), "id")

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped(frames, keys):
            edges = bounds(frame, keys)
            ids, weight, blk, bi, bj = (frame[c].to_numpy() for c in ("id", "weight", "blk", "bi", "bj"))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo > 1:
                    out = _compare(hashers and hashers.value, ids[lo:hi], weight[lo:hi], frame["v"].iloc[lo:hi], blk[lo:hi], int(bi[lo]), int(bj[lo]), int(frame["bucket"].iloc[lo]), cosine)
                    if out is not None:
                        yield out

    return placed.repartition(width, *keys).sortWithinPartitions(*keys).mapInPandas(compared, "id long, root long, n long")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, recall: float = 0.995, occupancy: float = 512.0, block: int = 2048, component_limit: int = 1 << 20, seed: int = 17) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links: pairs with a cosine of at least ``cosine``, none below; of pairs exactly at it, ``recall`` are expected to be
    found, of nearer ones more. A vector that is null, empty or zero, or holds a null or a non-finite number, links with nothing. Equal
    vectors are one class and are compared once: a class of any size adds a row, not its pairs. Vectors of different
    lengths are never linked. n_links counts rows, copies included; rows that repeat an id link with each other if equal.
    A null id has no component. An empty table stays empty. Other columns are ignored.
    """
    spark = vectors.sparkSession
    values = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    good = F.coalesce((F.size(values) > 0) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, F.col(vec_col)).alias("v"))
    keyed = saved(rows.select("vec_id", "v", F.sha2(F.array_join(F.transform("v", lambda v: v.cast("double").cast("string")), ","), 256).alias("digest")))
    chosen = keyed.where("v is not null and vec_id is not null").groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    classes = saved(chosen.join(keyed.select("digest", F.col("vec_id").alias("id"), "v"), ["digest", "id"]).dropDuplicates(["digest"]))
    dims = [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().limit(65).collect()]
    if len(dims) > 64:
        raise ValueError("vectors of more than 64 different lengths")
    n = classes.count()
    k, tables, width = tables_for(n, cosine, recall, occupancy)
    hashers = spark.sparkContext.broadcast({d: Hasher(d, k, tables, width, seed + d) for d in dims})
    found = saved(_links(spark, classes, hashers, n * tables, cosine, block, component_limit).groupBy("id", "root").agg(F.sum("n").alias("n")))
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    classed = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("digest", "id", "weight").join(linked, "id", "left").join(classed, "id", "left").select("digest", F.col("weight"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("component"))
    out = keyed.select("vec_id", "digest").join(cut(of_class), "digest", "left")
    links = F.coalesce(F.col("n") + F.when(F.col("vec_id").isNotNull(), F.col("weight") - 1), F.lit(0)).cast("long")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(spark: SparkSession, classes: DataFrame, hashers, hashes: int, cosine: float, block: int, component_limit: int) -> DataFrame:
    """(id, root, n): the links of each vector, and the smallest id that it hangs together with, in parts to be added up."""
    dealt = max(parts(spark), hashes // 200_000)
    most = most_different(cosine, 0.0005)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, part in frame.groupby(frame["v"].map(len)):
                hasher = hashers.value[d]
                for lo in range(0, len(part), 2000):
                    x, ids = _unit(part["v"].iloc[lo : lo + 2000]), part["id"].to_numpy()[lo : lo + 2000]
                    keys, sketch = hasher.keys(x), hasher.sketches(x)
                    yield pd.DataFrame({"bucket": keys.ravel(), "id": np.repeat(ids, keys.shape[1]), "s0": np.repeat(sketch[:, 0], keys.shape[1]), "s1": np.repeat(sketch[:, 1], keys.shape[1])})

    places = classes.select("id", "v").mapInPandas(hashed, "bucket long, id long, s0 long, s1 long")
    edges = saved(_candidates(places, most, block, dealt).distinct())
    members = saved(components(edges).select(F.col("component").alias("bucket"), "id"))
    giant = cut(members.groupBy("bucket").count().where(F.col("count") > component_limit).select("bucket"))
    if giant.isEmpty():
        return _exact(members, classes, cosine, block, dealt)
    small = members.join(giant, "bucket", "left_anti")
    of_giant = classes.join(members.join(giant, "bucket").select("id"), "id")
    buckets = saved(of_giant.select("id", "v").mapInPandas(hashed, "bucket long, id long, s0 long, s1 long").select("bucket", "id"))
    return _exact(small, classes, cosine, block, dealt).unionByName(_exact(buckets, classes, cosine, block, dealt, hashers))


def _compare(hashers: dict | None, ids, weight, vectors, blk, bi: int, bj: int, bucket: int, cosine: float) -> pd.DataFrame | None:
    """The links of a block pair (with hashers: those that no earlier table has): per member its linked rows and the smallest id it hangs together with."""
    if len(set(map(len, vectors))) > 1:  # a bucket of candidates has one length: keys of different lengths differ
        raise ValueError("vectors of different lengths in one bucket")
    x = _unit(vectors)
    near = np.triu(x @ x.T >= cosine - 1e-9, 1)
    if bi != bj:
        near &= blk[:, None] != blk[None, :]
    a, b = np.nonzero(near)
    if not len(a):
        return None
    exact = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
    a, b = a[exact], b[exact]
    if hashers is not None and len(a):
        used = np.unique(np.concatenate([a, b]))
        keys = hashers[x.shape[1]].keys(x[used])
        at = np.searchsorted(used, np.stack([a, b]))
        first = np.concatenate([np.zeros(0, dtype=np.int64), *(np.argmax(keys[at[0][s : s + 65536]] == keys[at[1][s : s + 65536]], axis=1) for s in range(0, len(a), 65536))]).astype(np.int64)
        own = keys[at[0], first] == bucket
        a, b = a[own], b[own]
    if not len(a):
        return None
    return link_summary(ids, weight, a, b)
