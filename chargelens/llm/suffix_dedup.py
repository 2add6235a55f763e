"""Removal of long byte strings that an earlier document holds, by distributed prefix doubling.

The rank of a longer string at a place comes from the pair of ranks of two shorter ones, there and an offset on. Executors
double ranks of single bytes to ``anchor`` bytes, with hashes for ranks, and keep of every window of ``threshold`` bytes its
leftmost place of smallest rank: windows with equal bytes keep the same place, and only about 2 / (threshold - anchor + 2)
of all places are kept (a rank pair for each place would be many times the input). From there on Spark sorts and reranks:

* First it sorts (rank of the anchor, rank of all bytes of the anchor's windows). Anchors that only one document holds are
  unique and go. Places that agree in both are settled: of equal strings the smallest id's stays. One document of each
  string goes on where an anchor has several.
* Then the offset grows. An anchor's windows reach up to threshold - anchor bytes before it; they are parted into ever smaller
  ranges of that reach, and the windows of a range of r have threshold - r + 1 bytes in common. At each round Spark sorts by those common
  bytes, themselves and not a hash; what is unique goes, what agrees in all its bytes is settled, the rest goes on. A range
  of one window has all ``threshold`` bytes in common, so the last round leaves nothing open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargelens.llm.common import cut, doc_columns, parts, runs_of, saved, small_batches
from chargelens.llm.kernels import flatten, mix64, sliding, span_hash

_LAST = (1 << 63) - 1
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
#: Stands for the rank of all bytes at a place that is settled already.
_SETTLED = -1


def anchors(raw: np.ndarray, off: np.ndarray, threshold: int, anchor: int) -> dict[str, np.ndarray]:
    """The anchored places of the texts in ``raw``: doc, at (place in ``raw``), near and far (its windows begin that many bytes before it), rank of the anchor, and rank of all bytes of its windows (whole)."""
    n = len(raw)
    empty = dict.fromkeys(("doc", "at", "near", "far", "rank", "whole"), np.zeros(0, dtype=np.int64))
    if n < threshold:
        return empty
    rank, have = mix64(raw.astype(np.uint64) + np.uint64(1)), 1
    while have < anchor:
        step = min(have, anchor - have)
        rank = mix64(rank[: len(rank) - step] * np.uint64(0x9E3779B97F4A7C15) ^ (rank[step:] + np.uint64(have)))
        have += step
    least = sliding((rank & _HIGH) | np.arange(len(rank), dtype=np.uint64), threshold - anchor + 1, np.minimum) & _LOW
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    begin = np.flatnonzero(doc[: n - threshold + 1] == doc[threshold - 1 :])
    if not len(begin):
        return empty
    at = least[begin].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # a place in one text is no window's place in another
    last = np.append(first[1:], len(begin)) - 1
    at, far, near = at[first], at[first] - begin[first], at[first] - begin[last]
    return {"doc": doc[at], "at": at, "near": near, "far": far, "rank": rank[at], "whole": span_hash(raw, at - far, at - near + threshold) ^ mix64(far.astype(np.uint64))}


def _first_pass(threshold: int, anchor: int, keyed: bool, chunk: int, batch: int):
    """Rows (rank, whole, did, key if ``keyed``, place), few bytes each: ``place`` is at, near and far in as few bits as they need. Of a string that a chunk's documents share only the smallest id's is to be sorted; the others are
    settled there, and get a rank that spreads them. So a string costs the sort a row a chunk, however often it occurs."""

    bits = (threshold - anchor).bit_length()

    def emit(found: list[dict]) -> pd.DataFrame:
        rows = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
        order = np.lexsort((rows["did"], rows["whole"], rows["rank"]))
        rank, whole, did = (rows[c][order] for c in ("rank", "whole", "did"))
        new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (whole[1:] != whole[:-1])])[: len(rank)]
        settled = np.zeros(len(rank), dtype=bool)
        settled[order] = did > did[np.flatnonzero(new)][np.cumsum(new) - 1]
        spread = mix64(rows["did"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rows["place"].astype(np.uint64))
        rows["rank"] = np.where(settled, spread, rows["rank"]).view(np.int64)
        whole = rows["whole"].view(np.int64)
        rows["whole"] = np.where(settled, _SETTLED, np.where(whole == _SETTLED, 0, whole))
        return pd.DataFrame(rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        for frame in frames:
            texts, ids = frame["text"].tolist(), frame["did"].to_numpy()
            for lo, hi in runs_of(texts, batch):
                raw, off = flatten(texts[lo:hi])
                a = anchors(raw, off, threshold, anchor)
                keys = np.array([hashlib.sha256(raw[s:e]).digest() if keyed else b"" for s, e in zip(off[:-1], off[1:], strict=True)], dtype=object)
                doc = a["doc"]
                place = ((a["at"] - off[doc]) << bits | a["near"]) << bits | a["far"]
                found.append({"rank": a["rank"].astype(np.uint64), "whole": a["whole"].astype(np.uint64), "did": ids[lo:hi][doc], "place": place} | ({"key": keys[doc]} if keyed else {}))
                held += len(raw)
                if held >= chunk:
                    yield emit(found)
                    found, held = [], 0
        if found:
            yield emit(found)

    return run


def _rerank(spread: DataFrame, key: list[str], whole: list[str], settled: Column, often: Column | None = None) -> DataFrame:
    """One round: the places without the unique ones, with ``covered``: a smaller id has the same string. What isn't covered is still open. Places that
    are ``often``, whose key is dealt in parts, aren't looked at for uniqueness.

    ``spread`` is dealt by the key. Spark sorts it by (key, whole); both windows read that one order, and spill what one key's rows need."""
    same, near = Window.partitionBy(*key, *whole), Window.partitionBy(*key)
    ranked = spread.withColumn("first", F.min("did").over(same)).withColumn("n_same", F.count("*").over(same))
    ranked = ranked.withColumn("low", F.min("did").over(near)).withColumn("high", F.max("did").over(near)).withColumn("n_key", F.count("*").over(near))
    covered = settled | (F.col("did") > F.col("first"))
    go_on = (F.col("low") < F.col("high")) & (F.col("n_same") < F.col("n_key"))
    if often is not None:
        go_on |= often
    return ranked.where(covered | go_on).withColumn("covered", covered).drop("first", "n_same", "low", "high", "n_key")


def _strings(places: DataFrame, threshold: int) -> tuple[Column, Column]:
    """The bytes that the windows of a range have in common, and all bytes of those windows that the place has."""
    return F.expr(f"substring(bytes, before - lo + 1, {threshold} + lo - hi)"), F.expr(f"substring(bytes, before - far + 1, {threshold} + far - near)")


def _round(places: DataFrame, threshold: int, last: bool, width: int) -> DataFrame:
    """_rerank() by (lo, common), but for strings so frequent that one would fill a task: those aren't ranked, as they are neither unique nor
    settled as a whole. Their places go on to the next round, where longer strings tell them apart; in the last one, the smallest id of each is an aggregate.

    A sample finds them. It decides on the way only, not on the result. There are at most 2 x ``width`` of them. What is dealt is a
    place and its bytes; the strings to sort by are cut out of these where it arrives."""
    key = ["lo", "common"]
    common, whole = _strings(places, threshold)
    cut_out = lambda df: df.withColumn("common", common)
    rank = lambda df: _rerank(cut_out(df.repartition(width, "lo", common)).withColumn("whole", whole), key, ["near", "far", "whole"], F.lit(False)).drop("common", "whole")
    sample = cut(cut_out(places.where(F.pmod(F.xxhash64("did", "at", "near"), F.lit(64)) == 0)).groupBy(*key).agg(F.count("*").alias("n")))
    seen = sample.agg(F.sum("n")).first()[0] or 0
    often = cut(sample.where(F.col("n") > max(32, seen / (2 * width))).select(*key))
    if often.isEmpty():
        return rank(places)
    rare = rank(cut_out(places).join(F.broadcast(often), key, "left_anti").drop("common"))
    hot = cut_out(places).join(F.broadcast(often), key)
    if last:
        least = cut(hot.groupBy(*key).agg(F.min("did").alias("first")))
        hot = hot.join(F.broadcast(least), key).withColumn("covered", F.col("did") > F.col("first"))
    else:
        hot = hot.withColumn("covered", F.lit(False))
    return rare.unionByName(hot.select(*rare.columns))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 50, anchor: int = 16, chunk: int = 8_000_000, batch_chars: int = 250_000, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes left (``kept_bytes``) if wanted.

    Every byte in a string of ``threshold`` UTF-8 bytes that also begins in a row with a smaller id is removed; strings are
    judged on the input, overlaps count, none crosses rows. Null and empty texts have 0 bytes; texts shorter than the
    threshold stay whole. Rows that repeat an id don't remove from each other; a null id counts as larger than any. Strings
    are compared byte by byte, but for those settled in the first round, which agree in two 64-bit hashes. An empty table
    stays empty. A text has fewer than 2^31 bytes.
    """
    if not 1 < anchor < threshold or threshold - anchor >= 1 << 15:
        raise ValueError("anchor must be between 1 and the threshold, and less than 32,768 below it")
    spark = docs.sparkSession
    small_batches(spark, 1000)
    source = doc_columns(docs, id_col, text_col)
    source = source.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("did"), "text")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = not source.groupBy("did").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    width = max(parts(spark), total // 24_000_000)

    first = lambda docs: docs.select("did", "text").mapInPandas(_first_pass(threshold, anchor, keyed, chunk, batch_chars), "rank long, whole long, did long, place long" + ", key binary" * keyed)
    # Anchors that very many documents hold, found in one document of 64 (that decides on the way only): they are dealt by all bytes of their windows too.
    few = cut(first(source.where(F.pmod(F.xxhash64("did", F.octet_length("text")), F.lit(64)) == 0)).where(F.col("whole") != _SETTLED).groupBy("rank").agg(F.count("*").alias("n")))
    seen = few.agg(F.sum("n")).first()[0] or 0
    often = cut(few.where(F.col("n") > max(32, seen / (2 * width))).select("rank", F.lit(True).alias("often")))  # fewer than 2 x width rows
    places = first(source)
    keys, hot = ["rank"], None
    if not often.isEmpty():
        keys, hot = ["rank", "part"], F.col("often")
        places = places.join(F.broadcast(often), "rank", "left").withColumn("often", F.coalesce("often", F.lit(False)))
        places = places.withColumn("part", F.when(F.col("often"), F.col("whole")).otherwise(F.lit(0)))
    bits = (threshold - anchor).bit_length()
    low = (1 << bits) - 1
    of_place = [F.shiftright("place", 2 * bits).alias("at"), F.shiftright("place", bits).bitwiseAND(low).cast("int").alias("near"), F.col("place").bitwiseAND(low).cast("int").alias("far")]
    ranked = saved(_rerank(places.repartition(width, *keys), keys, ["whole"], F.col("whole") == _SETTLED, hot).select("did", F.col("key") if keyed else F.lit(b"").alias("key"), *of_place, "covered"))
    spans = [ranked.where("covered").select("did", "key", "at", "near", "far")]

    def zipped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            blobs = [t.encode("utf-8", "surrogatepass") for t in frame["text"]]
            frame["key"] = [hashlib.sha256(b).digest() if keyed else b"" for b in blobs]
            frame["z"] = [pack.compress(b) for b in blobs]
            yield frame[["doc_id", "did", "key", "z"]]

    packed = source.mapInPandas(zipped, "doc_id long, did long, key binary, z binary")

    def with_bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each open place with the bytes of its windows."""
        unzip = zstandard.ZstdDecompressor()
        for frame in frames:
            rows, held = [], 0
            for did, key, z, places in zip(frame["did"], frame["key"], frame["z"], frame["places"], strict=True):
                raw = unzip.decompress(z)
                for at, near, far in np.asarray(places, dtype=np.int64).reshape(-1, 3).tolist():
                    rows.append((did, key, at, near, far, far, raw[at - far : at - near + threshold]))
                held += len(places)
                if held >= 60_000:
                    yield pd.DataFrame(rows, columns=["did", "key", "at", "near", "far", "before", "bytes"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["did", "key", "at", "near", "far", "before", "bytes"])

    of_doc = lambda rows: rows.groupBy("did", "key").agg(F.flatten(F.collect_list(F.array("at", F.col("near").cast("long"), F.col("far").cast("long")))).alias("places"))
    still = ranked.where("not covered")
    opened = None if still.isEmpty() else saved(packed.join(of_doc(still), ["did", "key"]).select("did", "key", "z", "places").mapInPandas(with_bytes, "did long, key binary, at long, near int, far int, before int, bytes binary"))
    size = 1 << max((threshold - anchor).bit_length() - 1, 0)
    while opened is not None and size:
        each = F.explode(F.sequence(F.floor(F.col("near") / size).cast("int"), F.floor(F.col("far") / size).cast("int")))
        parted = opened.select("did", "key", "at", "near", "far", "before", "bytes", each.alias("lo")).withColumn("lo", F.col("lo") * size)
        parted = parted.withColumn("hi", F.least(F.col("lo") + size - 1, F.lit(threshold - anchor)))
        parted = parted.withColumn("near", F.greatest("near", "lo")).withColumn("far", F.least("far", "hi"))
        ranked_places = _round(parted, threshold, size == 1, width).select("did", "key", "at", "near", "far", "covered", *[F.when(~F.col("covered"), F.col(c)).alias(c) for c in ("before", "bytes")])
        done = saved(ranked_places)
        spans.append(done.where("covered").select("did", "key", "at", "near", "far"))
        opened = done.where("not covered")
        size //= 2
        if opened.isEmpty():
            break

    covered = spans[0]
    for more in spans[1:]:
        covered = covered.unionByName(more)

    def removed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for frame in frames:
            out = []
            for doc_id, z, places in zip(frame["doc_id"], frame["z"], frame["places"], strict=True):
                raw = np.frombuffer(unzip.decompress(z), dtype=np.uint8)
                gone = np.zeros(len(raw) + 1, dtype=np.int64)
                if places is not None and len(places):
                    at, near, far = np.asarray(places, dtype=np.int64).reshape(-1, 3).T
                    np.add.at(gone, at - far, 1)
                    np.add.at(gone, at - near + threshold, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = raw[~gone].tobytes()
                out.append((doc_id, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(kept).hexdigest(), kept))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])
            yield frame if with_text else frame.drop(columns="kept_bytes")

    joined = packed.join(of_doc(covered), ["did", "key"], "left").select("doc_id", "z", "places")
    return joined.mapInPandas(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text)
