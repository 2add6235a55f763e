"""What the operators share: table reads, lineage cuts, bounded block pairs, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chargelens.operators.staging import shared_folder, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there, so lost executors cost no rework."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table in the same folder: smaller than a checkpoint, and read by column. For wide or large results.

    The table stays until the folder is cleaned, as a failed task may read it at any time. The shuffles that made earlier tables are
    of no more use: collections on the driver, before and after, let Spark's cleaner remove their files, which is what bounds the disk of a chain of such steps.
    """
    collect = df.sparkSession.sparkContext._jvm.java.lang.System.gc
    collect()  # the one after the step before may have come while its plan was still on the event bus
    out = staged(df)
    collect()
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns_of(docs: DataFrame, *without: str) -> list[Column]:
    """The columns of ``docs``, whatever characters are in their names, but for those named like ``without``."""
    return [F.col(f"`{c}`") for c in docs.columns if c.lower() not in without]


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns named like ``names`` under other names, so that an operator can add those; and what selects the columns of ``docs`` again."""
    other = {c: f"__own_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: Bits of one row of a filter, as bitmap_construct_agg() makes them.
ROW_BITS = 32768


def filter_bits(rows: int, most_bits: int, least: int = ROW_BITS) -> int:
    """A power of two, at least 16 bits a row but at most ``most_bits``."""
    bits = least
    while 2 * bits <= most_bits and bits < 16 * rows:
        bits *= 2
    return bits


def bit_of(key: Column, bits: int) -> tuple[Column, Column]:
    """(slot, bit in its row) of a key in a one-hash filter."""
    at = F.pmod(F.xxhash64(key, F.lit(9)), F.lit(bits))
    return F.floor(at / ROW_BITS).alias("slot"), F.pmod(at, F.lit(ROW_BITS)).alias("bit")


def bit_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame, of: Column, most_bits: int = 1 << 27) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't among the values ``of`` of ``keys``; none of the others is lost.

    The filter has 16 bits a key but at most ``most_bits`` / 8 bytes, 16 MB, a proven bound for its broadcast; beyond that it only lets more through.
    """
    bits = filter_bits(keys.count(), most_bits)
    filters = keys.select(*bit_of(of, bits)).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("__bitmap")).withColumnRenamed("slot", "__slot")
    slot, bit = bit_of(key, bits)
    found = rows.withColumn("__slot", slot).withColumn("__bit", bit).join(F.broadcast(filters), "__slot")
    return found.where(bit_set(F.col("__bitmap"), F.col("__bit"))).drop("__slot", "__bit", "__bitmap")


def blocks_of(members: DataFrame, size: int) -> DataFrame:
    """Splits buckets into pairs of blocks of about ``size`` members, so no task ever holds a whole hot bucket.

    members: (bucket long, id long), distinct. Returns (bucket, bi, bj, blk, id): within a row group (bucket, bi, bj)
    every pair of members with blocks bi and bj is to be compared; each pair of a bucket is in exactly one such group.
    Buckets of one member are left out: they hold no pair.
    """
    counts = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    out = members.join(cut(counts), "bucket").withColumn("nb", F.ceil(F.col("n") / size).cast("int"))
    out = out.withColumn("blk", F.pmod(F.xxhash64("id", F.lit(7)), F.col("nb")).cast("int"))
    out = out.select("bucket", "id", "blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("k"))
    return out.select("bucket", F.least("blk", "k").alias("bi"), F.greatest("blk", "k").alias("bj"), "blk", "id")


def grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole key groups, from batches in which the rows of a key follow each other."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        if not len(change):
            held.append(frame)
            continue
        done = frame.iloc[: change[-1]]
        yield pd.concat([*held, done], ignore_index=True) if held else done.reset_index(drop=True)
        held = [frame.iloc[change[-1] :]]
    if held:
        yield pd.concat(held, ignore_index=True)


def bounds(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where each key group of a sorted frame begins, and the end."""
    k = frame[keys].to_numpy()
    return np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(frame)]])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of 0..n-1 over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

    edges: (a long, b long), nulls and loops ignored. Returns (id, component): the smallest id that each linked id
    reaches. Every round is an aggregate and a join on the node, cut into the shared folder; neither edges nor
    components reach the driver, which sees only one count a round. Minima are cut before they are joined, so both
    sides of the join are plain exchanges and a hot node's rows can be split.
    """
    spark = edges.sparkSession
    links = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def star(links: DataFrame, both: bool) -> DataFrame:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else links
        low = cut(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        joined = near.join(low, "u")
        if both:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        return out.where("u <> v").distinct()

    for _ in range(rounds):
        if links.isEmpty():
            break
        new = cut(star(cut(star(links, True)), False))
        gone = links.join(new, ["u", "v"], "left_anti").isEmpty() and new.join(links, ["u", "v"], "left_anti").isEmpty()
        links = new
        if gone:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows an Arrow batch, so that batches of long texts fit a Python worker beside its JVM."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def runs_of(texts, budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``budget`` characters together; a longer text is a range of its own."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t is not None else 0
        if size >= budget:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def doc_columns(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The id as long and the text with null as empty, under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def link_summary(ids: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Links a-b (indexes into ids) as one row per linked member: the rows it links to, and the smallest id it hangs together with."""
    n = np.bincount(a, weights=weight[b], minlength=len(ids)) + np.bincount(b, weights=weight[a], minlength=len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    root = ids[order][roots(len(ids), rank[a], rank[b])[rank]]
    live = n > 0
    return pd.DataFrame({"id": ids[live], "root": root[live], "n": n[live].astype(np.int64)})
