"""Exact deduplication by a log-structured merge index of digests. DataFrame operations only.

Memtables (a hash share of the rows each) flush runs, sorted by digest, of (digest, kept id, count), and with each run a
filter: a bit for every digest it holds. Compaction merges the runs of a level, ``fan_in`` at a time, until one is left. A
digest of a run is merged only if the filter of another run that it meets says that it may be there too; all others move on as they are, and
no row of theirs is shuffled. Of equal digests one identifier is kept. What occurs more than once at the end is a hit: its texts are
compared, byte by byte, with the text they would be dropped for. Digests that prove to stand for several texts are regrouped by the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargelens.llm.common import ROW_BITS, bit_of, bit_set, columns_of, cut, filter_bits, maybe_in, saved


def _digest(text: Column, bits: int) -> Column:
    """The first bits of the text's SHA-256, as bytes."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, bits // 8)


def flush(rows: DataFrame, memtables: int, best) -> DataFrame:
    """Level 0: each memtable's run of (run, digest, keep_id, n), one row a digest, sorted."""
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(memtables))
    runs = rows.groupBy(share.alias("run"), "digest").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return runs.sortWithinPartitions("run", "digest")


def filters_of(runs: DataFrame, bits: int) -> DataFrame:
    """The filter of every run, as rows (run, slot, bitmap) of 4 KB: ``bits`` / 8 bytes a run at most."""
    return runs.select("run", *bit_of(F.col("digest"), bits)).groupBy("run", "slot").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def elsewhere(runs: DataFrame, filters: DataFrame, bits: int, fan_in: int) -> DataFrame:
    """``runs`` with ``merge``: whether the filter of another run of the ``fan_in`` that are merged together has the digest.

    All filters have ``filter_bytes`` together, see exact_dedup(): a proven bound for their broadcast."""
    group = F.floor(F.col("run") / fan_in)
    beside = filters.groupBy(group.alias("into"), "slot").agg(F.collect_list(F.struct("run", "bitmap")).alias("beside"))  # fan_in at most
    slot, bit = bit_of(F.col("digest"), bits)
    found = runs.withColumn("into", group).withColumn("slot", slot).withColumn("bit", bit).join(F.broadcast(beside), ["into", "slot"], "left")
    hit = F.exists("beside", lambda f: (f["run"] != F.col("run")) & bit_set(f["bitmap"], F.col("bit")))
    return found.withColumn("merge", F.coalesce(hit, F.lit(False))).drop("slot", "bit", "beside")


def compact(runs: DataFrame, memtables: int, fan_in: int, filter_bytes: int, best) -> DataFrame:
    """The last run: (digest, keep_id, n). Each level is a table: its runs, and the filters that the next level probes."""
    left = memtables
    while left > 1:
        runs = saved(runs)
        bits = filter_bits(runs.count() // left, max(filter_bytes * 8 // left, ROW_BITS))
        probed = elsewhere(runs, cut(filters_of(runs, bits)), bits, fan_in)
        merged = probed.where("merge").groupBy(F.col("into").alias("run"), "digest").agg(best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        runs = merged.unionByName(probed.where("not merge").select(F.col("into").alias("run"), "digest", "keep_id", "n")).sortWithinPartitions("run", "digest")
        left = -(-left // fan_in)
    return runs.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", memtables: int = 16, fan_in: int = 4, filter_bytes: int = 1 << 24, digest_bits: int = 256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty, and all empty texts are one group. The row with the
    largest (or smallest, ``keep``) id stays. Rows that repeat an id and a text are both kept if that id stays; a null
    id is never preferred to another, and a group of null ids keeps them all. An empty table gives no rows. Other columns are ignored.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = saved(source.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha")))
    rows = hashed.withColumn("digest", F.substring("sha", 1, digest_bits // 8))
    hits = saved(compact(flush(rows, memtables, best), memtables, fan_in, filter_bytes, best).where("n > 1"))
    looked_up = maybe_in(source.withColumn("digest", _digest(F.col("text"), digest_bits)), F.col("digest"), hits, F.col("digest"), filter_bytes * 8)
    keepers = looked_up.join(hits.select("digest", F.col("keep_id").alias("doc_id")), ["digest", "doc_id"]).groupBy("digest").agg(F.min("text").alias("kept_text"))
    compared = looked_up.join(cut(keepers), "digest").where(F.col("text") != F.col("kept_text"))
    several = cut(cut(compared.select("digest")).distinct())  # cut first: with no aggregate above it, the join's hot digests can be split
    out = rows.join(hits, "digest", "left")
    plain = out.select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"), "digest")
    if several.isEmpty():
        result = plain
    else:  # one digest for several texts: the texts themselves are the key
        texts = source.withColumn("digest", _digest(F.col("text"), digest_bits)).join(several, "digest")
        groups = cut(texts.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
        regrouped = texts.join(groups, ["digest", "text"]).select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), "group_size", F.sha2("text", 256).alias("text_sha256"), "digest")
        result = plain.join(several, "digest", "left_anti").unionByName(regrouped)
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_exact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that exact_dedup() drops; all columns stay. Of rows with one text, all that repeat the kept id stay."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    dropped = exact_dedup(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    keyed = docs.withColumn("__sha", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).withColumn("__id", F.col(id_col).cast("long"))
    return keyed.join(cut(dropped), (keyed["__id"].eqNullSafe(dropped["__id"])) & (keyed["__sha"] == dropped["__sha"]), "left_anti").select(*columns_of(docs))
